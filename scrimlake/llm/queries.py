"""The thin queries over the given tables, one per operator, and SQL for those that SQL can express."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from scrimlake.llm import decontamination, html_extraction, license_scan, line_dedup, ngram_join, oracles, packing, prefix_trie, quality_rules, ranked_search, simhash_dedup, substring_dedup, token_counts, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word and line counts of every document and whether the line rules keep it."""
    return quality_rules.judge(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("cleaned_text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those removed as repeats of 50-word windows, and the digest of the rest."""
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return found.withColumnRenamed("id", "doc_id").drop("kept_text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license of every document, its own or that of the nearest folder above."""
    files = license_scan.document_files(_table(spark, sf_dir, "documents"))
    return license_scan.scan(files).withColumn("doc_id", F.regexp_extract("path", r"-(-?\d+)$", 1).cast("long"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words and unigram tokens of every document."""
    found = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by its host's winning path."""
    return html_extraction.main_text(_table(spark, sf_dir, "pages"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written into ZIP packages of WARC records and read back from them."""
    return warc_zip.round_trip(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item of which it has a like window."""
    found = decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, the numbers of those that an earlier like line makes superfluous, and what is left."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("left_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document's token ids and its place in a sequence of at most 1024."""
    found = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the highest score for every benchmark item."""
    found = ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the component of those that are alike."""
    return ngram_join.similar_sets(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations' common starts, with the totals of its subtree."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_token_counts": op4_token_counts,
    "op5_html_extraction": op5_html_extraction,
    "op6_warc_zip": op6_warc_zip,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_ngram_join": op12_ngram_join,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.QUALITY,
    "op2_substring_dedup": oracles.REPEATS,
    "op5_html_extraction": oracles.ARTICLES,
    "op6_warc_zip": oracles.RECORDS,
    "op11_ranked_search": oracles.RANKED,
    "op12_ngram_join": oracles.SIMILAR,
    "op13_prefix_trie": oracles.TRIE,
}

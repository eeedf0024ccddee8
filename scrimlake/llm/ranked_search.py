"""Ranked lexical search by hashed max-sketches.

A document's score for an item is a sum over the item's terms of the term's weight, by its rarity, times the document's
impact for it, by its count there and the document's length. The index has a sketch of each document: every term falls on one of 2^bits
coordinates by its hash, and a coordinate keeps the highest count of its terms. As an impact grows with the count, the
impact of a coordinate is no less than that of any term on it, so the weighted impacts at the coordinates of an item's terms
add up to an upper bound of its score. Items are looked up in blocks: a chunk of sketches times the weights of the
block's items is one matrix product.

Texts are then scored exactly, by descending bound: those of each item's highest bounds first, whose k-th score is a threshold,
and then all others with a bound that reaches it. No other text can be among the k best, whatever its count of candidates.
"""

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch, no_clash
from scrimlake.llm.substring_dedup import WordHashes

#: A coordinate is a number of two bytes, so bits go up to 16.
BITS = 14
#: Counts are kept up to this one, which stands for any higher one too.
_MOST = 255
_CHUNK = 512
#: Terms are runs of letters and digits of ASCII and of all other characters; in UTF-8 those are bytes from 128 on.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with only A-Z lower-cased."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def slope(n: int, n_docs: int, n_terms: int) -> int:
    """How much a document of n terms dampens its counts: 100 at the mean length."""
    return 10 + 90 * n * n_docs // n_terms


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _sketched(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            lengths, at, peak = [], [], []
            for text in _texts(batch):
                counts = Counter(terms(text))
                places = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts)) >> np.uint64(64 - bits)
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                both = np.sort(places.astype(np.int64) * (_MOST + 1) + np.minimum(tf, _MOST))
                both = both[np.diff(both // (_MOST + 1), append=-1) != 0]
                lengths.append(int(tf.sum()))
                at.append((both // (_MOST + 1)).astype("<u2").tobytes())
                peak.append((both % (_MOST + 1)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("tk"), pa.array(lengths, pa.int64()), pa.array(at, pa.binary()), pa.array(peak, pa.binary())], names=["tk", "n", "at", "peak"])

    return run


def _frequencies(vocabulary: frozenset[bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in _texts(batch):
                seen.update(vocabulary.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "df"])

    return run


class Block:
    """The items of one block with their terms' weights; its size is that of the items."""

    def __init__(self, items: list[list[bytes]], df: dict[bytes, int], n_docs: int, n_terms: int, bits: int = BITS):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.items = [{t: weight(n_docs, df[t]) for t in item if t in df} for item in items]
        hashes = WordHashes()
        places = [[hashes[t] >> (64 - bits) for t in item] for item in self.items]
        used = sorted({p for ps in places for p in ps})
        self.column = np.full(1 << bits, -1, np.int32)
        self.column[used] = np.arange(len(used))
        self.weights = np.zeros((len(used), len(items)), np.float32)
        for k, (ps, item) in enumerate(zip(places, self.items)):
            for p, w in zip(ps, item.values()):
                self.weights[self.column[p], k] += w
        self.slack = 1 + 1e-6 * (16 + np.array([len(i) for i in self.items], np.float32))  # more than single precision loses

    def bounds(self, lengths: list[int], at: list[bytes], peak: list[bytes]) -> np.ndarray:
        """Upper bounds of the scores, a row for each sketch, a column for each item."""
        rows = np.repeat(np.arange(len(at)), [len(x) // 2 for x in at])
        m = np.array([slope(n, self.n_docs, self.n_terms) for n in lengths], np.float64)
        columns = self.column[np.frombuffer(b"".join(at), "<u2")]
        tf = np.frombuffer(b"".join(peak), np.uint8).astype(np.float64)
        held = columns >= 0
        rows, columns, tf = rows[held], columns[held], tf[held]
        impact = np.where(tf == _MOST, 1e6, 1e9 * tf / (1000 * tf + 8 * m[rows]))
        folded = np.zeros((len(at), self.weights.shape[0]), np.float32)
        folded[rows, columns] = impact
        return folded @ self.weights * self.slack

    def score(self, counts: Counter, n: int, item: int) -> int:
        m = slope(n, self.n_docs, self.n_terms)
        return sum(w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m)) for t, w in self.items[item].items() if t in counts)


def _chunks(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(i, _CHUNK)
            yield part.column("tk").to_numpy(), block.bounds(*[part.column(c).to_pylist() for c in ("n", "at", "peak")])


def _highest(block: Block, keep: int) -> Callable:
    """(tk, items, bounds): the texts of the highest bounds of each item in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, of = np.zeros((0, len(block.items)), np.float32), np.zeros((0, len(block.items)), np.int64)
        for tk, bounds in _chunks(batches, block):
            best, of = np.concatenate([best, bounds]), np.concatenate([of, np.broadcast_to(tk[:, None], bounds.shape)])
            if len(best) > keep:
                top = np.argpartition(-best, keep, axis=0)[:keep]
                best, of = np.take_along_axis(best, top, 0), np.take_along_axis(of, top, 0)
        row, item = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(of[row, item]), pa.array(item.astype(np.int32)), pa.array(best[row, item].astype(np.float64))], names=["tk", "item", "bound"])

    return run


def _reaching(block: Block, thresholds: np.ndarray) -> Callable:
    """(tk, items): each text with the items for which its bound reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tk, bounds in _chunks(batches, block):
            row, item = np.nonzero((bounds >= thresholds) & (bounds > 0))
            texts, starts = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(item.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(tk[texts]), lists], names=["tk", "items"])

    return run


def _scored(block: Block) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, items, scores = [], [], []
            for row, (text, asked) in enumerate(zip(_texts(batch), batch.column("items").to_pylist())):
                counts = Counter(terms(text))
                n = sum(counts.values())
                for item in asked:
                    if score := block.score(counts, n, item):
                        at.append(row)
                        items.append(item)
                        scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), pa.array(items, pa.int32()), pa.array(scores, pa.int64())], names=["id", "item", "score"])

    return run


def _best(scores: DataFrame, keep: int, *order) -> DataFrame:
    """The first rows of each item, first within 64 parts of it; Spark cuts each task's rows before they are dealt."""
    part = F.pmod(F.xxhash64(*[c for c in scores.columns if c != "item"]), F.lit(64))
    cut = scores.withColumn("_n", F.row_number().over(Window.partitionBy("item", part).orderBy(*order))).where(F.col("_n") <= keep)
    return cut.withColumn("_n", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("_n") <= keep)


def sketches(docs: DataFrame, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The index: (tk, n, at, peak) of every row, tk a hash of the text, n its terms, at the coordinates in order, peak their highest counts."""
    rows = no_clash(docs, text_col).select(F.xxhash64(f"`{text_col}`").alias("tk"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_sketched(bits), "tk long, n long, at binary, peak binary")


def _search_block(rows: DataFrame, index: DataFrame, items: list[list[bytes]], totals: tuple[int, int], keep: int, bits: int, scratch: Scratch, step: str) -> DataFrame:
    """(item, rank, id, score); item counts from 0 within the block."""
    spark = rows.sparkSession
    vocabulary = frozenset(t for item in items for t in item)
    counted = rows.select("text").mapInArrow(_frequencies(vocabulary), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    block = Block(items, {bytes(r["term"]): r["df"] for r in counted.collect()}, *totals, bits)  # a row for each term of the block at most
    rescored = lambda chosen: rows.join(chosen, "tk").select("id", "text", "items").mapInArrow(_scored(block), "id long, item int, score long")

    first = index.mapInArrow(_highest(block, 4 * keep), "tk long, item int, bound double")
    first = _best(first, 4 * keep, F.desc("bound"), "tk").groupBy("tk").agg(F.collect_set("item").alias("items"))
    first = scratch.save(first, f"{step}first")
    ahead = _best(rescored(first), keep, F.desc("score"), F.asc_nulls_last("id")).where(F.col("_n") == keep).select("item", "score").collect()  # one row for each item at most
    thresholds = np.ones(len(items), np.float64)
    for r in ahead:
        thresholds[r["item"]] = r["score"]

    rest = index.mapInArrow(_reaching(block, thresholds), "tk long, items array<int>").dropDuplicates(["tk"])
    rest = scratch.save(rest, f"{step}rest")
    found = _best(rescored(rest), keep, F.desc("score"), F.asc_nulls_last("id"))
    found = scratch.save(found.select("item", F.col("_n").cast("int").alias("rank"), "id", "score"), f"{step}found")
    scratch.drop(f"{step}first", f"{step}rest")
    return found


def search(docs: DataFrame, queries: DataFrame, keep: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block: int = 512, bits: int = BITS) -> DataFrame:
    """(item, rank, id, score): for each item the `keep` documents of the highest score above 0, all if fewer.

    Equal scores rank by ascending id, null last. Rows of queries with one id are one item with all their terms; a null item id is
    an item like any other. Null, empty and blank texts have no terms: such a document isn't counted and never ranks, such an
    item has no rows. Repeated rows of docs each count and rank. Terms that no document has add nothing. Empty tables give no
    rows; extra columns are ignored. The items pass through the driver, a block at a time; documents never do.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    rows = no_clash(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("tk", F.xxhash64("text"))
    index = scratch.save(sketches(docs, text_col, bits), "index")
    totals = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = no_clash(queries, query_id, query_text).groupBy(F.col(f"`{query_id}`").alias("item_id")).agg(F.concat_ws("\n", F.collect_set(f"`{query_text}`")).alias("text"))
    asked = scratch.save(asked, "asked")
    kind = asked.schema["item_id"].dataType.simpleString()
    out, held = spark.createDataFrame([], f"item {kind}, rank int, id long, score long"), []
    if not totals[0]:
        return out

    def searched() -> DataFrame:
        items = [list(dict.fromkeys(terms(text.encode()))) for _, text in held]
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(held)], f"at int, name {kind}")
        found = _search_block(rows, index, items, tuple(totals), keep, bits, scratch, f"b{n}-")
        return found.join(names, F.col("item") == F.col("at")).select(F.col("name").alias("item"), "rank", "id", "score")

    n = 0
    for r in asked.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        if len(held) == block:
            out, held, n = out.unionByName(searched()), [], n + 1
    return out.unionByName(searched()) if held else out

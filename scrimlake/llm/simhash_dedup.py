"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. Two fingerprints within 3 bits agree in one segment to
within 1 bit, so each fingerprint looks up, in a table of exact segments, the ball of radius 1 around each
of its own; of two segments that differ in one bit, the one where the bit is 0 looks up the other. Every
match is verified on all 64 bits. A segment shared by more than `hot_bucket` fingerprints isn't paired:
its members enumerate balls around the other segment instead and are linked through shared centres,
which finds the same components with a fixed number of rows for each member.

That is whole for 3 bits, and copies of a five-word similarity of 0.8 differ in about ten, of which three is the standard deviation. Those
are found beside it: texts that the fingerprints don't link yet also meet by their `sketch` least shingle hashes, are held together (see
meeting) if their fingerprints differ in at most WIDE bits and their sizes and signatures (see ngram_join) allow it, and are linked
if their whole sets of shingles are within the threshold.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch, ascii_lower, no_clash, words
from scrimlake.llm.components import connected_components
from scrimlake.llm.meeting import met_components
from scrimlake.llm.ngram_join import may_reach, signature, similar, whole_sets

RADIUS = 3
#: The radius within which nearly all texts of similarity 0.8 lie.
WIDE = 20
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(w: Column, size: int) -> Column:
    """XXH64 (seed 42) of each run of `size` words joined by spaces; of all words if there are fewer; none of no words."""
    return (
        F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < size, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]))))
    )


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes: a bit is 1 if set in over half of the group; 0 for empty groups."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    n = lengths[full].astype(np.int64)
    starts = np.cumsum(n) - n
    parts = -(-n // 255)  # sums of up to 255 bits fit the bytes of a word
    first = np.cumsum(parts) - parts
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    ones = np.empty((len(cuts), 8, 8), np.int64)
    for j in range(8):
        ones[:, :, j] = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
    ones = np.add.reduceat(ones, first).reshape(-1, 64)
    out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(sketch: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            columns = [batch.column("id"), batch.column("tk"), pa.array(majority_bits(flat, lengths).view(np.int64))]
            if sketch:
                ends = np.cumsum(lengths)
                sets = [np.unique(flat[e - n : e].view(np.int64)) for e, n in zip(ends, lengths)]
                columns += [pa.array([h[:sketch] for h in sets], pa.list_(pa.int64())), pa.array([len(h) for h in sets], pa.int64()), pa.array([signature(h.view(np.uint64)) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "tk", "fp", "s", "n", "sig"][: len(columns)])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, sketch: int = 0) -> DataFrame:
    """(id, tk, fp): tk is a hash of the text, fp the SimHash of its lower-cased word shingles as a signed long; null or blank text gives 0.
    With a sketch also s, the `sketch` least of its distinct shingle hashes, n, how many it has, and sig, their signature."""
    rows = no_clash(docs, id_col, text_col)
    w = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{text_col}`").alias("tk"), words(ascii_lower(F.col(f"`{text_col}`"))).alias("w"))
    h = w.select("id", "tk", shingle_hashes(F.col("w"), shingle).alias("h"))
    return h.mapInArrow(_fingerprint_batches(sketch), "id long, tk long, fp long" + (", s array<long>, n long, sig array<long>" if sketch else ""))


def _segments(fps: DataFrame) -> DataFrame:
    """(fp, seg, own): own is the 32 bits of segment 0 or 1."""
    low = F.lit(0xFFFFFFFF).cast("long")
    return fps.select("fp", F.posexplode(F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32).bitwiseAND(low))).alias("seg", "own"))


def _flips(key: Column, upward: bool = False) -> Column:
    """The keys that differ from this one in one of 32 bits; upward: only by setting a bit."""
    near = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: key.bitwiseXOR(F.expr("1L").cast("long") * F.pow(F.lit(2.0), i).cast("long")))
    return F.filter(near, lambda k: k > key) if upward else near


def hamming_links(fps: DataFrame, scratch: Scratch, hot_bucket: int = 256) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that give the components of all pairs within 3 bits.

    Pairs of buckets up to hot_bucket are all there; of larger ones, a subset with the same components.
    """
    seg = _segments(fps)
    key = lambda k: (F.col("seg").cast("long") * F.lit(1 << 32) + k).alias("k")
    table = seg.select(key(F.col("own")), "fp")
    asks = seg.select(F.col("seg"), "fp", F.explode(F.concat(F.array("own"), _flips(F.col("own"), upward=True))).alias("ask"), "own").select(key(F.col("ask")), F.col("fp").alias("q"), (F.col("ask") != F.col("own")).alias("flip"))
    hot = scratch.save(table.groupBy("k").count().where(F.col("count") > hot_bucket).select("k"), "hot")
    # exploded tables have many times the size that Spark reckons with, so none of them may be broadcast
    near = asks.join(hot, "k", "left_anti").join(table.hint("merge"), "k")
    near = near.where(F.when(F.col("flip"), F.col("q") != F.col("fp")).otherwise(F.col("q") < F.col("fp")))
    pairs = near.where(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= RADIUS).select(F.col("q").alias("a"), F.col("fp").alias("b"))

    other = lambda fp: F.when(F.col("k") >= F.lit(1 << 32), fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).otherwise(F.shiftrightunsigned(fp, 32))
    members = table.join(hot, "k", "left_semi").select("k", "fp", other(F.col("fp")).alias("o"))
    ball1 = F.concat(F.array("o"), _flips(F.col("o")))
    ball2 = F.array_distinct(F.concat(ball1, F.flatten(F.transform(_flips(F.col("o")), lambda x: _flips(x)))))
    ones = members.select("k", "fp", F.explode(ball1).alias("c"))
    least = ones.groupBy("k", "c").agg(F.min("fp").alias("m"))  # those within 1 of a centre are within 2 of each other
    asked = asks.where("flip").join(hot, "k", "left_semi").select("k", F.col("q").alias("fp"), other(F.col("q")).alias("o"))
    reach = ones.unionByName(members.select("k", "fp", F.explode(ball2).alias("c"))).unionByName(asked.select("k", "fp", F.explode(ball1).alias("c")))
    through = reach.join(least.hint("merge"), ["k", "c"]).where(F.col("fp") != F.col("m")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("m"))) <= RADIUS)
    return pairs.unionByName(through.select(F.col("fp").alias("a"), F.col("m").alias("b")))


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, hot_bucket: int = 256) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col, shingle), "rows")
    nodes = scratch.save(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    edges = scratch.save(hamming_links(nodes.select("fp"), scratch, hot_bucket).distinct(), "edges")
    roots = connected_components(edges, scratch)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = scratch.save(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "named")
    scratch.drop("nodes", "edges", "hot")
    return rows.join(by_fp, "fp").select("id", "tk", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, hot_bucket: int = 256) -> DataFrame:
    """(id, fp, component_id) for every row: rows whose fingerprints are linked by steps of at most 3 bits share
    the smallest id reachable. Equal fingerprints are one node, so copies are never paired.

    Null or blank text: fingerprint 0, linked like any other. Repeated rows come back as often as they come in.
    A null id keeps its row and never names a component unless all ids there are null. Empty table: no rows.
    """
    return _components(docs, id_col, text_col, shingle, hot_bucket).select("id", "fp", "component_id")


def _near_texts(texts: DataFrame, scratch: Scratch, hot_bucket: int = 256) -> DataFrame:
    """(a, b) for every text (columns tk, fp) that steps of at most 3 bits link to a text with a smaller tk: the least of those."""
    edges = scratch.save(hamming_links(texts.select("fp").distinct(), scratch, hot_bucket).distinct(), "edges")
    named = texts.select("tk", "fp").join(connected_components(edges, scratch).withColumnRenamed("node", "fp"), "fp", "left")
    named = scratch.save(named.select("tk", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("tk").alias("b"), F.max("tk").alias("most")).where("b < most")
    near = scratch.save(named.join(least, "root").where("tk <> b").select(F.col("tk").alias("a"), "b"), "near")
    scratch.drop("edges", "hot", "named")
    return near


def _alike(docs: DataFrame, id_col: str, text_col: str, shingle: int, sketch: int, radius: int, percent: int) -> DataFrame:
    """(id, tk, component_id): components of texts linked by fingerprints within 3 bits or by whole similarity."""
    scratch = Scratch(docs.sparkSession, "alike")
    rows = scratch.save(fingerprints(docs, id_col, text_col, shingle, sketch), "rows")
    known = rows.groupBy("tk").agg(*[F.first(c).alias(c) for c in ("fp", "s", "n", "sig")])
    near = _near_texts(rows.select("tk", "fp").distinct(), scratch)
    meets = known.select(F.explode("s").alias("k"), F.col("tk").alias("node"), "fp", "n", "sig")
    shared = scratch.save(rows.select(F.explode("s").alias("k"), "tk").groupBy("k").agg(F.min("tk").alias("lo"), F.max("tk").alias("hi")).where("lo < hi").select("k"), "shared")
    meets = scratch.save(meets.join(shared, "k", "left_semi"), "meets")

    def likely(met: DataFrame, whole: bool) -> DataFrame:
        x, y = F.col("about_a"), F.col("about_b")
        allowed = (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius) & may_reach(x, y, percent) & (F.col("a") != F.col("b"))
        return met.where(allowed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    texts = no_clash(docs, text_col).select(F.xxhash64(f"`{text_col}`").alias("tk"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def verify(pairs: DataFrame) -> DataFrame:
        scratch.drop("sets")
        asked = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
        found = whole_sets(texts, asked, shingle).select(F.col("tk").alias("node"), "h")
        return similar(pairs, scratch.save(found.dropDuplicates(["node"]), "sets"), percent)

    roots = met_components(meets, likely, verify, scratch, linked=near)
    placed = rows.select("id", "tk").join(roots.withColumnRenamed("node", "tk"), "tk", "left").withColumn("root", F.coalesce("root", "tk"))
    placed = scratch.save(placed, "placed")
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    scratch.drop("rows", "near", "shared", "meets", "sets")
    return placed.join(least, "root").select("id", "tk", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, sketch: int = 0, radius: int = WIDE, percent: int = 80) -> DataFrame:
    """The rows of docs that name their component: one document of each near-duplicate group, the smallest id.

    Without a sketch groups are those of near_duplicates(). With one, also texts are linked that share one of so many least shingles, lie within the radius and are similar to `percent`.
    A row goes if its text's group has a smaller id. Rows that repeat the smallest id stay if their texts are in the group;
    of rows with one id and unlike texts each is judged by its own group; rows with a null id stay. Null, empty and
    blank texts are one group. Extra columns are carried; an empty table gives no rows.
    """
    found = _alike(docs, id_col, text_col, shingle, sketch, radius, percent) if sketch else _components(docs, id_col, text_col, shingle)
    gone = found.where(F.col("id") != F.col("component_id")).select("id", "tk").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("at"), F.xxhash64(f"`{text_col}`").alias("of"))
    return rows.join(gone, (F.col("at") == F.col("id")) & (F.col("of") == F.col("tk")), "left_anti").select("row.*")

"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits in lower case. An item of n words is compared with the windows of n
words of every text. Items and windows get a 64-bit SimHash of their word shingles. Fingerprints are joined
on four blocks of 16 bits: the item side enumerates the ball of radius 2 around each block and the window
side that of radius 1, so that every pair within 15 bits meets, as one of its blocks differs in at most 3.
Matches are verified by the weighted Jaccard similarity of the shingles, a shingle's weight in a text being
how often it occurs there.

A window as similar as asked has most of its shingles in items of its size, so a fixed-size bit table of
(size, shingle) says which windows need a fingerprint. The table has no false negatives, so this loses none.
"""

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch
from scrimlake.llm.simhash_dedup import majority_bits
from scrimlake.llm.substring_dedup import mixed

RADIUS = 15
_WORD = re.compile(r"[^\W_]+")
_BITS = 26
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def word_hashes(text: str, known: dict) -> np.ndarray:
    found = _WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of `size` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _P + h[k : k + n]
    return mixed(out)


def _slot(s: np.ndarray, n: int) -> np.ndarray:
    """The bit of a shingle in items of n words; n = 0: in items of any size."""
    return mixed(s + np.uint64(n * int(_P) % (1 << 64)), 0xC4CEB9FE1A85EC53) >> np.uint64(64 - _BITS)


def _items(shingle: int) -> Callable:
    """(item, n, shingles, fp) of each item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                h = word_hashes(text or "", known)
                if len(h):
                    s = shingles(h, min(shingle, len(h)))
                    rows.append((item, len(h), s.view(np.int64).tolist(), int(majority_bits(s, np.array([len(s)])).view(np.int64)[0])))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["item", "n", "s", "fp"])

    return run


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << _BITS, bool)
    for batch in batches:
        for n, s in zip(batch.column("n").to_pylist(), batch.column("s").to_pylist()):
            s = np.array(s, np.int64).view(np.uint64)
            bits[_slot(s, n)] = True
            bits[_slot(s, 0)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])


def _windows(shingle: int, sizes: list[int], threshold: float, table) -> Callable:
    """(id, at, n, fp, s) of the windows with enough shingles in the bit table."""

    def has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = _Hashes(), np.frombuffer(table.value, np.uint8)
        widths = sorted({min(shingle, n) for n in sizes})
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                h = word_hashes(text, known) if text else ()
                for width in widths if len(h) else ():
                    s = shingles(h, width)
                    found = np.flatnonzero(has(bits, _slot(s, 0)))
                    if not len(found):
                        continue
                    for n in sizes:
                        if min(shingle, n) != width or n > len(h):
                            continue
                        m = n - width + 1
                        need = math.ceil(2 * threshold / (1 + threshold) * m - 1e-9)
                        if len(found) < need:
                            continue
                        mine = found[has(bits, _slot(s[found], n))]
                        total = np.zeros(len(s) + 1, np.int64)
                        total[mine + 1] = 1
                        total = np.cumsum(total)
                        for at in np.flatnonzero(total[m:] - total[:-m] >= need):
                            out.append((doc, int(at), n, s[at : at + m]))
            if out:
                fps = majority_bits(np.concatenate([r[3] for r in out]), np.array([len(r[3]) for r in out]))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *[len(r[3]) for r in out]]).astype(np.int32), pa.array(np.concatenate([r[3] for r in out]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32()), pa.array(fps.view(np.int64)), lists], names=["id", "at", "n", "fp", "s"])

    return run


def weighted_jaccard(a: list[int], b: list[int]) -> float:
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both)


def _verify(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likeness = np.array([weighted_jaccard(a, b) for a, b in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist())])
            ok = np.flatnonzero(likeness >= threshold) if len(likeness) else []
            if len(ok):
                kept = batch.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([kept.column("n"), kept.column("w"), kept.column("item"), pa.array(likeness[ok])], names=["n", "w", "item", "similarity"])

    return run


def _ball(value, radius: int):
    flips = lambda v: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: v.bitwiseXOR(F.pow(F.lit(2.0), i).cast("long")))
    near = F.concat(F.array(value), flips(value))
    return near if radius == 1 else F.array_distinct(F.concat(near, F.flatten(F.transform(flips(value), flips))))


def _keys(df: DataFrame, radius: int, *carry: str) -> DataFrame:
    """Rows of df for every value in the ball around each block of fp, under column k."""
    blocks = F.array(*[F.shiftrightunsigned("fp", 16 * b).bitwiseAND(F.lit(0xFFFF).cast("long")) for b in range(4)])
    df = df.select(*carry, F.posexplode(blocks).alias("b", "v"))
    return df.select(*carry, F.explode(_ball(F.col("v"), radius)).alias("v"), "b").withColumn("k", (F.col("n").cast("long") * 4 + F.col("b")) * 65536 + F.col("v")).drop("b", "v")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, item, n_words, at, similarity): each document and benchmark item of which it has a window within
    RADIUS bits and at least as similar as the threshold; at: the first word of the most similar window, the
    first such if several.

    Null, blank and short texts have no window; null and wordless items match nothing; items of fewer than
    `shingle` words count as one shingle. Repeated rows give one row an id and item. Rows with a null id are
    compared too. Extra columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    items = scratch.save(items.mapInArrow(_items(shingle), "item long, n int, s array<long>, fp long"), "items")
    sizes = sorted(r["n"] for r in items.select("n").distinct().toLocalIterator())  # one number for each item length
    bits = np.zeros((1 << _BITS) // 8, np.uint8)
    for r in items.coalesce(4).mapInArrow(_table, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    table = spark.sparkContext.broadcast(bits.tobytes())  # 2^26 bits, whatever the benchmark's size

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    seen = rows.mapInArrow(_windows(shingle, sizes, threshold, table), "id long, at int, n int, fp long, s array<long>")
    seen = scratch.save(seen.withColumn("w", F.xxhash64("s")), "windows")
    windows = scratch.save(seen.select("n", "w", "fp", "s").dropDuplicates(["n", "w"]), "distinct")
    asks = _keys(windows.select("n", "w", "fp"), 1, "n", "w", "fp")
    table_side = _keys(items.select("n", "item", "fp"), 2, "n", "item", "fp").withColumnRenamed("fp", "item_fp").drop("n")
    near = asks.join(table_side, "k").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = near.select("n", "w", "item").distinct().join(windows.select("n", "w", "s"), ["n", "w"]).join(items.select("item", F.col("s").alias("t"), F.col("n").alias("tn")), "item").where("n = tn")
    sure = scratch.save(pairs.select("n", "w", "item", "s", "t").mapInArrow(_verify(threshold), "n int, w long, item long, similarity double"), "sure")
    hits = seen.select("id", "at", "n", "w").join(sure, ["n", "w"])
    best = hits.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("at")).alias("back"), "n")).alias("m"))
    return best.select("id", "item", F.col("m.n").alias("n_words"), (-F.col("m.back")).alias("at"), F.col("m.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **rules) -> DataFrame:
    """The rows of docs that hold no benchmark item; rows of the same id go together."""
    found = contaminated(docs, benchmark, id_col, **rules).select(F.col("id").alias("_id")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_id"]), "left_anti")

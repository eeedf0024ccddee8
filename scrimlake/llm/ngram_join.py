"""Jaccard join on word shingles by adaptive multi-match prefixes.

Two sets within the threshold share most of their shingles. With all shingles in one order, a set of n shingles that must share
`need` of them with any partner has, as its prefix for l matches, its first n - need + l shingles: two partners share at
least l shingles of their prefixes for l. A longer prefix meets more sets but asks more shared shingles of them before they
are compared. Each set takes the l from 1 to MATCHES at which the estimated cost is least: what its prefix meets in all,
and 1/l of that, which is the most sets that can share l shingles, times the cost of a comparison. Two sets of unlike l share
as many as the lesser asks.

The order is by estimated frequency, rare shingles first, then by hash; frequencies come from a count-min row over all shingles, of at most
`max_cells` cells, of which half a byte each, the logarithm, goes back to the tasks. Any order gives the same result, but with many more
shingles than cells more of those that few sets have are in prefixes, and more pairs are looked at.

Sets that meet are first held together by signatures: bit i of a signature is whether an odd number of the set's hashes fall on it. Each
shingle that only one of two sets has changes one bit of the difference, so they differ in at least as many shingles as bits; pairs that differ in too many go.

Equal sets are one node. Not all sets that share a shingle are paired, but the components are those of all pairs (see meeting).
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch, no_clash
from scrimlake.llm.meeting import met_components
from scrimlake.llm.substring_dedup import Rolling, WordHashes, _pack, _unpack, _word_hashes

MATCHES = 8
#: What a comparison of two sets costs, in meetings of two sets at a shingle.
COMPARED = 20
#: Bits of a signature.
SIGNED = 512
_BLOCK = 1 << 20
_HELD = 1_000_000
#: Sets that a task remembers, to send copies on once.
_SEEN = 100_000
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


class Shingles:
    """The distinct shingle hashes of texts, in order: of each `size` words in a row, or of all words if there are fewer."""

    def __init__(self, size: int):
        self.size, self.known, self.rolling, self.seen = size, WordHashes(), Rolling(size), set()

    def __call__(self, text: bytes) -> np.ndarray:
        w = _word_hashes(text.lower(), self.known)  # of bytes, lower() changes A-Z only
        if 0 < len(w) < self.size:
            return np.array([xxhash.xxh64_intdigest(w.tobytes(), len(w))], np.uint64)
        return np.unique(self.rolling(w))

    def new(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """(node, hashes) of the texts; a set that this task has met lately is left out."""
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                h = self(text or b"")
                if len(h) and self.is_new(node := _node(h)):
                    yield node, h

    def is_new(self, node: int) -> bool:
        if node in self.seen:
            return False
        if len(self.seen) >= _SEEN:
            self.seen.clear()
        self.seen.add(node)
        return True


def _node(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 7)).view(np.int64))


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def signature(h: np.ndarray) -> np.ndarray:
    odd = np.bincount((h % np.uint64(SIGNED)).astype(np.int64), minlength=SIGNED) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _counted(size: int, bits: int) -> Callable:
    """(block, cells): for every million shingles or so the cells they fall on."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(_cells(np.concatenate(held), bits))
        starts = np.flatnonzero(np.diff(cells // _BLOCK, prepend=-1))
        blocks = [int(cells[a] // _BLOCK) for a in starts]
        packed = [_pack(cells[a:b] % _BLOCK) for a, b in zip(starts, [*starts[1:], len(cells)])]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, h in Shingles(size).new(batches):
            held.append(h)
            n += len(h)
            if n >= _HELD:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of blocks and gives their binary logarithm, rounded up, 15 at most, two in a byte."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total = sums.setdefault(block, np.zeros(_BLOCK, np.int64))
            at, n = np.unique(_unpack(cells), return_counts=True)
            total[at] += n
    for block, total in sums.items():
        levels = np.minimum(np.ceil(np.log2(np.maximum(total, 1))), 15).astype(np.uint8)
        both = levels[::2] | levels[1::2] << 4
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([both.tobytes()], pa.binary())], names=["block", "levels"])


def need(n: int, percent: int) -> int:
    """How many shingles a set of n must share with a partner at least."""
    return -(-percent * n // 100)


def prefix(h: np.ndarray, levels: np.ndarray, load: float, percent: int) -> tuple[np.ndarray, int]:
    """The places in h of the set's prefix, in the order of all shingles, and the matches it is for. levels: of each shingle;
    load: how many shingles a cell has that aren't this one's."""
    n = len(h)
    order = np.lexsort((h, levels))
    shortest = n - need(n, percent) + 1
    longest = min(n, shortest + MATCHES - 1)
    others = np.maximum(np.exp2(levels[order[:longest]].astype(np.float64)) - load - 1, 0)
    met = np.cumsum(others)[shortest - 1 : longest]
    asked = np.arange(1, len(met) + 1)
    best = int(np.argmin(met + COMPARED * met / asked))
    return order[: shortest + best], best + 1


_ROW = pa.schema([("id", pa.int64()), ("tk", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("asked", pa.int32()), ("place", pa.int32()), ("sig", pa.list_(pa.int64()))])


def _prefixes(size: int, bits: int, table, load: float, percent: int) -> Callable:
    """Rows of _ROW: one without k for each text, with the size, node and signature of its set, and one for each shingle of a set's prefix that another set may have."""

    def heads(batch: pa.RecordBatch, sets: list[np.ndarray], nodes: list) -> pa.RecordBatch:
        none = pa.nulls(len(sets), pa.int64())
        signs = pa.array([signature(h) if len(h) else None for h in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tk"), pa.array(nodes, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), none, none.cast(pa.int32()), none.cast(pa.int32()), signs], schema=_ROW)

    def shared(out: list[tuple]) -> pa.RecordBatch:
        nodes, lengths, keys, asked, places = zip(*out)
        many = [len(k) for k in keys]
        each = lambda x: np.repeat(np.array(x, np.int64), many)
        none = pa.nulls(sum(many), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(each(nodes)), pa.array(each(lengths)), pa.array(np.concatenate(keys)), pa.array(each(asked).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32)), pa.nulls(sum(many), _ROW.field("sig").type)], schema=_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, shingles = np.frombuffer(table.value, np.uint8), Shingles(size)
        for batch in batches:
            sets = [shingles(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            nodes = [_node(h) if len(h) else None for h in sets]
            yield heads(batch, sets, nodes)
            out = []
            for h, node in zip(sets, nodes):
                if node is None or not shingles.is_new(node):
                    continue
                cells = _cells(h, bits)
                levels = every[cells >> 1] >> ((cells & 1) << 2).astype(np.uint8) & 15
                at, asked = prefix(h, levels, load, percent)
                place = np.flatnonzero(levels[at] > 0)  # a cell with one shingle in all is that of one text
                if len(place):
                    out.append((node, len(h), h[at[place]].view(np.int64), asked, place))
            if out:
                yield shared(out)

    return run


def _sets(size: int, wanted, bits: int) -> Callable:
    """(tk, node, h) of the sets of texts whose hash tk falls on a wanted bit; a text that this task has met lately is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shingles = np.frombuffer(wanted.value, np.uint8), Shingles(size)
        for batch in batches:
            tk = batch.column("tk").to_numpy()
            at = tk & ((1 << bits) - 1)
            for i in np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1):
                if shingles.is_new(int(tk[i])):
                    h = shingles((batch.column("text")[i].as_py() or "").encode())
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(tk[i : i + 1]), pa.array([_node(h)]), pa.array([h.view(np.int64)], pa.list_(pa.int64()))], names=["tk", "node", "h"])

    return run


def whole_sets(rows: DataFrame, hashes: DataFrame, size: int, bits: int = 24) -> DataFrame:
    """(tk, node, h) of the texts of rows (tk, text) whose tk is in hashes (h), and perhaps of some others: the sets' nodes and shingles. Copies of a text may come again."""
    wanted = rows.sparkSession.sparkContext.broadcast(_bit_table(hashes, bits))
    return rows.select("tk", "text").mapInArrow(_sets(size, wanted, bits), "tk long, node long, h array<long>")


def _bit_table(hashes: DataFrame, bits: int) -> bytes:
    """A bit for each low part of the column h that occurs: 2 ** bits bits, from rows of 4096 bytes."""
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    made = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 15).cast("long").alias("b")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    for r in made.toLocalIterator():
        table[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return table.tobytes()


def _reaches(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether so many shared shingles of sets of a and b give the similarity."""
    return shared.cast("long") * (100 + percent) >= (a + b).cast("long") * percent


def may_reach(x: Column, y: Column, percent: int) -> Column:
    """Whether sets of sizes n and signatures sig may be within the threshold."""
    apart = sum((F.bit_count(F.get(x["sig"], F.lit(i)).bitwiseXOR(F.get(y["sig"], F.lit(i)))) for i in range(1, SIGNED // 64)), F.bit_count(F.get(x["sig"], F.lit(0)).bitwiseXOR(F.get(y["sig"], F.lit(0)))))
    # sets within the threshold share at least percent / (100 + percent) of both sizes together, and differ in what both don't share
    alike = apart.cast("long") * (100 + percent) <= (x["n"] + y["n"]) * (100 - percent)
    return (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent) & alike


def _likely(met: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(a, b) of the pairs that share as many shingles as asked and may reach the threshold after their first shared one. met: a row for each shingle that two prefixes share.

    If those aren't whole, pairs that share fewer are let through too, if they are small enough for unlike ones to differ in their signatures.
    """
    x, y = F.col("about_a"), F.col("about_b")
    each = met.where((F.col("a") != F.col("b")) & may_reach(x, y, percent))
    ordered = F.col("a") < F.col("b")
    each = each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(ordered, x).otherwise(y).alias("l"), F.when(ordered, y).otherwise(x).alias("r"))
    found = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), *[F.min(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("n", "asked", "place")])
    left_over = F.least(F.col("l_n") - F.col("l_place"), F.col("r_n") - F.col("r_place"))
    enough = (F.col("shared") >= F.least("l_asked", "r_asked")) & _reaches(left_over, F.col("l_n"), F.col("r_n"), percent)
    return found.where(enough if whole else enough | (F.col("l_n") + F.col("r_n") <= 4 * SIGNED)).select("a", "b")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with linked: whether their whole sets are within the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    counted = both.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("shared"))
    return counted.select("a", "b", _reaches(F.col("shared"), F.col("na"), F.col("nb"), percent).alias("linked"))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, max_cells: int = 1 << 27, stars: int = 2) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the size of its set of lower-cased word shingles and the smallest id that
    links of at least `percent` in Jaccard similarity reach.

    Texts of fewer words have all of them as their one shingle. Null, empty and blank texts have none, are linked with nothing and
    are components of their own. Repeated rows come back as often as they come in. A null id keeps its row and names a
    component only if all ids there are null. Shingles and sets are told apart by 64-bit hashes. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = no_clash(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("tk", F.coalesce(F.xxhash64("text"), F.lit(0)))

    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 6  # about as many words
    bits = min(max(total.bit_length(), 20), max_cells.bit_length() - 1)
    sums = rows.select("text").mapInArrow(_counted(shingle, bits), "block int, cells binary").repartition(64, "block").mapInArrow(_levels, "block int, levels binary")
    table = np.zeros((1 << bits) // 2, np.uint8)
    for r in scratch.save(sums, "levels").toLocalIterator():  # at most max_cells / 2 bytes, a block at a time
        table[r["block"] * _BLOCK // 2 : (r["block"] + 1) * _BLOCK // 2] = np.frombuffer(r["levels"], np.uint8)
    levels = spark.sparkContext.broadcast(table.tobytes())
    del table

    emitted = rows.mapInArrow(_prefixes(shingle, bits, levels, total / (1 << bits), percent), "id long, tk long, node long, n long, k long, asked int, place int, sig array<long>")
    emitted = scratch.save(emitted, "emitted")
    named = scratch.save(emitted.where("k is null").select("id", "tk", "node", F.col("n").alias("n_shingles"), "sig"), "rows")
    prefixes = emitted.where("k is not null").select("k", "node", "n", "asked", "place")
    shared = prefixes.groupBy("k").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("k")
    shared = scratch.save(shared, "shared")
    plain = scratch.save(prefixes.join(shared, "k", "left_semi").dropDuplicates(["k", "node"]), "plain")
    scratch.drop("levels", "emitted", "shared")
    nodes = named.join(plain.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("tk").alias("h"), F.first("sig").alias("sig"))
    nodes = scratch.save(nodes, "nodes")
    meets = scratch.save(plain.join(nodes.select("node", "sig"), "node"), "meets")
    named = named.drop("sig")
    sets = whole_sets(rows, nodes, shingle).select("node", "h")
    sets = scratch.save(sets.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    roots = met_components(meets, lambda met, whole: _likely(met, percent, whole), lambda pairs: similar(pairs, sets, percent), scratch, stars)
    roots = scratch.save(roots, "roots")
    scratch.drop("plain", "meets", "nodes", "sets")

    placed = named.where("node is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    by_node = scratch.save(placed.select("node", "root").distinct().join(least, "root").select("node", "component_id"), "named")
    out = named.join(by_node, "node", "left")
    return out.select("id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))

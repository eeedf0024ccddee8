"""Exact substring dedup behind a count-min prefilter.

Windows of `window` consecutive words are hashed to 128 bits. Pass one counts them in a count-min sketch of
two rows: every task sends the cells its windows touch, sorted and delta-coded, and the tasks that own a
block of cells add them up, up to 2. Only one bit a cell, "counted at least twice", goes back to the tasks;
its size is bounded by `max_cells`. An estimate is never too low, so a window that occurs twice always passes
the second pass, which groups the passing windows exactly. With more windows than cells more unique windows
pass, and the second pass has more to group, but its result is the same.

Texts that are whole copies of one with a smaller id are set aside first: all their windows repeat.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch

_P = 0x9E3779B97F4A7C15
_ODD = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)  # one multiplier for each row of the sketch
_BLOCK = 1 << 21
_KNOWN_WORDS = 100_000
#: Windows that a task holds before it gives them on.
_HELD = 250_000


class WordHashes(dict):
    """Hashes of words seen by this task; forgotten when they get too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def mixed(h: np.ndarray, odd: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(odd)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Polynomial hashes of all windows of a fixed size, from prefix sums modulo 2^64."""

    def __init__(self, size: int):
        self.size, self.up, self.down = size, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, p in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
                powers = np.full(n, p, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if n < self.size:
            return np.zeros(0, np.uint64)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.down[:n], out=sums[1:])
        return mixed((sums[self.size :] - sums[: -self.size]) * self.up[self.size - 1 : n])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _word_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    words = text.split()  # bytes split at exactly the six white space characters
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h * np.uint64(_ODD[row])) >> np.uint64(64 - bits)


def _pack(cells: np.ndarray) -> bytes:
    """Sorted cells of a block, repeats allowed, as gaps of one byte; 255 adds up and goes on."""
    gaps = np.diff(cells, prepend=0).astype(np.int64)
    wide = gaps // 255
    out = np.full(len(gaps) + int(wide.sum()), 255, np.uint8)
    out[np.arange(len(gaps)) + np.cumsum(wide)] = gaps % 255
    return out.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _sketch(window: int, bits: int) -> Callable:
    """Tasks send, for every million windows or so, the touched cells of each block of each row."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(held)
        rows, blocks, packed = [], [], []
        for row in range(2):
            cells = _cells(h, row, bits)
            cells.sort()
            if len(cells) > 2:  # two of a kind are enough
                cells = cells[np.r_[True, True, cells[2:] != cells[:-2]]]
            block = (cells // np.uint64(_BLOCK)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for a, b in zip(starts, [*starts[1:], len(cells)]):
                rows.append(row)
                blocks.append(int(block[a]))
                packed.append(_pack((cells[a:b] % np.uint64(_BLOCK)).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["row", "block", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling, held, n = WordHashes(), Rolling(window), [], 0
        for batch in batches:
            for text in _texts(batch):
                h = rolling(_word_hashes(text, known)) if text else ()
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= 4 * _HELD:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up blocks, each cell up to 2, and gives the bits of the cells that reach 2."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            total = sums.setdefault((row, block), np.zeros(_BLOCK, np.uint8))
            at = _unpack(cells)
            again = np.r_[False, at[1:] == at[:-1]]
            total[at[~again]] += 1
            total[at[again]] = 2
            np.minimum(total, 2, out=total)
    for (row, block), total in sums.items():
        bits = pa.array([np.packbits(total > 1, bitorder="little").tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), bits], names=["row", "block", "bits"])


def _repeated(window: int, bits: int, sketch) -> Callable:
    """(id, tk, at, h, g) of windows whose estimate in both rows is at least 2."""

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["id", "tk", "at", "h", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling, rolling2 = WordHashes(), Rolling(window), Rolling(window)
        twice = [np.frombuffer(x, np.uint8) for x in sketch.value]
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(zero_copy_only=False), batch.column("tk").to_numpy(zero_copy_only=False)
            out, n = [], 0
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_buffer()
                if text is None:
                    continue
                words = _word_hashes(text.to_pybytes(), known)
                h = rolling(words)
                ok = np.ones(len(h), bool)
                for row in range(2):
                    cell = _cells(h, row, bits)
                    ok &= (twice[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 != 0
                at = np.flatnonzero(ok)
                if len(at):
                    g = rolling2(mixed(words, 0xC4CEB9FE1A85EC53))[at]
                    out.append((np.full(len(at), ids[i]), np.full(len(at), keys[i]), at.astype(np.int32), h[at].view(np.int64), g.view(np.int64)))
                    n += len(at)
                if n >= _HELD:
                    yield given(out)
                    out, n = [], 0
            if out:
                yield given(out)

    return run


def _cut(window: int, with_text: bool) -> Callable:
    """What is left of each text after the words in its repeated windows go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, left = [], [], [], []
            for text, starts, copy in zip(_texts(batch), batch.column("starts").to_pylist(), batch.column("copy").to_pylist()):
                words = (text or b"").split()
                n = len(words)
                if copy and n >= window:
                    kept = []
                elif starts:
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, np.add(starts, window), -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:n]) == 0)]
                else:
                    kept = words
                joined = b" ".join(kept)
                n_words.append(n)
                n_removed.append(n - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                left.append(joined.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, max_cells: int = 1 << 29, with_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and kept_text (null unless with_text) for every row.

    A word goes if a window that covers it also starts in a row with a smaller id; windows are judged on the
    input. Null, blank and short texts lose nothing (null: no words). Rows with the same id don't remove each
    other's words, so repeated rows come out alike. Rows with a null id neither lose words nor remove others'.
    Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("tk", F.xxhash64("text"))
    ided = rows.where(F.col("id").isNotNull() & (F.col("text") != ""))
    prints = scratch.save(ided.select("id", "tk", F.md5("text").alias("print"), F.length("text").alias("n")), "prints")
    first = prints.groupBy("print").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = scratch.save(prints.join(first, "print").where("id > least").select("id", "tk").distinct(), "copies")
    ided = ided.join(copies, ["id", "tk"], "left_anti").select("id", "tk", "text")

    points = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(max((points // 2).bit_length(), 21), max_cells.bit_length() - 1)
    sums = ided.mapInArrow(_sketch(window, bits), "row int, block int, cells binary")
    merged = sums.repartition(64, "row", "block").mapInArrow(_merge, "row int, block int, bits binary")
    twice = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    for r in scratch.save(merged, "sketch").toLocalIterator():  # at most 2 * max_cells / 8 bytes, a block at a time
        twice[r["row"]][r["block"] * _BLOCK // 8 : (r["block"] + 1) * _BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    sketch = spark.sparkContext.broadcast([x.tobytes() for x in twice])
    del twice

    seen = scratch.save(ided.mapInArrow(_repeated(window, bits, sketch), "id long, tk long, at int, h long, g long"), "seen")
    groups = seen.groupBy("h", "g").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h", "g", "least")
    groups = scratch.save(groups, "groups")
    gone = seen.join(groups, ["h", "g"]).where("id > least").groupBy("id", "tk").agg(F.collect_set("at").alias("starts"))
    gone = scratch.save(gone, "gone")
    scratch.drop("prints", "sketch", "seen", "groups")
    marked = rows.join(gone, ["id", "tk"], "left").join(copies.withColumn("copy", F.lit(True)), ["id", "tk"], "left")
    return marked.select("id", "text", "starts", "copy").mapInArrow(_cut(window, with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")

"""Packing of token sequences by minimum bin slack.

Every document is tokenised, ended by id 0 and cut every `capacity` ids; whole pieces are sequences of their
own. What is left of each document is packed: documents are dealt by a hash into groups of about
`group_rows`, and each group plans on the counts of its remaining lengths alone. For each window the longest
length left is taken first, then a subset-sum over bit sets of the other lengths finds the multiset that
fills it closest to capacity; the counts come from walking the bit sets back, and the same fill is used for
as many windows as its lengths allow.
"""

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch

_KNOWN_UNITS = 1_600_000
#: So many new runs are encoded as one text.
_AT_ONCE = 50
_CUT = re.compile(r"(?<=\S) ")
_GAPS = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close below capacity as can be.

    The sums that can be reached with the lengths so far are the set bits of an integer. Lengths are tried from
    the longest down, several copies by doubling, until capacity itself is reached.
    """
    reach, steps, full, goal = 1, [], (1 << (capacity + 1)) - 1, 1 << capacity
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left and not reach & goal:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # not reached without this step
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(fill, windows): lengths with their counts, and for how many windows in a row."""
    counts = {length: n for length, n in counts.items() if n and length}
    while counts:
        longest = max(counts)
        rest = {length: n - (length == longest) for length, n in counts.items() if n - (length == longest)}
        fill = closest_fill(rest, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        windows = min(counts[length] // n for length, n in fill.items())
        yield fill, windows
        for length, n in fill.items():
            counts[length] -= n * windows
            if not counts[length]:
                del counts[length]


class UnitIds(dict):
    """Token ids, as little-endian bytes, of the runs of text that follow a space, and in heads of those that begin a
    text. The tokenizer's pre-tokens never reach over a space that follows a character other than white space, so
    texts can be encoded run by run; runs seen are remembered. New runs are encoded many at a time, as one text, which is cut
    where tokens begin with a space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.heads = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def learn(self, texts: list[list[str]]) -> None:
        """Makes sure that all runs of these texts are known."""
        new = {u for us in texts for u in us if u not in self}
        if len(self) + len(new) + len(self.heads) > _KNOWN_UNITS:
            self.clear()
            self.heads.clear()
            new = {u for us in texts for u in us}
        plain = [u for u in new if u and " " not in u and not u[-1].isspace()]
        for at in range(0, len(plain), _AT_ONCE):
            self._joined(plain[at : at + _AT_ONCE])
        self._each(self, [u for u in new if u not in self], " ")
        self._each(self.heads, list({us[0] for us in texts if us and us[0] not in self.heads}), "")

    def _joined(self, runs: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) == len(runs) and starts[0] == 0:  # else they are encoded one by one
            coded, ends = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            self.update(zip(runs, map(coded.__getitem__, map(slice, ends, ends[1:]))))

    def _each(self, known: dict, runs: list[str], before: str) -> None:
        for run, coded in zip(runs, self.tokenizer.encode_batch([before + r for r in runs], add_special_tokens=False)):
            known[run] = np.array(coded.ids, "<u4").tobytes()

    def ids(self, units: list[str]) -> bytes:
        return self.heads[units[0]] + b"".join(map(self.__getitem__, units[1:])) if units else b""


@lru_cache(maxsize=1)
def _units_of(path: str) -> UnitIds:
    """Kept by the worker from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitIds(path)


def units(text: str) -> list[str]:
    """The text cut at each space that follows a character other than white space; joined by spaces they are the text."""
    if not text:
        return []
    return _CUT.split(text) if text[0] == " " or any(map(text.__contains__, _GAPS)) else text.split(" ")


def _pieces(path: str, capacity: int, end: int) -> Callable:
    """(id, tokens, lengths, crcs) of each text: what its pieces are, cut every `capacity` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = _units_of(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 200):
                part = [units(t or "") for t in texts[at : at + 200]]
                known.learn(part)
                tokens, lengths, crcs = [], [], []
                for us in part:
                    ids = known.ids(us) + last
                    cuts = range(0, len(ids), 4 * capacity)
                    tokens.append(len(ids) // 4)
                    lengths.append([len(ids[c : c + 4 * capacity]) // 4 for c in cuts])
                    crcs.append([zlib.crc32(ids[c : c + 4 * capacity]) for c in cuts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, 200), pa.array(tokens, pa.int64()), pa.array(lengths, pa.list_(pa.int32())), pa.array(crcs, pa.list_(pa.int64()))],
                    names=["id", "tokens", "lengths", "crcs"],
                )

    return run


def _deal(capacity: int) -> Callable:
    """Puts the pieces of one group of documents into sequences numbered from 0."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("tokens", "ascending")])
        group = table.column("g")[0].as_py()
        ids, tokens = table.column("id").to_pylist(), table.column("tokens").to_pylist()
        lengths, crcs = table.column("lengths").to_pylist(), table.column("crcs").to_pylist()
        out, waiting, number = [], {}, 0
        for doc, total, ls, cs in zip(ids, tokens, lengths, crcs):
            for k, (length, crc) in enumerate(zip(ls, cs)):
                piece = (doc, k * capacity, length, crc, total)
                if length == capacity:
                    out.append((*piece, number, 0))
                    number += 1
                else:
                    waiting.setdefault(length, []).append(piece)
        for ps in waiting.values():
            ps.reverse()
        for fill, windows in plan({length: len(ps) for length, ps in waiting.items()}, capacity):
            for _ in range(windows):
                offset = 0
                for length in sorted(fill, reverse=True):
                    for _ in range(fill[length]):
                        out.append((*waiting[length].pop(), number, offset))
                        offset += length
                number += 1
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "number", "offset"]
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        return pa.Table.from_arrays([pa.array([group] * len(out), pa.int64()), *columns], names=["g", *names])

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end: int = 0, group_rows: int = 20_000) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each row's ids.

    Null and empty texts are their end id alone. Repeated rows and ids are packed each for itself; a null id stays
    null; extra columns are ignored; an empty table gives no rows. A group holds group_rows rows on average,
    whatever they are, as rows are dealt by id and length of text.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = scratch.save(rows.mapInArrow(_pieces(path, capacity, end), "id long, tokens long, lengths array<int>, crcs array<long>"), "pieces")
    groups = max(1, round(pieces.count() / group_rows))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("id", "tokens", "crcs"), F.lit(groups)))
    out = dealt.groupBy("g").applyInArrow(_deal(capacity), "g long, id long, start long, length long, ids_crc32 long, doc_tokens long, number long, offset long")
    return out.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("g") * F.lit(1 << 40) + F.col("number")).alias("sequence_id"), "offset")

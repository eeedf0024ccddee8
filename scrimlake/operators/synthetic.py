"""Synthetic values of a session, no two of which are equal, and their restoration in any text of the session.

A value's number within its session and type goes through a permutation of the eight-digit numbers that the session and a seed
choose, so unlike values of a session never get one synthetic value. Restoring looks for all of a session's synthetic values at once, with an
Aho-Corasick automaton: of matches the leftmost, then the longest counts, and what is put back isn't searched again.
"""

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrimlake.operators.anonymize import placeholder

#: The permutation is a Feistel network on two halves of four digits.
HALF = 10_000
ROUNDS = 4


def scrambled(number: Column, session: Column, seed: int = 42) -> Column:
    """A permutation of 0 to 99,999,999, one for each session and seed."""
    left, right = F.floor(number / HALF).cast("long") % HALF, number.cast("long") % HALF
    for k in range(ROUNDS):
        key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), session.cast("string"))), 1, 7), 16, 10).cast("long")
        mixed = F.shiftright((right * 40503 + key) * 2654435 + key, 16) % HALF
        left, right = right, (left + mixed) % HALF
    return left * HALF + right


def session_value(session: Column, ptype: Column, number: Column, original: Column, seed: int = 42) -> Column:
    """The synthetic phone or mail address of a session's value; other types keep their placeholder. A phone keeps its first three digits."""
    digits = F.lpad(scrambled(number, session, seed).cast("string"), 8, "0")
    phone = F.concat(F.left(F.regexp_replace(original, "[^0-9]", ""), F.lit(3)), digits)
    return F.when(ptype == "PHONE", phone).when(ptype == "EMAIL", F.concat(F.lit("user"), digits, F.lit("@example.com"))).otherwise(placeholder(ptype, number))


def put_back(text: str, values: ahocorasick.Automaton) -> tuple[str, int]:
    """The text with its matches' originals, and how many there are."""
    found = sorted((end + 1 - size, -size, original) for end, (size, original) in values.iter(text))
    out, at, n = [], 0, 0
    for start, size, original in found:
        if start >= at:
            out += (text[at:start], original)
            at, n = start - size, n + 1
    return "".join(out) + text[at:], n


def _restored(session: str, order: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, ready = None, None, False
        for batch in batches:
            rows, texts, counts = [], [], []
            sessions = batch.column(session).to_pylist()
            for i, (key, salt, synthetic, value) in enumerate(zip(sessions, *[batch.column(c).to_pylist() for c in ("_salt", "_synthetic", "_text")])):
                if (key, salt) != now:
                    now, values, ready = (key, salt), ahocorasick.Automaton(), False
                if synthetic is not None:
                    values.add_word(synthetic, (len(synthetic), value))
                    continue
                if not ready:
                    values.make_automaton()
                    ready = True
                text, n = put_back(value, values) if value and len(values) else (value, 0)
                rows.append(i)
                texts.append(text)
                counts.append(n)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(session).take(at), batch.column(order).take(at), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], schema=schema)

    return run


def restore_sessions(texts: DataFrame, mapping: DataFrame, session_col: str, order_col: str, text_col: str, together: int = 10_000) -> DataFrame:
    """(session, order, restored, n_restored) of texts, with the synthetic values of their session's mapping (original, placeholder) put back.

    A task reads a session's values, then its texts, one after the other. A session of over `together` texts is dealt in so many parts, each with
    the session's values. Null texts stay null; texts of a session without values, or of a null session, stay as they are. Of equal synthetic values the least original counts.
    """
    parts = texts.groupBy(session_col).agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64(order_col, text_col), "_parts").cast("int")
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    held = texts.where(F.col(session_col).isNotNull()).join(parts, session_col).select(session_col, part.alias("_salt"), order_col, F.lit(None).cast("string").alias("_synthetic"), F.col(text_col).alias("_text"))
    known = mapping.groupBy(session_col, F.col("placeholder").alias("_synthetic")).agg(F.min("original").alias("_text")).where("_synthetic <> ''")
    known = known.join(parts, session_col).select(session_col, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"), F.lit(None).cast(kinds[order_col]).alias(order_col), "_synthetic", "_text")
    rows = known.unionByName(held).repartition(session_col, "_salt").sortWithinPartitions(session_col, "_salt", F.asc_nulls_last("_synthetic"))
    made = f"{session_col} {kinds[session_col]}, {order_col} {kinds[order_col]}, restored string, n_restored int"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = rows.mapInArrow(_restored(session_col, order_col, to_arrow_schema(StructType.fromDDL(made))), made)
    alone = texts.where(F.col(session_col).isNull()).select(session_col, order_col, F.col(text_col).alias("restored"), F.lit(0).cast("int").alias("n_restored"))
    return out.unionByName(alone)

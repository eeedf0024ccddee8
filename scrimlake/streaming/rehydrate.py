"""Placeholders restored in chunked streams: what a chunk's end may have cut is held back until the rest arrives."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_WHOLE = re.compile(r"<[A-Z_]+_[0-9]+>")
_BEGUN = re.compile(r"<(?:[A-Z][A-Z_]*(?:_[0-9]*)?)?$")
MOST_HELD = 50


def safe_part(buffer: str) -> int:
    """How many characters of the buffer can go out: all before a last token that isn't whole yet."""
    at = buffer.rfind("<")
    return at if at >= 0 and _BEGUN.match(buffer, at) and len(buffer) - at <= MOST_HELD else len(buffer)


def restore(text: str, originals: dict[str, str]) -> str:
    return _WHOLE.sub(lambda m: originals.get(m[0], m[0]), text)


def restored_stream(chunks: DataFrame, wait: str = "ProcessingTimeTimeout", wait_ms: int = 60_000) -> DataFrame:
    """(stream_id, seq, out) from a streaming DataFrame (stream_id, seq, chunk, done, originals: map of placeholders).

    State for a stream is the held buffer, the last seq and the originals. Chunks of a batch are taken by seq;
    one that comes after a later one is dropped. A row with done, or wait_ms without one unless
    wait is NoTimeout, sends out what is held.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, last, names = state.get if state.exists else ("", -1, {})
        out = []
        if state.hasTimedOut:
            out.append((last + 1, restore(buffer, names)))
            state.remove()
        else:
            rows, done = pd.concat(list(batches)).sort_values("seq"), False
            for seq, chunk, end, originals in zip(rows["seq"], rows["chunk"], rows["done"], rows["originals"]):
                if seq <= last:
                    continue
                names = names or dict(originals or {})
                last, buffer = int(seq), buffer + (chunk or "")
                cut = len(buffer) if end else safe_part(buffer)
                out.append((last, restore(buffer[:cut], names)))
                buffer, done = buffer[cut:], done or bool(end)
            if done:
                state.remove()
            else:
                state.update((buffer, last, names))
                if wait != "NoTimeout":
                    state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "seq": [s for s, _ in out], "out": [t for _, t in out]})

    kind = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {kind}, seq long, out string", "buffer string, last long, names map<string,string>", "append", getattr(GroupStateTimeout, wait))


def chunked(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(stream_id, seq, chunk, done): each text cut into pieces of `size` characters."""
    pieces = F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    cut = df.select(F.col(key).alias("stream_id"), F.size(pieces).alias("n"), F.posexplode(pieces).alias("seq", "chunk"))
    return cut.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") == F.col("n") - 1).alias("done"))


def usage_windows(events: DataFrame, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests of a stream of events (ts, key) by tumbling window, with late events up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), key).agg(F.count(F.lit(1)).alias("used")).select(key, F.col("w.start").alias("window_start"), "used")

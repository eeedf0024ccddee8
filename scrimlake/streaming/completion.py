"""Streamed completions with state that expires.

A request's mapping and the chunks of its answer come as events of one stream, in any order and micro-batch. State for a
request holds the mapping's names, the chunks whose turn hasn't come, the text held back because a placeholder may be cut, and when the mapping
expires. Chunks are let out by number, each once; a placeholder is put back when it is whole. Each chunk that is let out prolongs the mapping's
life, at most once in `every`. With the last chunk the state goes; without one it goes when the watermark (or, by the
processing clock, the time) passes its end, by a timer.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from scrimlake.streaming.rehydrate import restore, safe_part

#: Where the state of these processors is kept.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EVENT = "tenant_id string, request_id string, seq long, chunk string, done boolean, names map<string,string>, at timestamp"
RELEASED = "tenant_id string, request_id string, seq long, out string, event string"


class _Completion(StatefulProcessor):
    def __init__(self, ttl_ms: int, every_ms: int, by_event: bool):
        self.ttl_ms, self.every_ms, self.by_event = ttl_ms, every_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "placeholder string", "original string")
        self.early = handle.getMapState("early", "seq long", "chunk string, done boolean")
        self.place = handle.getValueState("place", "turn long, held string, prolonged long, ends long")

    def _until(self, ends: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ends)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        turn, held, prolonged, ends = self.place.get() if self.place.exists() else (-1, "", 0, 0)
        ended = ends
        names = None
        for row in sorted(rows, key=lambda r: r.seq):
            now = int(row.at.timestamp() * 1000) if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            if not ended:
                prolonged, ends, ended = now, now + self.ttl_ms, -1
            if row.seq < turn or turn >= 0 and row.seq < 0:
                continue  # sent again
            if row.seq < 0:
                for placeholder, original in dict(row.names or {}).items():  # Arrow hands a map over as its pairs
                    self.names.updateValue((placeholder,), (original,))
                turn = 0
            else:
                self.early.updateValue((row.seq,), (row.chunk or "", bool(row.done)))
            while turn >= 0 and self.early.containsKey((turn,)):
                if names is None:
                    names = {k[0]: v[0] for k, v in self.names.iterator()} if self.names.exists() else {}
                if now - prolonged > self.every_ms:
                    prolonged, ends = now, max(ends, now + self.ttl_ms)
                chunk, done = self.early.getValue((turn,))
                self.early.removeKey((turn,))
                held += chunk
                cut = len(held) if done else safe_part(held)
                yield Row(tenant_id=key[0], request_id=key[1], seq=turn, out=restore(held[:cut], names), event="stop" if done else "text")
                held, turn = held[cut:], turn + 1
                if done:
                    self._gone()
                    return
        if ends != ended:
            self._until(ends)
        self.place.update((turn, held, prolonged, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        """What is held goes out as it is, chunks that wait for earlier ones included, as the names are no longer known."""
        turn, held, *_ = self.place.get() if self.place.exists() else (0, "")
        waiting = sorted((k[0], v[0]) for k, v in self.early.iterator()) if self.early.exists() else []
        yield Row(tenant_id=key[0], request_id=key[1], seq=max(turn, 0), out=held + "".join(c for _, c in waiting), event="expired")
        self._gone()

    def _gone(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        for state in (self.names, self.early, self.place):
            state.clear()

    def close(self) -> None:
        pass


def completions(events: DataFrame, ttl: int = 3600, every: int = 60, late: str = "10 minutes", clock: str = "event") -> DataFrame:
    """(tenant_id, request_id, seq, out, event) from a stream of EVENT rows: the mapping has seq -1 and names, chunks count from 0.

    out is the text that chunk seq lets out; event is text, stop with the last one, or expired. Events that come again change
    nothing. ttl and every are seconds; clock is event, with a watermark of `late` on `at`, or processing.
    """
    by_event = clock == "event"
    rows = events.withWatermark("at", late) if by_event else events
    processor = _Completion(ttl * 1000, every * 1000, by_event)
    return rows.groupBy("tenant_id", "request_id").transformWithState(processor, RELEASED, "append", "EventTime" if by_event else "ProcessingTime")


def started(spark: SparkSession, writer: DataStreamWriter):
    """Starts the writer's query with state in RocksDB, which such processors need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, PROVIDER)
    try:
        return writer.start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def whole_answers(released: DataFrame) -> DataFrame:
    """(tenant_id, request_id, restored, event): the parts of each request in order; an answer is one row."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "out")))
    joined = released.groupBy("tenant_id", "request_id").agg(parts.alias("p"), F.max_by("event", "seq").alias("event"))
    return joined.select("tenant_id", "request_id", F.array_join(F.transform("p", lambda x: x["out"]), "").alias("restored"), "event")


def admitted(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """requests (tenant_id, request_id, at, should_block) with code: quota_exceeded from a tenant's quota on, in order of time and id, else secret_blocked, else null.

    limits: tenant_id, quota; without one all are admitted. A request's place is counted within hours first, then the
    counts of the hours before are added, so that no task orders all of a tenant's requests. A request that has no quota left isn't looked at for secrets.
    """
    from pyspark.sql import Window

    hour = requests.withColumn("_hour", F.date_trunc("hour", "at"))
    counts = hour.groupBy("tenant_id", "_hour").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("tenant_id", "_hour", (F.sum("n").over(Window.partitionBy("tenant_id").orderBy("_hour")) - F.col("n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("tenant_id", "_hour").orderBy("at", "request_id"))
    placed = hour.withColumn("_place", place).join(before, ["tenant_id", "_hour"]).join(limits.select("tenant_id", "quota"), "tenant_id", "left")
    over = F.coalesce(F.col("_place") + F.col("_before") > F.col("quota"), F.lit(False))
    code = F.when(over, "quota_exceeded").when(F.col("should_block"), "secret_blocked")
    return placed.withColumn("code", code).drop("_hour", "_place", "_before", "quota")

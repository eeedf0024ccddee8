"""A token bucket over a stream: events wait until the watermark has passed them, so that each key's are taken in order of time."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scrimlake.operators.usage import refill


class _Bucket(StatefulProcessor):
    def __init__(self, key: str, order: str, kind: str, rate: float, burst: float):
        self.key, self.order, self.kind, self.rate, self.burst = key, order, kind, rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"t long, e {self.kind}")
        self.level = handle.getValueState("level", "tokens double, last long")

    def _next(self, when_us: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-when_us // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        new = [(r.t, r.e) for r in rows]
        self.waiting.appendList(new)
        first, timers = min(t for t, _ in new), list(self.handle.listTimers())
        if not timers or -(-first // 1000) < min(timers):
            self._next(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in waiting if x[0] <= passed], [x for x in waiting if x[0] > passed]
        tokens, last = self.level.get() if self.level.exists() else (self.burst, due[0][0] if due else 0)
        for t, e in due:
            ok, tokens = refill(tokens, last / 1e6, t / 1e6, self.rate, self.burst)
            last = t
            yield Row(**{self.key: key[0], self.order: e, "admitted": bool(ok), "tokens_left": round(tokens, 6)})
        full = last + int(self.burst / self.rate * 1e6) + 1_000_000
        if not later and passed >= full:  # a full bucket is that of a new key
            self.level.clear()
            self.waiting.clear()
            return
        self.level.update((tokens, last))
        self.waiting.put(later) if later else self.waiting.clear()
        self._next(later[0][0] if later else full)

    def close(self) -> None:
        pass


def token_bucket_stream(events: DataFrame, key: str, rate: float, burst: float, order: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """(key, order, admitted, tokens_left) of a stream of events (key, order, ts), as usage.token_bucket() gives them, each once the watermark has passed it.

    State for a key is its tokens and the events that wait; it goes when the bucket is full again and none waits. The query needs the state
    store of completion.started(). Events later than the watermark are dropped; those without a time too.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    timed = events.where("ts is not null").select(F.col(key), F.col(order).alias("e"), F.col("ts").cast("timestamp").alias("at")).withColumn("t", F.unix_micros("at")).withWatermark("at", late)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean, tokens_left double"
    return timed.groupBy(key).transformWithState(_Bucket(key, order, kinds[order], rate, burst), schema, "append", "EventTime")


def requests_with_errors(requests: DataFrame, errors: DataFrame, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Each request of a stream with each of the user's errors that comes at most `within` after it: (user_id, request_event, request_ts, error_event, error_ts).

    Both streams (event_id, user_id, ts) have a watermark, so a request is kept only as long as an error for it may come.
    """
    r = requests.select("user_id", F.col("event_id").alias("request_event"), F.col("ts").alias("request_ts")).withWatermark("request_ts", late)
    e = errors.select(F.col("user_id").alias("_user"), F.col("event_id").alias("error_event"), F.col("ts").alias("error_ts")).withWatermark("error_ts", late)
    near = (F.col("user_id") == F.col("_user")) & (F.col("error_ts") >= F.col("request_ts")) & (F.col("error_ts") <= F.col("request_ts") + F.expr(f"INTERVAL {within}"))
    return r.join(e, near).drop("_user")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, began, ended, n): the key's events (ts) without a gap of over `gap`; ended is the gap's end. Batch or stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")

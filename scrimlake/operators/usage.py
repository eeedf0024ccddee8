"""Usage accounting: quotas, rate limits, a token bucket, cache look-ups, rolling and percentile metrics."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrimlake.sources import shared

PERIODS = {"hourly": "hour", "daily": "day", "monthly": "month"}


def quota_usage(events: DataFrame) -> DataFrame:
    """tenant_id, period, window_start, used: events by tumbling UTC window; events has tenant_id and ts."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.date_trunc(unit, "ts").alias("window_start")) for p, unit in PERIODS.items()]))
    return events.select("tenant_id", each.alias("w")).groupBy("tenant_id", "w.period", "w.window_start").agg(F.count(F.lit(1)).alias("used")).select("tenant_id", "period", "window_start", "used")


def check_quota(usage: DataFrame, limits: DataFrame, amount: int = 1) -> DataFrame:
    """Adds allowed and warn. limits: tenant_id, period, quota, soft_percent; without a limit all is allowed."""
    joined = usage.join(limits, ["tenant_id", "period"], "left")
    soft = F.floor(F.col("quota") * F.col("soft_percent") / 100)
    allowed = F.coalesce(F.col("used") + amount <= F.col("quota"), F.lit(True))
    return joined.withColumn("allowed", allowed).withColumn("warn", F.coalesce(F.col("used") + amount > soft, F.lit(False)) & allowed)


def fixed_window(events: DataFrame, key: str, most: int, window: str = "1 minute") -> DataFrame:
    """key, window_start, requests, admitted: at most so many a window."""
    counted = events.groupBy(key, F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(key, F.col("w.start").alias("window_start"), "requests", F.least("requests", F.lit(most).cast("long")).alias("admitted"))


def refill(tokens: float, last: float, now: float, rate: float, burst: float) -> tuple[bool, float]:
    """Whether a request at `now` is admitted, and the tokens left after it."""
    tokens = min(burst, tokens + max(0.0, now - last) * rate)
    ok = tokens >= 1
    return ok, tokens - ok


def token_bucket(events: DataFrame, key: str, rate: float, burst: float, order: str = "event_id", parts: int | None = None, path: str | None = None) -> DataFrame:
    """(key, order, admitted, tokens_left): a bucket for each key refills at rate a second up to burst, a request takes one.

    After a gap of burst / rate seconds a bucket is full whatever it was, so a key's events are cut there into segments, which are folded
    apart, each in order by one task, with one bucket in memory at a time. The cuts are found in ranges of (key, time), of which each gets the
    last time of the one before it. A key that is never idle for so long is one segment. A null key is a key.
    """
    rows = events.select(F.col(key).alias("p"), F.struct(F.col("ts").cast("timestamp").cast("double").alias("t"), F.col(order).alias("e")).alias("o"))
    rows = ranged(rows, path or shared.folder(events.sparkSession), parts)
    by = Window.partitionBy("p").orderBy("g")
    ends = rows.groupBy("p", "g").agg(F.max("o.t").alias("last"))
    ends = ends.select(F.col("p").alias("cp"), F.col("g").alias("cg"), F.lag("last").over(by).alias("handed"))  # a row for each range
    rows = rows.join(ends, F.col("p").eqNullSafe(F.col("cp")) & (F.col("g") == F.col("cg"))).select("p", "g", "o", "handed")
    within = Window.partitionBy("p", "g").orderBy("o")
    before = F.coalesce(F.lag("o.t").over(within), "handed")
    cut = F.when(before.isNull() | ((F.col("o.t") - before) * rate >= burst), 1).otherwise(0)
    rows = rows.withColumn("cut", cut).withColumn("cuts", F.sum("cut").over(within))
    sums = rows.groupBy("p", "g").agg(F.sum("cut").alias("n"))
    sums = sums.select(F.col("p").alias("cp"), F.col("g").alias("cg"), (F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("earlier"))
    rows = rows.join(sums, F.col("p").eqNullSafe(F.col("cp")) & (F.col("g") == F.col("cg")))
    rows = rows.select(F.col("p").alias(key), F.col("o.e").alias(order), F.col("o.t").alias("_t"), (F.col("earlier") + F.col("cuts")).alias("_segment"))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {order} {rows.schema[order].dataType.simpleString()}, admitted boolean, tokens_left double"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, tokens = None, 0.0, burst
        for batch in batches:
            admitted, left = [], []
            for k, segment, t in zip(*[batch.column(c).to_pylist() for c in (key, "_segment", "_t")]):
                if (k, segment) != now:
                    now, last, tokens = (k, segment), t, burst
                ok, tokens = refill(tokens, last, t, rate, burst)
                last = t
                admitted.append(ok)
                left.append(round(tokens, 6))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), pa.array(admitted), pa.array(left, pa.float64())], names=[key, order, "admitted", "tokens_left"])

    return rows.repartition(key, "_segment").sortWithinPartitions(key, "_segment", "_t", order).mapInArrow(fold, schema)


def newest(entries: DataFrame, partition: list[str], order: list, keep: int) -> DataFrame:
    """Eviction: the newest so many of each partition."""
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def cache_lookup(requests: DataFrame, cache: DataFrame, now) -> DataFrame:
    """requests with hit: whether an entry of the same tenant and key lives. Null expires_at never expires."""
    live = cache.where(F.col("expires_at").isNull() | (now <= F.col("expires_at"))).select("tenant_id", "key").distinct().withColumn("hit", F.lit(True))
    return requests.join(live, ["tenant_id", "key"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def ranged(rows: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """rows (p, o, ...) dealt by ranges of (p, o), so that a large p is in many of them, and written under path with g, the range's number."""
    dealt = rows.repartitionByRange(parts, "p", "o") if parts else rows.repartitionByRange("p", "o")
    return shared.written(dealt.withColumn("g", F.spark_partition_id()), f"{path}/ranges")


def rolling(df: DataFrame, partition: str, order: str, value: str, size: int = 100, parts: int | None = None, path: str | None = None) -> DataFrame:
    """(partition, order, rolling_avg, rolling_max, n) of each row's value and those of the size - 1 rows before it in the partition's order.

    Rows are in ranges of (partition, order). A range's windows need no other rows than its own and the size - 1 before them, which it gets
    from the range before it or, where that has fewer, from several. Ties of order are in no fixed order; a null partition is one.
    """
    rows = ranged(df.select(F.col(partition).alias("p"), F.col(order).alias("o"), F.col(value).alias("v")), path or shared.folder(df.sparkSession), parts)
    counts = rows.groupBy("p", "g").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.withColumn("before", F.sum("m").over(Window.partitionBy("p").orderBy("g")) - F.col("m"))  # a row for each range
    last = rows.withColumn("back", F.row_number().over(Window.partitionBy("p", "g").orderBy(F.desc("o")))).where(F.col("back") < size)
    own = counts.toDF("cp", "cg", "m", "before")
    placed = last.join(own, F.col("p").eqNullSafe(F.col("cp")) & (F.col("g") == F.col("cg"))).select("p", "g", "o", "v", (F.col("before") + F.col("m") - F.col("back") + 1).alias("rank"))
    # rows go to the ranges that begin less than size rows after them, found by hundreds or so
    near = F.floor(F.col("rank") / size)
    placed = placed.withColumn("b", F.explode(F.array(near, near + 1)))
    later = counts.select(F.col("p").alias("cp"), F.col("g").alias("to"), "before", F.floor(F.col("before") / size).alias("cb"))
    handed = placed.join(later, F.col("p").eqNullSafe(F.col("cp")) & (F.col("b") == F.col("cb"))).where((F.col("to") > F.col("g")) & (F.col("before") - F.col("rank") < size - 1))
    both = rows.select("p", "g", "o", "v", F.lit(True).alias("own")).unionByName(handed.select("p", F.col("to").alias("g"), "o", "v", F.lit(False).alias("own")))
    w = Window.partitionBy("p", "g").orderBy("o").rowsBetween(1 - size, 0)
    out = both.select("p", "o", "own", F.round(F.avg("v").over(w), 6).alias("rolling_avg"), F.max("v").over(w).alias("rolling_max"), F.count("v").over(w).alias("n"))
    return out.where("own").select(F.col("p").alias(partition), F.col("o").alias(order), "rolling_avg", "rolling_max", "n")


def anchored_hours(events: DataFrame, path: str | None = None, seconds: int = 3600, slot: int = 60) -> DataFrame:
    """(tenant_id, window_start, used): windows that begin with the first event after the one before has ended, `seconds` after its own begin, which still belongs to it.

    Each moment with events is linked to the first moment after its window would end. The begins are the moments that the chain of links from a
    tenant's first moment goes through; they are found by doubling: links of 1, 2, 4, ... steps are joined with themselves and with the begins so far, so that a chain of
    n windows takes log2(n) joins and no task walks along a tenant's events. A link is looked up among the moments of one slot of
    `slot` seconds, or is the first moment of the next slot that has any. Null tenants are a tenant; events without a time don't count.
    """
    spark = events.sparkSession
    path = path or shared.folder(spark)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    moments = events.where("ts is not null").groupBy(F.to_json(F.struct("tenant_id")).alias("p"), F.col("tenant_id"), at.alias("t")).agg(F.count(F.lit(1)).alias("m"))
    moments = shared.written(moments, f"{path}/moments")
    micros, span = slot * 1_000_000, seconds * 1_000_000
    slot_of = lambda t: F.floor(t / micros).cast("long")
    slots = moments.groupBy("p", slot_of(F.col("t")).alias("s")).agg(F.min("t").alias("first"))
    slots = shared.written(slots, f"{path}/slots")
    # the next slot with moments after any slot that a window may end in
    ends = moments.select("p", slot_of(F.col("t") + span + 1).alias("s")).distinct()
    after = Window.partitionBy("p").orderBy("s").rowsBetween(1, Window.unboundedFollowing)
    all_slots = slots.unionByName(ends.withColumn("first", F.lit(None).cast("long"))).groupBy("p", "s").agg(F.min("first").alias("first"))
    following = all_slots.select("p", "s", F.min("first").over(after).alias("next"))
    probes = moments.select("p", "t", (F.col("t") + span + 1).alias("at"), F.lit(True).alias("asks")).unionByName(moments.select("p", "t", F.col("t").alias("at"), F.lit(False).alias("asks")))
    within = Window.partitionBy("p", "s").orderBy("at", F.desc("asks")).rowsBetween(0, Window.unboundedFollowing)
    probes = probes.withColumn("s", slot_of(F.col("at"))).withColumn("found", F.min(F.when(~F.col("asks"), F.col("at"))).over(within))
    links = probes.where("asks").join(following, ["p", "s"], "left").select("p", "t", F.coalesce("found", "next").alias("to")).where("to is not null")
    links = shared.written(links, f"{path}/links0")
    begins = shared.written(moments.groupBy("p").agg(F.min("t").alias("t")), f"{path}/begins0")
    turn, n = 0, begins.count()
    while True:
        more = begins.join(links, ["p", "t"]).select("p", F.col("to").alias("t"))
        begins = shared.written(begins.unionByName(more).distinct(), f"{path}/begins{turn + 1}")
        if (now := begins.count()) == n:
            break
        n, turn = now, turn + 1
        links = shared.written(links.join(links.toDF("p", "to", "on"), ["p", "to"]).select("p", "t", F.col("on").alias("to")), f"{path}/links{turn}")
    big = lambda t: F.floor(t / span).cast("long")
    known = begins.select("p", F.col("t").alias("b"), F.explode(F.array(big(F.col("t")), big(F.col("t")) + 1)).alias("h"))  # a window reaches into the next span at most
    of = moments.withColumn("h", big(F.col("t"))).join(known, ["p", "h"]).where("b <= t").groupBy("p", "tenant_id", "t", "m").agg(F.max("b").alias("b"))
    return of.groupBy("tenant_id", "b").agg(F.sum("m").alias("used")).select("tenant_id", F.timestamp_micros("b").alias("window_start"), "used")


def percentiles(df: DataFrame, key: str, value: str, buckets: int = 64) -> DataFrame:
    """min, max, avg, p50 (mean of two), and p95, p99 as the element int(n * q) from 0 of the values in order.

    Values are counted first. Distinct values are then ranked within `buckets` ranges of a key's values, each after the
    counts of the ranges before it, so that no task sorts all values of a key. Null values don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("m"))
    whole = counts.groupBy(F.col(key).alias("_k")).agg(F.sum("m").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.sum(F.col(value) * F.col("m")) / F.sum("m"), 6).alias("avg"))
    placed = counts.join(whole, F.col(key).eqNullSafe(F.col("_k")))
    share = (F.col(value) - F.col("min")) / (F.col("max") - F.col("min"))
    placed = placed.withColumn("b", F.when(F.col("max") > F.col("min"), F.floor(share * (buckets - 1))).otherwise(0))
    ranges = placed.groupBy("_k", "b").agg(F.sum("m").alias("of"))
    ranges = ranges.select(F.col("_k").alias("_k2"), F.col("b").alias("b2"), (F.sum("of").over(Window.partitionBy("_k").orderBy("b")) - F.col("of")).alias("before"))
    ranked = placed.join(ranges, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("b") == F.col("b2")))
    ranked = ranked.withColumn("end", F.col("before") + F.sum("m").over(Window.partitionBy("_k", "b").orderBy(value)))
    holds = lambda at: (F.col("end") - F.col("m") <= at) & (at < F.col("end"))
    at = lambda r: F.max(F.when(holds(r), F.col(value)))
    of = lambda q: F.floor(F.col("n") * q).cast("long")
    found = ranked.groupBy("_k", "n", "min", "max", "avg").agg(F.round((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2, 6).alias("p50"), at(of(0.95)).alias("p95"), at(of(0.99)).alias("p99"))
    return found.select(F.col("_k").alias(key), "n", "min", "max", "avg", "p50", "p95", "p99")


def histogram(df: DataFrame, key: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts: one row for each key and bound."""
    counts = df.groupBy(key).agg(*[F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)])
    return counts.select(key, F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)])).alias("h")).select(key, "h.le", "h.n")

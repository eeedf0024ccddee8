"""Registered queries: limits and joins over streams, sinks that may be tried again, secrets within JSON."""

from datetime import timedelta

from pyspark.sql import functions as F

from scrimlake.operators import secrets
from scrimlake.plans.catalog import ORACLES, _PREVIEW, _secret_sql, _table, query
from scrimlake.sources import audit_log, shared
from scrimlake.streaming import completion, limits, sinks


def _dealt(df, folder: str, name: str, files: int = 12):
    """The rows as files in no order of their own, read as a stream a few files at a time."""
    df.repartition(files, F.xxhash64(*df.columns)).write.parquet(f"{folder}/{name}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // 3)).parquet(f"{folder}/{name}")


def _ended(spark, df, folder: str, **options):
    """The rows that a streaming DataFrame has given once its sources are read and the watermark has passed all of them."""
    out = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    completion.started(spark, out).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _last_watermark(df, columns: dict):
    """A row of far later time, by which the watermark passes all others; it is in the last file that is read."""
    return df.sparkSession.range(1).select(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])


@query(ORACLES["token_bucket"])
def token_bucket_stream(spark, sf_dir):
    """Every user's bucket over a stream whose events come out of order."""
    folder = shared.folder(spark)
    events = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    _dealt(events, folder, "in")
    run = lambda: _ended(spark, limits.token_bucket_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in"), "user_id", 0.00001, 5.0, late="3650 days"), folder)
    run()
    _last_watermark(events, {"ts": F.lit("2100-01-01"), "user_id": F.lit(-1), "event_id": F.lit(-1)}).write.mode("append").parquet(f"{folder}/in")
    return run().where("user_id <> -1")


@query("""SELECT r.user_id, r.event_id AS request_event, r.ts::TIMESTAMP AS request_ts, e.event_id AS error_event, e.ts::TIMESTAMP AS error_ts FROM events r JOIN events e
ON r.user_id = e.user_id AND r.event_type = 'purchase' AND e.event_type = 'error' AND e.ts >= r.ts AND e.ts <= r.ts + INTERVAL 12 HOUR""")
def request_errors_stream(spark, sf_dir):
    """Requests with the user's errors in the twelve hours after them, both streams."""
    folder = shared.folder(spark)
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    sides = [_dealt(events.where(F.col("event_type") == kind).drop("event_type"), folder, kind) for kind in ("purchase", "error")]
    return _ended(spark, limits.requests_with_errors(*sides, within="12 hours", late="3650 days"), folder)


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, TRUE) AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, count(*) FILTER (cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts)::TIMESTAMP AS began, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions_stream(spark, sf_dir):
    """Every user's sessions, as a stream lets them out."""
    folder = shared.folder(spark)
    events = _table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    _dealt(events, folder, "in")
    run = lambda: _ended(spark, limits.sessions(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in"), "user_id", "6 hours", late="3650 days"), folder)
    run()
    _last_watermark(events, {"ts": F.lit("2100-01-01"), "user_id": F.lit(-1)}).write.mode("append").parquet(f"{folder}/in")
    return run().where("user_id <> -1")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, 'm' || o_custkey % 7 AS tenant_id, 'k' || o_custkey % 500 AS key, o_orderdate::TIMESTAMP AS created_at FROM orders),
l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY tenant_id, key ORDER BY created_at DESC, o_orderkey DESC) = 1)
SELECT tenant_id, key, o_orderkey FROM l QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, o_orderkey DESC, key) <= 40""")
def cache_put_stream(spark, sf_dir):
    """The cache after orders were put in by micro-batches in order of time, each tenant's 40 newest kept; the last batch is put in twice."""
    folder = shared.folder(spark)
    orders = _table(spark, sf_dir, "orders")
    created = F.col("o_orderdate").cast("timestamp")
    entries = orders.select(F.concat(F.lit("m"), F.col("o_custkey") % 7).alias("tenant_id"), F.concat(F.lit("k"), F.col("o_custkey") % 500).alias("key"), "o_orderkey", created.alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    entries = shared.written(entries, f"{folder}/entries")
    cuts = [0.0, 0.3, 0.6, 1.0]
    low, high = entries.agg(F.min(F.unix_seconds("created_at")), F.max(F.unix_seconds("created_at"))).first()
    sink = lambda batch, i: sinks.cache_batch(batch, i, f"{folder}/cache", 40, ("o_orderkey",))
    for a, b in zip(cuts, cuts[1:]):
        part = F.unix_seconds("created_at").between(low + (high - low) * a + (1 if a else 0), low + (high - low) * b)
        entries.where(part).write.mode("append").parquet(f"{folder}/in")
        sinks.into(spark.readStream.schema(entries.schema).parquet(f"{folder}/in"), sink, f"{folder}/state", availableNow=True).awaitTermination()
    sink(entries.where(part), sinks.versions(spark, f"{folder}/cache")[-1])
    return sinks.cache_now(spark, f"{folder}/cache", entries.schema).select("tenant_id", "key", "o_orderkey")


_DAY_EVENTS = "SELECT event_id::VARCHAR AS event_id, event_type, ts::DATE AS event_date FROM events"


@query(_DAY_EVENTS)
def audit_stream_once(spark, sf_dir):
    """Events written by micro-batches, one of them a second time, and read back: each is there once."""
    folder = shared.folder(spark)
    events = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("ts").cast("timestamp").alias("timestamp"))
    seen = []

    def sink(batch, i):
        sinks.audit_batch(batch, i, f"{folder}/audit")
        if not seen:  # as if the first try had been written but not noted down
            sinks.audit_batch(batch, i, f"{folder}/audit")
            seen.append(i)

    sinks.into(_dealt(events, folder, "in"), sink, f"{folder}/state", availableNow=True).awaitTermination()
    return sinks.audit_events(spark, f"{folder}/audit", "event_id string, event_type string, timestamp timestamp").select("event_id", "event_type", "event_date")


@query("SELECT event_id::VARCHAR AS event_id, rotation FROM events, (VALUES ('daily'), ('weekly'), ('monthly')) r(rotation) WHERE ts BETWEEN (SELECT date_trunc('day', min(ts)) + INTERVAL 5 DAY FROM events) AND (SELECT date_trunc('day', min(ts)) + INTERVAL 20 DAY FROM events)")
def audit_files_range(spark, sf_dir):
    """Events written as files of each rotation and read back for fifteen days: only the files of those days are opened."""
    folder = shared.folder(spark)
    events = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("timestamp"))
    first = events.agg(F.date_trunc("day", F.min("timestamp"))).first()[0]
    out = None
    for rotation in ("daily", "weekly", "monthly"):
        audit_log.write_files(events, f"{folder}/{rotation}", rotation)
        found = audit_log.read_files(spark, f"{folder}/{rotation}", first + timedelta(days=5), first + timedelta(days=20), rotation)
        found = found.select("event_id", F.lit(rotation).alias("rotation"))
        out = found if out is None else out.unionByName(found)
    return out


# ---- secrets within JSON

_JSON = """(SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || ', "user": {"id": ' || user_id || ', "notes": ["plain", {"key": "AKIA' || upper(left(md5(event_id::VARCHAR), 16)) || '"}, ["password = p' || event_id || '"]]}, "url": "redis://h/' || event_id || '", "none": null}' AS j FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, props FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'not json ' || event_id FROM events WHERE event_id % 3 = 2)"""
_STRINGS = f"(SELECT event_id, replace(replace(fullkey, '\"', ''), chr(0), '') AS path, atom ->> '$' AS value FROM (SELECT event_id, j FROM {_JSON} WHERE json_valid(j)), json_tree(j) WHERE type = 'VARCHAR')"
_JSON_SQL = _secret_sql().replace("FROM documents", f"FROM (SELECT event_id || '|' || path AS doc_id, value AS text FROM {_STRINGS})")


@query(f"SELECT split_part(doc_id, '|', 1)::BIGINT AS event_id, split_part(doc_id, '|', 2) AS path, name, secret_type, risk, start, \"end\", {_PREVIEW} AS preview FROM ({_JSON_SQL})")
def secret_json_paths(spark, sf_dir):
    """Secrets in the strings of JSON properties, some of which keys are put into, with their paths."""
    events = _table(spark, sf_dir, "events")
    e, s = F.col("event_id").cast("string"), F.lit
    full = F.concat(s('{"k": '), F.get_json_object("props", "$.k"), s(', "user": {"id": '), F.col("user_id").cast("string"), s(', "notes": ["plain", {"key": "AKIA'), F.upper(F.left(F.md5(e), s(16))), s('"}, ["password = p'), e, s('"]]}, "url": "redis://h/'), e, s('", "none": null}'))
    rows = events.select("event_id", F.when(F.col("event_id") % 3 == 0, full).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(s("not json "), e)).alias("j"))
    return secrets.json_match_rows(rows, "event_id", "j", shared.folder(spark))

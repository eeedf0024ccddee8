"""Audit events on storage: a table of JSON or parquet files, partitioned by day."""

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrimlake.operators.audit import log_name
from scrimlake.streaming import sinks

SCHEMA = """event_id string, event_type string, timestamp timestamp, tenant_id string, user_id string, request_id string, entity_type string, entity_count int, strategy_used string,
source_ip string, user_agent string, api_key_hash string, endpoint string, method string, status_code int, error_message string, risk_level string, metadata map<string,string>"""


def append(events: DataFrame, path: str, kind: str = "json") -> None:
    """Adds the events to the table under path."""
    events.withColumn("event_date", F.to_date("timestamp")).write.mode("append").partitionBy("event_date").format(kind).save(path)


def read(spark: SparkSession, path: str, kind: str = "json", start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The events, without lines that don't parse; a time range also names its days, so that only their files are read."""
    reader = spark.read.schema(SCHEMA + ", event_date date").format(kind)
    df = (reader.option("mode", "DROPMALFORMED") if kind == "json" else reader).load(path)
    # Spark turns the bounds into days as it did the events' times, so both are days of the session's zone
    if start is not None:
        df = df.where((F.col("event_date") >= F.to_date(F.lit(start))) & (F.col("timestamp") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("event_date") <= F.to_date(F.lit(end))) & (F.col("timestamp") <= F.lit(end)))
    return df.drop("event_date")


def file_names(start: date, end: date, rotation: str = "daily") -> list[str]:
    """The names of the files of a range of days, each once, in order: what operators.audit.log_name() gives its days."""
    names = {}
    for k in range((end - start).days + 1):
        day = start + timedelta(days=k)
        year, week, _ = day.isocalendar()
        names[{"daily": f"{day:%Y%m%d}", "weekly": f"{year}{week:02d}", "monthly": f"{day:%Y%m}"}[rotation]] = None
    return [f"audit_{n}.jsonl" for n in names]


def write_files(events: DataFrame, path: str, rotation: str = "daily") -> None:
    """Adds the events as lines of JSON to the files of a rotation; a file is a folder log=NAME of what its writers have added."""
    events.withColumn("log", log_name(F.col("timestamp"), rotation)).write.mode("append").partitionBy("log").json(path)


def read_files(spark: SparkSession, path: str, start: datetime, end: datetime, rotation: str = "daily") -> DataFrame:
    """The events from start to end in files of a rotation, plain ones or folders of write_files(): only those whose names the range asks for are
    opened, each once. Lines that don't parse are left out; no file gives no rows. The times are those of the session's zone, as the names are."""
    found = []
    for name in file_names(start.date(), end.date(), rotation):
        for at in (f"{path}/{name}", f"{path}/log={name}"):
            p = spark._jvm.org.apache.hadoop.fs.Path(at)
            if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                found.append(at)
    if not found:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(found)
    return rows.where(F.col("timestamp").between(F.lit(start), F.lit(end)))


def append_stream(events: DataFrame, path: str, checkpoint: str, seconds: int = 1):
    """Starts a query that adds micro-batches of a stream of events, each once; sinks.audit_events() reads them."""
    return sinks.into(events, lambda batch, i: sinks.audit_batch(batch, i, path), checkpoint, processingTime=f"{seconds} seconds")


def read_jdbc(spark: SparkSession, url: str, table: str = "audit_logs", **options: str) -> DataFrame:
    """An audit table behind JDBC; filters are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_csv(events: DataFrame, path: str) -> None:
    from scrimlake.operators.audit import csv_rows

    csv_rows(events).write.mode("overwrite").option("header", True).csv(path)

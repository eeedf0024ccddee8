"""Sinks of micro-batches that may be tried again: what a batch writes is named by its id, so a second try takes the place of the first."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrimlake.operators import stores, usage


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The ids of the batches that are whole, in order."""
    top, fs = _path(spark, path)
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    ids = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
    return [i for i in ids if fs.exists(_path(spark, f"{path}/batch={i}/_SUCCESS")[0])]


def audit_batch(batch: DataFrame, batch_id: int, path: str, kind: str = "parquet") -> None:
    """Writes the batch's events by day under its id."""
    batch.withColumn("event_date", F.to_date("timestamp")).write.mode("overwrite").partitionBy("event_date").format(kind).save(f"{path}/batch={batch_id}")


def audit_events(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The events of all whole batches; a batch that was broken off isn't read. The days and the batch are columns by which files are pruned."""
    whole = [f"{path}/batch={i}" for i in versions(spark, path)]
    reader = spark.read.schema(f"{schema}, event_date date, batch long").format(kind).option("basePath", path)
    return reader.load(whole) if whole else spark.createDataFrame([], f"{schema}, event_date date, batch long")


def cache_batch(batch: DataFrame, batch_id: int, path: str, most: int, ties: tuple[str, ...], keep: int = 2) -> None:
    """A new version of the cache under path: the last one before this batch with the batch's entries put in, of which each tenant's newest `most` stay.

    Entries are (tenant_id, key, ..., created_at, expires_at); ties: columns that order entries of one time. A version depends on the one before
    and on the batch only, so a second try of a batch gives the same one. Versions but the last `keep` go.
    """
    spark = batch.sparkSession
    before = [i for i in versions(spark, path) if i < batch_id]
    store = spark.read.schema(batch.schema).parquet(f"{path}/batch={before[-1]}") if before else batch.limit(0)
    order = [F.desc("created_at"), *[F.desc(c) for c in ties], "key"]
    usage.newest(stores.put(store, batch, ties=ties), ["tenant_id"], order, most).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    for i in before[: 1 - keep] if keep > 1 else before:
        old, fs = _path(spark, f"{path}/batch={i}")
        fs.delete(old, True)


def cache_now(spark: SparkSession, path: str, schema) -> DataFrame:
    """The last whole version of the cache."""
    whole = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/batch={whole[-1]}") if whole else spark.createDataFrame([], schema)


def into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Starts a query that gives each micro-batch and its id to the sink."""
    return stream.writeStream.trigger(**(trigger or {"processingTime": "1 second"})).option("checkpointLocation", checkpoint).foreachBatch(sink).start()

"""Tables that are read more than once, written under the cluster's shared folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, where all executors can write. Where that is unset a local session, as in tests, gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scrimlake-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of df as a table at the path, which cuts lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

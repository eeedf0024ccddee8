"""What the operators share: words, scratch tables in the cluster's shared folder, even partitions."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters (space, tab to carriage return).
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset a local session, as in tests, gets a temporary one;
    on a cluster, whose machines don't share such a folder, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        root = held.rsplit("/", 1)[0] if held else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scrimlake-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: With this set, an execution's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written under the shared folder, which cut lineage: a lost executor costs no earlier stage.

    A table's shuffle files go once it is written. A table that a returned DataFrame still reads stays in the folder; drop()
    removes the others.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, step: str) -> DataFrame:
        held = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(f"{self.path}/{step}")
        finally:
            self.spark.conf.set(_CLEANUP, held)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{step}")

    def drop(self, *steps: str) -> None:
        for step in steps:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{step}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def no_clash(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller can't clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])

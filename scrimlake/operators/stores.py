"""Stores with a time to live as relations: mappings of sessions and cached answers, keyed by tenant and key.

An entry is a row of tenant_id, key, value columns, created_at and expires_at (null: never). Writing, prolonging and
deleting give a new version of the relation.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def put(store: DataFrame, new: DataFrame, ttl_seconds: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The store with new entries, of which the newest of each tenant and key stays. ttl_seconds sets when the new ones expire.

    ties: columns by which entries of one time are told apart, the highest counts; after them a hash of the whole entry, so that a second run gives the same.
    """
    if ttl_seconds is not None:
        new = new.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy("tenant_id", "key").orderBy(F.desc("_new"), F.desc("created_at"), *[F.desc(c) for c in ties], F.xxhash64(*[F.col(c).cast("string") for c in store.columns]))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def live(store: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired."""
    return store.where(F.col("expires_at").isNull() | (now <= F.col("expires_at")))


def extend(store: DataFrame, asked: DataFrame, now: Column, seconds: int) -> DataFrame:
    """The live entries; those of the asked (tenant_id, key) last at least so long from now on."""
    known = asked.select("tenant_id", "key").distinct().withColumn("_asked", F.lit(True))
    later = F.greatest("expires_at", now + F.make_dt_interval(secs=F.lit(seconds)))
    out = live(store, now).join(known, ["tenant_id", "key"], "left")
    return out.withColumn("expires_at", F.when(F.col("_asked") & F.col("expires_at").isNotNull(), later).otherwise(F.col("expires_at"))).drop("_asked")


def without_tenant(store: DataFrame, tenant_id: str) -> DataFrame:
    return store.where(F.col("tenant_id") != tenant_id)


def stats(store: DataFrame, now: Column) -> DataFrame:
    """tenant_id, entries, bytes, hits and mean age in seconds of the live entries."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    return live(store, now).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("size_bytes").alias("bytes"), F.sum("hit_count").alias("hits"), F.round(F.avg(age), 3).alias("avg_age"))


def preview(store: DataFrame, size: int = 10) -> DataFrame:
    """The first entries of each tenant, by age."""
    first = Window.partitionBy("tenant_id").orderBy("created_at", "key")
    return store.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= size).drop("_n")


def mapping_json(mapping: DataFrame, session_col: str) -> DataFrame:
    """session, json of {ptype: {original: placeholder}} in order of names; a session's values are one row."""
    kinds = mapping.groupBy(session_col, "ptype").agg(F.array_sort(F.collect_list(F.struct("original", "placeholder"))).alias("m"))
    whole = kinds.groupBy(session_col).agg(F.array_sort(F.collect_list(F.struct("ptype", "m"))).alias("k"))
    of = F.transform("k", lambda x: F.struct(x["ptype"], F.map_from_entries(x["m"])))
    return whole.select(session_col, F.to_json(F.map_from_entries(of)).alias("json"))


def mapping_of_json(rows: DataFrame, session_col: str) -> DataFrame:
    """The relation of mapping_json()'s rows."""
    parsed = F.from_json("json", "map<string,map<string,string>>")
    kinds = rows.select(session_col, F.explode(parsed).alias("ptype", "m"))
    return kinds.select(session_col, "ptype", F.explode("m").alias("original", "placeholder"))

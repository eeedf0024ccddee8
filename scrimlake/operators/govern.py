"""Allowlists, tenants, keys, roles: look-ups that are joins with dimension relations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(spans: DataFrame, allow: DataFrame, how: str) -> DataFrame:
    """spans semi- or anti-joined with the enabled lists. allow: entity_type ('*' for any), entry, enabled, case_sensitive."""
    lists = allow.where("enabled").select(F.col("entity_type").alias("_type"), F.when(F.col("case_sensitive"), F.col("entry")).otherwise(F.lower("entry")).alias("_entry"), F.col("case_sensitive").alias("_cs")).distinct()
    # an equality join by the lower-cased value, of which the exact form is tested in lists that tell cases apart
    keyed = lists.withColumn("_lower", F.lower("_entry"))
    meets = (F.lower(spans["value"]) == F.col("_lower")) & (~F.col("_cs") | (spans["value"] == F.col("_entry"))) & ((F.col("_type") == "*") | (F.col("_type") == spans["entity_type"]))
    return spans.join(keyed, meets, how)


def exempt(spans: DataFrame, allow: DataFrame) -> DataFrame:
    """Spans that a list allows, repeats included."""
    return _joined(spans, allow, "left_semi")


def not_exempt(spans: DataFrame, allow: DataFrame) -> DataFrame:
    """Spans that no list allows, repeats included."""
    return _joined(spans, allow, "left_anti")


def with_entries(allow: DataFrame, new: DataFrame) -> DataFrame:
    """The lists with new entries, each once by list name and entry; of equal ones a new one counts."""
    both = allow.join(new.select("name", "entry").distinct(), ["name", "entry"], "left_anti")
    return both.unionByName(new.dropDuplicates(["name", "entry"]))


def without_entries(allow: DataFrame, gone: DataFrame) -> DataFrame:
    return allow.join(gone.select("name", "entry").distinct(), ["name", "entry"], "left_anti")


def entries_page(allow: DataFrame, name: str, search: str = "", page: int = 1, size: int = 100) -> DataFrame:
    """entry, total, has_more: a page of a list's entries in order, of those that contain the search in any case."""
    found = allow.where(F.col("name") == name).select("entry").distinct()
    found = found.where(F.contains(F.lower("entry"), F.lower(F.lit(search)))) if search else found
    total = found.agg(F.count(F.lit(1))).scalar()
    return found.orderBy("entry").offset((page - 1) * size).limit(size).withColumn("total", total).withColumn("has_more", F.col("total") > page * size)


def list_stats(allow: DataFrame) -> DataFrame:
    """One row: total_allowlists, enabled_allowlists, total_entries; a list counts an entry once."""
    lists = allow.groupBy("name").agg(F.bool_or("enabled").alias("enabled"), F.count_distinct("entry").alias("n"))
    return lists.agg(F.count(F.lit(1)).alias("total_allowlists"), F.count_if("enabled").alias("enabled_allowlists"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries"))


def tenants_of_keys(requests: DataFrame, keys: DataFrame, fallback: str) -> DataFrame:
    """requests (api_key) with tenant_id: by the key's hash if active, else the key's own tenant part, else fallback."""
    known = keys.where("status = 'active'").select("key_hash", F.col("tenant_id").alias("_tenant"))
    own = F.regexp_extract("api_key", r"^[a-z]+_([A-Za-z0-9-]+)_", 1)
    joined = requests.join(known, F.sha2("api_key", 256) == F.col("key_hash"), "left")
    return joined.withColumn("tenant_id", F.coalesce("_tenant", F.nullif(own, F.lit("")), F.lit(fallback))).drop("_tenant", "key_hash")


def permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """user_id, permissions: the union over a user's roles, in order."""
    return users.select("user_id", F.explode("roles").alias("role")).join(roles, "role").groupBy("user_id").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))


#: The permission that stands for all.
ADMIN_ALL = "admin.all"


def permitted(users: DataFrame, roles: DataFrame, permission: str) -> DataFrame:
    """user_id, allowed: whether one of the user's roles has the permission, or the one for all. Users without roles have none; a user's repeated rows count together."""
    grants = roles.where(F.col("permission").isin(permission, ADMIN_ALL)).select("role").distinct().withColumn("_has", F.lit(True))
    held = users.select("user_id", F.explode_outer("roles").alias("role")).join(grants, "role", "left")
    return held.groupBy("user_id").agg(F.coalesce(F.bool_or("_has"), F.lit(False)).alias("allowed"))


def listed(entities: DataFrame, **filters) -> DataFrame:
    """Keys, users or tenants whose columns have the given values; a filter of None asks for nothing, one of a list for any of its values."""
    for name, value in filters.items():
        if value is not None:
            column = entities[name]
            many = value if isinstance(value, (list, tuple, set)) else [value]
            kind = entities.schema[name].dataType.typeName()
            entities = entities.where(F.arrays_overlap(column, F.array(*[F.lit(v) for v in many])) if kind == "array" else column.isin(*many))
    return entities

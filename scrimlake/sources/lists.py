"""Configuration read as relations: allowlists from text files, patterns and presets from YAML, event streams of a model."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrimlake.operators.spans import Pattern

# fixed values: what a list's file name says about its entries
STEMS = (("person|figure", "PERSON"), ("location|place|city", "LOCATION"), ("org|company", "ORG"), ("email", "EMAIL_ADDRESS"))


def allowlists(spark: SparkSession, folder: str) -> DataFrame:
    """name, entity_type, entry, enabled, case_sensitive of every line of the folder's text files that isn't blank or a # comment."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    kind = F.lit("*")
    for names, entity in reversed(STEMS):
        kind = F.when(F.lower("name").rlike(names), entity).otherwise(kind)
    lines = spark.read.text(folder).select(stem.alias("name"), F.trim("value").alias("entry")).where(~F.col("entry").rlike(r"^(#|$)"))
    return lines.select("name", kind.alias("entity_type"), F.lower("entry").alias("entry"), F.lit(True).alias("enabled"), F.lit(False).alias("case_sensitive")).dropDuplicates()


def patterns(path: str) -> tuple[Pattern, ...]:
    """The patterns of a YAML file: a list under patterns of name, entity_type, regex and perhaps score."""
    import yaml

    with open(path) as f:
        rows = (yaml.safe_load(f) or {}).get("patterns") or []
    for row in rows:
        for field in ("name", "entity_type", "regex"):
            if not row.get(field):
                raise ValueError(f"a pattern of {path} has no {field}")
    return tuple(Pattern(r["name"], r["entity_type"], r["regex"], float(r.get("score", 0.7))) for r in rows)


@dataclass(frozen=True)
class Preset:
    """A compliance preset: strategies by placeholder type, the strategy of other types, patterns, days to keep audit events."""

    name: str
    strategies: dict[str, str]
    default: str
    patterns: tuple[Pattern, ...]
    retention_days: int | None


def preset(path: str) -> Preset:
    """A preset from YAML; its strategies may hold a default."""
    import yaml

    with open(path) as f:
        row = yaml.safe_load(f) or {}
    if not row.get("name"):
        raise ValueError(f"the preset of {path} has no name")
    strategies = dict(row.get("strategies") or {})
    found = tuple(Pattern(r["name"], r["entity_type"], r["regex"], float(r.get("score", 0.7))) for r in row.get("custom_patterns") or [])
    return Preset(row["name"], strategies, strategies.pop("default", "placeholder"), found, (row.get("retention") or {}).get("audit_days"))


CHUNK = "id string, created long, model string, choices array<struct<index:int,delta:struct<role:string,content:string>,finish_reason:string>>"


def sse_content(line: Column) -> Column:
    """(content, finish_reason) of a server-sent event line; null of other lines, [DONE] and broken JSON."""
    body = F.when(line.startswith("data: ") & (line != "data: [DONE]"), F.from_json(F.substring(line, F.lit(7), F.length(line)), CHUNK))
    return F.when(body["choices"].isNotNull(), F.struct(F.get(body["choices"], F.lit(0))["delta"]["content"].alias("content"), F.get(body["choices"], F.lit(0))["finish_reason"].alias("finish_reason")))


def sse_line(content: Column, chunk_id: Column, created: Column, model: Column) -> Column:
    delta = F.struct(F.lit(0).alias("index"), F.struct(content.alias("content")).alias("delta"))
    body = F.struct(chunk_id.alias("id"), F.lit("chat.completion.chunk").alias("object"), created.alias("created"), model.alias("model"), F.array(delta).alias("choices"))
    return F.concat(F.lit("data: "), F.to_json(body), F.lit("\n\n"))


def tenants(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tenants of a YAML file, and their keys as hashes. An unknown status is active; the file is one of configuration."""
    import yaml

    with open(path) as f:
        rows = (yaml.safe_load(f) or {}).get("tenants") or []
    status = lambda r: r["status"].lower() if str(r.get("status", "")).lower() in ("active", "disabled", "suspended") else "active"
    known = [(r["tenant_id"], r["name"], status(r), r.get("rate_limit", "60/minute"), int(r.get("max_ttl", 300))) for r in rows]
    out = spark.createDataFrame(known, "tenant_id string, name string, status string, rate_limit string, max_ttl int")
    keys = spark.createDataFrame([(k, r["tenant_id"]) for r in rows for k in r.get("api_keys") or []], "api_key string, tenant_id string")
    return out, keys.select(F.sha2("api_key", 256).alias("key_hash"), "tenant_id").join(out.select("tenant_id", "status"), "tenant_id")


def quotas(spark: SparkSession, path: str) -> DataFrame:
    """tenant_id, quota_type, period, quota, soft_percent of a YAML file; unknown periods and limits that are no numbers are left out."""
    import yaml

    with open(path) as f:
        rows = (yaml.safe_load(f) or {}).get("quotas") or []
    found = []
    for r in rows:
        for kind in ("requests", "tokens"):
            for period, limit in (r.get(kind) or {}).items():
                if period in ("hourly", "daily", "monthly") and str(limit).isdigit():
                    found.append((r["tenant_id"], kind, period, int(limit), float(r.get("soft_limit_percent", 80))))
    return spark.createDataFrame(found, "tenant_id string, quota_type string, period string, quota long, soft_percent double")

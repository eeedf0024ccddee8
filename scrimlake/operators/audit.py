"""Audit analytics over an event relation: filter, order, page, summaries, exports, retention."""

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrimlake.functions.values import RISKS


@dataclass(frozen=True)
class AuditFilter:
    start: datetime | None = None
    end: datetime | None = None
    event_types: tuple[str, ...] = ()
    tenant_id: str | None = None
    user_id: str | None = None
    request_id: str | None = None
    risk_levels: tuple[str, ...] = ()
    min_risk: str | None = None
    sort_by: str = "timestamp"
    descending: bool = True
    by_severity: bool = True
    offset: int = 0
    limit: int | None = 1000
    tie: tuple[str, ...] = field(default=("event_id",))


def severity(risk: Column) -> Column:
    out = F.lit(-1)
    for k, r in enumerate(RISKS):
        out = F.when(risk == r, k).otherwise(out)
    return out


def matching(events: DataFrame, f: AuditFilter) -> DataFrame:
    """The events that pass; predicates are plain comparisons, which reach the scan."""
    tests = [
        (f.start, lambda: F.col("timestamp") >= F.lit(f.start)), (f.end, lambda: F.col("timestamp") <= F.lit(f.end)), (f.event_types, lambda: F.col("event_type").isin(*f.event_types)),
        (f.tenant_id, lambda: F.col("tenant_id") == f.tenant_id), (f.user_id, lambda: F.col("user_id") == f.user_id), (f.request_id, lambda: F.col("request_id") == f.request_id),
        (f.risk_levels, lambda: F.col("risk_level").isin(*f.risk_levels)), (f.min_risk, lambda: F.col("risk_level").isin(*RISKS[RISKS.index(f.min_risk or "none") :])),
    ]
    for given, test in tests:
        if given:
            events = events.where(test())
    return events


def query(events: DataFrame, f: AuditFilter) -> DataFrame:
    """One page: filtered, ordered (risk by severity unless by_severity is off), from offset on, at most limit."""
    key = severity(F.col("risk_level")) if f.sort_by == "risk_level" and f.by_severity else F.col(f.sort_by)
    out = matching(events, f).orderBy(key.desc() if f.descending else key.asc(), *f.tie)
    out = out.offset(f.offset) if f.offset else out
    return out if f.limit is None else out.limit(f.limit)


def summary(events: DataFrame) -> DataFrame:
    """One row: the total, sums over detected and anonymised entities, and counts of five kinds of event."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    entities = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("entity_count"))), F.lit(0)).cast("long")
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), entities("pii_detected").alias("pii_detected_count"), entities("pii_anonymized").alias("pii_anonymized_count"), of("api_request").alias("api_requests"),
        of("api_error").alias("api_errors"), of("auth_failure").alias("auth_failures"), of("rate_limit_exceeded").alias("rate_limit_hits"), of("secret_detected").alias("secrets_detected"),
    )


def summary_counts(events: DataFrame) -> DataFrame:
    """section, name, n: events by type and by risk, detected entities by their type, anonymising events by strategy."""
    counted = events.groupBy("event_type", "risk_level", "entity_type", "strategy_used").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("entity_count"), F.lit(0)).cast("long").alias("entities"))
    of = lambda section, name, n: F.struct(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(n).alias("n"))
    found, replaced = F.col("event_type") == "pii_detected", F.col("event_type") == "pii_anonymized"
    each = F.array(of("by_type", "event_type", "events"), of("by_risk", "risk_level", "events"), F.when(found, of("by_entity", "entity_type", "entities")), F.when(replaced, of("by_strategy", "strategy_used", "events")))
    return counted.select(F.explode(each).alias("e")).select("e.*").where("name is not null").groupBy("section", "name").agg(F.sum("n").alias("n"))


def summary_maps(events: DataFrame) -> DataFrame:
    """One row of four maps, each from a section's names to its counts; their size is that of the vocabularies."""
    of = lambda section: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("name", "n"))))).alias(section)
    return summary_counts(events).agg(*[of(s) for s in ("by_type", "by_risk", "by_entity", "by_strategy")])


def log_name(day: Column, rotation: str = "daily") -> Column:
    """The file that holds a day's events: by day, by ISO week and the year it belongs to, so that no two weeks share a name, or by month."""
    year = F.year(F.date_add(F.to_date(day), 3 - F.weekday(day)))  # that of the week's Thursday
    names = {"daily": F.date_format(day, "yyyyMMdd"), "weekly": F.concat(year.cast("string"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")), "monthly": F.date_format(day, "yyyyMM")}
    return F.concat(F.lit("audit_"), names[rotation], F.lit(".jsonl"))


def merged(events: DataFrame, ambient: DataFrame, key: str, *columns: str) -> DataFrame:
    """events whose null columns are those of the ambient context with the same key, of which there is at most one."""
    known = ambient.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = events.join(known, F.col(key) == F.col("_key"), "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_key", *[f"_{c}" for c in columns])


def summary_by(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("entity_count"), F.lit(0)).cast("long").alias("entities"))


def rollup(events: DataFrame) -> DataFrame:
    return events.rollup("event_type", "risk_level").agg(F.count(F.lit(1)).alias("n"))


def recent(events: DataFrame, now: Column, hours: int = 24, k: int = 100) -> DataFrame:
    since = now - F.make_interval(hours=F.lit(hours))
    return events.where((F.col("timestamp") >= since) & (F.col("timestamp") <= now)).orderBy(F.desc("timestamp"), "event_id").limit(k)


def retained(events: DataFrame, now: Column, days: int) -> DataFrame:
    """The events not older than this many days."""
    return events.where(F.col("timestamp") >= now - F.make_interval(days=F.lit(days)))


# fixed values: the columns of a CSV export
CSV = ("event_id", "event_type", "timestamp", "tenant_id", "user_id", "request_id", "entity_type", "entity_count", "strategy_used", "source_ip", "endpoint", "method", "status_code", "risk_level")


def csv_rows(events: DataFrame) -> DataFrame:
    """CSV's columns as strings; null, a status of 0 and columns that the events lack are empty."""
    shown = lambda c: F.nullif(F.col(c).cast("string"), F.lit("0")) if c == "status_code" else F.col(c).cast("string")
    return events.select(*[(F.coalesce(shown(c), F.lit("")) if c in events.columns else F.lit("")).alias(c) for c in CSV])


def json_rows(events: DataFrame, *columns: str) -> DataFrame:
    return events.select(F.to_json(F.struct(*(columns or events.columns))).alias("json"))


def signature(event_type: Column, request_id: Column, endpoint: Column, tenant_id: Column) -> Column:
    """16 hex digits that repeats of one event share; null prints None."""
    return F.left(F.sha2(F.concat_ws(":", *[F.coalesce(c, F.lit("None")) for c in (event_type, request_id, endpoint, tenant_id)]), 256), F.lit(16))


def alerts(events: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """tenant_id, risk_level, n where a tenant has at least so many events of a risk."""
    counted = events.groupBy("tenant_id", "risk_level").agg(F.count(F.lit(1)).alias("n"))
    test = F.lit(False)
    for risk, least in thresholds.items():
        test = test | ((F.col("risk_level") == risk) & (F.col("n") >= least))
    return counted.where(test)


def mask_key(key: Column, digits: int = 16) -> Column:
    return F.concat(F.left(key, F.lit(4)), F.lit("..."), F.left(F.sha2(key, 256), F.lit(digits)))

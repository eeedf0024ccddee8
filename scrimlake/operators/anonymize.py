"""Replacement of spans and its reversal.

Numbering is by text: the value that occurs last in a text has number 1 of its type, variants of a value share
a number. As a text is one row, numbering is an array expression and the operator needs no shuffle. Numbering
over a session of several rows (a conversation) is a window per session and type.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrimlake.functions import text as T
from scrimlake.functions.values import ENTITY_TYPES, STRATEGIES
from scrimlake.operators import govern
from scrimlake.operators.chat import entity_intent
from scrimlake.operators.spans import DEFAULT, SPAN, detect, resolve, splice
from scrimlake.sources.shared import written

TOKEN = r"<[A-Z_]+_[0-9]+>"
#: Types of which a value that is asked about stays as it is.
QUESTION_TYPES = ("PERSON", "ORGANIZATION", "LOCATION")


def _lookup(values: Mapping[str, str], key: Column, otherwise: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return F.coalesce(out, otherwise)


def placeholder_type(entity_type: Column) -> Column:
    return _lookup(ENTITY_TYPES, entity_type, entity_type)


def placeholder(ptype: Column, number: Column) -> Column:
    return F.format_string("<%s_%d>", ptype, number)


def replacement(value: Column, entity_type: Column, ptype: Column, number: Column, strategy: Column, marker: str = "[REDACTED]") -> Column:
    """The text that takes a value's place; an unknown strategy or synthetic type is redacted, by the marker."""
    synthetic = F.when(ptype == "PHONE", T.synthetic_phone(value)).when(ptype == "EMAIL", T.synthetic_email(value)).otherwise(marker)
    return (
        F.when(strategy == "placeholder", F.format_string("<%s_%d>", ptype, number))
        .when(strategy == "hash", T.salted_hash(value, entity_type))
        .when(strategy == "mask", T.mask(value, ptype))
        .when(strategy == "synthetic", synthetic)
        .otherwise(marker)
    )


def replace_spans(df: DataFrame, spans_col: str, text_col: str = "text", strategies: Mapping[str, str] = STRATEGIES, default: str = "placeholder", out: str = "anon_text", marker: str = "[REDACTED]") -> DataFrame:
    """Adds `out`, and `entities`: (entity_type, start, end, score, value, ptype, strategy, number, new) of each of the disjoint, ordered spans in spans_col."""
    typed = F.transform(spans_col, lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["value"].alias("value"), placeholder_type(s["entity_type"]).alias("ptype"), T.canonical(s["value"], s["entity_type"]).alias("canon")))
    df = df.withColumn("_typed", typed)
    last = F.transform(F.array_distinct(F.transform("_typed", lambda s: F.struct(s["ptype"].alias("ptype"), s["canon"].alias("canon")))), lambda u: F.struct(u["ptype"].alias("ptype"), u["canon"].alias("canon"), F.array_max(F.transform(F.filter("_typed", lambda s: (s["ptype"] == u["ptype"]) & (s["canon"] == u["canon"])), lambda s: s["start"])).alias("at")))
    df = df.withColumn("_last", last)
    at = lambda s: F.get(F.filter("_last", lambda u: (u["ptype"] == s["ptype"]) & (u["canon"] == s["canon"])), F.lit(0))["at"]
    number = lambda s: F.size(F.filter("_last", lambda u: (u["ptype"] == s["ptype"]) & (u["at"] > at(s)))) + 1
    numbered = F.transform("_typed", lambda s: F.struct(*[s[c].alias(c) for c in ("entity_type", "start", "end", "score", "value", "ptype")], _lookup(strategies, s["ptype"], F.lit(default)).alias("strategy"), number(s).alias("number")))
    df = df.withColumn("_numbered", numbered)
    new = lambda s: replacement(s["value"], s["entity_type"], s["ptype"], s["number"], s["strategy"], marker)
    df = df.withColumn("entities", F.transform("_numbered", lambda s: F.struct(*[s[c].alias(c) for c in ("entity_type", "start", "end", "score", "value", "ptype", "strategy", "number")], new(s).alias("new"))))
    return df.withColumn(out, splice(F.col(text_col), F.col("entities"))).drop("_typed", "_last", "_numbered")


def anonymize(df: DataFrame, text_col: str = "text", strategies: Mapping[str, str] = STRATEGIES, default: str = "placeholder", patterns=DEFAULT, threshold: float = 0.5, out: str = "anon_text", marker: str = "[REDACTED]") -> DataFrame:
    """Adds `out`, and `entities`: (entity_type, start, end, score, value, ptype, strategy, number, new) of each span replaced. marker: what stands for redacted values."""
    df = df.withColumn("_spans", resolve(detect(F.col(text_col), patterns), threshold))
    return replace_spans(df, "_spans", text_col, strategies, default, out, marker).drop("_spans")


def anonymize_exempting(
    df: DataFrame, path: str, allow: DataFrame | None = None, asked_types: Sequence[str] = QUESTION_TYPES, text_col: str = "text",
    strategies: Mapping[str, str] = STRATEGIES, default: str = "placeholder", patterns=DEFAULT, threshold: float = 0.5, spans: Column | None = None, out: str = "anon_text",
) -> DataFrame:
    """Like anonymize(), but spans that are asked about or that an allowlist has stay. Adds `exemptions`: (entity_type, start, end, value, reason) of those, by
    place; reason is intent, which is tried first, or allowlist.

    Each text is searched once and written under path with its spans. The spans, without texts, meet the allowlist, of any size
    (see govern), and what it exempts comes back to the texts in one join, a row for each text that has any. asked_types: the types that a question keeps. spans: an array to use
    instead of the patterns' resolved spans. Rows needn't have a key; null texts have no spans.
    """
    found = spans if spans is not None else resolve(detect(F.col(text_col), patterns), threshold)
    held = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_spans", F.coalesce(found, F.array().cast(f"array<{SPAN}>")))
    asked = lambda s: s["entity_type"].isin(*asked_types) & entity_intent(F.col(text_col), s["start"], s["end"])["is_question"] if asked_types else F.lit(False)
    held = held.withColumn("_spans", F.transform("_spans", lambda s: F.struct(s.alias("s"), asked(s).alias("asked"))))
    held = written(held, f"{path}/spans")
    exempt_at = F.lit(None).cast("array<int>")
    if allow is not None:
        each = held.select("_row", F.explode(F.filter("_spans", lambda x: ~x["asked"])).alias("x")).select("_row", "x.s.*")
        hits = govern.exempt(each, allow).groupBy("_row").agg(F.collect_set("start").alias("_allowed"))
        held, exempt_at = held.join(hits, "_row", "left"), F.col("_allowed")
    allowed = lambda x: ~x["asked"] & F.coalesce(F.array_contains(exempt_at, x["s"]["start"]), F.lit(False))
    kept = F.transform(F.filter("_spans", lambda x: ~x["asked"] & ~allowed(x)), lambda x: x["s"])
    gone = F.transform(F.filter("_spans", lambda x: x["asked"] | allowed(x)), lambda x: F.struct(*[x["s"][c].alias(c) for c in ("entity_type", "start", "end", "value")], F.when(x["asked"], "intent").otherwise("allowlist").alias("reason")))
    rows = held.withColumn("_kept", kept).withColumn("exemptions", gone)
    return replace_spans(rows, "_kept", text_col, strategies, default, out).drop("_row", "_spans", "_kept", "_allowed")


def anonymize_sessions(df: DataFrame, session_col: str, order_col: str, text_col: str = "text", patterns=DEFAULT, threshold: float = 0.5, skip: Column | None = None, name=None) -> tuple[DataFrame, DataFrame]:
    """Values named over a session. Returns (rows with anon_text, mapping).

    Numbers follow first occurrence. mapping: session, ptype, original (the first raw form), placeholder.
    skip: rows whose text stays as it is. name: of columns (session, ptype, number, original) the Column that takes a value's place, by default its placeholder.
    """
    found = resolve(detect(F.col(text_col), patterns), threshold)
    if skip is not None:
        found = F.when(skip, F.array().cast(f"array<{SPAN}>")).otherwise(found)
    # for explode() Spark would infer a filter that repeats all of the detection
    spans = df.select(F.col(session_col), F.col(order_col), F.posexplode_outer(found).alias("_i", "_s")).where("_i is not null").select(session_col, order_col, "_s.*")
    spans = spans.withColumn("ptype", placeholder_type(F.col("entity_type"))).withColumn("canon", T.canonical(F.col("value"), F.col("entity_type")))
    values = spans.groupBy(session_col, "ptype", "canon").agg(F.min(F.struct(order_col, "start", "value")).alias("first"))
    number = F.row_number().over(Window.partitionBy(session_col, "ptype").orderBy(F.col(f"first.{order_col}"), F.col("first.start")))
    values = values.select(session_col, "ptype", "canon", F.col("first.value").alias("original"), number.alias("number"))
    named = name(F.col(session_col), F.col("ptype"), F.col("number"), F.col("original")) if name else placeholder(F.col("ptype"), F.col("number"))
    values = values.select(session_col, "ptype", "canon", "original", named.alias("placeholder"))
    edits = spans.join(values, [session_col, "ptype", "canon"]).groupBy(session_col, order_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("placeholder").alias("new")))).alias("edits"))
    rows = df.join(edits, [session_col, order_col], "left")
    rows = rows.withColumn("anon_text", F.when(F.col("edits").isNull(), F.col(text_col)).otherwise(splice(F.col(text_col), F.col("edits")))).drop("edits")
    return rows, values.drop("canon")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def restore_in_row(text: Column, mapping: Column) -> Column:
    """Each placeholder of the text whose original is in a map column, put back by position; others stay."""
    parts = F.arrays_zip(F.split(text, TOKEN, -1).alias("gap"), tokens(text).alias("hit"))
    return F.array_join(F.flatten(F.transform(parts, lambda x: F.array(x["gap"], F.coalesce(F.try_element_at(mapping, x["hit"]), x["hit"], F.lit(""))))), "")


def reversible(entities: Column) -> Column:
    """placeholder or hash -> original of a row's entities; of variants the first in the text."""
    kept = F.filter(entities, lambda e: e["strategy"].isin("placeholder", "hash"))
    pairs = F.transform(kept, lambda e: F.struct(e["new"].alias("k"), e["value"].alias("v")))
    first = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(first)


def restore(texts: DataFrame, mapping: DataFrame, session_col: str, order_col: str, text_col: str) -> DataFrame:
    """Joins the texts' placeholders with a mapping relation by session; adds restored, n_restored and unresolved."""
    asked = texts.select(session_col, order_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("placeholder"))
    found = asked.join(mapping.select(session_col, "placeholder", "original"), [session_col, "placeholder"], "left")
    known = F.collect_list(F.when(F.col("original").isNotNull(), F.struct("placeholder", "original")))
    rows = found.groupBy(session_col, order_col).agg(known.alias("known"), F.array_sort(F.collect_list(F.when(F.col("original").isNull(), F.col("placeholder")))).alias("unresolved"))
    out = texts.join(rows, [session_col, order_col], "left")
    names = F.coalesce(F.map_from_entries("known"), F.create_map().cast("map<string,string>"))
    return out.withColumn("_map", names).withColumn("restored", restore_in_row(F.col(text_col), F.col("_map"))).withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>"))).withColumn("n_restored", F.size(F.filter(tokens(F.col(text_col)), lambda t: F.try_element_at(F.col("_map"), t).isNotNull()))).drop("_map", "known")


# fixed values: (regex with type and number, base confidence) of what stands in for a placeholder, in order of trial
FUZZY = (
    (r"^<([A-Z_]+)_([0-9]+)>$", 1.0),
    (r"(?i)^<([a-z][a-z_]+)_([0-9]+)>$", 0.95),
    (r"^<\s*([A-Za-z_]+?)\s*_\s*([0-9]+)\s*>$", 0.90),
    (r"^<([A-Za-z_]+)\s+([0-9]+)>$", 0.90),
    (r"^\[\s*([A-Za-z_]+?)\s*[_\s]\s*([0-9]+)\s*\]$", 0.85),
    (r"^\{\s*([A-Za-z_]+?)\s*[_\s]\s*([0-9]+)\s*\}$", 0.85),
    (r"^\(\s*([A-Za-z_]+?)\s*[_\s]\s*([0-9]+)\s*\)$", 0.85),
    (r"^<([A-Za-z_]+)-([0-9]+)>$", 0.90),
    (r"^<([A-Za-z_]+):([0-9]+)>$", 0.90),
)


def fuzzy_normal(token: Column) -> Column:
    """The placeholder that a token stands for, or null."""
    out = F.lit(None).cast("string")
    for regex, _ in reversed(FUZZY):
        name = F.upper(F.concat(F.lit("<"), F.regexp_extract(token, regex, 1), F.lit("_"), F.regexp_extract(token, regex, 2), F.lit(">")))
        out = F.when(token.rlike(regex), name).otherwise(out)
    return out


def fuzzy_confidence(token: Column) -> Column:
    """How sure it is that the token stands for its placeholder."""
    base = F.lit(0.0)
    case_variant = token.rlike(FUZZY[1][0])
    for regex, confidence in reversed(FUZZY):
        base = F.when(token.rlike(regex), confidence).otherwise(base)
    mixed = ~case_variant & (token != F.upper(token)) & (token != F.lower(token))
    spaced = token.contains(" ") & ~token.contains("< ")
    extra = F.greatest(F.length(token) - F.length(fuzzy_normal(token)), F.lit(0))
    bracket = token.startswith("[") | token.startswith("{")
    score = base - F.when(mixed, 0.05).otherwise(0.0) - F.when(spaced, 0.05).otherwise(0.0) - F.least(F.lit(0.1), extra * 0.02) - F.when(bracket, 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


#: What may stand for a placeholder within a text.
FUZZY_TOKEN = r"<\s*[A-Za-z][A-Za-z_]*?\s*[_\s:-]\s*[0-9]+\s*>|\[\s*[A-Za-z][A-Za-z_]*?\s*[_\s]\s*[0-9]+\s*\]|\{\{?\s*[A-Za-z][A-Za-z_]*?\s*[_\s]\s*[0-9]+\s*\}?\}|\(\s*[A-Za-z][A-Za-z_]*?\s*[_\s]\s*[0-9]+\s*\)"


def restore_fuzzy(texts: DataFrame, mapping: DataFrame, session_col: str, order_col: str, text_col: str, least: float = 0.75) -> DataFrame:
    """Like restore(), but variants of placeholders count too: by their place in the text, if their normal form, after one
    pair of doubled braces goes, is in the session's mapping and its confidence is at least `least`. Adds restored."""
    hits = lambda c: F.regexp_extract_all(c, F.lit(FUZZY_TOKEN), F.lit(0))
    asked = texts.select(session_col, order_col, F.explode(F.array_distinct(hits(F.col(text_col)))).alias("hit"))
    single = F.regexp_replace("hit", r"^\{(\{.*\})\}$", "$1")
    asked = asked.withColumn("placeholder", fuzzy_normal(single)).where(fuzzy_confidence(single) >= least)
    known = asked.join(mapping.select(session_col, "placeholder", "original"), [session_col, "placeholder"])
    known = known.groupBy(session_col, order_col).agg(F.map_from_entries(F.collect_list(F.struct("hit", "original"))).alias("_map"))
    out = texts.join(known, [session_col, order_col], "left")
    parts = F.arrays_zip(F.split(text_col, FUZZY_TOKEN, -1).alias("gap"), hits(F.col(text_col)).alias("hit"))
    put = F.array_join(F.flatten(F.transform(parts, lambda x: F.array(x["gap"], F.coalesce(F.try_element_at("_map", x["hit"]), x["hit"], F.lit(""))))), "")
    return out.withColumn("restored", F.when(F.col("_map").isNull(), F.col(text_col)).otherwise(put)).drop("_map")


def restore_synthetic(text: Column, entities: Column) -> Column:
    """The text with each synthetic value of its entities put back, the longest first, so that none cuts another."""
    made = F.filter(entities, lambda e: (e["strategy"] == "synthetic") & (e["new"] != "[REDACTED]"))
    pairs = F.array_distinct(F.transform(made, lambda e: F.struct((-F.length(e["new"])).alias("n"), e["new"].alias("new"), e["value"].alias("value"))))
    return F.aggregate(F.array_sort(pairs), text, lambda t, p: F.replace(t, p["new"], p["value"]))

"""Secrets: a catalogue of patterns compiled into the plan, matches with risk and line, blocking and sanitising."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrimlake.functions import text as T
from scrimlake.functions.values import RISKS, SECRETS
from scrimlake.operators.spans import splice
from scrimlake.sources import shared

MATCH = "struct<start:int,rank:int,end:int,name:string,secret_type:string,risk:string,value:string>"


def at_least(risk: Column, least: str) -> Column:
    return risk.isin(*RISKS[RISKS.index(least) :])


def patterns(types: tuple[str, ...] | None = None, min_risk: str = "none") -> tuple:
    """The catalogue's rows of these types and at least this risk."""
    return tuple(p for p in SECRETS if (types is None or p[1] in types) and RISKS.index(p[2]) >= RISKS.index(min_risk))


def _matches(text: Column, rank: int, name: str, kind: str, risk: str, regex: str, longest: int) -> Column:
    empty = F.array().cast(f"array<{MATCH}>")
    parts = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hit"))

    def step(acc, x):
        at, n = acc["pos"] + F.length(x["gap"]), F.coalesce(F.length(x["hit"]), F.lit(0))
        m = F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + n).alias("end"), F.lit(name).alias("name"), F.lit(kind).alias("secret_type"), F.lit(risk).alias("risk"), x["hit"].alias("value"))
        return F.struct((at + n).alias("pos"), F.when(n.between(1, longest), F.concat(acc["out"], F.array(m))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(regex), F.aggregate(parts, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])).otherwise(empty)


def scan(text: Column, catalogue: tuple = SECRETS, longest: int = 1000) -> Column:
    """All matches by start, then by place in the catalogue; of equal (start, end, type) the first."""
    found = F.array_sort(F.concat(F.array().cast(f"array<{MATCH}>"), *[_matches(text, k, *p, longest) for k, p in enumerate(catalogue)]))
    same = lambda a, m: (a["start"] == m["start"]) & (a["end"] == m["end"]) & (a["secret_type"] == m["secret_type"])
    return F.aggregate(found, F.array().cast(f"array<{MATCH}>"), lambda acc, m: F.when(F.exists(acc, lambda a: same(a, m)), acc).otherwise(F.concat(acc, F.array(m))))


def with_secrets(df: DataFrame, text_col: str = "text", catalogue: tuple = SECRETS) -> DataFrame:
    """Adds matches, should_block (any of high or critical risk) and sanitized (overlapping matches are cut out once)."""
    df = df.withColumn("matches", scan(F.col(text_col), catalogue))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{MATCH}>").alias("out"))
    apart = F.aggregate("matches", start, lambda acc, m: F.when(m["start"] >= acc["end"], F.struct(m["end"].alias("end"), F.concat(acc["out"], F.array(m)).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    edits = F.transform(apart, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit("[REDACTED:"), m["name"], F.lit("]")).alias("new")))
    return df.withColumn("should_block", F.exists("matches", lambda m: at_least(m["risk"], "high"))).withColumn("_edits", edits).withColumn("sanitized", splice(F.col(text_col), F.col("_edits"))).drop("_edits")


def match_rows(df: DataFrame, id_col: str, text_col: str = "text", catalogue: tuple = SECRETS) -> DataFrame:
    """One row for each match: id, name, secret_type, risk, start, end, line (from 1) and a preview of the value."""
    rows = df.select(id_col, text_col, F.explode(scan(F.col(text_col), catalogue)).alias("m"))
    line = F.regexp_count(F.left(F.col(text_col), F.col("m.start")), F.lit("\n")) + 1
    return rows.select(id_col, "m.name", "m.secret_type", "m.risk", "m.start", "m.end", line.alias("line"), T.preview(F.col("m.value")).alias("preview"))


def match_contents(df: DataFrame, id_col: str, text_col: str = "text", catalogue: tuple = SECRETS) -> DataFrame:
    """One row for each match: id, name, start, line (from 1) and content, the whole line that it begins on, trimmed."""
    rows = df.select(id_col, text_col, F.posexplode_outer(scan(F.col(text_col), catalogue)).alias("_i", "m")).where("_i is not null")
    line = (F.regexp_count(F.left(F.col(text_col), F.col("m.start")), F.lit("\n")) + 1).cast("int")
    content = F.regexp_replace(F.split_part(F.col(text_col), F.lit("\n"), line), r"^\s+|\s+$", "")
    return rows.select(id_col, "m.name", "m.start", line.alias("line"), content.alias("content"))


def tallies(df: DataFrame, id_col: str, text_col: str = "text", catalogue: tuple = SECRETS) -> DataFrame:
    """id, total, critical, high and should_block of every text's matches."""
    n = lambda risk: F.size(F.filter("matches", lambda m: m["risk"] == risk))
    out = df.select(id_col, scan(F.col(text_col), catalogue).alias("matches"))
    out = out.select(id_col, F.size("matches").alias("total"), n("critical").alias("critical"), n("high").alias("high"))
    return out.withColumn("should_block", F.col("critical") + F.col("high") > 0)


def scan_stats(tallied: DataFrame) -> DataFrame:
    """One row: total_scans, total_blocks, total_matches of tallies()."""
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return tallied.agg(F.count(F.lit(1)).alias("total_scans"), F.count_if("should_block").alias("total_blocks"), whole(F.sum("total")).alias("total_matches"))


def block_reasons(df: DataFrame, id_col: str, text_col: str = "text", catalogue: tuple = SECRETS) -> DataFrame:
    """id, reason: how many matches of each type, by first occurrence, of rows with any."""
    rows = match_rows(df, id_col, text_col, catalogue).groupBy(id_col, "secret_type").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "secret_type", "n")))
    return rows.groupBy(id_col).agg(listed.alias("l")).select(id_col, F.array_join(F.transform("l", lambda x: F.format_string("%s x%d", x["secret_type"], x["n"])), ", ").alias("reason"))


def json_strings(df: DataFrame, id_col: str, json_col: str, path: str, deepest: int = 64) -> DataFrame:
    """(id, path, value) of every string in a column of JSON texts; a path has a member's name after a dot, an element's place in brackets.

    Values are taken apart level by level: each level's objects and arrays are written under path and their members are the next level. Nulls and texts that aren't JSON have no
    strings; what lies deeper than `deepest` levels, at which Spark's own parser ends, isn't reached.
    """
    spark = df.sparkSession
    level = df.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.try_parse_json(json_col).alias("v")).where("v is not null")
    strings = []
    for depth in range(deepest + 1):
        level = shared.written(level.withColumn("kind", F.schema_of_variant("v")), f"{path}/level{depth}")
        strings.append(level.where("kind = 'STRING'").select("id", "path", F.variant_get("v", "$", "string").alias("value")))
        nested = level.where("kind like 'OBJECT%' or kind like 'ARRAY%'").select("id", "path", "v")
        if nested.isEmpty():
            break
        members = nested.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        level = members.select("id", F.concat("path", name).alias("path"), F.col("value").alias("v"))
    out = strings[0]
    for more in strings[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", id_col)


def json_match_rows(df: DataFrame, id_col: str, json_col: str, path: str, catalogue: tuple = SECRETS) -> DataFrame:
    """One row for each match in a string of a JSON text: id, path, name, secret_type, risk, start, end within the string, and a preview."""
    rows = json_strings(df, id_col, json_col, path).withColumn("_at", F.struct(id_col, "path"))
    return match_rows(rows, "_at", "value", catalogue).select("_at.*", "name", "secret_type", "risk", "start", "end", "preview")

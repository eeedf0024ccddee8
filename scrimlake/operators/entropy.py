"""Tokens that look random: entropy, shape and context of a token, and the suspicious tokens of a text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrimlake.functions import text as T

# fixed values: tokens that look random but are none, what a token of a key looks like, words near secrets, scores and reasons
FALSE_POSITIVES = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^#[0-9a-fA-F]{6}$",
    r"^#[0-9a-fA-F]{3}$",
    r"^[A-Z]{2,3}-[0-9]{3,5}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    r"^[0-9]{2}:[0-9]{2}:[0-9]{2}$",
    r"^[0-9]{4,}$",
)
BASE64 = r"^[A-Za-z0-9+/]{20,}={0,2}$"
LONG_HEX = r"^[0-9a-fA-F]{32,}$"
INDICATORS = ("key", "token", "secret", "password", "passwd", "pwd", "api", "auth", "session", "credential", "private", "access", "refresh")
SCORES = {"critical": 0.99, "high": 0.85, "medium": 0.70}
REASONS = {"critical": "Critical entropy - likely cryptographic material", "high": "High entropy - possible secret", "medium": "Medium entropy - suspicious", "low": "Low entropy - likely benign"}
LEAST = 16


def is_false_positive(token: Column) -> Column:
    return token.rlike("|".join(FALSE_POSITIVES))


def looks_like_token(token: Column) -> Column:
    """Base64 of 20 characters, hexadecimal of 32, or 20 characters with small and capital letters and digits."""
    mixed = (F.length(token) >= 20) & token.rlike(r"\p{Ll}") & token.rlike(r"\p{Lu}") & token.rlike(r"\p{Nd}")
    return token.rlike(BASE64) | token.rlike(LONG_HEX) | mixed


def has_indicators(context: Column) -> Column:
    return F.coalesce(F.lower(context).rlike("|".join(INDICATORS)), F.lit(False))


def _by_level(level: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(level == k, v).otherwise(out)
    return out


def analyze(df: DataFrame, token_col: str, context: Column | None = None, bits: Column | None = None) -> DataFrame:
    """df with entropy (3 decimals), level, suspicious and reason of a token; all null if it has fewer than LEAST characters.
    bits: the token's entropy, if it is at hand."""
    token = F.col(token_col)
    told = F.lit(False) if context is None else has_indicators(context)
    benign = is_false_positive(token)
    df = df.withColumn("entropy", F.when(F.length(token) >= LEAST, F.when(benign, 0.0).otherwise(F.round(T.entropy(token) if bits is None else bits, 3))))
    df = df.withColumn("level", F.when(F.col("entropy").isNotNull(), T.entropy_level(F.col("entropy"))))
    shaped = looks_like_token(token)
    df = df.withColumn("suspicious", F.col("level").isin("high", "critical") | ((F.col("level") == "medium") & (told | shaped)))
    reasons = F.concat_ws("; ", _by_level(F.col("level"), REASONS), F.when(shaped, "Token-like format detected"), F.when(told, "Context contains secret indicators"))
    return df.withColumn("reason", F.when(F.col("level").isNull(), None).when(benign, "Matches known false positive pattern").otherwise(reasons))


def _with_suspicious(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with an array (start, token, entropy, level, shaped) of the suspicious tokens of a text, by place.

    The text is cut at its tokens of LEAST characters or more alone, so what is between them counts by its length.
    """
    long = rf"\S{{{LEAST},}}"
    held = "array<struct<start:int,token:string>>"
    parts = F.arrays_zip(F.split(text_col, long, -1).alias("gap"), F.regexp_extract_all(text_col, F.lit(long), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(held).alias("out"))

    def step(acc, x):
        at = acc["pos"] + F.length(x["gap"])
        random = x["hit"].isNotNull() & ~x["hit"].rlike(r"^(\p{Nd}+|[\p{Ll}\p{Lo}]+|[\p{Lu}\p{Lo}]+)$")
        token = F.array(F.struct(at.alias("start"), x["hit"].alias("token")))
        return F.struct((at + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("pos"), F.when(random, F.concat(acc["out"], token)).otherwise(acc["out"]).alias("out"))

    found = F.when(F.col(text_col).rlike(long), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(held))
    df = df.withColumn(out, found)
    bits = lambda t: F.when(is_false_positive(t["token"]), 0.0).otherwise(F.round(T.entropy(t["token"]), 3))
    df = df.withColumn(out, F.transform(out, lambda t: F.struct(t["start"].alias("start"), t["token"].alias("token"), bits(t).alias("entropy"))))
    df = df.withColumn(out, F.transform(out, lambda t: F.struct(*[t[c].alias(c) for c in ("start", "token", "entropy")], T.entropy_level(t["entropy"]).alias("level"), looks_like_token(t["token"]).alias("shaped"))))
    return df.withColumn(out, F.filter(out, lambda t: t["level"].isin("high", "critical") | ((t["level"] == "medium") & t["shaped"])))


def suspicious_tokens(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, start, token, entropy, level, suspicious, reason of each run without spaces that is suspicious.

    Runs of digits, and of letters of one case, aren't. A token that stands twice in a text comes twice.
    """
    rows = _with_suspicious(df.select(id_col, text_col), text_col, "_t").select(id_col, F.posexplode_outer("_t").alias("_n", "_t")).where("_n is not null").select(id_col, "_t.*")
    benign = is_false_positive(F.col("token"))
    reasons = F.concat_ws("; ", _by_level(F.col("level"), REASONS), F.when(F.col("shaped"), "Token-like format detected"))
    return rows.select(id_col, "start", "token", "entropy", "level", F.lit(True).alias("suspicious"), F.when(benign, "Matches known false positive pattern").otherwise(reasons).alias("reason"))


def report(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, n_found and overall_risk, the highest level or none, of every row."""
    levels = ("low", "medium", "high", "critical")
    rank = lambda t: F.array_position(F.array(*[F.lit(x) for x in levels]), t["level"]).cast("int")
    rows = _with_suspicious(df.select(id_col, text_col), text_col, "_t").select(id_col, F.coalesce(F.size("_t"), F.lit(0)).alias("n_found"), F.array_max(F.transform("_t", rank)).alias("_top"))
    named = F.get(F.array(*[F.lit(x) for x in levels]), F.col("_top") - 1)
    return rows.select(id_col, F.greatest("n_found", F.lit(0)).alias("n_found"), F.coalesce(named, F.lit("none")).alias("overall_risk"))


def spans(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, entity_type, start, end, score, value of each suspicious token."""
    found = suspicious_tokens(df, id_col, text_col)
    end = (F.col("start") + F.length("token")).alias("end")
    return found.select(id_col, F.lit("HIGH_ENTROPY_SECRET").alias("entity_type"), "start", end, _by_level(F.col("level"), SCORES).cast("double").alias("score"), F.col("token").alias("value"))

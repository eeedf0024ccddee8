"""Detection: texts to arrays of scored spans, and what is done with such arrays. No Python runs on the executors.

A span is (entity_type, start, end, score, value); positions count code points from 0.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrimlake.functions import text as T
from scrimlake.functions.values import EMAIL, PHONE_WORDS, SURNAMES

SPAN = "struct<entity_type:string,start:int,end:int,score:double,value:string>"


@dataclass(frozen=True)
class Pattern:
    """A regular expression that never matches the empty string. check: which values count, as a Column function."""

    name: str
    entity_type: str
    regex: str
    score: float = 0.7
    check: object = None


CN_PHONE = (
    Pattern("cn_phone", "PHONE_NUMBER", r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])", 0.70),
    Pattern("cn_phone_code", "PHONE_NUMBER", r"(?:\+?86[-\s]?)1[3-9][0-9]{9}(?![0-9])", 0.85),
    Pattern("cn_phone_parts", "PHONE_NUMBER", r"(?<![0-9])1[3-9][0-9][-\s]?[0-9]{4}[-\s]?[0-9]{4}(?![0-9])", 0.65),
)
CN_ID = Pattern("cn_id", "ZH_ID_CARD", r"(?<![\p{L}\p{N}_])[1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx](?![\p{L}\p{N}_])", 0.70, T.id_checksum_ok)
MAIL = Pattern("email", "EMAIL_ADDRESS", EMAIL, 0.85)
IPV4 = Pattern("ipv4", "IP_ADDRESS", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", 0.6, T.valid_ipv4)
CARD = Pattern("card", "CREDIT_CARD", r"[0-9]{16}", 0.6)
US_PHONE = Pattern("us_phone", "PHONE_NUMBER", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.75)
DEFAULT = (MAIL, IPV4, CARD, US_PHONE, *CN_PHONE, CN_ID)


def pattern_spans(text: Column, p: Pattern) -> Column:
    """The matches of one pattern: what lies between matches and the matches themselves alternate, which gives offsets."""
    empty = F.array().cast(f"array<{SPAN}>")
    parts = F.arrays_zip(F.split(text, p.regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("pos"), empty.alias("out"))

    def step(acc, x):
        at = acc["pos"] + F.length(x["gap"])
        hit = x["hit"]
        span = F.struct(F.lit(p.entity_type).alias("entity_type"), at.alias("start"), (at + F.length(hit)).alias("end"), F.lit(p.score).cast("double").alias("score"), hit.alias("value"))
        keep = hit.isNotNull() if p.check is None else hit.isNotNull() & F.coalesce(p.check(hit), F.lit(False))
        return F.struct((at + F.coalesce(F.length(hit), F.lit(0))).alias("pos"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(p.regex), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(empty)


def detect(text: Column, patterns: Sequence[Pattern] = DEFAULT, entities: Sequence[str] | None = None) -> Column:
    """The spans of all patterns; entities: only patterns of these types are compiled into the plan."""
    asked = [p for p in patterns if entities is None or p.entity_type in entities]
    return F.concat(F.array().cast(f"array<{SPAN}>"), *[pattern_spans(text, p) for p in asked])


def _scored(s: Column, score: Column) -> Column:
    return F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), score.cast("double").alias("score"), s["value"].alias("value"))


def with_context(spans: Column, text: Column, entity_type: str = "PHONE_NUMBER", words: Sequence[str] = PHONE_WORDS, before: int = 30, boost: float = 0.35, least: float = 0.4) -> Column:
    """Spans of a type score more, at least `least` and at most 1, if one of the words, in any case, begins within so many characters before them."""
    listed = "(?iu)" + "|".join(words)
    near = lambda s: F.substring(text, F.greatest(s["start"] - before, F.lit(0)) + 1, F.least(s["start"], F.lit(before)))
    more = lambda s: F.least(F.greatest(F.round(s["score"] + boost, 6), F.lit(least)), F.lit(1.0))
    return F.transform(spans, lambda s: F.when((s["entity_type"] == entity_type) & near(s).rlike(listed), _scored(s, more(s))).otherwise(s))


def score_persons(spans: Column, base: float = 0.85, surname: float = 0.1, whole: float = 0.05, most: float = 0.95, lengths: tuple[int, int] = (2, 4)) -> Column:
    """PERSON spans that any model found, scored by a common surname at their start and by a usual length; others stay."""
    first = lambda s: F.when(F.left(s["value"], F.lit(1)).isin(*SURNAMES), F.least(F.lit(most), F.lit(base + surname))).otherwise(F.lit(base))
    both = lambda s: F.when(F.length(s["value"]).between(*lengths), F.least(F.lit(most), first(s) + whole)).otherwise(first(s))
    return F.transform(spans, lambda s: F.when(s["entity_type"] == "PERSON", _scored(s, F.round(both(s), 6))).otherwise(s))


def resolve(spans: Column, threshold: float = 0.5, order: str = "leftmost") -> Column:
    """Disjoint spans of at least the threshold. leftmost: by start, then score, then length, each kept if it begins
    after the last kept; highest_score: by score first, each kept if it meets none kept."""
    keyed = lambda s: F.struct(s["start"].alias("start"), (-s["score"]).alias("worse"), (s["start"] - s["end"]).alias("shorter"), s.alias("s"))
    if order == "highest_score":
        keyed = lambda s: F.struct((-s["score"]).alias("worse"), (s["start"] - s["end"]).alias("shorter"), s["start"].alias("start"), s.alias("s"))
    ordered = F.array_sort(F.transform(F.filter(spans, lambda s: s["score"] >= threshold), keyed))
    empty = F.array().cast(f"array<{SPAN}>")
    if order == "highest_score":
        meets = lambda kept, s: F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"]))
        kept = F.aggregate(ordered, empty, lambda acc, x: F.when(meets(acc, x["s"]), acc).otherwise(F.concat(acc, F.array(x["s"]))))
        return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["start"], s.alias("s")))), lambda x: x["s"])
    start = F.struct(F.lit(0).alias("end"), empty.alias("out"))
    take = lambda acc, x: F.when(x["s"]["start"] >= acc["end"], F.struct(x["s"]["end"].alias("end"), F.concat(acc["out"], F.array(x["s"])).alias("out"))).otherwise(acc)
    return F.aggregate(ordered, start, take, lambda acc: acc["out"])


def splice(text: Column, edits: Column) -> Column:
    """The text with each (start, end, new) of ordered disjoint edits put in place."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, e: F.struct(e["end"].alias("pos"), F.concat(acc["out"], F.array(F.substring(text, acc["pos"] + 1, e["start"] - acc["pos"]), e["new"])).alias("out"))
    return F.aggregate(edits, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))

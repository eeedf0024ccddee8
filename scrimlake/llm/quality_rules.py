"""Line-first cleaning with DataFrame functions only.

Every line of a text is judged by three rules, failing lines are removed, and a document that loses too
much of its text is rejected. Each row is judged by itself: no shuffle.

punctuation  over `symbol_percent` of the line's code points are neither letter, mark, digit nor space
navigation   separators (|, >, », ›, •, ·) are as many as a fifth of the line's gaps between words, or the
             line has fewer than `short_words` words and doesn't end as a sentence does
boilerplate  the line has at most `boilerplate_words` words and one of the phrases
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrimlake.llm.common import SPACES, words

PHRASES = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie",
    "javascript",
    "click here",
    "read more",
    "sign up",
    "log in",
    "subscribe",
    "lorem ipsum",
)
SEPARATORS = "|>»›•·"
SENTENCE_ENDS = ".!?…:;\"'”’»)。！？"
SYMBOLS = "#*$%&|<>"
#: A line of this pattern's characters alone has no symbol.
PLAIN = r"[\p{L}\p{M}\p{N} \t-\r]+"


@dataclass(frozen=True)
class LineRules:
    symbol_percent: int = 15
    short_words: int = 6
    boilerplate_words: int = 40
    max_lost_percent: int = 40
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5


def count_of(text: Column, characters: str) -> Column:
    """How many code points of the text are among the characters."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether one of the three rules removes this line. Blank lines stay."""
    n = F.length(line)
    gaps = count_of(line, " ") + 1
    symbols = F.length(F.regexp_replace(line, PLAIN, ""))
    unfinished = (gaps < rules.short_words) & ~F.right(line, F.lit(1)).isin(*SENTENCE_ENDS)
    menu = count_of(line, SEPARATORS) * 5 >= gaps
    phrase = (gaps <= rules.boilerplate_words) & F.lower(line).rlike("|".join(PHRASES))
    return (n > 0) & (unfinished | (menu & (count_of(line, SEPARATORS) > 0)) | (symbols * 100 > rules.symbol_percent * n) | phrase)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def clean_lines(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows with columns prefixed _q_: _q_lines, _q_left (lines that stay) and _q_lost (code points of the others)."""
    lines = docs.withColumn("_q_lines", F.split(F.coalesce(text_col, F.lit("")), "\n", -1))
    left = lines.withColumn("_q_left", F.filter("_q_lines", lambda x: ~line_fails(_trimmed(x), rules)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return left.withColumn("_q_lost", total(F.col("_q_lines")) - total(F.col("_q_left")))


def _repeat_words(pairs: Column, window: int) -> Column:
    """Words covered by windows whose hash occurs again; pairs: (hash, position) in order."""
    same = lambda p, i: (i > 0) & F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False))
    after = lambda p, i: F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False))
    at = F.array_sort(F.transform(F.filter(pairs, lambda p, i: same(p, i) | after(p, i)), lambda p: p["i"]))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n")), lambda acc: acc["n"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_removed,
    lost_chars and cleaned_text, one row for each row of docs.

    Null or blank text: no words, so base_failed. Repeated rows are judged alike; a null id stays null; extra
    columns are ignored; an empty table gives no rows. Windows are told apart by a 64-bit hash of their words.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    k = rules.window
    base = rows.withColumn("w", words(F.col("text")))
    windows = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - k, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("h", windows).withColumn("n_words", F.size("w").cast("long")).drop("w")
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    base = base.withColumn("pairs", pairs).drop("h")
    base = base.withColumn("n_repeat_words", _repeat_words(F.col("pairs"), k).cast("long")).drop("pairs")
    base = clean_lines(base, "text", rules)
    spoken = F.filter("_q_lines", lambda x: F.length(_trimmed(x)) > 0)
    base = base.withColumn("_q_spoken", spoken)
    base = base.withColumns(
        {
            "word_chars": (F.length("text") - count_of(F.col("text"), SPACES)).cast("long"),
            "n_symbols": count_of(F.col("text"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_q_spoken") - F.size(F.array_distinct("_q_spoken"))).cast("long"),
            "base_failed": (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent),
        }
    )
    kept = ~F.col("base_failed") & (F.col("_q_lost") * 100 <= F.length("text") * rules.max_lost_percent)
    return base.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        F.size("_q_lines").cast("long").alias("n_lines"), (F.size("_q_lines") - F.size("_q_left")).cast("long").alias("n_lines_removed"),
        F.col("_q_lost").alias("lost_chars"), F.array_join("_q_left", "\n").alias("cleaned_text"),
    )


def kept_rows(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of docs that the rules keep, without their failing lines; other columns are carried."""
    judged = judge(docs.withColumn("_row", F.struct("*")), "_row", text_col, rules)
    # the row number keeps Spark from moving the filter below, and so repeating, the computation that it tests
    judged = judged.select("id", "kept", "cleaned_text", F.monotonically_increasing_id().alias("_n")).where(F.col("kept") & (F.col("_n") >= 0))
    return judged.select(*[F.col("cleaned_text").alias(c) if c == text_col else F.col(f"id.`{c}`").alias(c) for c in docs.columns])

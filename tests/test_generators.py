"""Synthetic names and id cards, detectors in code, tokens in long texts."""

import pytest
from pyspark.sql import functions as F

from scrimlake.functions import generators as G
from scrimlake.functions import text as T
from scrimlake.operators import detectors, entropy, spans


def named(spark, names, seed=42, gender=None):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    return [r[1] for r in sorted(rows.select("k", G.synthetic_name(F.col("n"), F.lit(seed), gender)).collect())]


def test_names(spark):
    names = ["张三", "王小明", "欧阳修", "欧阳", "李", "", None, "赵一二三", "张三"]
    out = named(spark, names)
    assert [len(x) if x is not None else None for x in out] == [2, 3, 3, 2, 1, 0, None, 4, 2]
    assert out[0] == out[8] != "张三" and out[2][:2] in G.TWO_SIGNS and out[3] in G.TWO_SIGNS and out[1][0] in G.ONE_SIGN
    assert out[4:7] == ["李", "", None]
    assert named(spark, ["王小明"], seed=7) != named(spark, ["王小明"], seed=42)
    men, women = named(spark, ["王小明"], gender="male")[0], named(spark, ["王小明"], gender="female")[0]
    assert men[2] in G.MEN + G.ANYBODY and women[2] in G.WOMEN + G.ANYBODY


def test_id_cards_keep_province_birth_and_gender(spark):
    cards = ["110101199003077758", "31010119850101123x", "440301850101124", "12345", None, " 110101199003077715 "]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cards)], "k int, c string")
    made = G.synthetic_id_card(F.col("c"), F.lit(42))
    out = {r["k"]: (r["s"], r["ok"]) for r in rows.select("k", made.alias("s"), T.id_checksum_ok(made).alias("ok")).collect()}
    assert out[3][0] == "12345" and out[4][0] is None
    for k, (province, born, odd) in {0: ("11", "19900307", 1), 1: ("31", "19850101", 1), 2: ("44", "19850101", 0), 5: ("11", "19900307", 1)}.items():
        s, ok = out[k]
        assert ok and s != cards[k] and s[:2] == province and s[6:14] == born and int(s[16]) % 2 == odd


def test_sessions_have_seeds_of_their_own(spark):
    a, b, c = spark.range(1).select(G.session_seed(F.lit("a")), G.session_seed(F.lit("b")), G.session_seed(F.lit("a"), 42)).first()
    assert a != b and c == (a + 42) % 2**31


def test_detectors_run_beside_patterns_and_only_if_asked(spark):
    def find(texts, sign):
        return [[("THING", t.index(sign), t.index(sign) + 1, 0.9), ("OTHER", 0, 1, 0.9)] if sign in t else [] for t in texts]

    d = detectors.Detector("x", ("THING", "OTHER"), find, load=lambda: "x")
    rows = spark.createDataFrame([("a x a@b.com",), (None,), ("none",), ("",)], "t string")
    found = lambda e: [sorted((s["entity_type"], s["start"], s["value"]) for s in r[0] or []) for r in rows.select(detectors.detect_with(F.col("t"), (d,), (spans.MAIL,), e)).collect()]
    assert found(None) == [[("EMAIL_ADDRESS", 4, "a@b.com"), ("OTHER", 0, "a"), ("THING", 2, "x")], [], [], []]
    assert found(("THING",))[0] == [("THING", 2, "x")]
    plan = rows.select(detectors.detect_with(F.col("t"), (d,), (spans.MAIL,), ("EMAIL_ADDRESS",)))._jdf.queryExecution().optimizedPlan().toString()
    assert "made" not in plan


def test_a_detectors_spans_lie_within_their_text(spark):
    bad = detectors.Detector("bad", ("T",), lambda texts: [[("T", 0, 99, 1.0)] for _ in texts])
    with pytest.raises(Exception, match="gave the span 0 to 99"):
        spark.createDataFrame([("short",)], "t string").select(detectors.code_spans(F.col("t"), bad)).collect()


def test_tokens_of_long_texts(spark):
    """Offsets count all that stands before a token; a text of 200,000 words takes no longer than its length asks."""
    token = "aB3dE5fG7hJ9kL1mN3pQ"
    text = "word " * 200_000 + token + " " + "b" * 30 + "  " + token
    rows = spark.createDataFrame([(1, text), (2, None), (3, "short aB3"), (4, token)], "k int, text string")
    found = sorted((r["k"], r["start"], r["token"]) for r in entropy.suspicious_tokens(rows, "k").collect())
    assert found == [(1, 1_000_000, token), (1, 1_000_053, token), (4, 0, token)]
    assert sorted(tuple(r)[:2] for r in entropy.report(rows, "k").collect()) == [(1, 2), (2, 0), (3, 0), (4, 1)]

"""Exemptions, synthetic values of sessions, streamed completions with state, anchored hours, ranges of large keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scrimlake.operators import anonymize as A
from scrimlake.operators import spans, synthetic, usage
from scrimlake.plans import catalog, sessions  # noqa: F401 - registers its queries
from scrimlake.sources import shared
from scrimlake.streaming import completion

ALLOW = "entity_type string, entry string, enabled boolean, case_sensitive boolean"
T0 = dt.datetime(2024, 1, 1)


# ---- exemptions


def exempting(spark, texts, allow=(), kinds=("EMAIL_ADDRESS",), **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    lists = spark.createDataFrame(list(allow), ALLOW) if allow else None
    out = A.anonymize_exempting(rows, shared.folder(spark), lists, kinds, strategies={}, **more)
    return {r["k"]: (r["anon_text"], [(e["value"], e["reason"]) for e in r["exemptions"]]) for r in out.collect()}


def test_allowlisted_and_asked_values_stay(spark):
    texts = ["mail a@x.com and b@x.com and a@x.com", "Who is a@x.com?", "send to A@X.com", None, "", "host 10.0.0.1"]
    allow = [("EMAIL_ADDRESS", "b@X.com", True, False), ("*", "10.0.0.1", True, True), ("EMAIL_ADDRESS", "a@x.com", False, False), ("PHONE_NUMBER", "A@X.com", True, False)]
    assert exempting(spark, texts, allow) == {
        0: ("mail <EMAIL_1> and b@x.com and <EMAIL_1>", [("b@x.com", "allowlist")]),
        1: ("Who is a@x.com?", [("a@x.com", "intent")]),
        2: ("send to <EMAIL_1>", []),
        3: (None, []),
        4: ("", []),
        5: ("host 10.0.0.1", [("10.0.0.1", "allowlist")]),
    }


def test_intent_comes_before_the_allowlist(spark):
    assert exempting(spark, ["Who is a@x.com?"], [("*", "a@x.com", True, True)])[0][1] == [("a@x.com", "intent")]


def test_persons_in_questions_stay_and_in_statements_go(spark):
    """Spans of any detector, by the default types that a question keeps."""
    texts = ["Who is Xi Jinping?", "Send email to Xi Jinping"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    at = F.instr("text", "Xi") - 1
    span = F.array(F.struct(F.lit("PERSON").alias("entity_type"), at.alias("start"), (at + 10).alias("end"), F.lit(0.9).alias("score"), F.lit("Xi Jinping").alias("value")))
    out = A.anonymize_exempting(rows, shared.folder(spark), spans=span, strategies={})
    assert {r["anon_text"] for r in out.collect()} == {"Who is Xi Jinping?", "Send email to <PERSON_1>"}


def test_exempting_without_lists_is_anonymize(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plain = A.anonymize(docs).select("doc_id", "anon_text")
    held = A.anonymize_exempting(docs, shared.folder(spark), asked_types=()).select("doc_id", "anon_text")
    assert plain.exceptAll(held).count() == 0 and held.count() == docs.count()


def test_a_long_allowlist_is_not_broadcast_whole_and_repeats_do_no_harm(spark):
    lists = spark.range(30_000).select(F.lit("*").alias("entity_type"), F.concat(F.lit("u"), F.col("id") % 20_000, F.lit("@x.com")).alias("entry"), F.lit(True).alias("enabled"), F.lit(False).alias("case_sensitive"))
    rows = spark.range(100).select(F.concat(F.lit("to U"), F.col("id") * 400, F.lit("@x.com")).alias("text"))
    out = A.anonymize_exempting(rows, shared.folder(spark), lists, (), strategies={})
    assert out.where(F.col("anon_text").contains("<EMAIL_1>")).count() == 50 and out.count() == 100


# ---- synthetic values


def test_a_session_has_no_value_twice(spark):
    out = spark.range(1, 60_001).select(synthetic.scrambled(F.col("id"), F.lit("s")).alias("a"), synthetic.scrambled(F.col("id"), F.lit("t")).alias("b"))
    held = out.agg(F.count_distinct("a"), F.count_distinct("b"), F.min("a"), F.max("a"), F.count_if(F.col("a") == F.col("b"))).first()
    assert held[0] == held[1] == 60_000 and held[2] >= 0 and held[3] < 10**8 and held[4] < 10


def test_the_permutation_is_whole(spark):
    """Every round can be undone, so all of the numbers are permuted: the same holds for halves of any size."""
    r = random.Random(2)
    for number in (r.randrange(10**8) for _ in range(200)):
        left, right = divmod(number, synthetic.HALF)
        keys = [r.randrange(1 << 28) for _ in range(synthetic.ROUNDS)]
        mix = lambda x, k: ((x * 40503 + k) * 2654435 + k >> 16) % synthetic.HALF
        a, b = left, right
        for k in keys:
            a, b = b, (a + mix(b, k)) % synthetic.HALF
        for k in reversed(keys):
            a, b = (b - mix(a, k)) % synthetic.HALF, a
        assert (a, b) == (left, right)


def test_restoring_takes_the_longest_and_searches_nothing_again(spark):
    texts = spark.createDataFrame([("s", 1, "to ab and abc, abx"), ("s", 2, None), ("s", 3, "none"), ("t", 1, "ab abc"), (None, 1, "ab"), ("u", 1, "ab")], "s string, o long, x string")
    mapping = spark.createDataFrame([("s", "abc", "1"), ("s", "ZZ", "ab"), ("s", "Q", "abx"), ("t", "T", "ab")], "s string, original string, placeholder string")
    mapping = mapping.select("s", F.col("original"), F.col("placeholder")).unionByName(spark.createDataFrame([("s", "zz", "abc"), ("u", "x", "")], "s string, original string, placeholder string"))
    for together in (10_000, 1):
        found = {(r["s"], r["o"]): (r["restored"], r["n_restored"]) for r in synthetic.restore_sessions(texts, mapping, "s", "o", "x", together).collect()}
        assert found == {("s", 1): ("to ZZ and zz, Q", 3), ("s", 2): (None, 0), ("s", 3): ("none", 0), ("t", 1): ("T abc".replace("abc", "Tc"), 2), (None, 1): ("ab", 0), ("u", 1): ("ab", 0)}


def test_many_values_of_a_session_come_back(spark):
    """5,000 addresses in one session, each text holding some; an original may look like a synthetic value."""
    turns = spark.range(1000).select(F.lit(7).alias("s"), F.col("id").alias("o"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(F.lit("m"), F.col("id") * 5 + k, F.lit("@y.org"))), " ").alias("text"))
    turns = turns.withColumn("text", F.when(F.col("o") == 3, F.concat("text", F.lit(" user00000001@example.com"))).otherwise(F.col("text")))
    rows, mapping = A.anonymize_sessions(turns, "s", "o", patterns=(spans.MAIL,), name=synthetic.session_value)
    assert mapping.select("placeholder").distinct().count() == 5001
    out = synthetic.restore_sessions(rows, mapping, "s", "o", "anon_text", together=100).join(turns, ["s", "o"])
    assert out.where(F.col("restored") != F.col("text")).count() == 0
    assert out.agg(F.sum("n_restored")).first()[0] == 5001


# ---- streamed completions


def event(request, seq, chunk=None, done=False, names=None, at=0, tenant="t"):
    return (tenant, request, seq, chunk, done, names, T0 + dt.timedelta(seconds=at))


def released(spark, batches, **options):
    """Each batch as a file and a run of its own from the checkpoint of the one before."""
    folder = shared.folder(spark)
    for batch in batches:
        spark.createDataFrame(batch, completion.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(completion.EVENT).parquet(f"{folder}/in")
        out = completion.completions(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        completion.started(spark, out).awaitTermination()
    rows = spark.read.schema(completion.RELEASED).parquet(f"{folder}/out").collect()
    return sorted((r["tenant_id"], r["request_id"], r["seq"], r["out"], r["event"]) for r in rows)


def test_chunks_are_let_out_in_order_over_restarts(spark):
    names = {"<PERSON_1>": "Ann", "<EMAIL_1>": "a@x.com"}
    batches = [
        [event("r", 2, "N_1>, <EM"), event("r", 4, ".", True), event("r", -1, names=names, tenant="u")],
        [event("r", 0, "to "), event("r", -1, names=names)],
        [event("r", 0, "to "), event("r", 1, "<PERSO"), event("r", 0, "<PERSON_1>", tenant="u")],
        [event("r", 3, "AIL_1>"), event("r", 1, "", True, tenant="u"), event("r", 1, "<PERSO")],
    ]
    found = released(spark, batches, late="1 hour")
    assert found == [("t", "r", 0, "to ", "text"), ("t", "r", 1, "", "text"), ("t", "r", 2, "Ann, ", "text"), ("t", "r", 3, "a@x.com", "text"), ("t", "r", 4, ".", "stop"), ("u", "r", 0, "Ann", "text"), ("u", "r", 1, "", "stop")]


def test_every_order_gives_the_same_text(spark):
    r = random.Random(4)
    text, names = "Hi <PERSON_1>, <PERSON_2> <b>bold</b> <EMAIL_9> a<b <PERSON_1", {"<PERSON_1>": "张三", "<PERSON_2>": "<PERSON_1>"}
    events = []
    for k in range(6):
        size = k + 1
        cuts = [text[i : i + size] for i in range(0, len(text), size)]
        events += [event(f"r{k}", -1, names=names), *[event(f"r{k}", i, c, i == len(cuts) - 1) for i, c in enumerate(cuts)]]
    r.shuffle(events)
    found = released(spark, [events[i::3] for i in range(3)], late="1 hour")
    want = "Hi 张三, <PERSON_1> <b>bold</b> <EMAIL_9> a<b <PERSON_1"
    for k in range(6):
        assert "".join(x[3] for x in found if x[1] == f"r{k}") == want
    assert sum(x[4] == "stop" for x in found) == 6


def test_a_mapping_expires_and_chunks_prolong_it(spark):
    names = {"<A_1>": "x"}
    batches = [
        [event("dies", -1, names=names), event("dies", 0, "<A_1> <A"), event("dies", 2, "late"), event("lives", -1, names=names), event("lives", 0, "<A_1>")],
        [event("lives", 1, "<A_1>", at=80)],
        [event("lives", 2, "<A_", at=160)],  # 100 seconds after the begin only those that were prolonged are left
        [event("lives", 3, "1>", True, at=200)],
        [event("clock", -1, at=1000)],
        [event("clock", 0, "<A_1>", True, at=1001)],
    ]
    found = released(spark, batches, ttl=100, every=10, late="0 seconds")
    assert [x[2:] for x in found if x[1] == "dies"] == [(0, "x ", "text"), (1, "<Alate", "expired")]
    assert [x[2:] for x in found if x[1] == "lives"] == [(0, "x", "text"), (1, "x", "text"), (2, "", "text"), (3, "x", "stop")]
    assert [x[2:] for x in found if x[1] == "clock"] == [(0, "<A_1>", "stop")]


def test_quota_counts_requests_in_order_whoever_is_blocked(spark):
    rows = [("a", f"r{k}", T0 + dt.timedelta(minutes=40 * k), k == 1) for k in range(5)] + [("b", "x", T0, True), ("b", "y", T0, False)]
    limits = spark.createDataFrame([("a", 3)], "tenant_id string, quota int")
    out = completion.admitted(spark.createDataFrame(rows, "tenant_id string, request_id string, at timestamp, should_block boolean"), limits)
    assert {r["request_id"]: r["code"] for r in out.collect()} == {"r0": None, "r1": "secret_blocked", "r2": None, "r3": "quota_exceeded", "r4": "quota_exceeded", "x": "secret_blocked", "y": None}


# ---- usage by ranges


def hours(spark, offsets, tenant="t"):
    rows = spark.createDataFrame([(tenant, T0 + dt.timedelta(seconds=s)) for s in offsets], "tenant_id string, ts timestamp")
    return sorted(((r["window_start"] - T0).total_seconds(), r["used"]) for r in usage.anchored_hours(rows).collect())


def folded(offsets):
    out = []
    for s in sorted(offsets):
        if not out or s > out[-1][0] + 3600:
            out.append([s, 0])
        out[-1][1] += 1
    return [tuple(x) for x in out]


@pytest.mark.parametrize("offsets", [[0], [0, 0, 3600, 3600.000001], [5, 3605, 3606, 7206, 7207, 100_000], []])
def test_anchored_hours(spark, offsets):
    assert hours(spark, offsets) == folded(offsets)


def test_anchored_hours_of_long_chains(spark):
    r = random.Random(6)
    offsets = [r.randrange(0, 90 * 3600) + r.choice([0, 0.5]) for _ in range(700)] + [r.randrange(10**6, 2 * 10**6) for _ in range(50)]
    assert hours(spark, offsets) == folded(offsets)


def test_hourly_quota_at_its_limit(spark):
    """The tenth of ten requests in an hour is allowed, the eleventh isn't; after the hour there are ten more."""
    used = dict(hours(spark, [60 * k for k in range(10)] + [3661]))
    limits = lambda n, quota: n + 1 <= quota
    assert used == {0.0: 10, 3661.0: 1} and not limits(used[0.0], 10) and limits(9, 10) and not limits(5, 5)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_rolling_over_ranges_is_that_of_one_window(spark, parts):
    r = random.Random(parts)
    rows = [("hot" if r.random() < 0.8 else r.choice(["a", "b", None]), k, r.random() if r.random() < 0.9 else None) for k in range(600)]
    df = spark.createDataFrame(rows, "p string, o long, v double")
    from pyspark.sql import Window

    w = Window.partitionBy("p").orderBy("o").rowsBetween(-6, 0)
    want = df.select("p", "o", F.round(F.avg("v").over(w), 6).alias("rolling_avg"), F.max("v").over(w).alias("rolling_max"), F.count("v").over(w).alias("n"))
    found = usage.rolling(df, "p", "o", "v", size=7, parts=parts)
    assert found.exceptAll(want).count() == 0 and found.count() == 600


@pytest.mark.parametrize("parts", [1, 20])
def test_bucket_segments_are_one_fold(spark, parts):
    r = random.Random(9)
    rows, at = [], {"hot": 0.0, "b": 0.0, None: 0.0}
    for k in range(500):
        key = r.choice(["hot"] * 6 + ["b", None])
        at[key] += r.choice([0, 0.25, 0.5, 1.75, 6.0])  # exact in binary
        rows.append((k, key, T0 + dt.timedelta(seconds=at[key])))
    want, state = {}, {}
    for k, key, t in rows:
        tokens, last = state.get(key, (3.0, t))
        ok, tokens = usage.refill(tokens, 0.0, (t - last).total_seconds(), 0.5, 3.0)
        state[key] = tokens, t
        want[k] = ok
    out = usage.token_bucket(spark.createDataFrame(rows, "event_id long, key string, ts timestamp"), "key", 0.5, 3.0, parts=parts)
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == want and 100 < sum(want.values()) < 480

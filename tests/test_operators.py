"""Operators on small tables: literal cases, invariants, and the registered queries against their SQL."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scrimlake.functions import text as T
from scrimlake.operators import anonymize as A
from scrimlake.operators import audit, govern, secrets, spans, usage
from scrimlake.plans import catalog, generators, relations, sessions, streams  # noqa: F401 - registers its queries
from scrimlake.sources import audit_log, lists
from scrimlake.streaming import rehydrate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_its_sql_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = catalog.QUERIES[name](spark, SF)
    rel = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in rel.description]
    rows = lambda names, rs: sorted(tuple(repr(r[k]) for k in sorted(range(len(names)), key=names.__getitem__)) for r in rs)
    assert sorted(df.columns) == sorted(columns) and rows(df.columns, df.collect()) == rows(columns, rel.fetchall())


@pytest.mark.parametrize("name", ["anonymize_exempting", "anonymize_exemptions", "question_intent", "entity_intent_context", "intent_replaced_entities"])
def test_questions_are_those_of_the_sql(spark, tmp_path, name):
    """Words that end before a letter with an accent, letters that are like ASCII ones in any case, wide spaces, white space and line ends at the edges."""
    texts = ["Do\u00f1ez los.", "Is\u00e9 ta", "Does it", "Doesx it", "Wha\u0442 it", "\u3000Can it", "Ca\u0301n it", "\x0bCan it", "\x0cCan it", "so?\u00a0", "so?\u3000", "a \u212anown", "de\u017fcribe it", "Wa\u017f it", "I\u017f it", "I\u017f\u017f it", "Who_ it", "do you \u212anow", "plain", ""]
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        if t in ("customer", "nation"):
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    roles = [("system", "user", "assistant")[k % 3] for k in range(3)]
    rows = spark.createDataFrame([(k, j, r, t) for k, t in enumerate(texts) for j, r in enumerate(roles)], "conv_id long, turn int, role string, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    rel = db.execute(catalog.ORACLES[name])
    columns = sorted(d[0] for d in rel.description)
    expected = sorted(map(repr, rel.fetchdf()[columns].astype(str).values.tolist()))
    assert sorted(map(repr, catalog.QUERIES[name](spark, str(tmp_path)).toPandas()[columns].astype(str).values.tolist())) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    rows = catalog.QUERIES[name](spark, SF)
    assert rows.count() > 0 and len(rows.columns) > 1


@pytest.mark.parametrize("name", ["detect_email", "overlap_resolved_spans", "anonymize_mixed", "secret_sanitized", "pii_counts_by_type", "audit_summary"])
def test_no_python_in_native_plans(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("value,kind,masked", [("13800138000", "PHONE", "138****8000"), ("test@example.com", "EMAIL", "t**t@example.com"), ("110101199003077758", "ID_CARD", "110101********7758"), ("4111111111111111", "CREDIT_CARD", "4111********1111"), ("abc", "OTHER", "***"), ("192.168.10.20", "IP", "192*******.20")])
def test_masks(spark, value, kind, masked):
    assert one(spark, T.mask(F.lit(value), F.lit(kind)))[0] == masked


def test_id_checksum(spark):
    ids = {"110101199003077715": True, "11010119900307109X": True, "110101199003077758": True, "110101199003077710": False, "12345678901234567X": False, "11010119900307": False}
    assert {v: one(spark, T.id_checksum_ok(F.lit(v)))[0] for v in ids} == ids


def test_fuzzy_tokens(spark):
    tokens = ["<person_1>", "<Person_1>", "[PERSON_1]", "{PERSON_1}", "(PERSON_1)", "<PERSON-1>", "<PERSON:1>", "< PERSON_1 >", "< PERSON_1>", "<PERSON _1>", "<PERSON_1>"]
    for t in tokens:
        name, sure = one(spark, A.fuzzy_normal(F.lit(t)), A.fuzzy_confidence(F.lit(t)))
        assert name == "<PERSON_1>" and sure >= 0.75, t
    assert [one(spark, A.fuzzy_normal(F.lit(t)))[0] for t in ("PERSON_1", "hello", "", "<>")] == [None] * 4


def test_offsets_count_code_points(spark):
    df = spark.createDataFrame([("😀 a@b.de and 13800138000 or 1.2.3.4, 300.1.1.1",)], "text string")
    found = df.select(F.explode(spans.resolve(spans.detect(F.col("text")))).alias("s")).select("s.start", "s.end", "s.value", "s.entity_type").collect()
    assert [tuple(r) for r in found] == [(2, 8, "a@b.de", "EMAIL_ADDRESS"), (13, 24, "13800138000", "PHONE_NUMBER"), (28, 35, "1.2.3.4", "IP_ADDRESS")]


def test_overlaps(spark):
    row = "array(named_struct('entity_type','A','start',0,'end',5,'score',0.6D,'value','x'), named_struct('entity_type','B','start',3,'end',9,'score',0.9D,'value','y'), named_struct('entity_type','C','start',9,'end',12,'score',0.4D,'value','z'))"
    kept = lambda **k: [s["entity_type"] for s in one(spark, spans.resolve(F.expr(row), **k))[0]]
    assert kept() == ["A"] and kept(order="highest_score") == ["B"] and kept(threshold=0.1) == ["A", "C"]


def test_round_trip_and_numbering(spark):
    r = random.Random(1)
    mails = ["ann@x.de", "Bob@y.org", "c.d@z.com"]
    texts = [" ".join(r.choice([*mails, "10.0.0.1", "word", "+1 (555) 123-4567", "😀"]) for _ in range(r.randint(0, 12))) for _ in range(40)] + ["", None]
    df = A.anonymize(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), strategies={}, default="placeholder", patterns=(spans.MAIL, spans.IPV4, spans.US_PHONE))
    for row in df.withColumn("back", A.restore_in_row(F.col("anon_text"), A.reversible(F.col("entities")))).collect():
        assert row["back"] == row["text"]
        if row["text"]:
            assert not any(m in row["anon_text"] for m in mails)
            last = [e for e in row["entities"] if e["ptype"] == "EMAIL"][-1:]
            assert not last or last[0]["new"] == "<EMAIL_1>"


def test_secrets_do_not_overlap_when_cut_out(spark):
    text = "password = sk-abcdefghijklmnop and\nredis://u:p@h/0 key-" + "a" * 32
    row = secrets.with_secrets(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert row["should_block"] and row["sanitized"] == "[REDACTED:Password in Connection String] and\n[REDACTED:Redis URL] key-[REDACTED:Mailgun API Key]"
    assert {m["name"] for m in row["matches"]} >= {"OpenAI API Key", "Redis URL"} and len(secrets.patterns(min_risk="critical")) < len(secrets.patterns())


def test_allowlists(spark):
    found = spark.createDataFrame([(1, "PERSON", "Ada"), (2, "PERSON", "bob"), (3, "ORG", "ADA")], "id long, entity_type string, value string")
    allow = spark.createDataFrame([("PERSON", "ada", True, False), ("*", "bob", False, False)], "entity_type string, entry string, enabled boolean, case_sensitive boolean")
    assert [r["id"] for r in govern.exempt(found, allow).collect()] == [1]
    assert sorted(r["id"] for r in govern.not_exempt(found, allow).collect()) == [2, 3]


def test_token_bucket(spark):
    events = spark.createDataFrame([(k, "a", float(t)) for k, t in enumerate([0, 0, 0, 1, 1, 10])], "event_id long, key string, s double").withColumn("ts", F.timestamp_seconds("s"))
    out = {r["event_id"]: r["admitted"] for r in usage.token_bucket(events, "key", 1.0, 2.0).collect()}
    assert out == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}


def test_audit_log(spark, tmp_path):
    rows = [(str(k), "pii_detected", f"2026-01-{k + 1:02d} 10:00:00", k) for k in range(5)]
    events = spark.createDataFrame(rows, "event_id string, event_type string, t string, entity_count int").withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    audit_log.append(events, str(tmp_path / "log"))
    with open(glob.glob(str(tmp_path / "log/event_date=2026-01-03"))[0] + "/bad.json", "w") as f:
        f.write("{broken\n")
    assert audit_log.read(spark, str(tmp_path / "log")).count() == 5
    got = audit.summary(audit_log.read(spark, str(tmp_path / "log"))).first()
    assert (got["total_events"], got["pii_detected_count"]) == (5, 10)


def test_lists(spark, tmp_path):
    (tmp_path / "public_figures.txt").write_text("# names\nAda Lovelace\n\n ada lovelace \nBob\n")
    found = {(r["name"], r["entity_type"], r["entry"]) for r in lists.allowlists(spark, str(tmp_path)).collect()}
    assert found == {("public_figures", "PERSON", "ada lovelace"), ("public_figures", "PERSON", "bob")}


def test_any_chunking_restores_the_same():
    originals, text, r = {"<PERSON_1>": "张三", "<EMAIL_2>": "a@b.de"}, "Hi <PERSON_1>, a < b > c <EMAIL_2><PERSON_1> <PERS", random.Random(2)
    for _ in range(200):
        buffer, out, at = "", "", 0
        while at < len(text):
            n = r.randint(1, 9)
            buffer, at = buffer + text[at : at + n], at + n
            cut = rehydrate.safe_part(buffer)
            out, buffer = out + rehydrate.restore(buffer[:cut], originals), buffer[cut:]
        assert out + rehydrate.restore(buffer, originals) == "Hi 张三, a < b > c a@b.de张三 <PERS"


def test_allowlists_keep_repeated_rows(spark):
    from scrimlake.operators import govern

    rows = spark.createDataFrame([("ORG", "Acme")] * 2 + [("ORG", "acme"), ("ORG", None), ("PERSON", "Bo")] * 2, "entity_type string, value string")
    allow = spark.createDataFrame([("ORG", "Acme", True, True), ("ORG", "Acme", True, True), ("*", "bo", False, False)], "entity_type string, entry string, enabled boolean, case_sensitive boolean")
    assert [tuple(r) for r in govern.exempt(rows, allow).collect()] == [("ORG", "Acme")] * 2
    assert sorted((tuple(r) for r in govern.not_exempt(rows, allow).collect()), key=str) == sorted([("ORG", "acme"), ("ORG", None), ("PERSON", "Bo")] * 2, key=str)


def test_percentiles_of_few_and_null_values(spark):
    from scrimlake.operators import usage

    rows = [("a", float(v)) for v in (3, 1, 2, 2)] + [("a", None), (None, 5.0)]
    found = {r["k"]: tuple(r)[1:] for r in usage.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert found == {"a": (4, 1.0, 3.0, 2.0, 2.0, 3.0, 3.0), None: (1, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0)}


@pytest.mark.parametrize("name, most", [("pii_counts_by_type", 4), ("anonymize_placeholder", 4), ("anonymize_hash", 4), ("anonymize_mask", 4), ("anonymize_synthetic", 4), ("strategy_overlay", 4), ("mapping_relation", 2), ("entropy_tokens", 1), ("entropy_report", 1)])
def test_detection_isn_t_repeated(spark, name, most):
    """Each pattern is looked for once in a text; entropy cuts the texts of two tables."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    tables = 2 if name.startswith("entropy") else 1
    assert 0 < plan.count("regexp_extract_all") <= 2 * most * tables


def test_fuzzy_tokens_in_texts(spark):
    from scrimlake.operators import anonymize

    texts = ["see <person_1>, [PERSON_1] and {{PERSON_1}}.", "<PERSON_1 <PERSON_9> (x 1) <PERSON:1>", "none"]
    rows = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "s string, n int, t string")
    mapping = spark.createDataFrame([("s", "<PERSON_1>", "Bo")], "s string, placeholder string, original string")
    found = [r["restored"] for r in anonymize.restore_fuzzy(rows, mapping, "s", "n", "t").orderBy("n").collect()]
    assert found == ["see Bo, Bo and Bo.", "<PERSON_1 <PERSON_9> (x 1) Bo", "none"]


def test_tenants_and_quotas_of_yaml(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("tenants:\n- {tenant_id: a, name: A, status: SUSPENDED, api_keys: [k1, k2], max_ttl: 600}\n- {tenant_id: b, name: B, status: odd}\n")
    found, keys = lists.tenants(spark, str(tmp_path / "t.yaml"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", "A", "suspended", "60/minute", 600), ("b", "B", "active", "60/minute", 300)]
    assert sorted((r["tenant_id"], r["status"]) for r in keys.collect()) == [("a", "suspended")] * 2
    (tmp_path / "q.yaml").write_text("quotas:\n- {tenant_id: a, soft_limit_percent: 50, requests: {daily: 10, yearly: 5}, tokens: {hourly: 7}}\n- {tenant_id: b}\n")
    assert sorted(tuple(r) for r in lists.quotas(spark, str(tmp_path / "q.yaml")).collect()) == [("a", "requests", "daily", 10, 50.0), ("a", "tokens", "hourly", 7, 50.0)]
    (tmp_path / "e.yaml").write_text("")
    assert lists.quotas(spark, str(tmp_path / "e.yaml")).count() == 0 and lists.tenants(spark, str(tmp_path / "e.yaml"))[1].count() == 0

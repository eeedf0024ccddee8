"""Registered queries: exemptions, synthetic values of sessions, streamed completions, anchored hours."""

from pyspark.sql import functions as F

from scrimlake.operators import anonymize as A
from scrimlake.operators import chat, secrets, spans, synthetic, usage
from scrimlake.plans.catalog import _CHAT_TEXT, _any, _chat, _near, _table, query
from scrimlake.functions import text as T
from scrimlake.sources import shared
from scrimlake.streaming import completion, rehydrate

# ---- anonymise with exemptions: user turns get a mail address, an IPv4 address, a phone and an id card

_MAIL, _IP, _PHONE = "'user' || conv_id % 97 || '@example.com'", "'10.0.' || turn % 250 || '.' || conv_id % 250", "'138' || lpad((conv_id * 8 + turn)::VARCHAR, 8, '0')"
_CARD, _US = "lpad((4111111111111111 + conv_id)::VARCHAR, 16, '0')", "'+1 (212) 555-' || lpad((turn + 100)::VARCHAR, 4, '0')"
#: The pieces that are put into a user turn, with what comes before each.
_PUT = ((" Mail ", _MAIL, "EMAIL_ADDRESS", "EMAIL"), (", host ", _IP, "IP_ADDRESS", "IP"), (", call ", _PHONE, "PHONE_NUMBER", "PHONE"), (" or card ", _CARD, "CREDIT_CARD", "CREDIT_CARD"), (" or ", _US, "PHONE_NUMBER", "PHONE"))


def _contact(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    values = (
        F.concat(F.lit("user"), (F.col("conv_id") % 97).cast("string"), F.lit("@example.com")),
        F.concat(F.lit("10.0."), (F.col("turn") % 250).cast("string"), F.lit("."), (F.col("conv_id") % 250).cast("string")),
        F.concat(F.lit("138"), digits(F.col("conv_id") * 8 + F.col("turn"), 8)),
        digits(F.lit(4111111111111111) + F.col("conv_id"), 16),
        F.concat(F.lit("+1 (212) 555-"), digits(F.col("turn") + 100, 4)),
    )
    put = F.concat(*[x for (lead, *_), v in zip(_PUT, values) for x in (F.lit(lead), v)])
    return turns.withColumn("text", F.concat("text", F.when(F.col("role") == "user", put).otherwise("")))


def _put_sql() -> str:
    """A row for each value put in: conv_id, turn, t (the whole text), k, kind, ptype, value, start, end."""
    whole = " || ".join(f"'{lead}' || {v}" for lead, v, *_ in _PUT)
    base = f"SELECT conv_id, turn, text, text || {whole} AS t FROM conversations WHERE role = 'user'"
    parts, before = [], "length(text)"
    for k, (lead, v, kind, ptype) in enumerate(_PUT):
        before += f" + {len(lead)}"
        parts.append(f"SELECT conv_id, turn, t, {k} AS k, '{kind}' AS kind, '{ptype}' AS ptype, {v} AS value, {before} AS start, {before} + length({v}) AS \"end\" FROM b")
        before += f" + length({v})"
    return f"WITH b AS ({base}), p AS ({' UNION ALL '.join(parts)})"


_LISTED = """(SELECT lower('USER' || c_custkey || '@example.com') AS entry, 'EMAIL_ADDRESS' AS of FROM customer WHERE c_custkey % 3 = 0 UNION SELECT '10.0.' || n_nationkey % 5 || '.' || n_nationkey, '*' FROM nation)"""
_GATED = f"""{_put_sql()}, g AS (SELECT p.*, kind IN ('EMAIL_ADDRESS', 'PHONE_NUMBER') AND ({_any("trim(t)", T.INTENT)} OR {_any(_near, chat.ASKED)}) AS asked, l.entry IS NOT NULL AS listed FROM p LEFT JOIN {_LISTED} l ON lower(p.value) = l.entry AND (l.of = '*' OR l.of = kind)),
n AS (SELECT *, CASE WHEN asked THEN 'intent' WHEN listed THEN 'allowlist' END AS reason FROM g),
m AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY conv_id, turn, ptype, reason IS NULL ORDER BY start DESC) END AS number FROM n)"""


def _exempted(spark, sf_dir):
    mails = _table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.lit("EMAIL_ADDRESS").alias("entity_type"), F.concat(F.lit("USER"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("entry"), F.lit(False).alias("case_sensitive"))
    n = F.col("n_nationkey")
    hosts = _table(spark, sf_dir, "nation").select(F.lit("*").alias("entity_type"), F.concat(F.lit("10.0."), (n % 5).cast("string"), F.lit("."), n.cast("string")).alias("entry"), F.lit(True).alias("case_sensitive"))
    allow = mails.unionByName(hosts).withColumn("enabled", F.lit(True))
    return A.anonymize_exempting(_contact(spark, sf_dir), shared.folder(spark), allow, ("EMAIL_ADDRESS", "PHONE_NUMBER"), strategies={}, patterns=spans.DEFAULT)


@query(f"""{_GATED} SELECT c.conv_id, c.turn, CASE WHEN role = 'user' THEN c.text || new ELSE c.text END AS anon_text FROM conversations c
LEFT JOIN (SELECT conv_id, turn, string_agg(CASE k WHEN 0 THEN ' Mail ' WHEN 1 THEN ', host ' WHEN 2 THEN ', call ' WHEN 3 THEN ' or card ' ELSE ' or ' END || CASE WHEN number IS NULL THEN value ELSE '<' || ptype || '_' || number || '>' END, '' ORDER BY k) AS new FROM m GROUP BY ALL) x ON x.conv_id = c.conv_id AND x.turn = c.turn""")
def anonymize_exempting(spark, sf_dir):
    """Turns with all built-in patterns' values replaced, but for what a question asks about and what allowlists have."""
    return _exempted(spark, sf_dir).select("conv_id", "turn", "anon_text")


@query(f'{_GATED} SELECT conv_id, turn, kind AS entity_type, start::INT AS start, "end"::INT AS "end", value, reason FROM m WHERE reason IS NOT NULL')
def anonymize_exemptions(spark, sf_dir):
    """What stays as it is in those turns, and why."""
    return _exempted(spark, sf_dir).select("conv_id", "turn", F.posexplode_outer("exemptions").alias("i", "e")).where("i is not null").select("conv_id", "turn", "e.*")


# ---- synthetic values of sessions


def _synthetic_sessions(spark, sf_dir):
    turns = _chat(spark, sf_dir)
    phone = F.concat(F.lit(", call 138"), F.lpad((F.col("conv_id") * 8 + F.col("turn") % 3).cast("string"), 8, "0"))
    turns = turns.withColumn("text", F.concat("text", F.when(F.col("role") == "user", phone).otherwise("")))
    return A.anonymize_sessions(turns, "conv_id", "turn", patterns=(spans.MAIL, spans.IPV4, spans.CN_PHONE[0]), name=synthetic.session_value)


def _scrambled_sql(number: str, session: str, seed: int = 42) -> str:
    left, right = f"(({number}) // {synthetic.HALF} % {synthetic.HALF})", f"(({number}) % {synthetic.HALF})"
    sql = f"SELECT *, {left}::BIGINT AS l0, {right}::BIGINT AS r0 FROM v"
    for k in range(synthetic.ROUNDS):
        key = f"('0x' || left(md5('{seed}:{k}:' || {session}), 7))::BIGINT"
        sql = f"SELECT *, r{k} AS l{k + 1}, (l{k} + (((r{k} * 40503 + {key}) * 2654435 + {key}) >> 16) % {synthetic.HALF}) % {synthetic.HALF} AS r{k + 1} FROM ({sql})"
    return f"SELECT *, lpad((l{synthetic.ROUNDS} * {synthetic.HALF} + r{synthetic.ROUNDS})::VARCHAR, 8, '0') AS digits FROM ({sql})"


_SESSION_VALUES = """WITH u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, 'EMAIL' AS ptype, 'user' || conv_id % 97 || '@example.com' AS original, min(turn) AS t FROM u GROUP BY conv_id
    UNION ALL SELECT conv_id, 'IP', '10.0.' || turn % 250 || '.' || conv_id % 250, min(turn) FROM u GROUP BY ALL
    UNION ALL SELECT conv_id, 'PHONE', '138' || lpad((conv_id * 8 + turn % 3)::VARCHAR, 8, '0'), min(turn) FROM u GROUP BY ALL),
v AS (SELECT conv_id, ptype, original, row_number() OVER (PARTITION BY conv_id, ptype ORDER BY t) AS number FROM a)"""


@query(f"{_SESSION_VALUES} SELECT conv_id, ptype, original, CASE ptype WHEN 'EMAIL' THEN 'user' || digits || '@example.com' WHEN 'PHONE' THEN left(original, 3) || digits ELSE '<IP_' || number || '>' END AS placeholder FROM ({_scrambled_sql('number', 'conv_id')})")
def synthetic_session_values(spark, sf_dir):
    """The values of every conversation and what stands for them, no two alike."""
    return _synthetic_sessions(spark, sf_dir)[1]


@query(f"SELECT conv_id, turn, {_CHAT_TEXT} || CASE WHEN role = 'user' THEN ', call 138' || lpad((conv_id * 8 + turn % 3)::VARCHAR, 8, '0') ELSE '' END AS restored, CASE WHEN role = 'user' THEN 3 ELSE 0 END::INT AS n_restored FROM conversations")
def deanonymize_synthetic_sessions(spark, sf_dir):
    """Turns with their conversation's synthetic values put back."""
    rows, mapping = _synthetic_sessions(spark, sf_dir)
    return synthetic.restore_sessions(rows.select("conv_id", "turn", "anon_text"), mapping, "conv_id", "turn", "anon_text")


# ---- streamed completions

_KEYED = "conv_id % 7 = 3"


def _requests(spark, sf_dir):
    """(tenant_id, request_id, at, should_block) of every conversation; of each seventh a user's turn holds a key."""
    turns = _chat(spark, sf_dir)
    key = F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit(" AKIA"), F.upper(F.left(F.md5(F.col("conv_id").cast("string")), F.lit(16))))).otherwise("")
    asked = secrets.with_secrets(turns.where("role = 'user'").withColumn("text", F.concat("text", key)))
    blocks = asked.groupBy("conv_id").agg(F.bool_or("should_block").alias("should_block"))
    convs = _table(spark, sf_dir, "conversations").select("conv_id").distinct().join(blocks, "conv_id", "left")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60)
    return convs.select(F.concat(F.lit("tenant-"), (F.col("conv_id") % 5).cast("string")).alias("tenant_id"), F.col("conv_id").cast("string").alias("request_id"), at.alias("at"), F.coalesce("should_block", F.lit(False)).alias("should_block"))


@query(f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations), u AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user'),
o AS (SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id % 5 ORDER BY c.conv_id) AS k, u.conv_id IS NOT NULL AND c.{_KEYED} AS blocked FROM c LEFT JOIN u USING (conv_id)),
q AS (SELECT conv_id, CASE WHEN k > 12 + 2 * (conv_id % 5) AND conv_id % 5 > 0 THEN 'quota_exceeded' WHEN blocked THEN 'secret_blocked' END AS code FROM o)
SELECT conv_id::VARCHAR AS request_id, code, CASE WHEN code IS NULL THEN string_agg({_CHAT_TEXT}, chr(10) ORDER BY turn) END AS restored, CASE WHEN code IS NULL THEN 'stop' END AS event FROM q JOIN conversations USING (conv_id) GROUP BY conv_id, code""")
def stream_completion(spark, sf_dir):
    """Answers to conversations within quota and without secrets, streamed back: mappings and pieces of the answers are dealt out of
    order over micro-batches, and the text is let out by piece with its placeholders put back."""
    folder = shared.folder(spark)
    nations = _table(spark, sf_dir, "nation").where("n_nationkey between 1 and 4")
    limits = nations.select(F.concat(F.lit("tenant-"), F.col("n_nationkey").cast("string")).alias("tenant_id"), (12 + 2 * F.col("n_nationkey")).alias("quota"))
    judged = shared.written(completion.admitted(_requests(spark, sf_dir), limits), f"{folder}/judged")
    rows, mapping = A.anonymize_sessions(_chat(spark, sf_dir), "conv_id", "turn", patterns=(spans.MAIL, spans.IPV4), skip=F.col("role") == "system")
    let_in = judged.where("code is null").select("tenant_id", "request_id", "at")
    whole = rows.groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "anon_text"))), lambda x: x["anon_text"]), "\n").alias("t"))
    pieces = rehydrate.chunked(whole.join(let_in, "request_id"), "request_id", "t", 11).select(F.col("stream_id").alias("request_id"), "seq", "chunk", "done", F.lit(None).cast("map<string,string>").alias("names"))
    named = mapping.groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("names"))
    heads = let_in.select("request_id").join(named, "request_id", "left").select("request_id", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("chunk"), F.lit(False).alias("done"), "names")
    events = pieces.unionByName(heads).join(let_in, "request_id").select("tenant_id", "request_id", "seq", "chunk", "done", "names", "at")
    turns = events.withColumn("b", F.pmod(F.xxhash64("request_id", "seq"), F.lit(3))).repartitionByRange(12, "b", F.xxhash64("seq", "request_id")).drop("b")
    turns.write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(completion.EVENT).option("maxFilesPerTrigger", 4).parquet(f"{folder}/events")
    out = completion.completions(stream, late="3650 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    completion.started(spark, out).awaitTermination()
    answers = completion.whole_answers(spark.read.schema(completion.RELEASED).parquet(f"{folder}/out"))
    return judged.select("tenant_id", "request_id", "code").join(answers, ["tenant_id", "request_id"], "left").select("request_id", "code", "restored", "event")


# ---- anchored hours


@query("""WITH RECURSIVE e AS (SELECT user_id % 5 AS tenant_id, ts FROM events), w AS (SELECT tenant_id, min(ts) AS a FROM e GROUP BY tenant_id
UNION ALL SELECT w.tenant_id, (SELECT min(ts) FROM e WHERE e.tenant_id = w.tenant_id AND e.ts > w.a + INTERVAL 1 HOUR) FROM w WHERE w.a IS NOT NULL)
SELECT w.tenant_id, w.a::TIMESTAMP AS window_start, count(*) AS used FROM w JOIN e ON e.tenant_id = w.tenant_id AND e.ts BETWEEN w.a AND w.a + INTERVAL 1 HOUR GROUP BY ALL""")
def quota_anchored_hours(spark, sf_dir):
    """Requests of each tenant in hours that begin with a request."""
    return usage.anchored_hours(_table(spark, sf_dir, "events").select("ts", (F.col("user_id") % 5).alias("tenant_id")))

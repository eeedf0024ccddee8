"""The registered queries and their SQL, by name."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrimlake.functions import text as T
from scrimlake.functions.values import EMAIL, SECRETS
from scrimlake.operators import anonymize as A
from scrimlake.operators import audit, chat, entropy, govern, secrets, spans, usage
from scrimlake.sources import audit_log, lists, shared
from scrimlake.streaming import rehydrate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- detection


def spans_sql(regex: str, kind: str, score: float, check: str = "TRUE", table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    rx = regex.replace("'", "''")
    size = "lambda x: length(x)"
    return f"""SELECT {key}, '{kind}' AS entity_type, s::INT AS start, (s + length(v))::INT AS "end", {score}::DOUBLE AS score, v AS value FROM (
    SELECT {key}, h[i] AS v, coalesce(list_sum(list_transform(g[1:i], {size})), 0) + coalesce(list_sum(list_transform(h[1:i - 1], {size})), 0) AS s FROM (
        SELECT {key}, h, g, unnest(range(1, len(h) + 1)) AS i FROM (
            SELECT {key}, regexp_extract_all({text}, '{rx}') AS h, string_split_regex({text}, '{rx}') AS g FROM {table}))) WHERE {check}"""


OCTETS = "list_max(list_transform(string_split(v, '.'), lambda x: x::INT)) <= 255"
MAIL_SQL = spans_sql(EMAIL, "EMAIL_ADDRESS", 0.85)
IP_SQL = spans_sql(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "IP_ADDRESS", 0.6, OCTETS)
CARD_SQL = spans_sql(r"[0-9]{16}", "CREDIT_CARD", 0.6)
PHONE_SQL = spans_sql(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "PHONE_NUMBER", 0.75)
FOUR = (spans.MAIL, spans.IPV4, spans.CARD, spans.US_PHONE)
ALL_SQL = " UNION ALL ".join((MAIL_SQL, IP_SQL, CARD_SQL, PHONE_SQL))
#: Leftmost first: a span stays if it begins after the last that stays.
RESOLVED_SQL = f"""WITH RECURSIVE s AS ({ALL_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, score DESC, "end" - start DESC) AS r FROM s),
walk AS (SELECT *, TRUE AS kept, "end" AS reach FROM o WHERE r = 1 UNION ALL
    SELECT o.*, o.start >= walk.reach, CASE WHEN o.start >= walk.reach THEN o."end" ELSE walk.reach END FROM walk JOIN o ON o.doc_id = walk.doc_id AND o.r = walk.r + 1)
SELECT doc_id, entity_type, start, "end", score, value FROM walk WHERE kept"""


def _detected(spark, sf_dir, *patterns):
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(spans.detect(F.col("text"), patterns)).alias("s")).select("doc_id", "s.*")


@query(MAIL_SQL)
def detect_email(spark, sf_dir):
    return _detected(spark, sf_dir, spans.MAIL)


@query(IP_SQL)
def detect_ipv4(spark, sf_dir):
    return _detected(spark, sf_dir, spans.IPV4)


@query(CARD_SQL)
def detect_card(spark, sf_dir):
    return _detected(spark, sf_dir, spans.CARD)


@query(PHONE_SQL)
def detect_us_phone(spark, sf_dir):
    return _detected(spark, sf_dir, spans.US_PHONE)


@query(RESOLVED_SQL)
def overlap_resolved_spans(spark, sf_dir):
    found = spans.resolve(spans.detect(F.col("text"), FOUR))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


@query()
def resolved_highest_score(spark, sf_dir):
    found = spans.resolve(spans.detect(F.col("text")), order="highest_score")
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


_CN = "'138' || lpad(c_custkey::VARCHAR, 8, '0')"


@query(f"SELECT c_custkey, 'PHONE_NUMBER' AS entity_type, 4::INT AS start, 15::INT AS \"end\", 0.7::DOUBLE AS score, {_CN} AS value FROM customer")
def detect_cn_phone(spark, sf_dir):
    text = F.concat(F.lit("tel "), F.lit("138"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit(" end"))
    found = spans.resolve(spans.detect(text, spans.CN_PHONE[:1]))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.explode(found).alias("s")).select("c_custkey", "s.*")


_ID17 = "'110101' || strftime(o_orderdate, '%Y%m%d') || lpad((o_orderkey % 1000)::VARCHAR, 3, '0')"


@query(
    f"""WITH i AS (SELECT o_orderkey, {_ID17} AS d FROM orders), s AS (SELECT o_orderkey, d, list_sum(list_transform(range(1, 18), lambda k: d[k]::INT * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][k])) % 11 AS m FROM i)
    SELECT o_orderkey, d || '7' AS value, ('10X98765432')[m::INT + 1] = '7' AS valid FROM s"""
)
def cn_id_checksum(spark, sf_dir):
    digits = F.concat(F.lit("110101"), F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit("7"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", digits.alias("value")).select("o_orderkey", "value", T.id_checksum_ok(F.col("value")).alias("valid"))


# ---- secrets

#: What SQL's regular expressions, which have no look-behind and no back reference, have instead: pattern and what precedes the match.
_WITHOUT_LOOKS = {
    "Google Cloud API Key": (r""""AIza[A-Za-z0-9_-]{35}"|'AIza[A-Za-z0-9_-]{35}'""", 0),
    "Mailgun API Key": (r"key-[a-zA-Z0-9]{32}", 4),
}


def _secret_sql() -> str:
    """rank, doc_id, name, secret_type, risk, start, end, value of every match, of equal (start, end, type) the first."""
    parts = []
    for rank, (name, kind, risk, rx) in enumerate(SECRETS):
        rx, skip = _WITHOUT_LOOKS.get(name, (rx, 0))
        parts.append(f"SELECT {rank} AS rank, doc_id, '{name}' AS name, '{kind}' AS secret_type, '{risk}' AS risk, (start + {skip})::INT AS start, \"end\", substr(value, {skip + 1}) AS value FROM ({spans_sql(rx, kind, 1.0, f'length(v) - {skip} <= 1000')})")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) QUALIFY row_number() OVER (PARTITION BY doc_id, start, \"end\", secret_type ORDER BY rank) = 1"


def _with_keys(spark, sf_dir):
    """documents, and texts that hold keys made from orders."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    key = F.concat(F.lit("password = p"), F.col("o_orderkey").cast("string"), F.lit(" and AKIA"), F.upper(F.left(F.md5(F.col("o_orderkey").cast("string")), F.lit(16))), F.lit("\nredis://h/"), F.col("o_orderkey").cast("string"))
    return docs.unionByName(_table(spark, sf_dir, "orders").select((F.col("o_orderkey") + (1 << 40)).alias("doc_id"), key.alias("text")))


_KEYS = "(SELECT doc_id, text FROM documents UNION ALL SELECT o_orderkey + 1099511627776, 'password = p' || o_orderkey || ' and AKIA' || upper(left(md5(o_orderkey::VARCHAR), 16)) || chr(10) || 'redis://h/' || o_orderkey FROM orders)"


_MATCHES = _secret_sql().replace("FROM documents", f"FROM {_KEYS}")
_PREVIEW = "CASE WHEN length(value) <= 8 THEN repeat('*', length(value)) ELSE left(value, 4) || '****' || right(value, 4) END"


@query(f'SELECT doc_id, name, secret_type, risk, start, "end" FROM ({_MATCHES})')
def secret_matches(spark, sf_dir):
    return secrets.match_rows(_with_keys(spark, sf_dir), "doc_id").drop("line", "preview")


@query(f"SELECT doc_id, name, secret_type, risk, start, \"end\", (length(left(text, start)) - length(replace(left(text, start), chr(10), '')) + 1)::INT AS line, {_PREVIEW} AS preview FROM ({_MATCHES}) JOIN {_KEYS} USING (doc_id)")
def secret_lines(spark, sf_dir):
    return secrets.match_rows(_with_keys(spark, sf_dir), "doc_id")


@query(
    f"""WITH RECURSIVE m AS ({_MATCHES}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, rank, "end") AS r FROM m),
    walk AS (SELECT *, TRUE AS kept, "end" AS reach FROM o WHERE r = 1 UNION ALL
        SELECT o.*, o.start >= walk.reach, CASE WHEN o.start >= walk.reach THEN o."end" ELSE walk.reach END FROM walk JOIN o ON o.doc_id = walk.doc_id AND o.r = walk.r + 1),
    p AS (SELECT doc_id, count(*)::INT AS n, bool_or(risk IN ('high', 'critical')) AS b FROM m GROUP BY doc_id),
    k AS (SELECT doc_id, start, "end", name, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM walk WHERE kept),
    j AS (SELECT doc_id, string_agg(substr(text, (before + 1)::BIGINT, (start - before)::BIGINT) || '[REDACTED:' || name || ']', '' ORDER BY start) AS head, max("end") AS last FROM k JOIN {_KEYS} USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::INT AS n_matches, coalesce(b, FALSE) AS should_block, sha256(CASE WHEN head IS NULL THEN text ELSE head || substr(text, last + 1) END) AS sanitized_sha256
    FROM {_KEYS} LEFT JOIN p USING (doc_id) LEFT JOIN j USING (doc_id)"""
)
def secret_sanitized(spark, sf_dir):
    out = secrets.with_secrets(_with_keys(spark, sf_dir))
    return out.select("doc_id", F.size("matches").alias("n_matches"), "should_block", F.sha2("sanitized", 256).alias("sanitized_sha256"))


@query(f"SELECT doc_id, string_agg(secret_type || ' x' || n, ', ' ORDER BY first_at, secret_type) AS reason FROM (SELECT doc_id, secret_type, count(*) AS n, min(start) AS first_at FROM ({_MATCHES}) GROUP BY ALL) GROUP BY doc_id")
def secret_block_reason(spark, sf_dir):
    return secrets.block_reasons(_with_keys(spark, sf_dir), "doc_id")


@query(
    """WITH c AS (SELECT n_nationkey, n_name, unnest(string_split(n_name, '')) AS ch FROM nation), k AS (SELECT n_nationkey, n_name, ch, count(*) AS n FROM c GROUP BY ALL),
    e AS (SELECT n_nationkey, n_name, round(-sum(n / length(n_name) * log2(n / length(n_name))), 6) AS entropy FROM k GROUP BY ALL)
    SELECT n_nationkey, entropy, CASE WHEN entropy >= 5 THEN 'critical' WHEN entropy >= 4.5 THEN 'high' WHEN entropy >= 3.5 THEN 'medium' ELSE 'low' END AS level FROM e"""
)
def entropy_names(spark, sf_dir):
    e = F.round(T.entropy(F.col("n_name")), 6)
    return _table(spark, sf_dir, "nation").select("n_nationkey", e.alias("entropy"), T.entropy_level(e).alias("level"))


def _entropy_sql(v: str) -> str:
    share = f"(len(list_filter(string_split({v}, ''), lambda x: x = c)) / length({v}))"
    return f"round(list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -{share} * log2({share}))), 3)"


def _with_tokens(spark, sf_dir):
    """documents, and texts with hashes, keys of mixed case, ids and dates made from orders."""
    h = F.md5(F.col("o_orderkey").cast("string"))
    text = F.concat(F.lit("id "), h, F.lit(" at 2024-01-02, key"), F.left(h, F.lit(12)), F.upper(F.right(h, F.lit(12))), F.lit("\n"), F.upper(F.left(h, F.lit(8))), F.lit("-1234-1234-1234-"), F.left(h, F.lit(12)), F.lit(" 12345678901234567890 again "), h)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.unionByName(_table(spark, sf_dir, "orders").select((F.col("o_orderkey") + (1 << 40)).alias("doc_id"), text.alias("text")))


_HASHED = "(SELECT doc_id, text FROM documents UNION ALL SELECT o_orderkey + 1099511627776, 'id ' || h || ' at 2024-01-02, key' || left(h, 12) || upper(right(h, 12)) || chr(10) || upper(left(h, 8)) || '-1234-1234-1234-' || left(h, 12) || ' 12345678901234567890 again ' || h FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders))"
_TOKENS = rf"""(WITH t AS (SELECT doc_id, h[i] AS token, s::INT AS start FROM (
        SELECT doc_id, h, i, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS s FROM (
            SELECT doc_id, h, g, unnest(list_filter(range(1, len(h) + 1), lambda k: length(h[k]) >= 16)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS h, string_split_regex(text, '\S+') AS g FROM {_HASHED})))),
    f AS (SELECT *, {' OR '.join(f"regexp_matches(token, '{rx}')" for rx in entropy.FALSE_POSITIVES)} AS benign,
        regexp_matches(token, '{entropy.BASE64}') OR regexp_matches(token, '{entropy.LONG_HEX}') OR (length(token) >= 20 AND regexp_matches(token, '\p{{Ll}}') AND regexp_matches(token, '\p{{Lu}}') AND regexp_matches(token, '\p{{Nd}}')) AS shaped
        FROM t WHERE NOT regexp_matches(token, '^(\p{{Nd}}+|[\p{{Ll}}\p{{Lo}}]+|[\p{{Lu}}\p{{Lo}}]+)$')),
    e AS (SELECT *, CASE WHEN benign THEN 0.0 ELSE {_entropy_sql("token")} END AS bits FROM f)
    SELECT doc_id, token, start, bits AS entropy, CASE WHEN bits >= 5 THEN 'critical' WHEN bits >= 4.5 THEN 'high' ELSE 'medium' END AS level, shaped FROM e WHERE bits >= 4.5 OR (bits >= 3.5 AND shaped))"""
_REASON = "CASE level WHEN 'critical' THEN 'Critical entropy - likely cryptographic material' WHEN 'high' THEN 'High entropy - possible secret' ELSE 'Medium entropy - suspicious' END || CASE WHEN shaped THEN '; Token-like format detected' ELSE '' END"


@query(f"SELECT doc_id, start, token, entropy::DOUBLE AS entropy, level, {_REASON} AS reason FROM {_TOKENS}")
def entropy_tokens(spark, sf_dir):
    """The suspicious tokens of documents, and why they are."""
    return entropy.suspicious_tokens(_with_tokens(spark, sf_dir), "doc_id").select("doc_id", "start", "token", "entropy", "level", "reason")


@query(f"SELECT doc_id, count(t.token)::INT AS n_found, coalesce(CASE max(CASE level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' END, 'none') AS overall_risk FROM {_HASHED} LEFT JOIN {_TOKENS} t USING (doc_id) GROUP BY doc_id")
def entropy_report(spark, sf_dir):
    """How many suspicious tokens every document has, and its risk."""
    return entropy.report(_with_tokens(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id, 'HIGH_ENTROPY_SECRET' AS entity_type, start, (start + length(token))::INT AS \"end\", CASE level WHEN 'critical' THEN 0.99 WHEN 'high' THEN 0.85 ELSE 0.7 END::DOUBLE AS score, token AS value FROM {_TOKENS}")
def entropy_spans(spark, sf_dir):
    """Suspicious tokens as spans, every occurrence at its place."""
    return entropy.spans(_with_tokens(spark, sf_dir), "doc_id")


@query("SELECT conv_id, turn, (ends OR asks) AS is_question, CASE WHEN t = '' THEN 0.0 WHEN ends THEN 0.9 WHEN asks THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM (SELECT conv_id, turn, trim(text) AS t, trim(text) LIKE '%?' AS ends, regexp_matches(trim(text), '(?i)^[\\s]*(who|what|where|when|why|how|which|whose|whom|is|are|do|does|can|could|would|should|will)\\b') OR regexp_matches(text, '(?i)tell me|describe|explain|introduce|do you know|have you heard') AS asks FROM conversations)")
def question_intent(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_question(F.col("text")).alias("q")).select("conv_id", "turn", "q.*")


# ---- replacement and reversal


def _rows(df, key: str, array: str = "entities"):
    """A row for each element, as e; for explode() Spark would infer a filter that repeats all that makes the array."""
    return df.select(key, F.posexplode_outer(array).alias("_i", "e")).where("_i is not null")


def _anon(spark, sf_dir, strategy=None):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = {} if strategy else A.STRATEGIES
    return A.anonymize(docs, strategies=kinds, default=strategy or "placeholder", patterns=FOUR)


#: Spans with their placeholder type, canonical value and number: the value that occurs last has number 1.
_TYPED = f"""WITH RECURSIVE {RESOLVED_SQL.removeprefix("WITH RECURSIVE ").replace("SELECT doc_id, entity_type, start, \"end\", score, value FROM walk WHERE kept", "").rstrip()},
t AS (SELECT *, CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' WHEN 'IP_ADDRESS' THEN 'IP' WHEN 'PHONE_NUMBER' THEN 'PHONE' ELSE entity_type END AS ptype,
    CASE entity_type WHEN 'EMAIL_ADDRESS' THEN lower(value) WHEN 'PHONE_NUMBER' THEN regexp_replace(value, '[ ()-]', '', 'g') ELSE value END AS canon FROM walk WHERE kept),
m AS (SELECT *, max(start) OVER (PARTITION BY doc_id, ptype, canon) AS latest FROM t), n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, ptype ORDER BY latest DESC) AS number FROM m)"""


@query(f"{_TYPED} SELECT doc_id, ptype, value, start, '<' || ptype || '_' || number || '>' AS new FROM n")
def anonymize_placeholder(spark, sf_dir):
    return _rows(_anon(spark, sf_dir, "placeholder"), "doc_id").select("doc_id", "e.ptype", "e.value", "e.start", "e.new")


@query(f"{_TYPED} SELECT doc_id, ptype, value, start, sha256(entity_type || ':' || value) AS new FROM n")
def anonymize_hash(spark, sf_dir):
    return _rows(_anon(spark, sf_dir, "hash"), "doc_id").select("doc_id", "e.ptype", "e.value", "e.start", "e.new")


_MASK = """CASE ptype WHEN 'PHONE' THEN left(regexp_replace(value, '[^0-9]', '', 'g'), 3) || '****' || right(regexp_replace(value, '[^0-9]', '', 'g'), 4)
    WHEN 'EMAIL' THEN CASE WHEN strpos(value, '@') <= 3 THEN repeat('*', strpos(value, '@') - 1) ELSE value[1] || repeat('*', strpos(value, '@') - 3) || value[strpos(value, '@') - 1] END || substr(value, strpos(value, '@'))
    WHEN 'CREDIT_CARD' THEN left(value, 4) || repeat('*', length(value) - 8) || right(value, 4)
    ELSE left(value, greatest(1, length(value) // 4)) || repeat('*', length(value) - 2 * greatest(1, length(value) // 4)) || right(value, greatest(1, length(value) // 4)) END"""


@query(f"{_TYPED} SELECT doc_id, ptype, value, start, {_MASK} AS new FROM n")
def anonymize_mask(spark, sf_dir):
    return _rows(_anon(spark, sf_dir, "mask"), "doc_id").select("doc_id", "e.ptype", "e.value", "e.start", "e.new")


@query(f"{_TYPED} SELECT doc_id, ptype, count(*) AS n, count(DISTINCT canon) AS n_values FROM n GROUP BY ALL")
def pii_counts_by_type(spark, sf_dir):
    # posexplode_outer, as for explode Spark infers a filter that repeats all of the detection
    found = _anon(spark, sf_dir).select("doc_id", F.posexplode_outer("entities").alias("i", "e")).where("i is not null").select("doc_id", "e.*")
    return found.groupBy("doc_id", "ptype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(T.canonical(F.col("value"), F.col("entity_type"))).alias("n_values"))


@query(
    f"""{_TYPED}, r AS (SELECT doc_id, start, "end", CASE WHEN ptype IN ('IP', 'CREDIT_CARD') THEN {_MASK} ELSE '<' || ptype || '_' || number || '>' END AS new, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM n),
    p AS (SELECT doc_id, string_agg(substr(text, (before + 1)::BIGINT, (start - before)::BIGINT) || new, '' ORDER BY start) AS head, max("end") AS last, count(*) AS k FROM r JOIN documents USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN k IS NULL THEN text ELSE head || substr(text, last + 1) END AS anon_text, coalesce(k, 0) AS n_entities FROM documents LEFT JOIN p USING (doc_id)"""
)
def anonymize_mixed(spark, sf_dir):
    return _anon(spark, sf_dir).select("doc_id", "anon_text", F.size("entities").cast("long").alias("n_entities"))


_MOD = "(('0x' || md5('42:' || {v}))::UHUGEINT % {n})::BIGINT"


@query(f"""{_TYPED} SELECT doc_id, ptype, start, CASE ptype WHEN 'PHONE' THEN left(regexp_replace(value, '[^0-9]', '', 'g'), 3) || lpad({_MOD.format(v="value", n=100000000)}::VARCHAR, 8, '0')
    WHEN 'EMAIL' THEN 'user' || {_MOD.format(v="lower(value)", n=1000000)} || '@example.com' ELSE '[REDACTED]' END AS new FROM n""")
def anonymize_synthetic(spark, sf_dir):
    return _rows(_anon(spark, sf_dir, "synthetic"), "doc_id").select("doc_id", "e.ptype", "e.start", "e.new")


@query("SELECT doc_id, TRUE AS restored FROM documents")
def roundtrip_check(spark, sf_dir):
    """Placeholders put back give the text again; of variants of a value the first form is restored."""
    out = _anon(spark, sf_dir, "placeholder").withColumn("_map", A.reversible(F.col("entities")))
    return out.select("doc_id", (A.restore_in_row(F.col("anon_text"), F.col("_map")) == F.col("text")).alias("restored"))


def _chat(spark, sf_dir):
    """conversations with contact data of a customer put into each user turn."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    contact = F.when(F.col("role") == "user", F.concat(F.lit(" Mail user"), (F.col("conv_id") % 97).cast("string"), F.lit("@example.com, host 10.0."), (F.col("turn") % 250).cast("string"), F.lit("."), (F.col("conv_id") % 250).cast("string"))).otherwise("")
    return turns.withColumn("text", F.concat("text", contact))


def _sessions(spark, sf_dir):
    return A.anonymize_sessions(_chat(spark, sf_dir), "conv_id", "turn", patterns=(spans.MAIL, spans.IPV4), skip=F.col("role") == "system")


_SESSION_IPS = "(SELECT conv_id, x, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS k FROM (SELECT conv_id, turn % 250 AS x, min(turn) AS t FROM conversations WHERE role = 'user' GROUP BY ALL))"


@query(f"SELECT c.conv_id, turn, CASE WHEN role = 'user' THEN text || ' Mail <EMAIL_1>, host <IP_' || k || '>.' ELSE text END AS anon_text FROM conversations c LEFT JOIN {_SESSION_IPS} i ON i.conv_id = c.conv_id AND i.x = c.turn % 250".replace(">.'", ">'"))
def anonymize_conversation(spark, sf_dir):
    return _sessions(spark, sf_dir)[0].select("conv_id", "turn", "anon_text")


@query("""WITH u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, min(turn) AS turn FROM u GROUP BY conv_id),
ip AS (SELECT conv_id, turn % 250 AS x, min(turn) AS t FROM u GROUP BY ALL)
SELECT conv_id, 'EMAIL' AS ptype, 'user' || conv_id % 97 || '@example.com' AS original, '<EMAIL_1>' AS placeholder FROM f
UNION ALL SELECT conv_id, 'IP', '10.0.' || x || '.' || conv_id % 250, '<IP_' || row_number() OVER (PARTITION BY conv_id ORDER BY t) || '>' FROM ip""")
def mapping_relation(spark, sf_dir):
    return _sessions(spark, sf_dir)[1]


@query("SELECT conv_id, turn, text || CASE WHEN role = 'user' THEN ' Mail user' || conv_id % 97 || '@example.com, host 10.0.' || turn % 250 || '.' || conv_id % 250 ELSE '' END AS restored, CASE WHEN role = 'user' THEN 2 ELSE 0 END::INT AS n_restored, 0::INT AS n_unresolved FROM conversations")
def deanonymize_sessions(spark, sf_dir):
    rows, mapping = _sessions(spark, sf_dir)
    out = A.restore(rows.select("conv_id", "turn", "anon_text"), mapping, "conv_id", "turn", "anon_text")
    return out.select("conv_id", "turn", "restored", "n_restored", F.size("unresolved").alias("n_unresolved"))


_VARIANTS = ("<person_%s>", "<Person_%s>", "[PERSON_%s]", "{PERSON_%s}", "(PERSON_%s)", "<PERSON-%s>", "<PERSON:%s>", "< PERSON_%s >", "<PERSON %s>", "PERSON_%s")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE '<PERSON_' || c_custkey || '>' END AS normal FROM customer")
def fuzzy_placeholders(spark, sf_dir):
    token = F.element_at(F.array(*[F.format_string(v, F.col("c_custkey").cast("string")) for v in _VARIANTS]), (F.col("c_custkey") % 10 + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select("c_custkey", token.alias("t")).select("c_custkey", A.fuzzy_normal(F.col("t")).alias("normal"))


@query(f"{_TYPED} SELECT doc_id, ptype, start, CASE WHEN ptype = 'IP' THEN '[REDACTED]' WHEN ptype = 'CREDIT_CARD' THEN {_MASK} ELSE '<' || ptype || '_' || number || '>' END AS new FROM n")
def strategy_overlay(spark, sf_dir):
    out = A.anonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), strategies={**A.STRATEGIES, "IP": "redact"}, patterns=FOUR)
    return _rows(out, "doc_id").select("doc_id", "e.ptype", "e.start", "e.new")


@query("""WITH u AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, min(turn) AS f FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT c.conv_id, turn, role, CASE WHEN role = 'system' AND turn = f AND u.conv_id IS NOT NULL THEN text || chr(10) || chr(10) || 'Keep placeholders.' ELSE text END AS text FROM conversations c LEFT JOIN f USING (conv_id) LEFT JOIN u USING (conv_id)
UNION ALL SELECT conv_id, -1, 'system', 'Keep placeholders.' FROM u ANTI JOIN f USING (conv_id)""")
def prompt_injected_messages(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.inject_prompt(turns, turns.where("role = 'user'"), "conv_id", "turn", "Keep placeholders.")


@query("SELECT conv_id, sha256(conv_id % 5 || chr(31) || 'm' || chr(31) || string_agg(role || ':' || text, chr(31) ORDER BY turn)) AS key FROM conversations GROUP BY conv_id")
def cache_key(spark, sf_dir):
    return chat.cache_keys(_table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("conv_id") % 5, "m")


@query("SELECT conv_id, turn, TRUE AS whole, TRUE AS short FROM conversations")
def chunk_preserving_placeholders(spark, sf_dir):
    """Whether the pieces of each anonymised turn make it up again and none is too long."""
    rows = _sessions(spark, sf_dir)[0].select("conv_id", "turn", "anon_text")
    cut = rows.withColumn("c", chat.chunks(F.col("anon_text"), 200))
    return cut.select("conv_id", "turn", (F.array_join("c", "") == F.col("anon_text")).alias("whole"), F.forall("c", lambda x: F.length(x) <= 200).alias("short"))


_near = "substr(t, greatest(start - 50, 0) + 1, \"end\" - greatest(start - 50, 0) + 50)"
_any = lambda of, patterns: "(" + " OR ".join(f"regexp_matches({of}, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"
_CONTACTS = "(SELECT conv_id, turn, text || CASE WHEN role = 'user' THEN ' Mail user' || conv_id % 97 || '@example.com, host 10.0.' || turn % 250 || '.' || conv_id % 250 ELSE '' END AS t FROM conversations)"


@query(
    f"""WITH c AS {_CONTACTS}, b AS (SELECT c.*, (length(text) + 6)::INT AS m FROM c JOIN conversations USING (conv_id, turn) WHERE role = 'user'),
    s AS (SELECT conv_id, turn, t, m AS start, regexp_extract(substr(t, m + 1), '^[^,]*') AS value FROM b UNION ALL SELECT conv_id, turn, t, m + strpos(substr(t, m + 1), ', host ') + 6, regexp_extract(t, '10[.]0[.][0-9]+[.][0-9]+$') FROM b),
    e AS (SELECT *, start + length(value) AS "end", {_any("trim(t)", T.INTENT)} AS sure FROM s)
    SELECT conv_id, turn, start::INT AS start, value, sure OR {_any(_near, chat.ASKED)} AS is_question, CASE WHEN sure THEN 0.95 WHEN {_any(_near, chat.ASKED)} THEN 0.85 WHEN {_any(_near, chat.STATED)} THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM e"""
)
def entity_intent_context(spark, sf_dir):
    turns = _chat(spark, sf_dir)
    found = turns.select("conv_id", "turn", "text", F.explode(spans.resolve(spans.detect(F.col("text"), (spans.MAIL, spans.IPV4)))).alias("s"))
    return found.select("conv_id", "turn", "s.start", "s.value", chat.entity_intent(F.col("text"), F.col("s.start"), F.col("s.end")).alias("i")).select("conv_id", "turn", "start", "value", "i.is_question", "i.confidence")


# ---- audit: events as an audit log

_KINDS = {"view": "pii_detected", "click": "pii_anonymized", "purchase": "api_request", "signup": "auth_failure", "error": "api_error"}


def _events(spark, sf_dir):
    kind = F.element_at(F.create_map(*[F.lit(x) for p in _KINDS.items() for x in p]), F.col("event_type"))
    risk = F.when(F.col("value") >= 80, "critical").when(F.col("value") >= 60, "high").when(F.col("value") >= 40, "medium").when(F.col("value") >= 20, "low").otherwise("none")
    return _table(spark, sf_dir, "events").select(
        "event_id", kind.alias("event_type"), F.col("ts").alias("timestamp"), F.concat(F.lit("tenant-"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("r"), (F.col("event_id") % 1000).cast("string")).alias("request_id"), F.when(F.col("event_type").isin("view", "click"), (F.col("event_id") % 4).cast("int")).alias("entity_count"), risk.alias("risk_level"), F.lit("/v1/chat").alias("endpoint"),
    )


_EVENTS = """(SELECT event_id, CASE event_type WHEN 'view' THEN 'pii_detected' WHEN 'click' THEN 'pii_anonymized' WHEN 'purchase' THEN 'api_request' WHEN 'signup' THEN 'auth_failure' WHEN 'error' THEN 'api_error' END AS event_type, ts AS timestamp,
    'tenant-' || user_id % 5 AS tenant_id, 'u' || user_id AS user_id, 'r' || event_id % 1000 AS request_id, CASE WHEN event_type IN ('view', 'click') THEN (event_id % 4)::INT END AS entity_count,
    CASE WHEN value >= 80 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 40 THEN 'medium' WHEN value >= 20 THEN 'low' ELSE 'none' END AS risk_level, '/v1/chat' AS endpoint FROM events)"""
_SEVERITY = "CASE risk_level WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"


@query(f"SELECT * FROM {_EVENTS} WHERE tenant_id = 'tenant-1' AND event_type IN ('pii_detected', 'api_error') ORDER BY timestamp DESC, event_id LIMIT 50 OFFSET 20")
def audit_filter_page(spark, sf_dir):
    return audit.query(_events(spark, sf_dir), audit.AuditFilter(tenant_id="tenant-1", event_types=("pii_detected", "api_error"), offset=20, limit=50))


@query(f"SELECT event_id, risk_level FROM {_EVENTS} WHERE risk_level IN ('high', 'critical') ORDER BY {_SEVERITY} DESC, event_id LIMIT 100")
def audit_min_risk(spark, sf_dir):
    return audit.query(_events(spark, sf_dir), audit.AuditFilter(min_risk="high", sort_by="risk_level", limit=100)).select("event_id", "risk_level")


def _sum(kind: str) -> str:
    return f"coalesce(sum(entity_count) FILTER (event_type = '{kind}'), 0)::BIGINT"


def _n(kind: str) -> str:
    return f"count(*) FILTER (event_type = '{kind}')"


@query(f"SELECT count(*) AS total_events, {_sum('pii_detected')} AS pii_detected_count, {_sum('pii_anonymized')} AS pii_anonymized_count, {_n('api_request')} AS api_requests, {_n('api_error')} AS api_errors, {_n('auth_failure')} AS auth_failures, {_n('rate_limit_exceeded')} AS rate_limit_hits, {_n('secret_detected')} AS secrets_detected FROM {_EVENTS}")
def audit_summary(spark, sf_dir):
    return audit.summary(_events(spark, sf_dir))


@query(f"SELECT event_type, count(*) AS n, coalesce(sum(entity_count), 0)::BIGINT AS entities FROM {_EVENTS} GROUP BY event_type")
def audit_by_type(spark, sf_dir):
    return audit.summary_by(_events(spark, sf_dir), "event_type")


@query(f"SELECT event_type, risk_level, count(*) AS n FROM {_EVENTS} GROUP BY ROLLUP (event_type, risk_level)")
def audit_rollup(spark, sf_dir):
    return audit.rollup(_events(spark, sf_dir))


@query(f"SELECT * FROM {_EVENTS} WHERE timestamp >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR ORDER BY timestamp DESC, event_id LIMIT 25")
def audit_recent_topk(spark, sf_dir):
    events = _events(spark, sf_dir)
    last = events.agg(F.max("timestamp")).first()[0]
    return audit.recent(events, F.lit(last), 24, 25)


@query(f"SELECT event_id::VARCHAR AS event_id, event_type, strftime(timestamp, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(timestamp, '%f'), '0') END AS timestamp, tenant_id, user_id, request_id, coalesce(entity_count::VARCHAR, '') AS entity_count, risk_level, endpoint, '' AS entity_type, '' AS strategy_used, '' AS source_ip, '' AS method, CASE WHEN event_id % 3 = 0 THEN '' ELSE (event_id % 3 * 200)::VARCHAR END AS status_code FROM {_EVENTS}")
def audit_export_csv(spark, sf_dir):
    return audit.csv_rows(_events(spark, sf_dir).withColumn("status_code", F.col("event_id") % 3 * 200))


@query(f"""SELECT '{{"event_id":' || event_id || ',"event_type":"' || event_type || '","risk_level":"' || risk_level || '"}}' AS json FROM {_EVENTS}""")
def audit_export_json(spark, sf_dir):
    return audit.json_rows(_events(spark, sf_dir), "event_id", "event_type", "risk_level")


@query(f"SELECT event_id FROM {_EVENTS} WHERE timestamp >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def audit_retention(spark, sf_dir):
    events = _events(spark, sf_dir)
    return audit.retained(events, F.lit(events.agg(F.max("timestamp")).first()[0]), 7).select("event_id")


@query(f"SELECT left(sha256(event_type || ':' || request_id || ':' || endpoint || ':' || tenant_id), 16) AS signature, count(*) AS n FROM {_EVENTS} GROUP BY 1")
def audit_signatures(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy(audit.signature(*[F.col(c) for c in ("event_type", "request_id", "endpoint", "tenant_id")]).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT tenant_id, risk_level, count(*) AS n FROM {_EVENTS} GROUP BY ALL HAVING (risk_level = 'critical' AND count(*) >= 10) OR (risk_level = 'high' AND count(*) >= 50)")
def risk_alerts(spark, sf_dir):
    return audit.alerts(_events(spark, sf_dir), {"critical": 10, "high": 50})


# ---- usage


def _tenant_events(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("tenant_id"), "value")


_USAGE = " UNION ALL ".join(f"SELECT user_id % 5 AS tenant_id, '{p}' AS period, date_trunc('{u}', ts)::TIMESTAMP AS window_start, count(*) AS used FROM events GROUP BY ALL" for p, u in usage.PERIODS.items())


@query(_USAGE)
def quota_usage_windows(spark, sf_dir):
    return usage.quota_usage(_tenant_events(spark, sf_dir))


@query(f"SELECT tenant_id, period, window_start, used, used + 1 <= quota AS allowed, used + 1 > floor(quota * 0.8) AND used + 1 <= quota AS warn FROM ({_USAGE}) JOIN (SELECT n_nationkey AS tenant_id, 'daily' AS period, 60 + n_nationkey * 20 AS quota FROM nation WHERE n_nationkey < 5) USING (tenant_id, period)")
def quota_check(spark, sf_dir):
    limits = _table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("tenant_id"), F.lit("daily").alias("period"), (60 + F.col("n_nationkey") * 20).alias("quota"), F.lit(80).alias("soft_percent"))
    out = usage.check_quota(usage.quota_usage(_tenant_events(spark, sf_dir)), limits)
    return out.where("quota IS NOT NULL").select("tenant_id", "period", "window_start", "used", "allowed", "warn")


@query("SELECT user_id % 5 AS tenant_id, time_bucket(INTERVAL 1 MINUTE, ts)::TIMESTAMP AS window_start, count(*) AS requests, least(count(*), 2) AS admitted FROM events GROUP BY ALL")
def rate_limit_fixed(spark, sf_dir):
    return usage.fixed_window(_tenant_events(spark, sf_dir), "tenant_id", 2)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
b AS (SELECT user_id, event_id, t, r, TRUE AS admitted, 4.0::DOUBLE AS left_ FROM e WHERE r = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.t, e.r, least(5.0, left_ + greatest(0.0, e.t - b.t) * 0.00001) >= 1, least(5.0, left_ + greatest(0.0, e.t - b.t) * 0.00001) - CASE WHEN least(5.0, left_ + greatest(0.0, e.t - b.t) * 0.00001) >= 1 THEN 1 ELSE 0 END
    FROM b JOIN e ON e.user_id = b.user_id AND e.r = b.r + 1)
SELECT user_id, event_id, admitted, round(left_, 6) AS tokens_left FROM b""")
def token_bucket(spark, sf_dir):
    """A bucket for each user, the finest key at hand, as a bucket's events are folded in order by one task."""
    return usage.token_bucket(_table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), "user_id", 0.00001, 5.0)


@query("SELECT user_id % 5 AS tenant_id, event_id, round(avg(value) OVER w, 6) AS rolling_avg, max(value) OVER w AS rolling_max, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_metrics(spark, sf_dir):
    return usage.rolling(_tenant_events(spark, sf_dir), "tenant_id", "event_id", "value")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, round(median(value), 6) AS p50, max(value) FILTER (r = floor(n * 0.95)) AS p95, max(value) FILTER (r = floor(n * 0.99)) AS p99 FROM r GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return usage.percentiles(_table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT event_type, le::DOUBLE AS le, count(*) FILTER (value <= le) AS n FROM events, (VALUES (10), (25), (50), (75), (100)) b(le) GROUP BY event_type, le")
def histogram_buckets(spark, sf_dir):
    return usage.histogram(_table(spark, sf_dir, "events"), "event_type", "value", (10, 25, 50, 75, 100))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def cache_eviction(spark, sf_dir):
    return usage.newest(_table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


# ---- governance


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN (SELECT lower(c_mktsegment) FROM customer GROUP BY 1 HAVING min(c_custkey) <= 3)")
def allowlist_semi(spark, sf_dir):
    people = _table(spark, sf_dir, "customer")
    allow = people.groupBy(F.lower("c_mktsegment").alias("entry")).agg(F.min("c_custkey").alias("k")).where("k <= 3").select(F.lit("*").alias("entity_type"), "entry", F.lit(True).alias("enabled"), F.lit(False).alias("case_sensitive"))
    return govern.exempt(people.select("c_custkey", F.lit("ORG").alias("entity_type"), F.col("c_mktsegment").alias("value")), allow).select("c_custkey", F.col("value").alias("c_mktsegment"))


@query("SELECT s_suppkey, n_name AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 0")
def allowlist_anti(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation")
    allow = nations.where("n_regionkey = 0").select(F.lit("LOCATION").alias("entity_type"), F.col("n_name").alias("entry"), F.lit(True).alias("enabled"), F.lit(True).alias("case_sensitive"))
    places = _table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lit("LOCATION").alias("entity_type"), F.col("n_name").alias("value"))
    return govern.not_exempt(places, allow).select("s_suppkey", "value")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'known-' || c_nationkey ELSE c_nationkey::VARCHAR END AS tenant_id FROM customer")
def tenant_key_join(spark, sf_dir):
    people = _table(spark, sf_dir, "customer").withColumn("api_key", F.concat(F.lit("key_"), F.col("c_nationkey").cast("string"), F.lit("_"), F.col("c_custkey").cast("string")))
    keys = people.where("c_custkey % 3 = 0").select(F.sha2("api_key", 256).alias("key_hash"), F.concat(F.lit("known-"), F.col("c_nationkey").cast("string")).alias("tenant_id"), F.lit("active").alias("status"))
    return govern.tenants_of_keys(people.select("c_custkey", "api_key"), keys, "none").select("c_custkey", "tenant_id")


@query("SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 2 = 0 THEN 'read,write' ELSE 'read' END AS permissions FROM supplier")
def rbac_permissions(spark, sf_dir):
    users = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("editor"), F.lit("viewer"))).otherwise(F.array(F.lit("viewer"))).alias("roles"))
    roles = spark.createDataFrame([("viewer", "read"), ("editor", "read"), ("editor", "write")], "role string, permission string")
    return govern.permissions(users, roles).select("user_id", F.array_join("permissions", ",").alias("permissions"))


# ---- scalars


@query("""SELECT c_custkey, regexp_matches('user' || c_custkey || '@mail.example.com', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS email, c_custkey % 300 <= 255 AS ipv4, TRUE AS phone, (c_custkey % 3) > 0 AS url FROM customer""")
def validators_matrix(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", T.valid_email(F.concat(F.lit("user"), k, F.lit("@mail.example.com"))).alias("email"), T.valid_ipv4(F.concat(F.lit("10.1."), (F.col("c_custkey") % 300).cast("string"), F.lit(".7"))).alias("ipv4"),
        T.valid_phone(F.concat(F.lit("138-"), F.lpad(k, 8, "0"))).alias("phone"), T.valid_url(F.concat(F.element_at(F.array(F.lit("gopher"), F.lit("https"), F.lit("ftp")), (F.col("c_custkey") % 3 + 1).cast("int")), F.lit("://example.com/"), k)).alias("url"),
    )


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))::INT AS n_words, CASE WHEN length(text) > 50 THEN left(text, 47) || '...' ELSE text END AS short FROM documents")
def text_utils(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.count_words(F.col("text")).cast("int").alias("n_words"), T.truncate(F.col("text"), 50).alias("short"))


@query("SELECT c_custkey, left(c_name, 4) || '...' || left(sha256(c_name), 16) AS masked, (('0x' || md5('42:' || c_name))::UHUGEINT % 100)::BIGINT AS m FROM customer")
def keys_and_md5(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", audit.mask_key(F.col("c_name")).alias("masked"), T.md5_mod(F.concat(F.lit("42:"), F.col("c_name")), 100).alias("m"))


# ---- streams and storage


_CHAT_TEXT = "text || CASE WHEN role = 'user' THEN ' Mail user' || conv_id % 97 || '@example.com, host 10.0.' || turn % 250 || '.' || conv_id % 250 ELSE '' END"


@query(f"SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS restored FROM (SELECT conv_id, turn, {_CHAT_TEXT} AS t FROM conversations) GROUP BY conv_id")
def stream_rehydrate(spark, sf_dir):
    """Anonymised conversations sent in pieces of seven characters through the stateful operator."""
    rows, mapping = _sessions(spark, sf_dir)
    folder = shared.folder(spark)
    whole = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "anon_text"))), lambda x: x["anon_text"]), "\n").alias("t"))
    whole.write.parquet(f"{folder}/whole")
    whole = spark.read.schema(whole.schema).parquet(f"{folder}/whole")
    names = mapping.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("originals"))
    pieces = rehydrate.chunked(whole, "conv_id", "t", 7).join(names.withColumnRenamed("conv_id", "stream_id"), "stream_id", "left")
    pieces.write.parquet(f"{folder}/chunks")
    chunks = spark.readStream.schema(pieces.schema).parquet(f"{folder}/chunks")
    rehydrate.restored_stream(chunks, wait="NoTimeout").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("stream_id long, seq long, out string").parquet(f"{folder}/out")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "out"))), lambda x: x["out"]), "")
    return out.groupBy(F.col("stream_id").alias("conv_id")).agg(joined.alias("restored"))


@query(f"SELECT event_id::VARCHAR AS event_id, event_type, tenant_id, risk_level FROM {_EVENTS} WHERE timestamp >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY")
def audit_log_roundtrip(spark, sf_dir):
    """Events appended to a table by day and read back from a time on."""
    events = _events(spark, sf_dir)
    path = f"{shared.folder(spark)}/audit"
    audit_log.append(events.withColumn("event_id", F.col("event_id").cast("string")).withColumn("timestamp", F.col("timestamp").cast("timestamp")), path)
    first = events.agg(F.min("timestamp") + F.expr("INTERVAL 1 DAY")).first()[0]
    return audit_log.read(spark, path, start=first).select("event_id", "event_type", "tenant_id", "risk_level")


@query("SELECT conv_id, turn, text AS content FROM conversations")
def sse_roundtrip(spark, sf_dir):
    """Turns written as server-sent event lines and parsed again."""
    turns = _table(spark, sf_dir, "conversations")
    line = F.rtrim(lists.sse_line(F.col("text"), F.lit("c"), F.lit(0), F.lit("m")), F.lit("\n"))
    return turns.select("conv_id", "turn", lists.sse_content(line)["content"].alias("content"))

"""Registered queries: synthetic names and id cards, detectors in code, tokens in context."""

import re

from pyspark.sql import functions as F

from scrimlake.functions import generators as G
from scrimlake.functions.values import ID_WEIGHTS, SURNAMES
from scrimlake.operators import detectors, entropy, spans
from scrimlake.plans.catalog import _ID17, _table, query

_SEED = "(('0x' || left(sha256({s}), 8))::BIGINT + 42) % 2147483648"
_H = "('0x' || md5({s} || ':' || {t}))::UHUGEINT"
_EVERY = G.MEN + G.WOMEN + 2 * G.ANYBODY
_LIST = "[" + ", ".join(f"'{x}'" for x in G.TWO_SIGNS) + "]"
#: Names of two to five signs, each third with a surname of two.
_NAMES = f"""SELECT c_custkey, 's' || c_nationkey AS session, CASE WHEN c_custkey % 3 = 0 THEN {_LIST}[c_custkey % {len(G.TWO_SIGNS)} + 1] ELSE ('{G.ONE_SIGN}')[c_custkey % {len(G.ONE_SIGN)} + 1] END AS surname,
    left(('{G.MEN}')[c_custkey % 30 + 1:], c_custkey % 4) AS given FROM customer"""


@query(
    f"""WITH a AS ({_NAMES}), b AS (SELECT *, surname || given AS name, {_SEED.format(s="session")} AS seed FROM a WHERE surname || given <> ''),
    c AS (SELECT *, {_H.format(s="seed", t="surname")} AS hs, {_H.format(s="seed", t="name || given")} AS hg FROM b),
    d AS (SELECT *, (hg % 4294967296)::BIGINT AS low, ((hg % 4294967296)::BIGINT * 31 + 17) % 4294967296 AS two, ('{_EVERY}')[(hg % {len(_EVERY)})::INT + 1] AS one FROM c),
    e AS (SELECT *, ('{_EVERY}')[(two % {len(_EVERY)}) + 1] AS plain, ('{_EVERY}')[((two + 1) % 4294967296 % {len(_EVERY)}) + 1] AS next_ FROM d)
    SELECT c_custkey, name, CASE WHEN length(name) < 2 THEN name ELSE CASE WHEN c_custkey % 3 = 0 THEN {_LIST}[(hs % {len(G.TWO_SIGNS)})::INT + 1] ELSE ('{G.ONE_SIGN}')[(hs % {len(G.ONE_SIGN)})::INT + 1] END
        || CASE length(given) WHEN 0 THEN '' WHEN 1 THEN one WHEN 2 THEN one || CASE WHEN one = plain THEN next_ ELSE plain END
        ELSE array_to_string(list_transform(range(length(given)), lambda i: ('{_EVERY}')[((low + i * 31) % 4294967296 % {len(_EVERY)}) + 1]), '') END END AS synthetic FROM e"""
)
def synthetic_names(spark, sf_dir):
    """Names with those that stand for them in a session of their own."""
    k = F.col("c_custkey").cast("int")
    surname = F.when(k % 3 == 0, F.element_at(F.array(*[F.lit(x) for x in G.TWO_SIGNS]), k % len(G.TWO_SIGNS) + 1)).otherwise(F.substr(F.lit(G.ONE_SIGN), k % len(G.ONE_SIGN) + 1, F.lit(1)))
    name = F.concat(surname, F.left(F.substr(F.lit(G.MEN), k % 30 + 1), k % 4))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), G.session_seed(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")), 42).alias("seed"))
    return rows.select("c_custkey", "name", G.synthetic_name(F.col("name"), F.col("seed")).alias("synthetic"))


_FIFTEEN = "left(d, 6) || substr(d, 9, 9)"


@query(
    f"""WITH i AS (SELECT o_orderkey, o_custkey, {_ID17} AS d FROM orders), c AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN d || '7' WHEN 1 THEN {_FIFTEEN} ELSE 'no card ' || o_orderkey END AS card, {_SEED.format(s="'s' || o_custkey % 10")} AS seed, d FROM i),
    h AS (SELECT *, {_H.format(s="seed", t="left(card, 6)")} AS hr, {_H.format(s="seed", t="card || 'seq'")} AS hq FROM c),
    m AS (SELECT *, '11' || lpad((hr % 10000)::VARCHAR, 4, '0') || CASE o_orderkey % 3 WHEN 0 THEN substr(d, 7, 8) ELSE '19' || substr(d, 9, 6) END || lpad((hq % 100)::VARCHAR, 2, '0') || ((hq % 1280)::BIGINT // 256 * 2 + d[17]::INT % 2)::VARCHAR AS p FROM h)
    SELECT o_orderkey, card, CASE WHEN o_orderkey % 3 = 2 THEN card ELSE p || ('10X98765432')[(list_sum(list_transform(range(1, 18), lambda k: p[k]::INT * {list(ID_WEIGHTS)}[k])) % 11)::INT + 1] END AS synthetic FROM m"""
)
def synthetic_id_cards(spark, sf_dir):
    """Id cards of 18 and of 15 signs, and what isn't one, with those that stand for them."""
    key = F.col("o_orderkey")
    digits = F.concat(F.lit("110101"), F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((key % 1000).cast("string"), 3, "0"))
    card = F.when(key % 3 == 0, F.concat(digits, F.lit("7"))).when(key % 3 == 1, F.concat(F.left(digits, F.lit(6)), F.substr(digits, F.lit(9), F.lit(9)))).otherwise(F.concat(F.lit("no card "), key.cast("string")))
    seed = G.session_seed(F.concat(F.lit("s"), (F.col("o_custkey") % 10).cast("string")), 42)
    return _table(spark, sf_dir, "orders").select("o_orderkey", card.alias("card"), seed.alias("seed")).select("o_orderkey", "card", G.synthetic_id_card(F.col("card"), F.col("seed")).alias("synthetic"))


# ---- a detector in code

_SAID = re.compile(r"my name is ([一-鿿]{2,6})")


def _introduced(texts: list[str]) -> list[list[tuple]]:
    return [[("PERSON", m.start(1), m.end(1), 0.5) for m in _SAID.finditer(t)] for t in texts]


#: A stand-in for a model: names after words that introduce them.
INTRODUCED = detectors.Detector("introduced", ("PERSON",), _introduced)
_PEOPLE = "(SELECT conv_id, turn, text, ('" + "".join(SURNAMES) + f"')[conv_id % 200 % {len(SURNAMES)} + 1] || left('伟强磊洋勇', 1 + turn % 5) AS name FROM conversations WHERE role = 'user')"


@query(
    f"""SELECT conv_id, turn, 'PERSON' AS entity_type, (length(text) + 12)::INT AS start, (length(text) + 12 + length(name))::INT AS "end", 0.95::DOUBLE AS score, name AS value FROM {_PEOPLE}
    UNION ALL SELECT conv_id, turn, 'EMAIL_ADDRESS', (length(text) + 12 + length(name) + 7)::INT, (length(text) + 12 + length(name) + 7 + length('u' || conv_id || '@example.com'))::INT, 0.85, 'u' || conv_id || '@example.com' FROM {_PEOPLE}"""
)
def detect_persons_in_code(spark, sf_dir):
    """Names that a detector in code finds, scored by surname and length and resolved with the mail addresses of a pattern."""
    turns = _table(spark, sf_dir, "conversations").where("role = 'user'")
    name = F.concat(F.substr(F.lit("".join(SURNAMES)), (F.col("conv_id") % 200 % len(SURNAMES)).cast("int") + 1, F.lit(1)), F.left(F.lit("伟强磊洋勇"), (F.col("turn") % 5).cast("int") + 1))
    turns = turns.withColumn("text", F.concat("text", F.lit(" my name is "), name, F.lit(", mail u"), F.col("conv_id").cast("string"), F.lit("@example.com")))
    found = spans.resolve(spans.score_persons(detectors.detect_with(F.col("text"), (INTRODUCED,), (spans.MAIL,), ("PERSON", "EMAIL_ADDRESS"))))
    return turns.select("conv_id", "turn", F.posexplode_outer(found).alias("i", "s")).where("i is not null").select("conv_id", "turn", "s.*")


# ---- tokens in their context

_BITS = "round(list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)) * log2(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)))), 3)"


@query(
    f"""WITH t AS (SELECT o_orderkey, left(md5(o_orderkey::VARCHAR), 18) AS token, o_orderkey % 2 = 0 AS told FROM orders), e AS (SELECT *, {_BITS} AS bits FROM t WHERE NOT regexp_matches(token, '^([0-9]{{4,}})$'))
    SELECT o_orderkey, CASE WHEN bits >= 5 THEN 'critical' WHEN bits >= 4.5 THEN 'high' WHEN bits >= 3.5 THEN 'medium' ELSE 'low' END AS level, bits >= 4.5 OR (bits >= 3.5 AND told) AS suspicious FROM e"""
)
def entropy_in_context(spark, sf_dir):
    """Tokens too short for a shape of their own, half of them beside a word that tells a secret."""
    key = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.left(F.md5(key.cast("string")), F.lit(18)).alias("token"), F.when(key % 2 == 0, "your API Key: ").otherwise("the colour: ").alias("before"))
    return entropy.analyze(rows.where(~F.col("token").rlike("^[0-9]{4,}$")), "token", F.col("before")).select("o_orderkey", "level", "suspicious")

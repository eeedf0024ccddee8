"""More registered queries: restoration of variants, stores with a time to live, scalars, allowlist and usage relations."""

from pyspark.sql import functions as F

from scrimlake.functions import text as T
from scrimlake.operators import anonymize as A
from scrimlake.operators import audit, chat, govern, secrets, spans, stores, usage
from scrimlake.plans.catalog import FOUR, _rows, _CHAT_TEXT, _CONTACTS, _EVENTS, _KEYS, _MASK, _MATCHES, _TYPED, _USAGE, _any, _anon, _chat, _events, _near, _sessions, _table, _tenant_events, _with_keys, query

# ---- restoration

_FORMS = ("<$1_$2>", "[$1_$2]", "{{$1_$2}}", "<$1-$2>", "<$1 $2>", "%$1_$2%")


@query(f"SELECT c.conv_id, turn, CASE WHEN role = 'user' AND c.conv_id % 6 = 5 THEN text || ' Mail %EMAIL_1%, host %IP_' || k || '%' ELSE {_CHAT_TEXT} END AS restored FROM conversations c LEFT JOIN (SELECT conv_id, x, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS k FROM (SELECT conv_id, turn % 250 AS x, min(turn) AS t FROM conversations WHERE role = 'user' GROUP BY ALL)) i ON i.conv_id = c.conv_id AND i.x = c.turn % 250".replace("conv_id % 97", "c.conv_id % 97").replace("conv_id % 250", "c.conv_id % 250"))
def deanonymize_fuzzy(spark, sf_dir):
    """Anonymised turns whose placeholders came back in other forms, of which the last is none."""
    rows, mapping = _sessions(spark, sf_dir)
    changed = F.col("anon_text")
    for k, form in enumerate(_FORMS):
        changed = F.when(F.col("conv_id") % len(_FORMS) == k, F.regexp_replace("anon_text", "<(EMAIL|IP)_([0-9]+)>", form)).otherwise(changed)
    return A.restore_fuzzy(rows.select("conv_id", "turn", changed.alias("t")), mapping, "conv_id", "turn", "t").select("conv_id", "turn", "restored")


@query(
    f"""{_TYPED}, r AS (SELECT doc_id, start, "end", CASE WHEN ptype IN ('PHONE', 'EMAIL') THEN value ELSE '[REDACTED]' END AS new, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM n),
    p AS (SELECT doc_id, string_agg(substr(text, (before + 1)::BIGINT, (start - before)::BIGINT) || new, '' ORDER BY start) AS head, max("end") AS last FROM r JOIN documents USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, sha256(CASE WHEN head IS NULL THEN text ELSE head || substr(text, last + 1) END) AS restored_sha256 FROM documents LEFT JOIN p USING (doc_id)"""
)
def deanonymize_synthetic(spark, sf_dir):
    """Synthetic phones and mail addresses put back; what has no generator stays redacted."""
    out = _anon(spark, sf_dir, "synthetic")
    return out.select("doc_id", F.sha2(A.restore_synthetic(F.col("anon_text"), F.col("entities")), 256).alias("restored_sha256"))


@query("""WITH u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'), f AS (SELECT DISTINCT conv_id FROM u),
ip AS (SELECT conv_id, x, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS k FROM (SELECT conv_id, turn % 250 AS x, min(turn) AS t FROM u GROUP BY ALL))
SELECT conv_id, '{"EMAIL":{"user' || conv_id % 97 || '@example.com":"<EMAIL_1>"},"IP":{' || string_agg('"10.0.' || x || '.' || conv_id % 250 || '":"<IP_' || k || '>"', ',' ORDER BY '10.0.' || x || '.' || conv_id % 250) || '}}' AS json FROM ip GROUP BY conv_id""")
def mapping_as_json(spark, sf_dir):
    return stores.mapping_json(_sessions(spark, sf_dir)[1], "conv_id")


@query("""WITH u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')
SELECT conv_id, 'EMAIL' AS ptype, count(DISTINCT conv_id) AS n FROM u GROUP BY conv_id UNION ALL SELECT conv_id, 'IP', count(DISTINCT turn % 250) FROM u GROUP BY conv_id""")
def mapping_from_json(spark, sf_dir):
    """Values by type of mappings that were written as JSON and read again."""
    back = stores.mapping_of_json(stores.mapping_json(_sessions(spark, sf_dir)[1], "conv_id"), "conv_id")
    return back.groupBy("conv_id", "ptype").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, (CASE WHEN role = 'user' AND conv_id % 97 <= 2 THEN 1 ELSE 0 END)::INT AS exempted, (CASE WHEN role = 'user' THEN 1 ELSE 0 END - CASE WHEN role = 'user' AND conv_id % 97 <= 2 THEN 1 ELSE 0 END)::INT AS replaced FROM conversations""")
def allowlisted_mail_gate(spark, sf_dir):
    """Of each turn's mail addresses, how many an allowlist exempts and how many are to be replaced."""
    found = _chat(spark, sf_dir).select("conv_id", "turn", spans.resolve(spans.detect(F.col("text"), (spans.MAIL,))).alias("s"))
    one = found.select("conv_id", "turn", F.posexplode_outer("s").alias("i", "x")).where("i is not null").select("conv_id", "turn", "x.entity_type", "x.value")
    allow = _table(spark, sf_dir, "nation").where("n_nationkey <= 2").select(F.lit("EMAIL_ADDRESS").alias("entity_type"), F.concat(F.lit("USER"), F.col("n_nationkey").cast("string"), F.lit("@example.com")).alias("entry"), F.lit(True).alias("enabled"), F.lit(False).alias("case_sensitive"))
    n = lambda df, c: df.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).cast("int").alias(c))
    out = _table(spark, sf_dir, "conversations").select("conv_id", "turn").join(n(govern.exempt(one, allow), "exempted"), ["conv_id", "turn"], "left").join(n(govern.not_exempt(one, allow), "replaced"), ["conv_id", "turn"], "left")
    return out.fillna(0, ["exempted", "replaced"])


@query(
    f"""WITH c AS {_CONTACTS}, b AS (SELECT c.*, (length(text) + 6)::INT AS start, 'user' || conv_id % 97 || '@example.com' AS value FROM c JOIN conversations USING (conv_id, turn) WHERE role = 'user'), e AS (SELECT *, start + length(value) AS "end" FROM b)
    SELECT conv_id, turn, start, value, {_any("trim(t)", T.INTENT)} OR {_any(_near, chat.ASKED)} AS preserved FROM e"""
)
def intent_replaced_entities(spark, sf_dir):
    """The mail addresses of all turns, and whether a question keeps them."""
    turns = _chat(spark, sf_dir)
    found = turns.select("conv_id", "turn", "text", F.posexplode_outer(spans.resolve(spans.detect(F.col("text"), (spans.MAIL,)))).alias("i", "s")).where("i is not null")
    return found.select("conv_id", "turn", "s.start", "s.value", chat.entity_intent(F.col("text"), F.col("s.start"), F.col("s.end"))["is_question"].alias("preserved"))


# ---- stores: orders as entries of a cache

_STORE = "(SELECT 't' || o_custkey % 7 AS tenant_id, 'k' || o_orderkey % 500 AS key, o_orderkey AS entry, o_orderdate::TIMESTAMP AS created_at, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::TIMESTAMP + INTERVAL 1 DAY * (o_orderkey % 400) END AS expires_at, (o_orderkey % 1000)::BIGINT AS size_bytes, (o_orderkey % 13)::BIGINT AS hit_count FROM orders)"
_PUT = f"(SELECT * FROM {_STORE} QUALIFY row_number() OVER (PARTITION BY tenant_id, key ORDER BY entry % 2 DESC, created_at DESC, entry DESC) = 1)"
_NOW = "1998-06-01 00:00:00"


def _entries(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 7).cast("string")).alias("tenant_id"), F.concat(F.lit("k"), (k % 500).cast("string")).alias("key"), k.alias("entry"), day.alias("created_at"),
        F.when(k % 5 > 0, day + F.make_dt_interval((k % 400).cast("int"))).alias("expires_at"), (k % 1000).cast("long").alias("size_bytes"), (k % 13).cast("long").alias("hit_count"),
    )


def _now():
    return F.lit(_NOW).cast("timestamp")


@query(f"SELECT tenant_id, key, entry FROM {_PUT}")
def store_put(spark, sf_dir):
    """Entries of even orders, then those of odd ones: of each tenant and key the latest stays, of one day that of the highest number."""
    rows = _entries(spark, sf_dir)
    return stores.put(rows.where("entry % 2 = 0"), rows.where("entry % 2 = 1"), ties=("entry",)).select("tenant_id", "key", "entry")


@query(f"SELECT entry FROM {_STORE} WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{_NOW}'")
def store_live(spark, sf_dir):
    return stores.live(_entries(spark, sf_dir), _now()).select("entry")


@query(f"SELECT entry, CASE WHEN expires_at IS NOT NULL AND key IN ('k1', 'k2') AND tenant_id = 't1' THEN greatest(expires_at, TIMESTAMP '{_NOW}' + INTERVAL 100 DAY) ELSE expires_at END AS expires_at FROM {_STORE} WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{_NOW}'")
def store_extend(spark, sf_dir):
    rows = _entries(spark, sf_dir)
    asked = rows.where("tenant_id = 't1' and key in ('k1', 'k2')")
    return stores.extend(rows, asked, _now(), 100 * 86400).select("entry", "expires_at")


@query(f"SELECT tenant_id, count(*) AS entries, sum(size_bytes)::BIGINT AS bytes, sum(hit_count)::BIGINT AS hits, round(avg(epoch(TIMESTAMP '{_NOW}') - epoch(created_at)), 3) AS avg_age FROM {_STORE} WHERE (expires_at IS NULL OR expires_at >= TIMESTAMP '{_NOW}') AND tenant_id <> 't3' GROUP BY tenant_id")
def store_stats(spark, sf_dir):
    """Figures of each tenant's live entries after one tenant's went."""
    return stores.stats(stores.without_tenant(_entries(spark, sf_dir), "t3"), _now())


@query(f"SELECT tenant_id, key, created_at::DATE AS day FROM (SELECT * FROM {_STORE} QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, key) <= 10)")
def store_preview(spark, sf_dir):
    return stores.preview(_entries(spark, sf_dir)).select("tenant_id", "key", F.to_date("created_at").alias("day"))


@query(f"SELECT o_orderkey, entry IS NOT NULL AS hit FROM (SELECT o_orderkey, 't' || o_custkey % 7 AS tenant_id, 'k' || (o_orderkey * 3) % 500 AS key FROM orders) r LEFT JOIN (SELECT tenant_id, key, min(entry) AS entry FROM {_STORE} WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{_NOW}' GROUP BY ALL) USING (tenant_id, key)")
def cache_hits(spark, sf_dir):
    """Whether each request finds a live entry."""
    asked = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("t"), (F.col("o_custkey") % 7).cast("string")).alias("tenant_id"), F.concat(F.lit("k"), (F.col("o_orderkey") * 3 % 500).cast("string")).alias("key"))
    return usage.cache_lookup(asked, _entries(spark, sf_dir), _now()).select("o_orderkey", "hit")


@query(f"SELECT tenant_id, sum(used) FILTER (period = 'hourly')::BIGINT AS hourly, sum(used) FILTER (period = 'daily')::BIGINT AS daily, sum(used) FILTER (period = 'monthly')::BIGINT AS monthly FROM ({_USAGE}) GROUP BY tenant_id")
def usage_pivot(spark, sf_dir):
    return usage.quota_usage(_tenant_events(spark, sf_dir)).groupBy("tenant_id").pivot("period", ["hourly", "daily", "monthly"]).agg(F.sum("used"))


# ---- scalars


@query("""SELECT c_custkey, c_custkey % 4 <> 3 AS postal, c_custkey % 3 <> 2 AS ip, c_custkey % 1000 BETWEEN 1 AND 899 AND c_custkey % 1000 <> 666 AS ssn, c_custkey % 5 > 1 AS ok,
CASE c_custkey % 5 WHEN 0 THEN 'Input cannot be empty' WHEN 1 THEN 'Input contains potentially malicious content' ELSE c_name || ' x' END AS told, round((c_custkey % 4) / (c_custkey % 4 + 6.0), 6)::DOUBLE AS cjk, c_custkey % 4 = 3 AS chinese, 'a b ' || c_custkey AS spaced FROM customer""")
def scalar_matrix(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    pick = lambda n, *of: F.element_at(F.array(*[x if hasattr(x, "alias") else F.lit(x) for x in of]), (k % n + 1).cast("int"))
    cleaned = T.sanitize_input(pick(5, " \t", "<a onclick = 1>", *[F.concat(F.lit("\n "), F.col("c_name"), F.lit(" x "))] * 3))
    mixed = F.concat(F.repeat(F.lit("中"), (k % 4).cast("int")), F.lit(" abc def "))
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", T.valid_postal_code(pick(4, "123456", "SW1A 1AA", "K1A 0B1", "12-34"), pick(4, "CN", "UK", "ca", "JP")).alias("postal"), T.valid_ip(pick(3, "2001:db8:0:0:0:0:0:1", " 10.0.0.1 ", "1.2.3.400")).alias("ip"),
        T.valid_ssn(F.concat(F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-12-3456"))).alias("ssn"), cleaned["ok"].alias("ok"), cleaned["text"].alias("told"), F.round(T.cjk_share(mixed), 6).alias("cjk"), T.is_chinese(mixed).alias("chinese"), T.normalize_spaces(F.concat(F.lit(" a\t b\n"), s, F.lit(" "))).alias("spaced"),
    )


# ---- audit summaries, scan statistics, allowlist pages

_KINDS_OF = "(SELECT *, CASE WHEN event_id % 7 > 0 THEN 'TYPE_' || event_id % 3 END AS entity_type, CASE WHEN event_id % 5 > 0 THEN 'way_' || event_id % 2 END AS strategy_used FROM {})"
_SECTIONS = " UNION ALL ".join(
    f"SELECT '{section}' AS section, {name} AS name, {n} AS n FROM {_KINDS_OF.format(_EVENTS)} WHERE {test} AND {name} IS NOT NULL GROUP BY ALL"
    for section, name, n, test in (("by_type", "event_type", "count(*)", "TRUE"), ("by_risk", "risk_level", "count(*)", "TRUE"), ("by_entity", "entity_type", "coalesce(sum(entity_count), 0)::BIGINT", "event_type = 'pii_detected'"), ("by_strategy", "strategy_used", "count(*)", "event_type = 'pii_anonymized'"))
)


def _detailed(spark, sf_dir):
    k = F.col("event_id")
    named = lambda stem, n: F.concat(F.lit(stem), (k % n).cast("string"))
    return _events(spark, sf_dir).withColumn("entity_type", F.when(k % 7 > 0, named("TYPE_", 3))).withColumn("strategy_used", F.when(k % 5 > 0, named("way_", 2)))


@query(_SECTIONS)
def audit_summary_counts(spark, sf_dir):
    return audit.summary_counts(_detailed(spark, sf_dir))


@query(f"""SELECT max(j) FILTER (section = 'by_type') AS by_type, max(j) FILTER (section = 'by_risk') AS by_risk, max(j) FILTER (section = 'by_entity') AS by_entity, max(j) FILTER (section = 'by_strategy') AS by_strategy
FROM (SELECT section, '{{' || string_agg('"' || name || '":' || n, ',' ORDER BY name) || '}}' AS j FROM ({_SECTIONS}) GROUP BY section)""")
def audit_summary_maps(spark, sf_dir):
    maps = audit.summary_maps(_detailed(spark, sf_dir))
    return maps.select(*[F.to_json(c).alias(c) for c in maps.columns])


@query(f"SELECT 'audit_' || strftime(timestamp, '%Y%m%d') || '.jsonl' AS daily, 'audit_' || strftime(timestamp, '%G') || strftime(timestamp, '%V') || '.jsonl' AS weekly, 'audit_' || strftime(timestamp, '%Y%m') || '.jsonl' AS monthly, count(*) AS n FROM {_EVENTS} GROUP BY ALL")
def audit_log_names(spark, sf_dir):
    """How many events go to each file of the three rotations."""
    return _events(spark, sf_dir).groupBy(*[audit.log_name(F.col("timestamp"), r).alias(r) for r in ("daily", "weekly", "monthly")]).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN tenant_id END, 'home-' || user_id) AS tenant_id, coalesce(entity_count, length(user_id))::INT AS entity_count FROM {_EVENTS}")
def audit_merged_context(spark, sf_dir):
    """Events without a tenant or count take those of their user's context."""
    rows = _events(spark, sf_dir)
    ambient = rows.select("user_id").distinct().select("user_id", F.concat(F.lit("home-"), "user_id").alias("tenant_id"), F.length("user_id").alias("entity_count"))
    bare = rows.select("event_id", "user_id", F.when(F.col("event_id") % 2 == 0, F.col("tenant_id")).alias("tenant_id"), "entity_count")
    return audit.merged(bare, ambient, "user_id", "tenant_id", "entity_count").select("event_id", "tenant_id", "entity_count")


_TALLIES = f"SELECT doc_id, count(risk)::INT AS total, count(*) FILTER (risk = 'critical')::INT AS critical, count(*) FILTER (risk = 'high')::INT AS high, count(*) FILTER (risk IN ('critical', 'high')) > 0 AS should_block FROM {_KEYS} LEFT JOIN ({_MATCHES}) m USING (doc_id) GROUP BY doc_id"


@query(_TALLIES)
def secret_tallies(spark, sf_dir):
    return secrets.tallies(_with_keys(spark, sf_dir), "doc_id")


@query(f"SELECT count(*) AS total_scans, count(*) FILTER (should_block) AS total_blocks, sum(total)::BIGINT AS total_matches FROM ({_TALLIES})")
def secret_scan_stats(spark, sf_dir):
    return secrets.scan_stats(secrets.tallies(_with_keys(spark, sf_dir), "doc_id"))


_LISTS = "(SELECT 'list_' || c_nationkey AS name, lower(c_mktsegment) || '_' || c_custkey % 50 AS entry, c_nationkey % 4 > 0 AS enabled FROM customer)"


def _lists(spark, sf_dir):
    entry = F.concat(F.lower("c_mktsegment"), F.lit("_"), (F.col("c_custkey") % 50).cast("string"))
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("list_"), F.col("c_nationkey").cast("string")).alias("name"), entry.alias("entry"), (F.col("c_nationkey") % 4 > 0).alias("enabled"))


@query(f"SELECT count(*) AS total_allowlists, count(*) FILTER (enabled) AS enabled_allowlists, sum(n)::BIGINT AS total_entries FROM (SELECT name, bool_or(enabled) AS enabled, count(DISTINCT entry) AS n FROM {_LISTS} GROUP BY name)")
def allowlist_stats(spark, sf_dir):
    return govern.list_stats(_lists(spark, sf_dir))


@query(f"WITH e AS (SELECT DISTINCT entry FROM {_LISTS} WHERE name = 'list_3' AND entry LIKE '%build%') SELECT entry, (SELECT count(*) FROM e) AS total, (SELECT count(*) FROM e) > 8 AS has_more FROM e ORDER BY entry LIMIT 4 OFFSET 4")
def allowlist_page(spark, sf_dir):
    """The second page, of four entries, of a list's entries that hold a word."""
    return govern.entries_page(_lists(spark, sf_dir), "list_3", "BUILD", page=2, size=4)


@query(f"SELECT name, count(DISTINCT entry) AS n FROM {_LISTS} WHERE NOT entry LIKE 'machinery%' GROUP BY name")
def allowlist_edited(spark, sf_dir):
    """Entries by list, after those of odd names came to those of even ones and one segment's were removed."""
    rows = _lists(spark, sf_dir).withColumn("_odd", F.substring("name", -1, 1).isin(*"13579"))
    edited = govern.with_entries(rows.where("not _odd").drop("_odd").dropDuplicates(["name", "entry"]), rows.where("_odd").drop("_odd"))
    return govern.without_entries(edited, rows.where("entry like 'machinery%'")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# ---- scores by context and by name

_PHONE = "'138' || lpad(c_custkey::VARCHAR, 8, '0')"


@query(f"SELECT c_custkey, {_PHONE} AS value, CASE WHEN c_custkey % 4 < 2 THEN 1.0 ELSE 0.7 END::DOUBLE AS score FROM customer")
def phone_context_scores(spark, sf_dir):
    """Numbers score more behind a word for phones, unless it is too far away."""
    lead = F.element_at(F.array(*[F.lit(x) for x in ("My Phone: ", "联系电话：", "order ", "phone" + " " * 40)]), (F.col("c_custkey") % 4 + 1).cast("int"))
    text = F.concat(lead, F.lit("138"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    found = spans.with_context(spans.resolve(spans.detect(text, spans.CN_PHONE[:1])), text)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.explode(found).alias("s")).select("c_custkey", "s.value", "s.score")


@query("SELECT c_custkey, value, CASE WHEN left(value, 1) IN ('王', '向') THEN 0.95 WHEN length(value) BETWEEN 2 AND 4 THEN 0.9 ELSE 0.85 END::DOUBLE AS score FROM (SELECT c_custkey, ['王', '向', '欧', 'L'][(c_custkey % 4 + 1)::BIGINT] || repeat('明', (c_custkey % 6)::BIGINT) AS value FROM customer)")
def person_scores(spark, sf_dir):
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("王", "向", "欧", "L")]), (F.col("c_custkey") % 4 + 1).cast("int")), F.repeat(F.lit("明"), (F.col("c_custkey") % 6).cast("int")))
    span = F.struct(F.lit("PERSON").alias("entity_type"), F.lit(0).alias("start"), F.length("value").alias("end"), F.lit(0.5).alias("score"), F.col("value").alias("value"))
    found = spans.score_persons(F.array(span).cast(f"array<{spans.SPAN}>"))
    return _table(spark, sf_dir, "customer").select("c_custkey", name.alias("value")).select("c_custkey", "value", F.get(found, F.lit(0))["score"].alias("score"))


@query("SELECT s_suppkey AS user_id, s_suppkey % 4 = 0 OR s_suppkey % 4 = 2 AS allowed FROM supplier")
def rbac_allowed(spark, sf_dir):
    """Who may write: editors, and administrators, who may do all."""
    key = F.col("s_suppkey")
    held = F.when(key % 4 == 0, F.array(F.lit("admin"))).when(key % 4 == 1, F.array(F.lit("viewer"))).when(key % 4 == 2, F.array(F.lit("viewer"), F.lit("editor"))).otherwise(F.array().cast("array<string>"))
    users = _table(spark, sf_dir, "supplier").select(key.alias("user_id"), held.alias("roles"))
    roles = spark.createDataFrame([("viewer", "read"), ("editor", "write"), ("admin", govern.ADMIN_ALL)], "role string, permission string")
    return govern.permitted(users, roles, "write")


@query("SELECT s_suppkey AS user_id FROM supplier WHERE s_suppkey % 4 IN (1, 2) AND s_nationkey % 2 = 1 AND s_suppkey % 3 > 0")
def entities_listed(spark, sf_dir):
    """Active users of a role in some tenants."""
    key = F.col("s_suppkey")
    held = F.when(key % 4 == 1, F.array(F.lit("viewer"))).when(key % 4 == 2, F.array(F.lit("viewer"), F.lit("editor"))).otherwise(F.array(F.lit("admin")))
    users = _table(spark, sf_dir, "supplier").select(key.alias("user_id"), held.alias("roles"), F.col("s_nationkey").alias("tenant_id"), (key % 3 > 0).alias("is_active"))
    return govern.listed(users, roles="viewer", tenant_id=list(range(1, 25, 2)), is_active=True, user_id=None).select("user_id")


@query(f"{_TYPED} SELECT doc_id, ptype, start, '#' AS new FROM n")
def redact_marker(spark, sf_dir):
    """All values redacted by a marker of one's own."""
    out = A.anonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), strategies={}, default="redact", patterns=FOUR, marker="#")
    return _rows(out, "doc_id").select("doc_id", "e.ptype", "e.start", "e.new")


@query("SELECT conv_id, sha256(conv_id % 5 || chr(31) || 'm' || chr(31) || string_agg(role || ':' || text, chr(31) ORDER BY turn) || CASE WHEN conv_id % 3 > 0 THEN chr(31) || 'temperature=0.' || conv_id % 3 ELSE '' END || chr(31) || 'top_p=1') AS key FROM conversations GROUP BY conv_id")
def cache_key_options(spark, sf_dir):
    """Keys of requests with options, of which one may be missing."""
    heat = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("0."), (F.col("conv_id") % 3).cast("string")))
    return chat.cache_keys(_table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("conv_id") % 5, "m", options={"top_p": F.lit(1), "temperature": heat})


@query(rf"SELECT doc_id, name, start, line, regexp_replace(string_split(text, chr(10))[line], '^\s+|\s+$', '', 'g') AS content FROM (SELECT doc_id, name, start, text, (length(left(text, start)) - length(replace(left(text, start), chr(10), '')) + 1)::INT AS line FROM ({{_MATCHES}}) JOIN {{_KEYS}} USING (doc_id))".format(_MATCHES=_MATCHES, _KEYS=_KEYS))
def secret_line_content(spark, sf_dir):
    """The lines on which secrets begin."""
    return secrets.match_contents(_with_keys(spark, sf_dir), "doc_id")

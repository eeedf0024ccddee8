"""DuckDB SQL for the queries that SQL can express."""

from scrimlake.llm.quality_rules import PHRASES, SEPARATORS, SENTENCE_ENDS, SYMBOLS, LineRules

_R = LineRules()
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _count(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, {characters}, '')))"


_quoted = "'" + SENTENCE_ENDS.replace("'", "''") + "'"
_gaps = f"({_count('l', chr(39) + ' ' + chr(39))} + 1)"
_seps = _count("l", f"'{SEPARATORS}'")
_symbols = r"length(regexp_replace(l, '[\p{L}\p{M}\p{N} \t-\r]+', '', 'g'))"
LINE_FAILS = f"""(length(l) > 0 AND (
    ({_gaps} < {_R.short_words} AND NOT contains({_quoted}, right(l, 1)))
    OR ({_seps} > 0 AND {_seps} * 5 >= {_gaps})
    OR {_symbols} * 100 > {_R.symbol_percent} * length(l)
    OR ({_gaps} <= {_R.boilerplate_words} AND regexp_matches(lower(l), '{"|".join(PHRASES)}'))))"""

#: One row for each document; w: its words, ls: its lines.
QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {_R.window - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_R.window - 2})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range({_R.window}) AS r(o) GROUP BY doc_id),
lines AS (SELECT doc_id, raw, trim(raw, {_SPACES}) AS l FROM (SELECT doc_id, unnest(ls) AS raw FROM w)),
lost AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({LINE_FAILS}) AS n_lines_removed, coalesce(sum(length(raw)) FILTER ({LINE_FAILS}), 0) AS lost_chars,
    count(*) FILTER (length(l) > 0) - count(DISTINCT raw) FILTER (length(l) > 0) AS n_dup_lines FROM lines GROUP BY doc_id),
base AS (SELECT w.doc_id, len(w) AS n_words, length(translate(text, {_SPACES}, '')) AS word_chars, {_count("text", f"'{SYMBOLS}'")} AS n_symbols,
    lost.n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, n_lines, n_lines_removed, lost_chars, length(text) AS n
    FROM w JOIN lost USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
    NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words) AND lost_chars * 100 <= n * {_R.max_lost_percent} AS kept,
    n_lines::BIGINT AS n_lines, n_lines_removed::BIGINT AS n_lines_removed, lost_chars::BIGINT AS lost_chars FROM base"""

#: Words that windows of 50 words starting in a smaller document cover are gone.
REPEATS = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
covered AS (SELECT DISTINCT doc_id, i + o AS i FROM gone, range(50) AS r(o)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

#: The record of every page; of equal payloads of 100 bytes or more the first is the response.
RECORDS = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND least < page_id THEN least END AS refers_to FROM f"""

#: The given pages all hold their text in one article element with b as its only tag within words.
ARTICLES = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""

#: Scores of all documents for all items, without bounds.
RANKED = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, big_n),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

#: Links of all pairs that share a shingle, followed from every document.
SIMILAR = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT DISTINCT a AS doc_id, a AS to_ FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.to_ = l.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(w.doc_id, m), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(to_) AS m FROM r GROUP BY doc_id) USING (doc_id)"""

#: Nodes as lists of turns; every conversation's node against all nodes on the paths through it.
TRIE = r"""WITH RECURSIVE steps AS (SELECT b, b AS c, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM steps WHERE k < 8),
bytes AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), bytes),
own AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations),
made AS (SELECT c.conv_id, 0 AS part, i, x FROM convs c JOIN own o ON o.conv_id = c.base AND i < h UNION ALL SELECT c.conv_id, 1, i, x FROM convs c JOIN own o ON o.conv_id = c.conv_id AND i >= h),
whole AS (SELECT conv_id, coalesce(list(x ORDER BY part, i) FILTER (x IS NOT NULL), []) AS xs FROM convs LEFT JOIN made USING (conv_id) GROUP BY conv_id),
steps_ AS (SELECT conv_id, d, sha256(xs[1:d]::VARCHAR) || d AS k, CASE WHEN d > 0 THEN sha256(xs[1:d - 1]::VARCHAR) || d - 1 END AS up, d = len(xs) AS ends, CASE WHEN d > 0 THEN len(list_filter(regexp_split_to_array(xs[d].t, '[ \t-\r]+'), lambda y: y <> '')) ELSE 0 END AS words FROM (SELECT conv_id, xs, unnest(range(0, len(xs) + 1)) AS d FROM whole)),
nodes AS (SELECT k, any_value(up) AS up, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS m, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS e FROM steps_ GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
under AS (SELECT DISTINCT a.k, b.k AS below FROM steps_ a JOIN steps_ b USING (conv_id) WHERE a.d <= b.d),
sums AS (SELECT under.k, count(*) FILTER (kids.n IS NULL) AS leaves, sum((m - 1) * words)::BIGINT AS saved FROM under JOIN nodes b ON b.k = below LEFT JOIN kids ON kids.k = below GROUP BY under.k)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, p.conv_id AS parent_conv_id, nodes.m::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved AS saved_tokens, nodes.e AS ends_sha256
FROM nodes JOIN sums ON sums.k = nodes.k LEFT JOIN kids ON kids.k = nodes.k LEFT JOIN nodes p ON p.k = nodes.up"""

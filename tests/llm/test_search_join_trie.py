"""Ranked search, shingle join and prefix trie against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrimlake.llm import line_dedup, ngram_join, prefix_trie, ranked_search, simhash_dedup
from scrimlake.llm.common import Scratch

DOCS = "doc_id long, text string, term string"


def terms(text):
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", folded)


def ranked(docs, items, keep=10):
    held = [(i, Counter(terms(t))) for i, t, *_ in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in items:
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            scored.append((-s, i is None, i or 0, i))
        out |= {(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(x for x in scored if x[0] < 0)[:keep], 1)}
    return out


@pytest.mark.parametrize("bits", [14, 4])
def test_search_is_that_of_all_scores(spark, bits):
    """With 16 coordinates nearly every bound is far too high, which may cost time but no result."""
    r = random.Random(bits)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)] + ["Ärger", "naïve", "日本"]
    docs = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))), "x") for k in range(300)]
    docs += [(1000 + k, docs[7][1], "x") for k in range(30)] + [(2000, None, "x"), (2001, " .,- ", "x"), (None, docs[8][1], "x"), (9, docs[9][1], "x"), (2002, "w1 " * 400 + "rare", "x")]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(8))) for k in range(12)] + [(20, docs[7][1]), (21, None), (22, "unheard of"), (23, "RARE, w1! w1"), (24, "ÄRGER Ärger")]
    found = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), bits=bits)
    assert {tuple(x) for x in found.collect()} == ranked(docs, items)
    blocks = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), keep=3, block=5, bits=bits)
    assert {tuple(x) for x in blocks.collect()} == ranked(docs, items, 3)


def test_search_edges(spark):
    docs, items = spark.createDataFrame([(1, "a b", "t")], DOCS), spark.createDataFrame([(1, "a"), (1, "b"), (None, "b")], "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    found = {(r["item"], r["rank"], r["id"]) for r in ranked_search.search(docs, items.withColumn("rank", F.lit(9))).collect()}
    assert found == {(1, 1, 1), (None, 1, 1)}  # rows of one item are one query; a null item is one too


def test_sketch_bounds_are_never_low():
    r = random.Random(3)
    items = [[f"t{r.randrange(60)}".encode() for _ in range(6)] for _ in range(9)]
    df = {f"t{k}".encode(): r.randint(1, 40) for k in range(60)}
    block = ranked_search.Block([list(dict.fromkeys(i)) for i in items], df, 100, 5000)
    counts = Counter({f"t{k}".encode(): r.choice([1, 2, 7, 254, 255, 256, 90_000]) for k in range(0, 60, 2)})
    import pyarrow as pa

    text = b" ".join(t for t, n in counts.items() for _ in range(n)).decode()
    sketch = next(ranked_search._sketched(14)([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["tk", "text"])]))
    bounds = block.bounds(*[sketch.column(c).to_pylist() for c in ("n", "at", "peak")])[0]
    assert all(bounds[k] >= block.score(counts, sum(counts.values()), k) for k in range(9))


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def joined(docs, percent=80):
    sets = [(i, shingle_set(t)) for i, t, *_ in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    ids = [[sets[y][0] for y in range(len(sets)) if find(y) == find(x) and sets[y][0] is not None] for x in range(len(sets))]
    return Counter((i, len(s), min(ids[k], default=None) if s else i) for k, (i, s) in enumerate(sets))


def near_copies(r, n_groups, copies, vocabulary, shared=()):
    out = []
    for _ in range(n_groups):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, copies)):
            copy = list(words)
            for _ in range(r.randint(0, max(1, len(copy) // 30))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join([*copy, *r.choice(shared)] if shared else copy))
    return out


@pytest.mark.parametrize("stars", [0, 3])
def test_join_is_that_of_all_pairs(spark, stars):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(500)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = near_copies(r, 60, 6, vocabulary) + near_copies(r, 2, 60, vocabulary) + near_copies(r, 40, 1, vocabulary, [passage])
    docs = [(k, t, "x") for k, t in enumerate(texts)]
    docs += [(5000, texts[0], "x"), (3, texts[3], "x"), (None, texts[1], "x"), (5001, None, "x"), (5002, " \t", "x"), (5003, "one two", "x"), (5004, "One  TWO", "x"), (5005, "one", "x"), (None, "quite alone here", "x")]
    want = joined(docs)
    assert sum(k[0] != k[2] for k in want) > 100
    found = ngram_join.similar_sets(spark.createDataFrame(docs, DOCS).repartition(5), stars=stars)
    assert Counter(tuple(x) for x in found.collect()) == want


def test_join_of_a_chain_and_at_the_threshold(spark):
    word = lambda k: f"w{k}"
    base = [word(k) for k in range(104)]  # 100 shingles
    texts = [base]
    for k in range(6):  # each changes two more words far from those before
        texts.append([f"c{i}" if i in range(8, 8 + 16 * (k + 1), 8) else w for i, w in enumerate(base)])
    eight, nine = [word(k) for k in range(200, 213)], [word(k) for k in range(200, 212)]  # 9 and 8 shingles, 8 shared: 8 / 9
    ten = [word(k) for k in range(200, 214)]  # 10 shingles, of which 8 are nine's: exactly 0.8
    docs = [(k, " ".join(t), "x") for k, t in enumerate([*texts, eight, nine, ten])]
    assert Counter(tuple(x) for x in ngram_join.similar_sets(spark.createDataFrame(docs, DOCS)).collect()) == joined(docs)


def test_join_edges(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.similar_sets(none).count() == 0
    docs = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "A b c d e f", "y")], "doc_id long, text string, node string").withColumn("component_id", F.lit(0))
    assert sorted(tuple(x) for x in ngram_join.similar_sets(docs).collect()) == [(1, 2, 1), (2, 2, 1)]
    blank = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x")], DOCS)
    assert sorted(tuple(x) for x in ngram_join.similar_sets(blank).collect()) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_prefixes_share_what_is_asked():
    """Whatever the order and the matches that each set takes, sets within the threshold share the lesser number in their prefixes."""
    import numpy as np

    r = random.Random(5)
    levels_of = {k: r.choice([0, 1, 2, 3, 3, 4]) for k in range(4000)}
    both = 0
    for _ in range(400):
        n = r.randint(1, 120)
        a = r.sample(range(4000), n)
        b = list(a)
        for _ in range(r.randint(0, max(1, n // 9))):
            b[r.randrange(n)] = r.randrange(4000)
        sets = [np.array(sorted(set(x)), np.uint64) for x in (a, b)]
        if 100 * len(set(a) & set(b)) < 80 * len(set(a) | set(b)):
            continue
        (at_a, asked_a), (at_b, asked_b) = (ngram_join.prefix(s, np.array([levels_of[int(x)] for x in s], np.uint8), 0.0, 80) for s in sets)
        assert len(set(sets[0][at_a]) & set(sets[1][at_b])) >= min(asked_a, asked_b)
        both += asked_a > 1 or asked_b > 1
    assert both > 20


def tries(turns):
    convs = sorted({c for c, *_ in turns if c is not None})
    own = {c: [(role or "", text or "") for _, _, role, text in sorted((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in turns if x[0] == c)] for c in convs}
    whole = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {tuple(p[:d]) for p in whole.values() for d in range(len(p) + 1)}
    members = {n: [c for c in convs if tuple(whole[c][: len(n)]) == n] for n in nodes}
    rows = set()
    for n in nodes:
        under = [x for x in nodes if x[: len(n)] == n]
        leaves = sum(not any(y[:-1] == x and y != x and y for y in nodes) for x in under)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in under if x)
        ends = ",".join(str(c) for c in members[n] if len(whole[c]) == len(n))
        rows.add((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), sum(len(x) == len(n) + 1 for x in under), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


TURNS = "conv_id long, turn long, role string, text string, key string"


@pytest.mark.parametrize("heavy, most", [(None, 100_000), (3, 2), (1, 1)])
def test_trie_is_that_of_all_prefixes(spark, heavy, most):
    r = random.Random(8)
    turns = []
    for c in [*range(120), 1000, 1019, 1020]:
        for t in range(r.choice([0, 1, 2, 3, 4, 8])):
            turns.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hello there", "go on", "", None, f"only in {c} {t}"]), "x"))
    turns += [(7, 3, "user", "again", "x"), (7, 3, "user", "again", "x"), (8, None, "user", "no number", "x"), (None, 0, "user", "lost", "x")]
    turns += [(200, t, "user", f"turn {t}", "x") for t in range(40)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(turns, TURNS).repartition(4), heavy=heavy, most=most)
    assert {tuple(x) for x in found.collect()} == tries([x[:4] for x in turns])


def test_trie_edges(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(none).count() == 0
    one = spark.createDataFrame([(41, 0, "user", "only", "x")], TURNS)  # starts with turns of conversation 40, which isn't there
    assert {tuple(x) for x in prefix_trie.prefix_trie(one.withColumn("depth", F.lit("clash"))).collect()} == tries([(41, 0, "user", "only")])


def test_queue_sums_over_its_runs():
    r, queue, want = random.Random(1), prefix_trie.SpillingQueue(3), Counter()
    for _ in range(500):
        key = (-1, bytes([r.randrange(40)]))
        queue.add(key, 1, 2)
        want[key] += 1
    assert len(queue.runs) > 5
    for key in sorted({*want, (-1, b"zz")}):
        assert queue.take(key) == (want[key], 2 * want[key])
    assert not queue.runs and not queue.sums


@pytest.mark.parametrize("n", [800, 8000])
def test_line_links_do_not_fall_with_size(spark, n):
    """Lines of few common words, so that every run of two words is in many lines."""
    r = random.Random(n)
    common = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(5, 7))) for _ in range(25)]
    lines = []
    for _ in range(n // 2):
        words = [r.choice(common) for _ in range(r.randint(9, 15))]
        lines += [" ".join(words), " ".join([r.choice(common), *words[1:]])]  # one word of at most seven letters of nine or more: within a fifth
    found = {g["id"]: g["root"] for g in line_dedup.line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), Scratch(spark, "test")).collect()}
    assert sum(found[k] == found[k + 1] for k in range(0, n, 2)) >= 0.95 * (n // 2)


def test_near_copies_just_over_the_threshold_go(spark):
    """Pairs of five-word similarity 0.80 to 0.85 are found, those of 0.72 to 0.80 stay."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9)))
    docs, over, under = [], [], []
    while len(over) < 150 or len(under) < 50:
        w = [word() for _ in range(r.randint(40, 300))]
        copy = list(w)
        for k in r.sample(range(len(w)), max(1, len(w) // r.choice([42, 44, 46, 48, 50, 52, 54]))):
            copy[k] = word()
        a, b = shingle_set(" ".join(w)), shingle_set(" ".join(copy))
        alike = len(a & b) / len(a | b)
        if 0.8 <= alike < 0.85 and len(over) < 150 or 0.72 <= alike < 0.8 and len(under) < 50:
            (over if alike >= 0.8 else under).append(len(docs) + 1)
            docs += [(len(docs), " ".join(w)), (len(docs) + 1, " ".join(copy))]
    kept = {x["doc_id"] for x in simhash_dedup.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5, sketch=8).collect()}
    assert sum(k not in kept for k in over) >= 0.97 * len(over)
    assert kept >= set(under) and kept >= set(range(0, len(docs), 2))


def test_near_fingerprints_are_one_group(spark):
    """The pipeline's near-dedup links all that fingerprints within 3 bits link, also texts whose least shingles differ."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9)))
    docs = []
    for k in range(40):
        often = " ".join(word() for _ in range(40))
        docs += [(2 * k + i, " ".join([*[often] * 40, *[word() for _ in range(120)]])) for i in (0, 1)]
    docs = spark.createDataFrame([*docs, (900, None), (901, " "), (902, "")], "doc_id long, text string")
    near = {x["id"] for x in simhash_dedup.near_duplicates(docs, shingle=5).where("id <> component_id").collect()}
    assert len(near) > 10 and near >= {901, 902}
    kept = {x["doc_id"] for x in simhash_dedup.keep_one(docs, shingle=5, sketch=8).collect()}
    assert not near & kept and kept >= set(range(0, 80, 2)) | {900}

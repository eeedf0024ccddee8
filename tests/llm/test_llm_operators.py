"""Each operator against brute force on small tables, and on nulls, empty and repeated rows, clashing columns and no rows."""

import gzip
import hashlib
import itertools
import math
import random
import re
import textwrap
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scrimlake.llm import decontamination, html_extraction, license_scan, line_dedup, packing, quality_rules, simhash_dedup, substring_dedup, token_counts, warc_zip
from scrimlake.llm.common import Scratch
from scrimlake.llm.components import connected_components

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACES = " \t\n\x0b\f\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghilmnorstué") for _ in range(r.randint(2, 9))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k)).capitalize() + "."
    shared = [sentence(70), sentence(55), sentence(20)]
    docs = []
    for k in range(n):
        text = "\n".join(sentence(r.randint(3, 40)) for _ in range(r.randint(1, 5)))
        if k % 5 == 0:
            text += "\n" + r.choice(shared)
        if k % 7 == 3 and docs:
            text = docs[r.randrange(len(docs))][1]
        if k % 7 == 5 and docs:
            ws = docs[r.randrange(len(docs))][1].split(" ")
            ws[r.randrange(len(ws))] = "changed"
            text = " ".join(ws)
        docs.append((k, text))
    return docs


EDGES = [(1, None), (2, ""), (3, " \n\t\n"), (None, "A text without an id, but with words. And more of them."), (5, "Twice the same row stands here."), (5, "Twice the same row stands here."), (6, "中文 texts é — and 😀 signs!\nLine two | menu | more"), (7, "word " * 30_000)]
CLASH = "h string, w string, fp string, key string, n string, line string, at string, tk string, path string, starts string, host string, id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string")


@pytest.fixture(scope="module")
def edges(spark):
    names = [c.split()[0] for c in CLASH.split(", ")]
    return spark.createDataFrame([(*e, *names) for e in EDGES], f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASH}")


def benchmark(spark, rows=((1, corpus()[0][1]), (2, None), (3, ""), (4, "one two"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "quality": lambda s, d: quality_rules.judge(d),
    "repeats": lambda s, d: substring_dedup.remove_repeats(d),
    "licenses": lambda s, d: license_scan.scan(license_scan.document_files(d.withColumn("source", d["path"])), "path"),
    "tokens": lambda s, d: token_counts.token_counts(d, PIECES),
    "html": lambda s, d: html_extraction.main_text(d, "doc_id", "host", "text"),
    "warc": lambda s, d: warc_zip.round_trip(d, id_col="doc_id", url_col="host", html_col="text"),
    "lines": lambda s, d: line_dedup.dedup_lines(d.withColumns({"n_lines": d["n"], "removed_lines": d["n"], "_id": d["n"]})),
    "packing": lambda s, d: packing.pack(d, BPE),
    "simhash": lambda s, d: simhash_dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, edges, name):
    rows = OPERATORS[name](spark, edges).collect()
    if name == "packing":
        assert len({(r["id"], r["doc_tokens"]) for r in rows}) == 7 and sum(r["length"] for r in rows if r["id"] == 5) == 2 * next(r["doc_tokens"] for r in rows if r["id"] == 5)
    else:
        assert len(rows) == len(EDGES)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, nothing, name):
    assert OPERATORS[name](spark, nothing).count() == 0


def test_decontamination_edges(spark, edges, nothing):
    assert decontamination.contaminated(edges, benchmark(spark)).count() == 0
    assert decontamination.contaminated(nothing, benchmark(spark)).count() == 0
    assert decontamination.contaminated(edges, benchmark(spark, [])).count() == 0
    assert decontamination.decontaminate(edges, benchmark(spark, [(9, EDGES[4][1])])).count() == len(EDGES) - 2


def test_quality_counts(docs):
    texts = dict(corpus())
    for r in quality_rules.judge(docs).collect():
        ws, lines = words_of(texts[r["id"]]), [x for x in texts[r["id"]].split("\n") if words_of(x)]
        windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(ws) < 10 or 100 * len(covered) > 20 * len(ws)) and not (r["kept"] and r["base_failed"])


def test_quality_rules_reject_menus_and_symbols(spark):
    prose = "This is a whole sentence of some length, as people write them.\nAnother one follows it here."
    rows = [(1, prose), (2, "home | news | sport | more | login | help | about us |\n" * 4), (3, " ".join(f"word{k}###" for k in range(30))), (4, prose + "\nAll rights reserved.")]
    found = {r["id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k]["kept"] for k in (1, 2, 3, 4)] == [True, False, False, True]
    assert found[4]["cleaned_text"] == prose and found[1]["cleaned_text"] == prose


@pytest.mark.parametrize("window,cells", [(50, 1 << 29), (8, 1 << 21)])
def test_repeats(docs, window, cells):
    texts = {k: words_of(t) for k, t in corpus()}
    first = {}
    for k in sorted(texts):
        for i in range(len(texts[k]) - window + 1):
            first.setdefault(tuple(texts[k][i : i + window]), k)
    gone = 0
    for r in substring_dedup.remove_repeats(docs, window=window, max_cells=cells).collect():
        ws = texts[r["id"]]
        off = {i + j for i in range(len(ws) - window + 1) if first[tuple(ws[i : i + window])] < r["id"] for j in range(window)}
        kept = " ".join(w for i, w in enumerate(ws) if i not in off)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) == (len(ws), len(off), hashlib.sha256(kept.encode()).hexdigest(), kept)
        gone += len(off)
    assert gone


def test_sketch_packing():
    r = random.Random(3)
    cells = np.sort(np.array([r.randrange(1 << 21) for _ in range(500)] + [5, 5, 700_000, 700_000]))
    assert (substring_dedup._unpack(substring_dedup._pack(cells)) == cells).all()


def test_a_phrase_that_many_unlike_lines_hold_is_left_to_their_other_runs(spark, monkeypatch):
    """The phrase's words have the least hashes, so that its run is the first of all lines."""
    r, met = random.Random(7), []
    vocabulary = sorted({"".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(3000)}, key=lambda w: xxhash.xxh64_intdigest(w, 42) & ~(1 << 63))
    phrase, rest = vocabulary[:3], vocabulary[3:]
    lines = [r.sample(rest, 20) + phrase + r.sample(rest, 20) for _ in range(200)]
    lines += [[r.choice(rest) if k in (2, 17, 30, 38) else w for k, w in enumerate(line)] for line in lines[:20]]
    likely = line_dedup._likely
    monkeypatch.setattr(line_dedup, "_likely", lambda pairs, *more: met.append(pairs.count()) or likely(pairs, *more))
    found = {g["id"]: g["root"] for g in line_dedup.line_groups(spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string"), Scratch(spark, "test")).collect()}
    assert all(found[k] == found[200 + k] for k in range(20)) and len(set(found.values())) == 200 and met[-1] < 2000


def test_simhash_broadcasts_no_exploded_table(spark):
    """Of 2,000 fingerprints Spark takes the balls around all segments, 34 rows for each, for small enough to broadcast."""
    scratch = Scratch(spark, "test")
    fps = scratch.save(spark.range(2000).select(F.xxhash64("id").alias("fp")), "fps")
    plan = simhash_dedup.hamming_links(fps, scratch)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    held = [k for k, line in enumerate(plan) if "BroadcastExchange" in line]
    below = lambda k: itertools.takewhile(lambda line: depth(line) > depth(plan[k]), plan[k + 1 :])
    assert any("Generate" in line for line in plan) and not any("Generate" in line for k in held for line in below(k))


def test_simhash_components(docs):
    def fingerprint(text):
        ws = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {k: fingerprint(t) for k, t in corpus()}
    root = {k: k for k in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    for hot in (256, 1):
        found = {r["id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash_dedup.near_duplicates(docs, hot_bucket=hot).collect()}
        assert found == {k: (fps[k], root[k]) for k in fps}
    assert len(set(root.values())) < len(root)


def test_keep_one_judges_each_text(spark):
    rows = [(1, "the first text of them all"), (5, "the first text of them all"), (5, "another text with other words in it"), (7, None), (8, " "), (None, "the first text of them all")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, id string, tk string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash_dedup.keep_one(docs).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)


def test_keep_one_finds_near_copies(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9)))
    texts, near = [], 0
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for _ in range(60):
        w = [word() for _ in range(r.randint(80, 400))]
        copy = list(w)
        for k in r.sample(range(len(w)), max(1, len(w) // 100)):
            copy[k] = word()
        texts += [w, copy]
        near += len(grams(w) & grams(copy)) >= 0.8 * len(grams(w) | grams(copy))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    kept = {x["doc_id"] for x in simhash_dedup.keep_one(docs, shingle=5, sketch=8).collect()}
    assert kept >= set(range(0, 120, 2)) and near > 50 and 120 - len(kept) >= 0.9 * near


def test_majority_bits_of_long_groups():
    r = np.random.default_rng(1)
    groups = [r.integers(0, 1 << 63, n, np.uint64) for n in (1, 0, 2, 254, 255, 256, 1000)]
    found = simhash_dedup.majority_bits(np.concatenate(groups), np.array([len(g) for g in groups]))
    for g, f in zip(groups, found):
        assert int(f) == sum(1 << b for b in range(64) if 2 * int((g >> np.uint64(b) & np.uint64(1)).sum()) > len(g))


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (202, 202)]
    found = connected_components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test"))
    assert dict(found.collect()) == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b), 1)


def test_line_dedup(spark):
    base = "the quick brown foxes jumped happily over several lazy sleeping dogs yesterday evening near old river banks"
    variants = [base.replace("happily", w) for w in ("gladly", "happily", "merrily", "bravely")]
    rows = [(k, f"{v.upper()}!\nsome other line number{'x' * k} of many words entirely different here {k}\nshort one") for k, v in enumerate(variants)]
    rows += [(10, base + "."), (11, None)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["removed_lines"] == [] and out[10]["removed_lines"] == [0] and out[10]["text"] == "" and out[11]["text"] is None
    assert out[0]["text"].endswith("short one") and all(out[k]["removed_lines"][-1] == 2 for k in (1, 2, 3))  # equal short lines are grouped too


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edits_and_starts_by_all_pairs(spark):
    """Edits are at least the distance and none are found only if it is too high; starts never rule out a pair within the bound."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 6)))
    rows = [("is ntes thwhesnd esator whshing and hewh", "shou of aned thwhesnd esator whshing and hewh"), ("some words that stay here", "some words that we stay here"), ("a b c d e", "b c d e"), ("one two", "one two three")]
    for _ in range(400):
        x = [word() for _ in range(r.randint(5, 14))]
        y = list(x)
        for _ in range(r.randint(1, 5)):
            k = r.randrange(len(y))
            y[k : k + r.randint(0, 2)] = [word() for _ in range(r.randint(0, 2))]
        y = [*y, word()] if len(y) < 2 else y
        rows.append((" ".join(x), " ".join(y)))
    rows = [(2 * k, 2 * k + 1, x, y, int(0.2 * max(len(x), len(y)) + 1e-9)) for k, (x, y) in enumerate(rows) if x != y]
    true = {a: distance(x, y) for a, _, x, y, _ in rows}
    pairs = spark.createDataFrame(rows, "a long, b long, x string, y string, most int")
    found = {f["a"]: f["edits"] for f in line_dedup.edits(pairs, "x", "y").collect()}
    for a, _, _, _, most in rows:
        assert true[a] <= found[a] <= most if true[a] <= most else found[a] == -1, a
    texts = spark.createDataFrame([t for a, b, x, y, _ in rows for t in ((a, x), (b, y))], "key long, norm string")
    left = {p["a"] for p in line_dedup.starts_allow(pairs, texts, 0.8).collect()}
    assert left >= {a for a, _, _, _, most in rows if true[a] <= most} and len(left) < len(rows)


def all_pairs_root(lines, threshold=0.8):
    """Groups by the definition alone: lines of edit similarity of at least the threshold, and what they are linked to."""
    root = list(range(len(lines)))
    for _ in range(4):
        for a in range(len(lines)):
            for b in range(a):
                if root[a] != root[b] and abs(len(lines[a]) - len(lines[b])) <= 0.2 * max(len(lines[a]), len(lines[b])) and similarity(lines[a], lines[b]) >= threshold - 1e-9:
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_line_groups_are_those_of_all_pairs(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(300)]
    lines = []
    for _ in range(25):
        words = [r.choice(vocabulary) for _ in range(r.randint(6, 25))]
        for _ in range(r.randint(1, 6)):
            copy = list(words)
            for _ in range(r.randint(0, max(1, len(copy) // 8))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            lines.append(" ".join(copy))
    found = {g["id"]: g["root"] for g in line_dedup.line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), Scratch(spark, "test")).collect()}
    root = all_pairs_root(lines)
    assert all(root[a] == root[b] for a in found for b in found if found[a] == found[b])
    linked = [(a, b) for a in range(len(lines)) for b in range(a) if root[a] == root[b]]
    assert len(linked) > 60 and sum(found[a] == found[b] for a, b in linked) >= 0.98 * len(linked)


def test_line_groups_of_set_phrases(spark):
    """A run that very many unlike lines share: near lines among them meet by their other runs."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(4, 8)))
    lines = []
    for _ in range(150):
        tail = [word() for _ in range(14)]
        lines += [" ".join(["please", "accept", "all", "cookies", *tail]), " ".join(["please", "accept", "all", "cookies", *tail[:7], word(), *tail[8:]])]
    found = {g["id"]: g["root"] for g in line_dedup.line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), Scratch(spark, "test")).collect()}
    assert sum(found[k] == found[k + 1] for k in range(0, 300, 2)) >= 148 and len(set(found.values())) >= 150


def test_line_groups_find_changed_words(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(5, 8)))
    texts = []
    for size, changed in ((5, 1), (10, 1), (12, 2), (20, 2), (40, 1), (60, 6), (60, 10)) * 12:
        words = [word() for _ in range(size)]
        copy = list(words)
        for k in r.sample(range(size), changed):
            copy[k] = copy[k][:2] + word()[:3] + copy[k][5:] if size > 5 else copy[k][:-1] + "zz"
        texts += [" ".join(words), " ".join(copy)]
    groups = line_dedup.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "test"))
    root = {g["id"]: g["root"] for g in groups.collect()}
    alike = [k for k in range(0, len(texts), 2) if similarity(texts[k], texts[k + 1]) >= 0.8]
    assert len(alike) == len(texts) // 2 and all(root[k] == root[k + 1] for k in alike) and len(set(root.values())) == len(alike)


def test_short_lines(spark):
    han = "这是一个没有空格的很长的句子它应该被当作重复的行来处理才对呢好"
    texts = ["All rights reserved.\n\n***\n12.5 %", "all rights reserved\n \n***\n12.6 %", han, han.replace("长", "短"), "\u00a0\nown", "\u00a0\nother"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r["doc_id"]: r["removed_lines"] for r in line_dedup.dedup_lines(docs).collect()}
    assert gone == {0: [], 1: [0, 2], 2: [], 3: [0], 4: [], 5: []}


def test_leaks(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {k: text(r.randint(15, 57)) for k in range(8)} | {8: text(3)}
    docs = {}
    for k in range(40):
        ws = text(r.randint(30, 200))
        if k % 3 == 0:
            item = list(items[r.randrange(9)])
            if k % 2 and len(item) > 40:
                item[0] = "other"
            at = r.randrange(len(ws))
            ws[at:at] = [w.upper() + "," for w in item]
        docs[k] = " ".join(ws)
    expected = {}
    for d, t in docs.items():
        ws = [w.strip(",").lower() for w in t.split()]
        for i, item in items.items():
            width = min(5, len(item))
            grams = lambda x: [tuple(x[j : j + width]) for j in range(len(x) - width + 1)]  # noqa: E731, B023
            best = max((decontamination.weighted_jaccard(grams(ws[p : p + len(item)]), grams(item)) for p in range(len(ws) - len(item) + 1)), default=0)
            if best >= 0.8:
                expected[d, i] = round(best, 6)
    found = decontamination.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string"))
    assert {(x["id"], x["item"]): round(x["similarity"], 6) for x in found.collect()} == expected and len(expected) > 8


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer, texts = Tokenizer.from_file(BPE), dict(corpus())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, BPE, capacity=256, group_rows=20).collect():
        pieces[r["id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for k, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces[k], key=lambda p: p["start"]):
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += p["length"]
        assert at == len(ids)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256


def test_new_runs_are_encoded_together():
    """The ids are those of whole texts, and many new runs are one text for the tokenizer."""
    r = random.Random(9)
    odd = ["a ", "b", "  ", " ", "\n", "\n\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "<|endoftext|>", "'s", "12", "\u0120", "!", "é", "\u200b", "\x00"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    texts += [" ".join(f"run{r.randrange(10**6)}" for _ in range(100)) for _ in range(20)]
    known, texts_met = packing.UnitIds(BPE), []

    class Counting:
        def __getattr__(self, name, tokenizer=known.tokenizer):
            return lambda batch, **kw: (texts_met.extend(batch), getattr(tokenizer, name)(batch, **kw))[1]

    plain, known.tokenizer = known.tokenizer, Counting()
    cut = [packing.units(t) for t in texts]
    assert [" ".join(us) for us in cut] == texts
    known.learn(cut[:1500])
    del texts_met[:]
    known.learn(cut[1500:])
    assert len(texts_met) < 200
    for t, us in zip(texts, cut):
        assert known.ids(us) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_closest_fill_is_the_best_sum():
    r = random.Random(2)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 5))}
        capacity, sums = r.randint(1, 60), {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        fill = packing.closest_fill(counts, capacity)
        assert sum(a * b for a, b in fill.items()) == max(s for s in sums if s <= capacity) and all(fill[a] <= counts[a] for a in fill)


def test_units_encode_as_the_whole_text():
    from tokenizers import Tokenizer

    tokenizer, r = Tokenizer.from_file(BPE), random.Random(4)
    known = packing.UnitIds(BPE)
    for _ in range(500):
        text = "".join(r.choice(" \n\t ab'sé1.,   中😀") for _ in range(r.randint(0, 30)))
        us = packing.units(text)
        known.learn([us])
        assert " ".join(us) == text and known.ids(us) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_units_of_mixed_white_space():
    from tokenizers import Tokenizer

    tokenizer, r = Tokenizer.from_file(BPE), random.Random(6)
    known = packing.UnitIds(BPE)
    texts = ["a \u00a0 \u00a0 b"] + ["".join(r.choice(" \u00a0\u3000\u2003\u0085\x1c\x1f\t\n\rab1,") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for text in texts:
        us = packing.units(text)
        known.learn([us])
        assert " ".join(us) == text and known.ids(us) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_counts(docs):
    scores = token_counts.unigram(PIECES)
    byte = min(scores.values()) - 5.0

    def count(word):
        text = token_counts.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            size = len(text[end - 1].encode())
            options = [(best[end - 1][0] + size * byte, best[end - 1][1] - size)]
            options += [(best[s][0] + scores[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    texts = dict(corpus())
    for r in token_counts.token_counts(docs, PIECES).collect():
        ws = words_of(texts[r["id"]])
        assert (r["n_words"], r["n_tokens"]) == (len(ws), sum(map(count, ws)))


def test_main_text():
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><div class="cookie-notice">We use cookies.</div><header><h1>Site</h1></header>
    <nav><a href="/">Home</a></nav><div class="sidebar"><p>Side stuff, and more of it.</p></div><div class="post-content"><h2>Title &amp; more</h2><p>First para, with <a href="x">a link</a>
    inside. It goes on, and on.</p><!-- <p>hidden</p> --><ul><li>one<li>two</ul><p>Second&nbsp;para.<form><input><label>Mail</label></form></p></div>
    <div class="comments"><p>Nice post! I like it, a lot. Really, I do like it a lot.</p></div><footer>c</footer></body></html>"""
    assert html_extraction.Page(page).extract(None) == "Title & more First para, with a link inside. It goes on, and on. one two Second para."
    assert html_extraction.Page("").extract(None) == "" and html_extraction.Page("just text &lt;").extract("/x") == "just text <"


def test_whole_article_and_exact_attributes():
    body = "<div class='article-body'><p>" + "A long story, told in full. " * 20 + "</p></div>"
    page = html_extraction.Page(f"<body><main><article><h1>Title</h1><p class=lead>The lead, in short.</p>{body}<p>The end, at last.</p></article></main></body>")
    path = page.containers[-1][0]
    for text in (page.extract(None), page.extract(path)):
        assert text.startswith("Title The lead, in short. A long") and text.endswith("The end, at last.")
    page = "<body><div data-role='nav' href='/wiki/hidden' title='a class=menu x'><p>Shown text, with words.</p></div></body>"
    assert html_extraction.Page(page).extract(None) == "Shown text, with words."
    assert html_extraction.Page("<body><div CLASS = menu><p>Not this.</p></div><p hidden>Nor this.</p><p>This.</p></body>").extract(None) == "This."


def test_nothing_of_an_article_is_lost():
    read = lambda body: html_extraction.Page(f"<html><body>{body}</body></html>").extract(None)
    long = "<p>" + "A long story, told in full. " * 12 + "</p>"
    assert read(f"<article><div class=post-content>{long}</div><p>BBB tail para.</p></article>").endswith("BBB tail para.")
    assert read(f"<article>{long}</article><article><p>The second one.</p></article>").endswith("The second one.")
    assert read(f"<div><div>{long}</div><div><p>Short end, too.</p></div></div>").endswith("Short end, too.")
    assert read(f"<article><div class='article-header'><h1>Big title</h1></div>{long}</article>").startswith("Big title A long")
    assert read(f"<article><p class='side'>From the side.</p>{long}</article>").startswith("From the side. A long")
    assert "BUY" not in read(f"<article>{long}<p>So <span class='ad'>BUY NOW</span> it ends.</p></article>")
    assert read(f"<div class=header><p>Site, name.</p></div><article>{long}<div class=comments><p>No!</p></div></article>").rstrip().endswith("in full.")


def test_odd_urls(spark):
    urls = ["http://a.example/x\u2028y", "http://a.example/a\nb", "a\u0085b", "c\r\n\r\nd: e", "", None, "http://é.example/ {z} 19700101000000 {"]
    rows = [(k, u, "<p>" + "x" * 200) for k, u in enumerate(urls)]
    found = {r["page_id"]: r for r in warc_zip.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in found.items()} == {0: ("response", None)} | {k: ("revisit", 0) for k in range(1, 7)}
    assert all(r["payload_bytes"] == 203 for r in found.values())


def test_host_consensus(spark):
    good = '<body><div class="story-{0}"><p>{1}</p></div><div class="box"><p>Short, one.</p></div></body>'
    odd = '<body><div class="story-9"><p>A brief, but true, story of the day.</p></div><div class="box"><p>Long box, with words, and words, yes.</p></div></body>'
    pages = [(k, f"http://www.a.example/{k}", good.format(k, "A long story, told in full. " * 5)) for k in range(4)] + [(9, "http://a.example/9", odd), (10, None, None)]
    found = {r["page_id"]: r["text"] for r in html_extraction.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[9] == "A brief, but true, story of the day." and found[10] == "" and found[0].startswith("A long story")


def test_zip64_packages(tmp_path):
    for zip64 in (False, True):
        path = tmp_path / f"{zip64}.zip"
        with path.open("wb") as f:
            z = warc_zip.StoredZip(f, zip64)
            for name, data in (("a.txt", b"alpha"), ("dir/b.bin", bytes(range(256)) * 9)):
                z.begin(name)
                z.write(data[:3])
                z.write(data[3:])
                z.end()
            z.close()
        raw = path.read_bytes()
        found = warc_zip.central_directory(lambda at, n: raw[at : at + n], len(raw))
        assert {k: raw[a : a + n] for k, (a, n) in found.items()} == {"a.txt": b"alpha", "dir/b.bin": bytes(range(256)) * 9}
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.read("a.txt") == b"alpha"
    foreign = tmp_path / "foreign.zip"
    with zipfile.ZipFile(foreign, "w") as z:
        z.writestr("x", b"stored here")
        z.writestr(zipfile.ZipInfo("packed"), gzip.compress(b"y"), zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    raw = foreign.read_bytes()
    at, n = warc_zip.central_directory(lambda at, n: raw[at : at + n], len(raw))["x"]
    assert raw[at : at + n] == b"stored here"


def test_licenses(spark):
    rows = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/b/code.py", "nothing here"), ("r/a/own.py", "text\nLicensed under the Apache License, Version 2.0.\nmore"),
        ("r/x/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("r/x/y/z.py", ""), ("s/free.py", "plain"), (None, "plain"),
    ]
    found = {r["path"]: (r["license"], r["origin"], r["from_folder"]) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {
        "r/LICENSE": ("MIT", "own", None), "r/a/b/code.py": ("MIT", "inherited", "r"), "r/a/own.py": ("Apache-2.0", "own", None), "r/x/LICENSE": ("GPL-3.0", "own", None),
        "r/x/y/z.py": ("GPL-3.0", "inherited", "r/x"), "s/free.py": (None, "none", None), None: (None, "none", None),
    }


def test_licenses_are_those_of_plain_cosines(spark):
    """Headers, idf, cosines and the nearest folder by definition, in plain Python; wrapped and buried notices, ties, repeats."""
    cue = re.compile(license_scan.CUE, re.ASCII)
    named = re.compile(license_scan.LICENCE_NAME, re.ASCII)
    one = lambda s: re.sub(r"\s+", " ", s, flags=re.ASCII).strip(" ")
    rng = random.Random(3)
    filler = ["the", "river", "of", "copyrights", "software", "is", "General", "Public", "stone", "under", "license", "version", "3"]
    line = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    wordings = [w for _, w in license_scan.TEMPLATES]
    wrapped = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0.\n" + line(9)
    buried = f"{line(150)}. Licensed under the Apache License, Version 2.0. {line(150).capitalize()}."
    rows = [("a/LICENSE", textwrap.fill(wordings[1], 60)), ("a/b/wrapped.py", wrapped), ("a/b/c/buried.txt", buried), ("a/b/c/d/plain.txt", "nothing"), ("a/tie", "license license"), ("a/x", None), (None, wordings[0])]
    rows += [("e/COPYING", textwrap.fill(wordings[12], 70)), ("e/f/g.c", ""), ("e/f/g.c", ""), ("e/LICENSE.txt", wordings[2]), ("top.txt", wordings[5]), ("LICENSE", wordings[8])]
    for k in range(60):
        body = [rng.choice([line(rng.randint(0, 9)), rng.choice(wordings)[: rng.randint(10, 200)]]) for _ in range(rng.randint(0, 6))]
        folder = "/".join(rng.choice("mnop") for _ in range(rng.randint(0, 4)))
        rows.append((f"{folder}/{rng.choice(['LICENSE', 'file'])}{k}".lstrip("/"), "\n".join(body)))

    def headers(path, text):
        lines, out = text.split("\n"), set()
        for i, x in enumerate(lines):
            if cue.search(x):
                near = one(" ".join(lines[max(0, i - 1) : i + 2]))
                out |= {s for part in (one(x), near) for s in re.split(license_scan.SENTENCE_END, part) if cue.search(s)}
        return (out | ({one(text)} if named.search(path or "") else set())) - {""}

    def vector(text):
        w = [x for x in re.split("[^a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)})) if x]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    of = [(p, h) for p, t in rows if t is not None for h in headers(p, t)]
    df = Counter(term for _, h in of for term in vector(h)) + Counter(term for w in wordings for term in vector(w))
    total = len(of) + len(wordings)
    weigh = lambda text: {k: n * (math.log((1 + total) / (1 + df[k])) + 1) for k, n in vector(text).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    marks, own = [(i, weigh(w)) for i, w in license_scan.TEMPLATES], {}
    for path, header in of:
        v = weigh(header)
        for i, w in marks:
            s = round(sum(x * w.get(k, 0) for k, x in v.items()) / (norm(v) * norm(w)), 6) if v else 0
            if path is not None and s >= license_scan.THRESHOLD:
                own[path] = min(own.get(path, (0, "~")), (-s, i))
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    granted = {}
    for path, b in own.items():
        if named.search(path):
            granted[folder(path)] = min(granted.get(folder(path), (0, "~")), b)

    def expected(path):
        if path in own:
            return own[path][1], "own", None, -own[path][0]
        up = [g for g in granted if path is not None and (g in ("", folder(path)) or folder(path).startswith(g + "/"))]
        g = max(up, key=len, default=None)
        return (granted[g][1], "inherited", g, None) if up else (None, "none", None, None)

    found = license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted(str(r["path"]) for r in found) == sorted(str(p) for p, _ in rows)
    for r in found:
        want = expected(r["path"])
        assert (r["license"], r["origin"], r["from_folder"]) == want[:3], r
        assert r["similarity"] is None if want[3] is None else abs(r["similarity"] - want[3]) < 2e-6
    by = {r["path"]: r["license"] for r in found}
    assert (by["a/LICENSE"], by["a/b/wrapped.py"], by["a/b/c/buried.txt"], by["a/b/c/d/plain.txt"], by["e/f/g.c"]) == ("MIT", "MPL-2.0", "Apache-2.0", "MIT", by["e/LICENSE.txt"])


def test_pipeline_stages(spark, tmp_path):
    """Every stage on what the one before it gave, against what it is to do by definition."""
    from tokenizers import Tokenizer

    rows = corpus(7, 40)
    rows = [(k, t, "en", "s", len(t)) for k, t in rows] + [(90, None, None, None, None), (91, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    item = max((t for _, t, *_ in rows if t), key=len).split("\n")[0]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
    raw, quality, lined, single, clean = texts

    judged = {r["id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, docs_schema())).collect()}
    for d, t in raw.items():
        ws = words_of(t)
        windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
        assert not (failed and d in quality) and judged[d]["kept"] == (d in quality)
    assert all(set(t.split("\n")) <= set(raw[d].split("\n")) for d, t in quality.items())

    form = lambda x: " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in x.lower()).split())
    places = [(d, i, x) for d in sorted(quality) for i, x in enumerate(quality[d].split("\n")) if x.strip()]
    root = all_pairs_root([form(x) for _, _, x in places])
    first = {g: min(k for k in range(len(root)) if root[k] == g) for g in set(root)}
    kept = {}
    for k, (d, i, x) in enumerate(places):
        kept.setdefault(d, []).extend([x] * (first[root[k]] == k))
    assert lined == {d: "\n".join(x) for d, x in kept.items() if x}

    grams = lambda t: Counter(tuple(w[i : i + 5]) for w in [words_of(t.lower())] for i in range(max(1, len(w) - 4)))
    like = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values())
    assert set(single) == {d for d in lined if not any(e < d and like(grams(lined[e]), grams(lined[d])) for e in lined)}

    width = len(words_of(item))
    leak = lambda t: any(decontamination.weighted_jaccard(list(grams(" ".join(words_of(t)[p : p + width])).elements()), list(grams(item).elements())) >= 0.8 for p in range(max(1, len(words_of(t)) - width + 1)))
    assert set(clean) == {d for d, t in single.items() if not leak(t)} and len(clean) < len(single)

    tokenizer, n = Tokenizer.from_file(BPE), Counter()
    for r in docs.collect():
        n[r["doc_id"]] += r["length"]
    assert n == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"

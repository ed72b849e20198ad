"""Hard negatives, license scan and ranked search against brute-force versions, and on awkward input."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import epilens.llm.lexical as lexical_module
import epilens.llm.negatives as negatives_module
from epilens.llm.lexical import LexicalIndex, ranked_search
from epilens.llm.licenses import RULES, Rule, find_licenses, license_digest, rules_of, suppress
from epilens.llm.negatives import Pivots, hard_negatives, scaled
from epilens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
# Columns with names that the operators use inside.
EXTRA = "row_key string, v string, d int, block int, place int, want int, item int, score int, rank int, term string, docs int, matches int, names int, m map<string,int>"
SPARE = ("r", "v", 1, 2, 3, 4, 5, 6, 7, "t", 8, 9, 10, {"a": 1})


def documents(spark, texts):
    return spark.createDataFrame([(i, t, *SPARE) for i, t in texts], f"doc_id long, text string, {EXTRA}")


# 11 --------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, *SPARE) for i, label, v in rows], f"vec_id long, label int, embedding array<double>, {EXTRA}")


def brute_negatives(rows, every=50, n_pos=5, n_neg=3, low=50, high=95):
    """Rows of the result, from all pairs; rows stay apart by their place."""
    use = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for a, (i, label, v) in enumerate(use):
        if i is None or i % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), j, k) for k, (j, _, w) in enumerate(use) if k != a]
        order = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for score, j, _ in [s for s in order if use[s[2]][1] == label][:n_pos]:
            inside = [s for s in order if use[s[2]][1] != label and low * score <= 100 * s[0] <= high * score]
            found += [(i, j, n + 1, s[1], score, s[0]) for n, s in enumerate(inside[:n_neg])]
    return Counter(found)


def result_of(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("clusters", [0, 6])
def test_negatives(spark, monkeypatch, clusters):
    """Small blocks, so that blocks and rows drop out; copies, ties and repeated ids stay whole."""
    monkeypatch.setattr(negatives_module, "ANCHOR_BLOCK", 100)
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(max(1, clusters), 6)) * (1 if clusters else 0)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in centres[i % max(1, clusters)] + 0.3 * rng.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, i % 4, rows[3][2]) for i in range(40)] + [(50, 1, rows[7][2]), (50, 1, rows[7][2]), (None, 2, rows[9][2]), (None, 1, rows[9][2])]
    rows += [(450, 1, [0.0] * 6), (500, 2, []), (501, 2, [1.0]), (550, None, [1.0] * 6), (600, 1, None), (601, 1, [1.0, None]), (602, 1, [float("nan")] * 6), (603, 1, [float("inf")] * 6)]
    want = brute_negatives(rows)
    assert len(want) > 50 and result_of(hard_negatives(spark, vectors(spark, rows), pivots=4)) == want


def test_brackets_hold_scores():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, size=(60, 5))
    p = Pivots(x[:30], float((x * x).sum(axis=1).max()), 4)
    q = np.column_stack([x[:10].astype(float), np.zeros(10)])
    d, e = p.distances(q)[:, None, :], p.distances(p.lifted(x))[None, :, :]
    low, high = negatives_module._brackets(np.abs(d - e).max(axis=2), (d + e).min(axis=2), ((x[:10] ** 2).sum(axis=1) + p.largest)[:, None], 1e-6)
    assert ((low <= x[:10] @ x.T) & (x[:10] @ x.T <= high)).all() and p.points.shape == (4, 6)


def test_pivots_drop_rows(spark, monkeypatch):
    """Where vectors lie in clusters, most blocks drop out without an exact score."""
    seen = []
    rng = np.random.default_rng(2)
    x = np.floor(256 * (np.eye(8)[np.arange(4000) % 8] + 0.02 * rng.normal(size=(4000, 8)))).astype(np.int64)
    x = x[np.argsort(np.arange(4000) % 8, kind="stable")]
    p = Pivots(x[::40], float((x * x).sum(axis=1).max()), 8)
    e, q = p.distances(p.lifted(x)), np.column_stack([x[:1].astype(float), [[0.0]]])
    d = p.distances(q)
    for s in range(0, 4000, 100):
        low, high = e[s : s + 100].min(axis=0), e[s : s + 100].max(axis=0)
        near = np.maximum(0, np.maximum(d - high, low - d)).max(axis=1)
        seen.append(negatives_module._brackets(near, np.inf, (x[:1] ** 2).sum(axis=1) + p.largest, 1)[1][0] >= np.sort(x @ x[0])[-6])
    assert sum(seen) <= 8


def test_negatives_of_nothing(spark):
    assert hard_negatives(spark, vectors(spark, [])).count() == 0
    assert hard_negatives(spark, vectors(spark, [(0, 1, [1.0])])).count() == 0
    assert hard_negatives(spark, vectors(spark, [(0, 1, []), (1, 1, []), (2, 2, [])])).collect()[0].negative_score == 0
    assert scaled(vectors(spark, [(1, None, [1.0]), (2, 1, None), (3, 1, [-0.001])])).select("v").collect()[0].v == [-1]


def test_negatives_of_large_components(spark):
    rows = [(i, i % 2, [(-1) ** i * 3e4 * (i + 1), 2e4]) for i in range(0, 60)]
    assert result_of(hard_negatives(spark, vectors(spark, rows), every=10)) == brute_negatives(rows, every=10)


# 12 --------------------------------------------------------------------------------------------------

LICENSED = [
    (0, "Licensed under the Apache License, Version 2.0."),
    (1, "gnu general public license; GNU General Public License version 3 or later, CC-BY and CC BY-NC 4.0 mit license MIT/Apache License"),
    (2, None),
    (3, ""),
    (4, "é " * 50_000 + "The MIT License"),
    (5, "SPDX-License-Identifier: BSD-3-Clause"),
    (5, "gnu\tgeneral\n public -- license"),
    (None, "cc by cc by"),
    (7, "A license, a cc, then by gnu or apache or mit."),
    (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The MIT License."),
]


def brute_matches(text, rules):
    """All rules over all texts, all pairs of matches."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined = "".join(f" {x}" for x in w) + " "
    found = []
    for n, r in enumerate(rules):
        for m in re.finditer(f" (?:{r.pattern})(?= )", joined):
            start = joined[: m.start()].count(" ")
            found.append((start, start + m[0].count(" "), r.priority, n, r.base))
    left = [a for a in found if a[4] or not any(b != a and b[0] <= a[0] and a[1] <= b[1] and (b[2] < a[2] or b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or b[:2] == a[:2] and b[3] < a[3])) for b in found)]
    return len(w), sorted(left, key=lambda m: (m[0], -m[1], m[2], m[3]))


def test_licenses(spark):
    rows = find_licenses(spark, documents(spark, LICENSED)).collect()
    assert len(rows) == len(LICENSED)
    for r, (i, text) in zip(rows, LICENSED):
        assert (r.doc_id, r.n_words, [(m.start, m.end, m.priority, m.rule, m.base) for m in r.matches]) == (i, *brute_matches(text, RULES))
    digest = [tuple(r) for r in license_digest(find_licenses(spark, documents(spark, LICENSED))).collect()]
    assert digest[0][:7] == (0, 8, 1, 3, 3, "apache", "apache,apache-2.0")
    assert digest[1][2:6] == (6, 0, 23, "apache,cc-by,gpl,mit") and {"gpl-3.0-or-later", "cc-by-nc-4.0"} <= set(digest[1][6].split(","))
    assert digest[2] == (2, 0, 0, None, None, "", "", 0.0)
    assert digest[4][1:6] == (50_003, 1, 50_001, 50_001, "mit") and digest[5][6] == "bsd-3-clause" and digest[6][5] == "gpl"
    assert digest[7][2:6] == (2, 0, 2, "cc-by") and digest[8][2] == 0
    assert all(0 <= d[7] <= 1 for d in digest)


def test_licenses_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op12_licenses"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n, left = brute_matches(text, RULES)
        base = [m for m in left if m[4]]
        labels = sorted({RULES[m[3]].label for m in left})
        assert (got[i].n_words, got[i].n_base, got[i].labels) == (n, len(base), ",".join(labels))
        assert (got[i].first_word, got[i].last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
    assert find_licenses(spark, documents(spark, [])).count() == 0


def test_suppression_by_priority_and_containment():
    """Random intervals against all pairs."""
    rng = random.Random(3)
    for _ in range(300):
        found = [(a, a + rng.randint(1, 6), rng.randint(1, 3), n, rng.random() < 0.1) for n, a in enumerate(rng.choices(range(12), k=rng.randint(0, 9)))]
        want = [a for a in found if a[4] or not any(b != a and b[0] <= a[0] and a[1] <= b[1] and (b[2] < a[2] or b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or b[:2] == a[:2] and b[3] < a[3])) for b in found)]
        assert suppress(found) == sorted(want, key=lambda m: (m[0], -m[1], m[2], m[3]))


def test_rules_are_gated_by_their_own_words():
    """Hundreds of rules; each has keywords, and its keywords are in whatever it matches."""
    assert len(RULES) > 300 and all(r.keywords for r in RULES)
    for r in RULES:
        for k in r.keywords:
            assert re.search(rf"(?:^|[ )?]){re.escape(k)}(?:$|[ (])", r.pattern), r
    assert rules_of("a: <x> ... y", 2) == [Rule("a", 2, "x(?: [^ ]+){0,6}? y", ("x",))]


# 13 --------------------------------------------------------------------------------------------------


def brute_search(docs, items, top):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")

    def low(text):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms(text)]

    counts = [(i, Counter(low(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    found = []
    for item, text in items:
        scores = []
        for i, c, n in counts:
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(low(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        found += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return Counter(found)


@pytest.mark.parametrize("at_once", [1 << 21, 40])
def test_search(spark, monkeypatch, at_once):
    """Several blocks of items, several runs of postings; copies tie at the last rank."""
    monkeypatch.setattr(lexical_module, "ITEM_BLOCK", 300)
    monkeypatch.setattr(lexical_module, "_AT_ONCE", at_once)
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "é", "Ünï", "A1", "a1"]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(65)], k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(300 + i, "w1 w2, w3! w50") for i in range(80)] + [(7, "a repeated id w1"), (7, "a repeated id w1"), (None, "w1 w2"), (None, None), (900, ""), (901, "... !!!"), (902, "w1 " * 30_000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=8))) for k in range(30)] + [(30, "w1 W1 w2 w3 w50"), (30, "w1 w2"), (None, "é A1"), (31, ""), (32, None), (33, "nowhere"), (34, "w0")]
    got = ranked_search(spark, documents(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)), top=20)
    assert Counter(tuple(r) for r in got.collect()) == brute_search(docs, items, 20)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search(spark, documents(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert ranked_search(spark, documents(spark, [(1, "a")]), none).count() == 0
    assert ranked_search(spark, documents(spark, [(1, None)]), spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")).count() == 0


def test_few_documents_are_rescored(spark, monkeypatch):
    """The bytes' bounds leave few documents; a search of all of them finds the same."""
    index = LexicalIndex(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in index.search(items, 5).collect())
    assert got == brute_search(docs, [(r.item_id, r.text) for r in items.collect()], 5)

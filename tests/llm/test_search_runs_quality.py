"""Lexical search, periodic runs, quality scores: brute force and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relaylens.llm import basic_factors, boosted_quality, catalog, signature_search

from helpers import clashing, empty, odd_documents
from helpers import words as some_words

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op11 ---


def ranked(docs, items, top=10):
    """(item_id, rank, doc_id, score) of every item, from the definition."""
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in counted:
            m = 100 - 90 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s)
                for r, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def found_by_search(spark, docs, items):
    rows = signature_search.rank(
        docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=repr)


def test_search_of_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score"))
                  for r in catalog.QUERIES["op11_bloom_signatures"](spark, SF).collect()), key=repr)
    assert got == ranked(docs, items)


def test_search_takes_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(signature_search, "ITEM_BYTES", 400)  # several blocks
    docs = odd_documents(spark)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    base = plain[0][1]
    items = [(1, base[:200]), (1, "one"), (2, None), (3, ""), (4, "ONE two-One"), (None, base[100:300]),
             (5, "absent words only"), (6, base), (7, "12 34")]
    assert found_by_search(spark, docs, items) == ranked(plain, items)


def test_search_ranks_ties_by_id_and_null_ids_last(spark):
    plain = [(i, "same words here") for i in [*range(30, 5, -1), None, None]] + [(2, "Ähre ähre É")]
    docs = spark.createDataFrame(plain, "doc_id long, text string").repartition(7)
    items = [(0, "same"), (1, "ähre"), (2, "é É")]
    assert found_by_search(spark, docs, items) == ranked(plain, items)
    few = spark.createDataFrame(plain[-4:], "doc_id long, text string")
    assert found_by_search(spark, few, items) == ranked(plain[-4:], items)


def test_search_of_empty_and_clashing_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = odd_documents(spark)
    assert found_by_search(spark, empty(spark), [(1, "one")]) == []
    assert signature_search.rank(docs, none).count() == 0
    clash = clashing(spark).withColumn("shard", F.lit(1)).withColumn("rank", F.lit(1))
    plain = [(r.doc_id, r.text) for r in clash.collect()]
    assert found_by_search(spark, clash, [(1, plain[0][1])]) == ranked(plain, [(1, plain[0][1])])


def test_bounds_never_fall_short():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijkl") * rng.randint(1, 3) for _ in range(rng.randint(1, 90)))
             for _ in range(60)]
    counts = [Counter(t.encode().split()) for t in texts]
    hashes = [signature_search.words.hashes(t.encode(), *signature_search.words.spans(t.encode()))
              for t in texts]
    entry = [signature_search.entries(*np.unique(h, return_counts=True)) for h in hashes]
    terms = sorted({t for c in counts for t in c})
    holding = Counter(t for c in counts for t in c)
    n, total = len(texts), sum(c.total() for c in counts)
    s = signature_search.Searcher(
        terms=terms, weights=[signature_search.weight(n, holding[t]) for t in terms],
        items=[sorted(rng.sample(range(len(terms)), 8)) for _ in range(20)], documents=n, total=total,
        best=[], reached=[])
    lengths = [c.total() for c in counts]
    masses = [signature_search.mass(x, n, total) for x in lengths]
    loose = 0
    for bits in (6, 9, 12):
        bounds = s.bounds(bits, signature_search.sliced(entry, bits), lengths, masses)
        for q in range(20):
            for d in range(n):
                score = s.score(q, {terms.index(t): c for t, c in counts[d].items()}, masses[d])
                assert bounds[q, d] >= score
                loose += bounds[q, d] > 2 * score + 1
    assert loose < 20 * n  # they do tell documents apart


# --- op12 ---


def all_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(
                    all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        w += (unit * rng.randint(1, 9))[:rng.randint(1, 45)]
    return w


def test_runs_of_random_words_follow_the_definition():
    rng = random.Random(7)
    for _ in range(400):
        texts = [periodic_words(rng) for _ in range(rng.randint(1, 4))]
        ids, n = basic_factors.word_ids([" ".join(w).encode() for w in texts])
        ends, got = np.cumsum(n + 1), [[] for _ in texts]
        for start, length, period in basic_factors.runs(ids, n):
            d = int(np.searchsorted(ends, start, "right"))
            got[d].append((start - int(ends[d] - n[d] - 1), length, period))
        assert got == [all_runs(w) for w in texts]


def test_runs_inside_runs_are_all_found():
    unit = ["a"] * 7 + ["b"]
    w = (unit * 5 + ["c"]) * 5
    ids, n = basic_factors.word_ids([" ".join(w).encode()])
    assert basic_factors.runs(ids, n) == all_runs(w)
    assert basic_factors.strongest(all_runs(["a", "b"] * 4 + ["c"] * 8)) == (8, 8, 1)


def described(row):
    return row.n_words, [(r.start, r.length, r.period) for r in row.runs], row.collapsed


def expected(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    found = all_runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return len(w), found, " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(basic_factors, "BATCH_WORDS", 100)
    docs = odd_documents(spark).unionByName(spark.createDataFrame(
        [(20, "x\x1cy " * 9, "", "s", 0), (21, "é " * 50, "", "s", 0), (21, "ab\tab\n" * 3, "", "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.where((F.col("doc_id") != 10) | F.col("doc_id").isNull())  # too long for the plain version
    got = basic_factors.periodic_runs(docs).collect()
    assert sorted((described(r) for r in got), key=repr) == sorted(
        (expected(r.text) for r in docs.collect()), key=repr)
    assert {r.row.lang for r in got} == {r.lang for r in docs.collect()}
    assert all((r.strongest is None) == (not r.runs) for r in got)


def test_a_very_long_text_and_a_very_long_run(spark):
    text = some_words(3000, 3) + " " + "p q r " * 200_000
    row = basic_factors.periodic_runs(
        spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 603_000 and (row.strongest.length, row.strongest.period) == (600_000, 3)
    assert row.collapsed == text[:len(text) - len("p q r " * 199_999) - 1]


def test_runs_of_empty_and_clashing_tables(spark):
    assert basic_factors.periodic_runs(empty(spark)).count() == 0
    clash = clashing(spark).withColumn("runs", F.lit("r")).withColumn("collapsed", F.lit(1))
    got = basic_factors.periodic_runs(clash).collect()
    assert len(got) == 6 and {(r.row.runs, r.row.collapsed) for r in got} == {("r", 1)}


def test_rewritten_documents_repeat_from_their_place_on(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(200)] + [(None, "a b"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in catalog.with_periods(docs.where("doc_id is not null and text is not null")).collect()}
    changed = 0
    for i, text in rows[:200]:
        w, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a, n = g % len(w), len(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            changed += 1
        assert got[i].split() == w
    assert changed > 5
    assert {r.text for r in catalog.with_periods(docs.where("doc_id is null or text is null")).collect()} \
        == {"a b", None}


# --- op13 ---


def walked(trees, row):
    total = trees.base
    for node in trees.roots.tolist():
        while trees.child[node] != node:
            node = int(trees.child[node] + (row[trees.statistic[node]] > trees.threshold[node]))
        total += trees.value[node]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_flat_trees_score_like_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = boosted_quality.fit(x, y)
    scores = trees.scores(x)
    assert np.allclose(scores, [walked(trees, r) for r in x])
    assert ((scores >= 0.5) == (y > 0.5)).mean() > 0.97


def test_a_split_takes_the_largest_gain():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    g, h = rng.normal(size=300), np.full(300, 0.25)
    borders = boosted_quality.cuts(x)
    binned = np.stack([np.searchsorted(b, c) for b, c in zip(borders, x.T)], axis=1)
    best, border = boosted_quality._split(g, h, np.zeros(300, np.int64), 1, binned, borders)

    def gain(c, t):
        left = x[:, c] <= t
        if min(h[left].sum(), h[~left].sum()) < boosted_quality.LEAST_WEIGHT:
            return -1.0
        return sum(g[s].sum() ** 2 / (h[s].sum() + boosted_quality.RIDGE) for s in (left, ~left))

    want = max((gain(c, t), c, t) for c in range(4) for t in borders[c])
    assert np.isclose(gain(best[0], borders[best[0]][border[0]]), want[0])


def test_statistics_of_small_texts():
    named = dict(zip(boosted_quality.STATISTICS, boosted_quality.statistics(b"AB ab. 12\nab. ab.")))
    assert named["upper"] == pytest.approx(2 / 17) and named["digit"] == pytest.approx(2 / 17)
    assert named["distinct_words"] == pytest.approx(3 / 5) and named["top_word"] == pytest.approx(3 / 5)
    assert named["upper_words"] == pytest.approx(1 / 5) and named["distinct_lines"] == 1.0
    assert boosted_quality.statistics(b"") == [0.0] * len(boosted_quality.STATISTICS)
    for data in (b" ", b"\n\n", b"\xff\x00", b"a" * 3_000_000):
        found = boosted_quality.statistics(data)
        assert len(found) == len(boosted_quality.STATISTICS) and all(map(math.isfinite, found))


def test_quality_on_documents_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = catalog.QUERIES["op13_boosted_quality"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
               and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93


def test_training_takes_odd_labels_and_texts(spark):
    docs = odd_documents(spark).unionByName(spark.createDataFrame(
        [(i, "good text. it reads well, all of it." if i % 2 else "|| !! ||", "en", "s", 0)
         for i in range(100, 400)], "doc_id long, text string, lang string, source string, n_chars long"))
    usable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    of = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, text string, statistics int")
    some = of([(i, i % 2, "t", 1) for i in range(100, 400)] + [(None, 1, "t", 1), (2, None, "t", 1), (2, 1, "", 2),
                                                              (2, 0, "", 2), (9_999, 1, "", 2)])
    trees = boosted_quality.train(docs, some, usable)
    got = boosted_quality.score(docs.withColumn("score", F.lit("x")).withColumn("label", F.lit(1)), trees)
    assert got.columns == ["doc_id", "score"] and got.count() == docs.count()
    again = boosted_quality.train(docs.repartition(5), some.repartition(3), usable)
    assert np.array_equal(trees.threshold, again.threshold) and np.allclose(trees.value, again.value)
    nothing = boosted_quality.train(docs, of([]), usable)
    assert {r.score for r in boosted_quality.score(docs, nothing).collect()} == {0.5}
    assert boosted_quality.score(empty(spark), trees).count() == 0
    one_kind = boosted_quality.train(docs, of([(i, 1, "", 0) for i in range(100, 200)]), usable)
    assert all(r.score > 0.5 for r in boosted_quality.score(docs, one_kind).collect())

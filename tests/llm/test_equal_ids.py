"""One id with several texts, clashing columns, huge and tiny numbers."""

import hashlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from relaylens.llm import hyperplane_dedup, order_minhash, superkmer_dedup

from helpers import words

A, B = words(300, 1), words(300, 2)
NEAR_A, NEAR_B = A + " tail", "head " + B
ROWS = [(1, A), (2, NEAR_A), (2, B), (3, NEAR_B), (4, B + " end"), (5, words(40, 3)), (2, B), (None, A)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_go_by_texts(spark):
    got = order_minhash.dedup(table(spark)).collect()
    by_key = defaultdict(set)
    for r in got:
        by_key[bytes(r.class_key)].add((r.doc_id, r.class_id))
    assert sorted(map(sorted, (s - {(None, 1)} for s in by_key.values()))) == [
        [(1, 1), (2, 1)], [(2, 2), (3, 2), (4, 2)], [(5, 5)]]


def test_one_document_of_each_class_stays_also_with_equal_ids(spark):
    docs = table(spark, [*ROWS, (7, None), (7, None), (8, "")]).withColumn("_stays", F.lit(1)).withColumn(
        "_n", F.lit(2))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(1, A), (2, B), (5, words(40, 3)), (None, A), (7, None), (8, "")], key=repr)


def removed(rows):
    """(id, number of words, removed, kept) by the definition."""
    starts = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            if i is not None:
                starts[tuple(w[k:k + 50])].add(i)
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and min(starts[tuple(w[k:k + 50])]) < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_passages_go_by_texts(spark, monkeypatch):
    rows = [*ROWS, (6, words(10, 9) + " " + B[:800]), (6, words(60, 8)), (0, words(60, 8))]
    for hot in (1000, 1):
        monkeypatch.setattr(superkmer_dedup, "HOT", hot)
        got = superkmer_dedup.remove_repeats(table(spark, rows)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
                       for r in got), key=repr) == removed(rows)


def test_huge_and_tiny_numbers_link(spark):
    vectors = [[1e200, 1e200], [1e200, 1.01e200], [1e-200, 1e-200], [1e-200, 1.01e-200], [1.0, 1.0],
               [-1.0, 1.0], [0.0, 0.0], [float("inf"), 1.0], [5e-324, 5e-324], [1.7e308, -1.7e308]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hyperplane_dedup.dedup(df).collect()}
    assert got == {0: (5, 0), 1: (5, 0), 2: (5, 0), 3: (5, 0), 4: (5, 0), 8: (5, 0), 5: (0, 5), 6: (0, 6),
                   7: (0, 7), 9: (0, 9)}


def test_recall_at_the_threshold(spark):
    """Pairs of a cosine just above the threshold, the hardest ones to meet in a bucket."""
    rng = np.random.default_rng(4)
    n, size, cosine = 3000, 64, 0.902
    one = rng.standard_normal((n, size))
    one /= np.linalg.norm(one, axis=1)[:, None]
    away = rng.standard_normal((n, size))
    away -= (away * one).sum(axis=1)[:, None] * one
    away /= np.linalg.norm(away, axis=1)[:, None]
    other = cosine * one + np.sqrt(1 - cosine ** 2) * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([one, other]))]
    got = hyperplane_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0").count() >= 2 * n * 0.99

"""Near duplicates, embeddings, URLs, shards, chats: odd rows and brute force."""

import math
import random
from collections import defaultdict

import compare
import numpy as np
import pytest

from relaylens.llm import catalog, components, hyperplane_dedup, order_minhash, snapshot_collapse
from relaylens.llm import splitter_sharding, url_markov
from relaylens.llm.order_minhash import SIMILARITY

from helpers import clashing, empty, odd_documents, rows
from helpers import words as some_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, a):
        while self.up.setdefault(a, a) != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


# --- components, op3 ---


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)]
    edges += [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    found = {i: i for e in edges for i in e} | dict(rows(components.components(
        spark.createDataFrame(edges, "u long, v long")), "node", "component"))
    assert found == {i: sets.root(i) for i in found}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_classes(docs):
    sets, runs = Sets(), {}
    for i, text in sorted(docs):
        w = (text or "").split()
        sets.root(i)
        if w:
            runs.setdefault(tuple(w), i)
            sets.join(i, runs[tuple(w)])
    sh = {i: {w[k:k + 5] for k in range(max(1, len(w) - 4))} for w, i in runs.items()}
    for a in sh:
        for b in sh:
            if a < b and len(sh[a] & sh[b]) >= SIMILARITY * len(sh[a] | sh[b]):
                sets.join(a, b)
    return {i: sets.root(i) for i, _ in docs}


def edited(text, n, seed):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark, odd):
    base = some_words(250, 11)
    docs = [(100 + i, edited(base, i % 9, i)) for i in range(60)]
    chain, text = [], some_words(200, 12)
    for i in range(12):  # each is alike to the next, the ends are not alike
        chain.append((500 - i, text))
        text = edited(text, 3, 100 + i)
    known = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    for case in (docs, chain, known, docs + chain + known):
        table = spark.createDataFrame(case, "doc_id long, text string")
        found = dict(rows(order_minhash.dedup(table), "doc_id", "class_id"))
        assert found == brute_classes(case)


def test_near_duplicate_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = catalog.QUERIES["op3_order_minhash"](spark, SF)
    assert dict(rows(found, "doc_id", "class_id")) == brute_classes(docs)


def test_near_duplicate_odd_tables(spark, odd):
    assert order_minhash.dedup(empty(spark)).count() == 0
    assert order_minhash.dedup(odd).count() == odd.count()
    assert dict(rows(order_minhash.dedup(clashing(spark)), "doc_id", "class_id")) == {
        0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2}


def test_alignment_in_a_band():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(0, 4, rng.integers(1, 14))
        d = distance(a.tolist(), b.tolist())
        for band in range(0, 8):
            assert order_minhash.edits_within(a, b, band) == (d <= band)
    for seed in range(20):
        x, y = (order_minhash.Text(t) for t in (some_words(60, 1), edited(some_words(60, 1), 3, seed)))
        bound = order_minhash.edits_bound(x.words, y.words, x.runs, y.runs)
        assert bound >= distance(x.words.tolist(), y.words.tolist())


def test_sketches_see_order_and_occurrences():
    x = order_minhash.shingles(order_minhash.word_hashes(some_words(100, 1)))
    assert order_minhash.sketches(x) == order_minhash.sketches(x.copy())
    assert not set(order_minhash.sketches(x)) & set(order_minhash.sketches(x[::-1].copy()))
    twice = order_minhash.labelled(np.concatenate([x, x]))
    assert len(set(twice.tolist())) == len(twice)


# --- op5 ---


def brute_links(vectors):
    ok = [i for i, (_, v) in enumerate(vectors)
          if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    n, sets = [0] * len(vectors), Sets()
    for a in ok:
        for b in ok:
            x, y = np.array(vectors[a][1], float), np.array(vectors[b][1], float)
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                n[a] += 1
                sets.join(vectors[a][0], vectors[b][0])
    return sorted(((i, k, sets.root(i)) for (i, _), k in zip(vectors, n)), key=repr)


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hyperplane_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    vectors = [(int(i), (centres[i % 12] + rng.standard_normal(16) * 0.25 * (i % 3)).tolist())
               for i in rng.permutation(180)]
    vectors += [(300 + i, centres[0].tolist()) for i in range(5)] + [(305, (centres[0] * 3).tolist())]
    vectors += [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0] * 15 + [None]),
                (404, [math.nan] * 16), (405, [math.inf] + [1.0] * 15), (406, [1.0, 2.0]), (407, [1.0, 2.1])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 as label", "'x' as rep", "'y' as v")
    found = hyperplane_dedup.dedup(table)
    assert rows(found, "vec_id", "n_links", "component_id") == brute_links(vectors)
    assert all(k == (i == c) for i, c, k in rows(found, "vec_id", "component_id", "kept"))
    assert hyperplane_dedup.dedup(table.limit(0)).count() == 0


def test_embedding_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = catalog.QUERIES["op5_hyperplane_dedup"](spark, SF)
    assert rows(found, "vec_id", "n_links", "component_id") == brute_links(vectors)


def test_recall_follows_from_the_settings():
    for n in (10, 10_000, 10_000_000):
        bits, tables = hyperplane_dedup.settings(n)
        agree = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - agree) ** tables >= hyperplane_dedup.RECALL


# --- op2 ---


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for verdict, h, p in catalog.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or ("", ""), (h + p, verdict), key=lambda r: len(r[0]))
    return host, path, best


def test_url_rules_and_verdicts(spark):
    urls = [None, "", "x", "http://COM", "http://a.COM/x?y", "https://example.com/en/1#z", "://net/fr/",
            "http://www.example.com/en/?q", "http://m.www.example.com/en/a\nb", "ftp://notcom/de/", "a://b://c/d",
            "http://É.net/es/", "http://x.net?/fr/"]
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 2)],
                                  "page_id long, url string, host string")
    found = url_markov.judge(table, catalog.URL_RULES).collect()
    assert len(found) == 2 * len(urls)
    for r in found:
        host, path, rule = brute_rule(urls[r.page_id % len(urls)])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    assert url_markov.judge(table.limit(0), catalog.URL_RULES).count() == 0
    assert {r.verdict for r in url_markov.judge(table, []).collect()} == {"allow"}


def test_url_scores_equal_a_plain_model(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    ruled = url_markov.with_rule(url_markov.with_parts(pages), catalog.URL_RULES)
    found = url_markov.scores(ruled).collect()
    counts = {v: defaultdict(lambda: defaultdict(int)) for v in ("allow", "block")}
    k = url_markov.ORDER
    for r in found:
        if r.by_rule and not r.held:
            padded = "\x02" * k + r.host + r.path + "\x03"
            for i in range(k, len(padded)):
                for n in range(k + 1):
                    counts[r.by_rule][padded[i - n:i]][padded[i]] += 1

    def p(side, context, ch):
        out = 1 / url_markov.ALPHABET
        for n in range(k + 1):
            seen = counts[side].get(context[k - n:])
            if seen:
                out = (seen.get(ch, 0) + len(seen) * out) / (sum(seen.values()) + len(seen))
        return out

    for r in found[:60]:
        padded = "\x02" * k + r.host + r.path + "\x03"
        want = np.mean([math.log(p("allow", padded[i - k:i], padded[i]) / p("block", padded[i - k:i], padded[i]))
                        for i in range(k, len(padded))])
        assert abs(r.score - want) < 1e-9


def test_url_model_parts_held_out_urls(spark):
    ruled = url_markov.with_rule(url_markov.with_parts(spark.read.parquet(
        "/root/testdata/sf0.1/pages.parquet")), catalog.URL_RULES)
    held = [r for r in url_markov.scores(ruled).collect() if r.held and r.by_rule]
    right = sum((r.score > 0) == (r.by_rule == "allow") for r in held)
    assert right > 0.9 * len(held) > 0


# --- op6 ---


@pytest.mark.parametrize("shards", [24, 3])
def test_shards_are_even_and_gapless(spark, odd, shards):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for table in (docs, odd, clashing(spark)):
        found = splitter_sharding.shard(table, shards).collect()
        assert len(found) == table.count()
        by = defaultdict(list)
        for r in found:
            by[r.shard].append(r)
        for s, members in by.items():
            assert 0 <= s < shards
            assert sorted(r.slot for r in members) == list(range(len(members)))
        sizes = [sum(r.size for r in by[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 2 * max(r.size for r in found)
    assert splitter_sharding.shard(empty(spark), shards).count() == 0


def test_a_heavy_group_is_subdivided_and_others_stay_whole(spark):
    docs = [(i, "heavy " * 50) for i in range(3000)] + [(5000 + i, some_words(40, i // 3)) for i in range(3000)]
    found = splitter_sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    sizes = defaultdict(int)
    groups = defaultdict(set)
    for r in found:
        sizes[r.shard] += r.size
        groups[r.text_crc32].add(r.shard)
    assert max(sizes.values()) < 1.02 * min(sizes.values())
    assert sum(len(s) > 1 for s in groups.values()) <= 12


# --- op7 ---


def test_snapshots_query_and_oracle(spark):
    found = compare.difference(catalog.QUERIES["op7_snapshot_collapse"](spark, SF), compare.connect(SF),
                               catalog.ORACLE["op7_snapshot_collapse"])
    assert found is None, found


@pytest.mark.parametrize("part", [1024, 2])
def test_snapshots_by_hand(spark, monkeypatch, part):
    monkeypatch.setattr(snapshot_collapse, "PART", part)

    def log(i, *texts, role="user"):
        return [(i, t, role, text) for t, text in enumerate(texts)]

    table = spark.createDataFrame(
        log(1, "a", "b") + log(2, "a", "b", "c") + log(3, "a", "b", "c") + log(4, "a", "x")
        + log(5, "b") + log(6, None) + log(7, "") + log(8, "a", "b", role="bot") + log(8, "a", role="bot")
        + [(9, None, None, "<|q"), (None, 0, "user", "lone")],
        "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as part", "1 as place")
    found = snapshot_collapse.collapse(table).collect()
    whole = defaultdict(str)
    for r in sorted(found, key=lambda r: (r.conv_id or 0, r.part)):
        whole[r.conv_id] += r.rendered
    assert set(whole) == {2, 4, 5, 6, 7, 8, 9, None}
    assert whole[4] == "<|user|>\na<|end|>\n<|user|>\nx<|end|>\n"
    assert whole[9] == "<||>\n< |q<|end|>\n"
    assert {(r.conv_id, r.n_turns, r.snapshots) for r in found} >= {(2, 3, 2), (8, 2, 1)}
    assert snapshot_collapse.collapse(table.limit(0)).count() == 0

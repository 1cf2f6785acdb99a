"""Hot keys stay split in the plans of sharding and URL scores; sharding against plain Python."""

import random
import re
import zlib

from pyspark.sql import functions as F

from relaylens.llm import splitter_sharding, url_markov

from helpers import words


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_a_heavy_key_are_dealt_by_part(spark, monkeypatch):
    seen = []
    stage = splitter_sharding.written
    monkeypatch.setattr(splitter_sharding, "written", lambda df, name: seen.append((name, df)) or stage(df, name))
    rows = [(i, "hot text" * 9 if i % 3 == 0 else words(20, i)) for i in range(3000)]
    splitter_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"))
    (placed,) = [df for name, df in seen if name == "placed"]
    plan = plan_of(placed)
    window = plan.index("Window")
    below = plan[window:]
    nearest = re.search(r"Exchange hashpartitioning\(([^)]*)\)", below)[1]
    assert re.match(r"range#\d+, own#\d+L, part#\d+", nearest), nearest


def test_sizes_checksums_and_slots(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "é" * 7, words(30, i % 50), words(rng.randint(1, 300), i)]))
            for i in range(2000)]
    got = splitter_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for rows_ in shards.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
    sizes = [sum(r.size for r in shards.get(k, [])) for k in range(24)]
    largest = max(r.size for r in got)
    wanted = sum(sizes) / 24
    assert max(abs(s - wanted) for s in sizes) <= 2 * largest + 0.002 * wanted


def test_short_contexts_are_not_shuffled(spark):
    urls = spark.createDataFrame(
        [(f"run{i % 40}"[-5:], i % 3, i % 2) for i in range(200)], "run string, good long, bad long").groupBy(
        "run").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    few = url_markov._log_ratios(urls)
    assert plan_of(few).count("BroadcastHashJoin") >= 3
    before = {r.run: r.ratio for r in few.collect()}
    url_markov.LETTERS, kept = 0, url_markov.LETTERS
    try:
        assert {r.run: r.ratio for r in url_markov._log_ratios(urls).collect()} == before
    finally:
        url_markov.LETTERS = kept

import bisect

import pytest
from pyspark.sql import functions as F

from relaylens.functions.ranges import range_of
from relaylens.operators import cutting, ranges6
from relaylens.plans import catalog, workload
from relaylens.session import stage
from relaylens.sources import mime


def documents(spark, folder, n=40):
    spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(9).alias("n_chars")).coalesce(1).write.parquet(
        f"{folder}/documents.parquet")
    return str(folder)


def test_mail_of_one_file_is_dealt_to_all_cores(spark, tmp_path):
    flat = workload.flat_mail(spark, documents(spark, tmp_path))
    tasks = flat.select("k", F.spark_partition_id().alias("p")).groupBy("p").count().count()
    assert tasks >= 2 * spark.sparkContext.defaultParallelism


def test_quarantine_parses_each_message_once(spark, tmp_path, capsys):
    found = catalog.QUERIES["s14_quarantine"](spark, documents(spark, tmp_path))
    found.explain()
    assert "MapInPandas" not in capsys.readouterr().out
    assert found.where("NOT parsed").count() == 4 and found.count() == 40


def test_parsed_rows_leave_in_slices(monkeypatch):
    import pandas as pd

    mail = b"Subject: a\r\n\r\n" + b"x" * 100
    batch = pd.DataFrame({"email_id": list("abcdefg"), "path": list("abcdefg"), "content": [mail] * 7})
    monkeypatch.setattr(mime, "SLICE_ROWS", 3)
    assert [list(p["path"]) for p in mime._parse_batches(iter([batch]))] == [
        ["a", "b", "c"], ["d", "e", "f"], ["g"]]
    monkeypatch.setattr(mime, "SLICE_BYTES", 120)  # one message, never none
    assert [len(p) for p in mime._parse_batches(iter([batch, batch.iloc[:0]]))] == [1] * 7


def test_free_text_headers_read_as_the_registry_reads_them():
    from email.headerregistry import HeaderRegistry

    registry, read = HeaderRegistry(), mime.header_rules().header_factory
    for value in ("plain  text ", "a\tb (c) <d@e>", "=?utf-8?b?w6k=?= x", "x=?utf-8?q?a_b?=y", "café", "=?bad", ""):
        for name in ("Subject", "received", "X-Client-IP", "From", "Message-ID", "Content-Type"):
            assert str(read(name, value)) == str(registry(name, value)), (name, value)
    assert type(read("Received", "from a by b")) is str  # without the grammar


@pytest.mark.parametrize("count", [1, 2, 3, 7, 8, 9, 64])
def test_position_among_any_number_of_splitters(spark, count):
    numbers = [10 * i for i in range(count)]
    texts = [f"{n:05d}" for n in numbers]
    keys = [None, -1, 0, 5, 10, *range(10 * count - 15, 10 * count + 5, 3)]
    rows = spark.createDataFrame([(k, None if k is None else f"{max(k, 0):05d}") for k in keys], "k long, t string")
    for r in rows.select("k", "t", range_of(F.col("k"), numbers).alias("a"), range_of(F.col("t"), texts).alias("b")).collect():
        assert r.a == (0 if r.k is None else bisect.bisect_right(numbers, r.k))
        assert r.b == (0 if r.t is None else bisect.bisect_right(texts, r.t))


def test_segments_of_ranges_are_searched_once(spark, capsys):
    df = spark.range(400).selectExpr("id * 10 AS lo", "id * 10 + 500 + id % 7 AS end", "500 + id % 7 AS width",
                                     "named_struct('name', id) AS rec")
    cutting.pieces(df, 1 << 40, ranges6.splitters, ranges6.segment).explain()
    assert "aggregate(" not in capsys.readouterr().out


@pytest.fixture
def named_stages(monkeypatch):
    names = []

    def named(df, name):
        names.append(name)
        return stage(df, name)

    monkeypatch.setattr(catalog, "stage", named)
    return names


def small_tables(spark, folder):
    spark.createDataFrame([(i, f"R{i}") for i in range(5)], "r_regionkey long, r_name string").write.parquet(
        f"{folder}/region.parquet")
    spark.createDataFrame([(i, f"N{i}", i % 5) for i in range(25)], "n_nationkey long, n_name string, n_regionkey long") \
        .write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(i,) for i in range(9)], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(i, f"C{i}") for i in range(50)], "c_custkey long, c_name string").write.parquet(
        f"{folder}/customer.parquet")
    return documents(spark, folder)


def test_address_queries_run_only_the_steps_that_name_addresses(spark, tmp_path, named_stages):
    sf = small_tables(spark, tmp_path)
    found = catalog.QUERIES["g3_geo_range_join_overlaps"](spark, sf).collect()
    assert named_stages == ["addresses"]
    catalog.facts(spark, sf)
    assert sorted(catalog.g1(spark, sf).collect()) == sorted(
        catalog.geo.distinct_ips(catalog.once(spark, sf, "addresses", None)).collect())
    assert len(found) == catalog.g1(spark, sf).count()


@pytest.mark.parametrize("query", ["s9_write_reports", "s10_latest_published", "f10_unified_report"])
def test_results_read_once_are_not_written(spark, tmp_path, named_stages, query):
    sf = small_tables(spark, tmp_path)
    first = catalog.QUERIES[query](spark, sf).collect()
    assert "results" not in named_stages
    catalog.results(spark, sf)  # written by another query: read
    assert sorted(map(str, catalog.QUERIES[query](spark, sf).collect())) == sorted(map(str, first))

"""One row per content, whatever the paths of a raw table are."""

from relaylens.sources import messages as sources


def raw_table(spark, rows):
    return sources.with_content_id(spark.createDataFrame(
        [(path, at, content.encode() if content is not None else None) for content, path, at in rows],
        "path string, at long, content binary"))


def found(df):
    return sorted(((bytes(r.content).decode() if r.content is not None else None, r.path, r.at)
                   for r in df.collect()), key=repr)


def test_a_path_under_two_contents_loses_neither(spark):
    raw = raw_table(spark, [("X", "a", 1), ("X", "p", 2), ("Y", "p", 3)])
    assert found(sources.dedup_raw(raw)) == [("X", "a", 1), ("Y", "p", 3)]


def test_equal_and_null_paths_leave_one_row(spark, tmp_path):
    raw = raw_table(spark, [
        ("X", "a", 2), ("X", "a", 1), ("X", "b", 0), ("Y", None, 5), ("Y", None, 4), ("Z", None, 1),
        ("Z", "z", 2), ("W", "a", 9), (None, "n", 1), (None, "m", 2)])
    kept = [("W", "a", 9), ("X", "a", 1), ("Y", None, 4), ("Z", "z", 2), (None, "m", 2)]
    assert found(sources.dedup_raw(raw)) == sorted(kept, key=repr)
    store = str(tmp_path / "store")
    sources.store_raw(raw.where("content is not null"), store)
    sources.store_raw(raw.where("content is not null"), store)
    assert found(spark.read.parquet(store)) == sorted(kept[:4], key=repr)


def test_contents_are_scanned_and_hashed_once_for_the_ids(spark, tmp_path):
    raw = raw_table(spark, [("X", "a", 1), ("X", "b", 2), ("Y", "c", 3)])
    raw.drop("email_id").write.parquet(str(tmp_path / "t"))
    one = sources.dedup_raw(sources.with_content_id(spark.read.parquet(str(tmp_path / "t"))))
    assert sorted(one.select("path").collect()) == [("a",), ("c",)]
    plan = one.select("email_id", "path")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "sha2(" not in plan and "content" not in plan

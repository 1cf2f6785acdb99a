import pytest
from pyspark.sql import functions as F

from relaylens.sources import report_store as store


def reports(spark, ids, at=0):
    return spark.createDataFrame([(str(i), at + i) for i in ids], "id string, processed_at long")


def ids(df):
    return sorted(int(r.id) for r in df.collect())


def test_batches_are_read_whole_and_the_newest_by_its_manifest(spark, tmp_path):
    out = str(tmp_path)
    store.publish(reports(spark, range(5)), out, 0)
    store.publish(reports(spark, range(5, 9)), out, 1)
    store.publish(reports(spark, []), out, 2)
    assert ids(store.published(spark, out)) == list(range(9))
    latest = store.latest_published(spark, out)
    assert [(r.id, r.batch) for r in latest.collect()] == [("8", 1)]
    assert {n.split(".")[0] for n in map(str, latest.inputFiles()) for n in [n.split("/data/")[1]]} == {"1"}


@pytest.mark.parametrize("first", [True, False])
def test_a_write_that_dies_before_its_manifest_is_never_read(spark, tmp_path, monkeypatch, first):
    out = str(tmp_path)
    store.publish(reports(spark, range(3)), out, 0)
    if not first:
        store.publish(reports(spark, [7]), out, 1)
    before = ids(store.published(spark, out))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "move_folder", dies)
        with pytest.raises(OSError):
            store.publish(reports(spark, range(3, 9)), out, 1)
    assert ids(store.published(spark, out)) == before
    store.publish(reports(spark, range(3, 6)), out, 1)  # the retry
    assert ids(store.published(spark, out)) == list(range(6))
    store.remove_unpublished(spark, out)
    assert ids(store.published(spark, out)) == list(range(6))
    assert len(list((tmp_path / "data").iterdir())) == 2
    assert not list((tmp_path / "pending").iterdir())


def test_a_writer_that_dies_after_the_rename_leaves_the_last_attempt(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    store.publish(reports(spark, [1]), out, 0)
    with monkeypatch.context() as m:
        m.setattr(store, "remove_folder", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.publish(reports(spark, [1, 2]), out, 0)
    assert ids(store.published(spark, out)) == [1, 2]
    store.publish(reports(spark, [3]), out, 0)
    assert ids(store.published(spark, out)) == [3]


def test_a_store_without_batches_is_empty(spark, tmp_path):
    assert store.published(spark, str(tmp_path / "none")).count() == 0
    assert store.latest_published(spark, str(tmp_path / "none")).count() == 0
    store.publish(reports(spark, [1]).where(F.lit(False)), str(tmp_path), 0)
    assert store.latest_published(spark, str(tmp_path)).count() == 0

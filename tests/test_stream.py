import mails
import pytest
from pyspark.sql import functions as F

from relaylens import schemas
from relaylens.operators.report import final_report
from relaylens.plans import analysis
from relaylens.sources import messages as sources
from relaylens.sources.mime import parse_messages
from relaylens.streaming import monitor


def scorer(messages):
    return messages.withColumn("ml_prob", F.lit(0.2))


def test_stream_equals_batch_and_does_nothing_twice(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    mails.write(landing)
    dims = analysis.Dimensions(spark.createDataFrame([], schemas.IP_RANGES))

    def run():
        stream = sources.stream_messages(spark, str(landing), per_batch=6)
        monitor.monitor(stream, dims, out, f"{out}/checkpoint", scorer,
                        once=True).awaitTermination()
        return {r.id: r for r in monitor.reports_of(spark, out).drop(
            "processed_at", "batch", "source_stem").collect()}

    streamed = run()
    raw = sources.dedup_raw(sources.read_message_tree(spark, str(landing)))
    batch = final_report(analysis.analyze(scorer(parse_messages(raw)), dims)).collect()
    assert streamed == {r.id: r for r in batch}
    assert monitor.reports_of(spark, out).count() == len(mails.ALL) - 1

    (landing / "12_late_copy.eml").write_bytes(mails.SPOOFED.encode())
    (landing / "13_new.eml").write_bytes(mails.NO_FROM.replace("else", "new").encode())
    assert len(run()) == len(mails.ALL)
    assert monitor.reports_of(spark, out).count() == len(mails.ALL)


def test_failed_batch_is_done_again_in_full(spark, tmp_path):
    mails.write(tmp_path / "in")
    raw = sources.read_message_tree(spark, str(tmp_path / "in")).limit(3)
    out = str(tmp_path / "out")
    dims = analysis.Dimensions(spark.createDataFrame([], schemas.IP_RANGES))

    def broken(messages):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        monitor.process_batch(raw, 0, dims, out, broken)
    for _ in range(2):
        monitor.process_batch(raw, 0, dims, out, scorer)
    assert monitor.reports_of(spark, out).count() == spark.read.parquet(f"{out}/ledger").count()


def test_second_batch_does_not_shuffle_the_ledger_and_compaction_keeps_it(spark, tmp_path):
    mails.write(tmp_path / "in")
    raw = sources.read_message_tree(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    dims = analysis.Dimensions(spark.createDataFrame([], schemas.IP_RANGES))
    monitor.process_batch(raw.limit(4), 0, dims, out, scorer)
    ledger = monitor.finished(spark, out)
    met = ledger.join(raw.select("email_id").distinct(), "email_id", "left_semi")
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    before = {r.email_id for r in ledger.collect()}
    for _ in range(2):
        monitor.compact_ledger(spark, out, 0)
        assert {r.email_id for r in monitor.finished(spark, out).collect()} == before
    monitor.process_batch(raw, 1, dims, out, scorer)
    monitor.compact_ledger(spark, out, 1)
    assert {r.email_id for r in monitor.finished(spark, out).collect()} == {
        r.id for r in monitor.reports_of(spark, out).collect()}
    assert monitor.reports_of(spark, out).count() == len(mails.ALL) - 1


def ledger_of(spark, out, batches, per_batch=30):
    """A ledger as so many batches leave it."""
    spark.range(batches * per_batch).select(
        F.sha2(F.col("id").cast("string"), 256).alias("email_id"), F.current_timestamp().alias("processed_at"),
        F.expr(f"CAST(id DIV {per_batch} AS INT)").alias("batch")).write.partitionBy("batch").mode(
        "append").parquet(f"{out}/ledger")


def files_with_rows(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_a_batch_reads_a_bounded_part_of_a_long_ledger(spark, tmp_path):
    out = str(tmp_path / "out")
    ledger_of(spark, out, 60)
    before = {r.email_id for r in monitor.finished(spark, out).collect()}
    monitor.compact_ledger(spark, out, 29)
    monitor.compact_ledger(spark, out, 54)
    monitor.compact_ledger(spark, out, 54)
    assert {r.email_id for r in monitor.finished(spark, out).collect()} == before
    assert monitor._numbers(spark, f"{out}/ledger") == list(range(55, 60))
    part = monitor.finished(spark, out, ["ab", "0c", "f1"])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan[plan.index("PartitionFilters: [") :].split("]")[0]
    few = {f for f in files_with_rows(part) if "/ledger_base/" in f}
    assert 0 < len(few) <= 3 * 2 and len(files_with_rows(monitor.finished(spark, out))) > 250
    assert {i for i in before if i.startswith("ab")} <= {r.email_id for r in part.collect()}


def test_generations_of_the_ledger_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(monitor, "GENERATIONS", 2)
    out = str(tmp_path / "out")
    ledger_of(spark, out, 8, per_batch=5)
    before = {(r.email_id, r.batch) for r in monitor.finished(spark, out).collect()}
    for upto in (1, 3, 5, 7):
        monitor.compact_ledger(spark, out, upto)
    assert {(r.email_id, r.batch) for r in monitor.finished(spark, out).collect()} == before
    assert monitor._numbers(spark, f"{out}/ledger_base") == [5, 7]
    assert monitor._numbers(spark, f"{out}/ledger") == []


def test_a_failed_batch_leaves_no_staged_table(spark, tmp_path):
    from relaylens import session

    mails.write(tmp_path / "in")
    raw = sources.read_message_tree(spark, str(tmp_path / "in")).limit(3)
    out, dims = str(tmp_path / "out"), analysis.Dimensions(spark.createDataFrame([], schemas.IP_RANGES))
    monitor.process_batch(raw, 0, dims, out, scorer)
    before = session.staged_tables()

    def broken(messages):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        monitor.process_batch(raw, 1, dims, out, broken)
    assert session.staged_tables() == before

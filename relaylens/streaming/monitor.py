"""Continuous ingestion: every message one report, keyed by content, retried after a failure."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relaylens.operators.report import final_report
from relaylens.plans.analysis import Dimensions, address_intel, assessed, message_facts
from relaylens.session import (
    list_folders, move_folder, remove_folder, remove_staged, stage, staged_tables,
)
from relaylens.sources import report_store
from relaylens.sources.messages import dedup_messages, quarantine, read_table_or_none
from relaylens.sources.mime import parse_messages
from relaylens.sources.reports import source_stem

#: Batches between two compactions of the ledger; generations of its base before they are merged.
COMPACT_EVERY, GENERATIONS = 50, 16


def process_batch(
    raw: DataFrame, batch_id: int, dims: Dimensions, out: str,
    scorer: Callable[[DataFrame], DataFrame],
) -> None:
    """One micro-batch: reports first, the ledger last.

    The reports become visible in one step, and a retry replaces them.  The ledger read
    leaves out the current batch, so a batch that failed half way is done again in full, and a
    message that an earlier batch finished is not.
    """
    spark, before = raw.sparkSession, staged_tables()
    try:
        _process(spark, raw.select("email_id", "path", "content"), batch_id, dims, out, scorer)
    finally:
        remove_staged(spark, before)


def _process(spark: SparkSession, raw: DataFrame, batch_id: int, dims: Dimensions, out: str,
             scorer: Callable[[DataFrame], DataFrame]) -> None:
    if any(list_folders(spark, f"{out}/{n}") for n in ("ledger_base", "ledger")):
        ids = stage(raw.select("email_id").distinct(), "ids")
        shards = [r["shard"] for r in ids.select(_shard().alias("shard")).distinct().collect()]
        done = finished(spark, out, shards)  # at most 256 shards
        # The ledger is met from the batch's ids, its small side; only hits come back, so
        # neither the ledger nor the contents have to be shuffled.
        mine = done.where(F.col("batch") != batch_id).join(ids, "email_id", "left_semi") \
            .select("email_id").distinct()
        raw = raw.join(mine, "email_id", "left_anti")
    # One staged table serves good and bad rows, so every message is parsed once; copies within
    # the batch are folded on the narrow facts.
    facts = stage(dedup_messages(message_facts(scorer(parse_messages(raw)))), "facts")
    good, bad = quarantine(facts)
    results = assessed(good, stage(address_intel(good, dims), "intel"))
    reports = final_report(results, "email_id", "path").withColumns({
        "source_stem": source_stem(F.col("path")), "processed_at": F.current_timestamp(),
    }).drop("path")
    name = report_store.publish(reports, f"{out}/reports", batch_id)
    bad.write.mode("overwrite").parquet(f"{out}/dead_letter/batch={batch_id}")
    written = report_store.published(spark, f"{out}/reports", [name])
    written.select(F.col("id").alias("email_id"), "processed_at").write.mode("overwrite") \
        .parquet(f"{out}/ledger/batch={batch_id}")


def _shard():
    """Where the base of the ledger keeps an id: its first two hex digits."""
    return F.substring("email_id", 1, 2)


def finished(spark: SparkSession, out: str, shards: list[str] | None = None) -> DataFrame | None:
    """Ledger rows (email_id, processed_at, batch): compacted ones and those of single batches.

    With ``shards`` only those folders of the compacted ledger are read; the single batches are at most
    the ones since the last compaction.
    """
    base = read_table_or_none(spark, f"{out}/ledger_base")
    if base is not None and shards is not None:
        base = base.where(F.col("shard").isin(shards))
    parts = [t for t in (base, read_table_or_none(spark, f"{out}/ledger")) if t is not None]
    columns = ("email_id", "processed_at", "batch")
    return reduce(DataFrame.unionByName, [t.select(*columns) for t in parts]) if parts else None


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The values of the partition folders ``name=value``."""
    return sorted(int(n.rpartition("=")[2]) for n in list_folders(spark, folder) if "=" in n)


def compact_ledger(spark: SparkSession, out: str, upto: int) -> None:
    """Move the ledger folders of the batches up to ``upto`` into the base, by shards of the id.

    A generation of the base holds the batches since the one before, so a compaction costs what it moves;
    after ``GENERATIONS`` they become one.  A generation is put in place by one rename, complete, before
    the folders it replaces go, and a row that is there twice does no harm, so this can be
    repeated after a failure.  It must not run beside a batch.
    """
    generations = _numbers(spark, f"{out}/ledger_base")
    batches = [b for b in _numbers(spark, f"{out}/ledger") if b <= upto]
    fresh = [b for b in batches if not generations or b > generations[-1]]
    stale = generations if len(generations) >= GENERATIONS else []
    if fresh:
        rows = spark.read.parquet(f"{out}/ledger").where(F.col("batch").isin(fresh))
        if stale:
            rows = rows.unionByName(spark.read.parquet(f"{out}/ledger_base").select(*rows.columns))
        made = f"{out}/ledger_new/{uuid.uuid4().hex}"
        rows.dropDuplicates(["email_id", "batch"]).withColumn("shard", _shard()).repartition("shard") \
            .write.partitionBy("shard").parquet(made)
        move_folder(spark, made, f"{out}/ledger_base/upto={max(fresh)}")
    folders = [f"ledger/batch={b}" for b in batches] + (
        [f"ledger_base/upto={g}" for g in stale] if fresh else [])
    for folder in folders:
        remove_folder(spark, f"{out}/{folder}")


def monitor(
    raw_stream: DataFrame, dims: Dimensions, out: str, checkpoint: str,
    scorer: Callable[[DataFrame], DataFrame], once: bool = False, interval: str = "60 seconds",
    dedup_horizon: str | None = None,
) -> StreamingQuery:
    """Run every new message through the analysis.  The checkpoint is the high-water mark.

    Copies are recognised by the ledger, without a limit in time.  ``dedup_horizon`` adds a
    state-store filter that drops copies arriving within that time before they reach a batch;
    its state is bounded by the horizon.
    """
    if dedup_horizon:
        raw_stream = raw_stream.withWatermark("modificationTime", dedup_horizon) \
            .dropDuplicatesWithinWatermark(["email_id"])

    dims = dims.checked()

    def each(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, dims, out, scorer)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            compact_ledger(batch.sparkSession, out, batch_id)

    writer = raw_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def reports_of(spark: SparkSession, out: str) -> DataFrame:
    return report_store.published(spark, f"{out}/reports")

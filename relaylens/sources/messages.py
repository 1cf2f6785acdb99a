"""Raw message input: files, trees, streams, deduplication, ledger and store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from relaylens import schemas
from relaylens.session import remove_staged, stage, staged_tables

EML_GLOB = "*.[eE][mM][lL]"


def read_messages(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole files as bytes.  A path that does not exist is an error."""
    return with_content_id(spark.read.format("binaryFile").load(list(paths)))


def read_message_tree(spark: SparkSession, root: str) -> DataFrame:
    """All ``.eml`` files below a folder, any letter case."""
    return with_content_id(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", EML_GLOB).load(root))


def stream_messages(spark: SparkSession, landing: str, per_batch: int | None = None) -> DataFrame:
    """Messages as they arrive in a landing folder."""
    reader = (
        spark.readStream.format("binaryFile").schema(schemas.RAW)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", EML_GLOB))
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return with_content_id(reader.load(landing))


def with_content_id(raw: DataFrame) -> DataFrame:
    """``email_id``: lower-case hex SHA-256 of the bytes."""
    return raw.withColumn("email_id", F.sha2("content", 256))


def first_paths(raw: DataFrame) -> DataFrame:
    """``email_id`` and the smallest ``path`` of each content; no content is read or moved.

    Copies are folded on the map side, so a message that fills a third of the input still sends
    one short row per task.
    """
    return raw.groupBy("email_id").agg(F.min("path").alias("path"))


def dedup_raw(raw: DataFrame) -> DataFrame:
    """One row per content, the copy with the smallest path; a null path only if no copy has one.
    Among copies of one path the smallest values of the other columns, in their order, stay.

    The raw table is read and hashed once, into a staged table, where every row has a locator: its file
    and position.  Winners are found on ids, locators and the narrow columns, combined on the map side.
    The rows to drop are the small side of an anti join on the locator, which Spark broadcasts where its
    size allows, so contents are read a second time only if the caller wants them, and not sorted.
    """
    table = stage(raw, "raw").select(
        *raw.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    others = [c for c in raw.columns if c not in ("email_id", "path", "content")]
    rank = F.struct(F.col("path").isNull().alias("none"), "path", *others, "_file", "_row")
    rows = table.select("email_id", rank.alias("rank"))
    first = rows.groupBy("email_id").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where(
        F.col("n") > 1).select(F.col("email_id").alias("_id"), "first")
    dropped = rows.join(first, F.col("email_id").eqNullSafe(F.col("_id"))).where(
        (F.col("rank._file") != F.col("first._file")) | (F.col("rank._row") != F.col("first._row"))).select(
        F.col("rank._file").alias("_in"), F.col("rank._row").alias("_at"))
    return table.join(dropped, (F.col("_file") == F.col("_in")) & (F.col("_row") == F.col("_at")),
                      "left_anti").select(*raw.columns)


def dedup_messages(messages: DataFrame) -> DataFrame:
    """The same on parsed or derived rows, which are much smaller than raw bytes."""
    return dedup_by(messages, "email_id", "path")


def dedup_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    kept = rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r"))
    return kept.select(key, "r.*")


def read_table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def store_raw(raw: DataFrame, store: str) -> None:
    """Content-addressed store: add the contents that it does not have yet.

    Equal ids mean equal bytes, so leaving a stored copy alone equals rewriting it.
    """
    before = staged_tables()
    fresh = dedup_raw(raw)
    stored = read_table_or_none(raw.sparkSession, store)
    if stored is not None:
        fresh = fresh.join(stored.select("email_id"), "email_id", "left_anti")
    fresh.write.mode("append").parquet(store)
    remove_staged(raw.sparkSession, before)


def high_water_mark(items: DataFrame, order: str = "uid") -> DataFrame:
    """One row with the largest id seen; 0 for no items."""
    return items.agg(F.coalesce(F.max(order), F.lit(0)).alias("high_water_mark"))


def newer_than(items: DataFrame, mark: DataFrame, order: str = "uid") -> DataFrame:
    """Items above the mark, which is a one-row table and becomes a scalar subquery."""
    return items.where(F.col(order) > mark.scalar())


def pending_messages(items: DataFrame, ledger: DataFrame, k: int | None = None,
                     key: str = "email_id", order: str = "uid") -> DataFrame:
    """Items the ledger does not list; with ``k`` only the first ones by ``order``."""
    left = items.join(ledger.select(key).distinct(), key, "left_anti")
    return left.orderBy(order).limit(k) if k else left


def quarantine(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed messages, and the ones that failed with their error text."""
    good = messages.where(F.col("error").isNull())
    bad = messages.where(F.col("error").isNotNull()).select("email_id", "path", "error")
    return good, bad

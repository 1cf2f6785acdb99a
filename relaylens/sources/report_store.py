"""A store of reports in batches, each of which a reader meets whole or not at all.

A batch's rows go to a folder of their own below ``data``.  When they are complete, a manifest of one row is
put in place by one rename; readers go by the manifests, so rows of a write that died are never
read.  The name of a manifest, ``batch.attempt.id``, is the name of its data folder; of several attempts of
one batch the last one counts.

Defined cases: an empty batch has a manifest without a newest report; a store without manifests is an
empty table of reports.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens import schemas
from relaylens.session import list_folders, move_folder, remove_folder
from relaylens.sources.reports import latest_report

REPORTS = f"source_stem string, processed_at timestamp, {schemas.REPORT}, batch int"


def _attempts(spark: SparkSession, target: str) -> dict[int, list[tuple[int, str]]]:
    """(attempt, name) of every manifest by batch; only names reach the driver, one per batch."""
    found: dict[int, list[tuple[int, str]]] = {}
    for name in list_folders(spark, f"{target}/manifests"):
        batch, attempt, _ = name.split(".")
        found.setdefault(int(batch), []).append((int(attempt), name))
    return found


def batches(spark: SparkSession, target: str) -> list[str]:
    """Names of the batches that can be read, one per batch."""
    return [max(names)[1] for _, names in sorted(_attempts(spark, target).items())]


def publish(reports: DataFrame, target: str, batch: int, order: str = "processed_at",
            tie_break: str = "id") -> str:
    """Write a batch and then its manifest; a batch written before is replaced in the same step."""
    spark = reports.sparkSession
    before = _attempts(spark, target).get(batch, [])
    name = f"{batch}.{max(before)[0] + 1 if before else 0}.{uuid.uuid4().hex}"
    data = f"{target}/data/{name}"
    reports.withColumn("batch", F.lit(batch)).write.parquet(data)
    made = f"{target}/pending/{name}"
    spark.read.parquet(data).agg(
        F.lit(name).alias("name"), F.count("*").alias("n_rows"),
        F.max(F.struct(F.col(order).alias("at"), F.col(tie_break).alias("tie"))).alias("newest")) \
        .coalesce(1).write.parquet(made)
    move_folder(spark, made, f"{target}/manifests/{name}")
    for _, old in before:  # a reader that has listed the old attempt may still hold its data
        remove_folder(spark, f"{target}/manifests/{old}")
    return name


def remove_unpublished(spark: SparkSession, target: str) -> None:
    """Remove data of writes that died and of replaced attempts; for times without a writer or reader."""
    live = set(batches(spark, target))
    for folder in ("data", "pending"):
        for name in list_folders(spark, f"{target}/{folder}"):
            if folder == "pending" or name not in live:
                remove_folder(spark, f"{target}/{folder}/{name}")


def published(spark: SparkSession, target: str, names: list[str] | None = None) -> DataFrame:
    """The reports of all batches, or of the named ones."""
    names = batches(spark, target) if names is None else names
    if not names:
        return spark.createDataFrame([], REPORTS)
    return spark.read.parquet(*(f"{target}/data/{n}" for n in names))


def latest_published(spark: SparkSession, target: str, order: str = "processed_at",
                     tie_break: str = "id") -> DataFrame:
    """The most recently processed report: found by the manifests, read from its batch alone."""
    names = batches(spark, target)
    if not names:
        return published(spark, target, names)
    newest = spark.read.parquet(*(f"{target}/manifests/{n}" for n in names)).agg(
        F.max_by("name", "newest")).first()[0]
    # Without any report every batch is empty.
    return latest_report(published(spark, target, [newest or names[0]]), order, tie_break)

"""Report sinks and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylens import schemas
from relaylens.functions.ranges import range_of
from relaylens.functions.text import null_if_empty


def source_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")) \
        .otherwise(name)


def write_reports(reports: DataFrame, target: str, mode: str = "append") -> None:
    """JSON lines with a ``source_stem`` column: many reports per file, spread over the tasks."""
    reports.write.mode(mode).json(target)


def read_reports(spark: SparkSession, target: str) -> DataFrame:
    """Reports back from JSON; a line that cannot be read keeps its text in ``_corrupt_record``."""
    schema = f"source_stem string, processed_at timestamp, {schemas.REPORT}, " \
             "_corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(target)


def latest_report(reports: DataFrame, order: str = "processed_at",
                  tie_break: str = "id") -> DataFrame:
    """The most recently processed report: an aggregate, combined per task, no sort."""
    newest = reports.agg(
        F.max_by(F.struct(*reports.columns), F.struct(order, tie_break)).alias("r"))
    return newest.where(F.col("r").isNotNull()).select("r.*")


def list_reports(reports: DataFrame, name: str = "source_stem") -> DataFrame:
    """Numbered listing by name; rows that could not be read keep a number and an error."""
    overall = F.col("overall_assessment")
    verdict = F.coalesce(null_if_empty(overall["overall_verdict"]), "classification",
                         F.lit("N/A"))
    score = F.coalesce(F.nullif(F.col("risk_score"), F.lit(0)), overall["combined_threat_score"])
    place = F.trim(F.concat(
        F.coalesce("city", F.lit("")), F.lit(" "), F.coalesce("country", F.lit(""))))
    broken = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in reports.columns \
        else F.lit(False)
    shown = reports.select(
        F.coalesce(name, F.lit("")).alias("file"), F.coalesce("id", F.lit("")).alias("id"),
        F.when(~broken, verdict).alias("verdict"),
        F.when(~broken, F.coalesce(score.cast("string"), F.lit("N/A"))).alias("score"),
        F.when(~broken, F.coalesce(null_if_empty(place), F.lit("Unknown"))).alias("origin"),
        F.when(~broken, F.substring(F.coalesce("subject", F.lit("N/A")), 1, 30))
        .alias("subject"),
        F.when(broken, F.lit("Error reading")).alias("error"),
    )
    return numbered(shown, ["file", "id"]).drop("id")


def numbered(rows: DataFrame, order: list[str], column: str = "no",
             rows_per_range: int = 1_000_000) -> DataFrame:
    """Add 1-based positions in the order of some text columns, without one global sort task.

    A sample of 20 keys per range gives the range bounds (the only thing the driver sees: one key
    per ``rows_per_range`` rows).  A row's range depends on its own key and the bounds alone, so
    its position inside the range plus the sizes of the ranges before it is its number.
    """
    keyed = rows.withColumn("_key", F.concat_ws("\u0000", *order))
    parts = -(-keyed.count() // rows_per_range)
    keys: list[str] = []
    if parts > 1:
        sample = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(20 * parts)
        keys = sorted((r["_key"] for r in sample.collect()), key=lambda k: k.encode())[20::20]
    placed = keyed.withColumn("_part", range_of(F.col("_key"), keys))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        F.col("_part").alias("_p"),
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    position = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return placed.withColumn("_pos", position) \
        .join(offsets, F.col("_part") == F.col("_p")) \
        .select((F.col("_pos") + F.col("_before")).alias(column), *rows.columns)


def summary_lines(traced: DataFrame) -> DataFrame:
    """One line per traced message: file, address, place, score."""
    place = F.coalesce(
        null_if_empty(F.col("estimate.country")), null_if_empty(F.col("origin_geo.country")),
        F.lit("Unknown"))
    return traced.select(
        F.substring_index("path", "/", -1).alias("file"),
        F.coalesce("origin_ip", F.lit("None")).alias("ip"), place.alias("location"),
        F.col("trace_risk_score").alias("risk"),
    ).withColumn("line", F.format_string(
        "%-30s IP: %-15s Loc: %-15s Risk: %d/100", "file", "ip", "location", "risk"))


def export_batch(traced_reports: DataFrame) -> DataFrame:
    """``value``: one JSON document ``{file, report}`` per message."""
    fields = [c for c in traced_reports.columns if c != "path"]
    return traced_reports.select(F.to_json(F.struct(
        F.substring_index("path", "/", -1).alias("file"),
        F.struct(*fields).alias("report"))).alias("value"))

"""Shards of near equal bytes by sampled splitters, in DataFrame operations only.

The order of the records is (hash of the text, id), so equal texts stay next to each other.

1. Records are drawn with a probability in proportion to their size; quantiles of the drawn keys are
   the splitters of about ``RECORDS_PER_RANGE`` records each.
2. Every range is measured.  A key heavier than a range's share of the bytes (by the pigeonhole
   principle there are no more of them than ranges) is split by a hash of the id into parts of
   its own; other overfull ranges are subdivided by a hash of the key.
3. Running sums within the ranges plus the sums before them give every record its exact place in the
   order; the middle of a record, in bytes, decides its shard.  Groups of equal texts of at most
   ``WHOLE_GROUP`` of a shard go by the middle of the group, so they are not cut.

Only id, size, checksum and key are shuffled, never a text, and no task holds more than one range.

Defined cases: a null text has size 8 and checksum 0; a null id is a record like others; repeated rows
get a slot each; an empty table gives no rows; more shards than records leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.functions.ranges import range_of
from relaylens.llm.common import written

SHARDS = 24
RECORDS_PER_RANGE = 1_000_000
LEAST_RANGES = 96
DRAWS_PER_RANGE = 200
WHOLE_GROUP = 0.002
HEADER = 8


def _part(by: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(by, F.lit("part")), parts).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sized = written(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body) + HEADER).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("key")), "sized")
    whole = sized.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    total = max(1, whole["bytes"] or 0)
    ranges = max(LEAST_RANGES, -(-whole["n"] // RECORDS_PER_RANGE))
    share = -(-total // ranges)

    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = sized.where(draw < F.col("size") * (DRAWS_PER_RANGE * ranges / total))
    found = drawn.agg(F.percentile_approx(
        "key", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("q")).first()["q"]
    keyed = sized.withColumn("range", range_of(F.col("key"), sorted(set(found or []))))

    heavy = keyed.groupBy("key").agg(F.sum("size").alias("heavy")).where(F.col("heavy") > share) \
        .withColumnRenamed("key", "_key")
    # At most ``ranges`` keys can be heavier than total / ranges, and ``light`` has one row per range, so
    # these sides are bounded.  Were they shuffled, a range would stay in one task with all its parts.
    marked = keyed.join(F.broadcast(heavy), F.col("key") == F.col("_key"), "left").drop("_key")
    light = marked.where(F.col("heavy").isNull()).groupBy(F.col("range").alias("_range")).agg(
        F.sum("size").alias("light"))
    placed = marked.join(F.broadcast(light), F.col("range") == F.col("_range"), "left").withColumns({
        # light parts are numbered from 0, those of heavy keys by their key
        "own": F.when(F.col("heavy").isNotNull(), F.col("key")),
        "part": F.when(F.col("heavy").isNotNull(), _part("doc_id", F.ceil(F.col("heavy") / share)))
        .otherwise(_part("key", F.ceil(F.col("light") / (2 * share))))}).drop("_range", "heavy", "light")

    unit = ["range", "own", "part"]
    order = [F.col(c).asc_nulls_first() for c in unit]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    units = placed.groupBy(*unit).agg(F.sum("size").alias("b"), F.count("*").alias("r")).select(
        *(F.col(c).alias(f"_{c}") for c in unit),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("r").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy(*unit).orderBy("key", "doc_id", "text_crc32", "size")
    group = Window.partitionBy(*unit, "key")
    running = placed.withColumns({
        "end": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "row": F.row_number().over(inside)})
    grouped = running.withColumns({
        "group_start": F.min(F.col("end") - F.col("size")).over(group),
        "group_end": F.max("end").over(group)})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in unit]
    small = (F.col("group_end") - F.col("group_start")) <= int(WHOLE_GROUP * total / shards)
    twice = F.when(small, F.col("group_start") + F.col("group_end")).otherwise(
        2 * F.col("end") - F.col("size")) + 2 * F.col("bytes_before")
    positions = written(grouped.join(units, same[0] & same[1] & same[2]).select(
        "doc_id", "size", "text_crc32",
        F.least(F.lit(shards - 1), F.floor(twice.cast("decimal(38,0)") * shards / (2 * total)))
        .cast("int").alias("shard"),
        (F.col("rows_before") + F.col("row") - 1).alias("place")), "placed")
    first = positions.groupBy(F.col("shard").alias("_shard")).agg(F.min("place").alias("first"))
    return positions.join(first, F.col("shard") == F.col("_shard")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Chat formatting after collapse of cumulative snapshots, in DataFrame operations only.

A logged conversation whose turns are the first turns of a longer one, or equal to another one, is a
snapshot; only maximal conversations are rendered, and of equal ones the smallest id.

* Every turn gets a 128-bit hash of its place, role and text.  The hash of a prefix is the running
  XOR of the hashes of its turns, so it rolls from turn to turn.
* Prefix hashes are folded by a map-side combined ``distinct``, so a first turn or conversation that
  is everywhere costs one row per task; two anti-joins keep what is no prefix and no copy.
* A conversation is handled in parts of ``PART`` turns with carried hashes and counts.  So a
  conversation that holds a third of all rows is spread over tasks, and it is rendered as several
  rows; any other gives one row.

Defined cases: a null role or text differs from an empty one but is rendered empty; equal rows are one
turn; turns with one number follow in the order of role and text, null numbers first; a null id is an
id like others, smaller than all; ``<|`` in a text is rendered ``< |``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.llm.common import written

PART = 1024


def _null_first(c: str) -> Column:
    return F.col(c).asc_nulls_first()


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), F.coalesce("role", F.lit("")),
                      F.col("text").isNull(), F.coalesce("text", F.lit("")))


def rendered_turn() -> Column:
    def safe(c: str) -> Column:
        return F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))

    return F.concat(F.lit("<|"), safe("role"), F.lit("|>\n"), safe("text"), F.lit("<|end|>\n"))


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, part) with ``place`` from 1 and prefix hashes ``a`` and ``b``."""
    part = F.coalesce(F.floor(F.col("turn") / PART), F.lit(-1))
    turns = turns.distinct().withColumn("part", part)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def carried(sums: DataFrame, names: dict[str, Column]) -> DataFrame:
        return sums.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"),
                           *(c.alias(n) for n, c in names.items()))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv"))
                         & (F.col("part") == F.col("_part"))).drop("_conv", "_part")

    counts = carried(turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")), {
        "before": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    inside = Window.partitionBy("conv_id", "part").orderBy(*map(_null_first, ("turn", "role", "text")))
    placed = joined(turns.withColumn("row", F.row_number().over(inside)), counts).withColumn(
        "place", F.col("before") + F.col("row")).drop("before", "row")
    hashed = placed.withColumns({"x": _turn_hash(1), "y": _turn_hash(2)})
    sums = carried(hashed.groupBy("conv_id", "part").agg(
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")), {
        "x_before": F.coalesce(F.bit_xor("x").over(earlier), F.lit(0)),
        "y_before": F.coalesce(F.bit_xor("y").over(earlier), F.lit(0))})
    upto = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return joined(hashed.withColumns({
        "x": F.bit_xor("x").over(upto), "y": F.bit_xor("y").over(upto)}), sums).withColumns({
        "a": F.col("x").bitwiseXOR(F.col("x_before")),
        "b": F.col("y").bitwiseXOR(F.col("y_before"))}).drop("x", "y", "x_before", "y_before")


def collapse(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``part`` (from 0), ``n_turns``, ``snapshots`` (equal conversations), ``rendered``."""
    turns = written(with_prefix_hashes(conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")), "turns")
    key = ["place", "a", "b"]
    last = turns.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("last")).select("conv_id", "last.*")
    longest = last.select(F.col("conv_id").alias("_conv"), F.col("place").alias("n"))
    proper = turns.select("conv_id", *key).join(
        longest, F.col("conv_id").eqNullSafe(F.col("_conv"))).where(
        F.col("place") < F.col("n")).select(*key).distinct()
    first = last.groupBy(*key).agg(
        F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("first"),
        F.count("*").alias("snapshots"))
    kept = first.join(proper, key, "left_anti").select(
        F.col("first.conv_id").alias("_conv"), F.col("place").alias("n_turns"), "snapshots")
    lines = turns.withColumns({"line": rendered_turn(), "slice": F.floor((F.col("place") - 1) / PART)}) \
        .join(kept, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return lines.groupBy("conv_id", F.col("slice").alias("part")).agg(
        F.first("n_turns").alias("n_turns"), F.first("snapshots").alias("snapshots"),
        F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines")).select(
        "conv_id", "part", "n_turns", "snapshots",
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


ORACLE = r"""
WITH turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
    '<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10)
         || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS line
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
prefixes AS (
  SELECT conv_id, place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY place
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rendered
  FROM turns),
last AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS snapshots, rendered
  FROM prefixes WHERE place = n_turns GROUP BY n_turns, rendered)
SELECT conv_id, CAST(0 AS BIGINT) AS part, n_turns, snapshots, rendered FROM last
WHERE rendered NOT IN (SELECT rendered FROM prefixes WHERE place < n_turns)
"""

"""Cutting overlapping ranges into disjoint pieces; the narrowest range wins everywhere.

Works on any key that orders the same way in Spark and in Python (numbers, hex digits).  Ranges are dealt
to segments between splitters, which are quantiles of a sample of the cut points.  A range is a row of
the segments of its two ends, clipped to them; of the ranges that cover a segment whole only the narrowest
matters, and that is found over power-of-two groups of segments, so a wide range costs a few rows however
many segments it spans.  A segment is then swept in the order of its cut points with a heap of open ranges.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.session import stage


def sweep(starts: list, ends: list, order: list) -> Iterator[tuple]:
    """(start, end, number of the winner) between neighbouring cut points that some range covers.

    Ranges hold ``start`` but not ``end``; of the open ones the one of the smallest ``order`` wins.
    """
    rows = sorted(range(len(starts)), key=starts.__getitem__)
    cuts = sorted({*starts, *ends})
    at, open_ = 0, []
    for cut, following in zip(cuts, cuts[1:]):
        while at < len(rows) and starts[rows[at]] <= cut:
            heapq.heappush(open_, (*order[rows[at]], rows[at]))
            at += 1
        while open_ and ends[open_[0][-1]] <= cut:
            heapq.heappop(open_)
        if open_:
            yield cut, following, open_[0][-1]


def _swept(rows: pa.Table) -> pa.Table:
    columns = [rows.column(c).to_pylist() for c in ("start", "end", "width", "lo")]
    pieces = [*sweep(*columns[:2], [*zip(*columns[2:])])]
    start, end, winner = zip(*pieces) if pieces else ((), (), ())
    return pa.table({
        "lo": pa.array(start, rows.schema.field("start").type), "end": pa.array(end, rows.schema.field("end").type),
        "rec": rows.column("rec").take(pa.array(winner, pa.int64()))})


def pieces(ranges: DataFrame, last, splitters: Callable[[DataFrame], list],
           segment: Callable[[Column, list], Column]) -> DataFrame:
    """``lo, end, width, rec`` (``end`` exclusive, below or at ``last``) to disjoint ``lo, end, rec``.

    Of ranges of one width the one that starts first wins, of equal ranges the one of the smallest ``rec``.
    A piece ends at every cut point, start or end of a range, as far as a range covers it.
    """
    best = F.min(F.struct("width", "lo", "rec")).alias("best")
    # Written, because it is read three times, and later conditions would be worked out below the grouping.
    base = stage(ranges.groupBy("lo", "end", "width").agg(F.min("rec").alias("rec")), "ranges")
    borders = splitters(base.select(F.explode(F.array("lo", "end")).alias("at")).where(
        F.col("at") < F.lit(last)).distinct())
    bounds = F.lit(borders) if borders else F.array().cast(T.ArrayType(ranges.schema["lo"].dataType))
    count = len(borders) + 1
    starts = F.when(F.col("segment") > 0, F.get(bounds, F.col("segment") - 1))
    ends = F.coalesce(F.get(bounds, F.col("segment")), F.lit(last))
    # Written too: both readings below filter by the segments, which would be searched again for every filter.
    placed = stage(base.withColumns({
        "first": segment(F.col("lo"), borders), "to": segment(F.col("end"), borders)}), "placed")
    ended = placed.select("*", F.explode_outer(F.array_distinct(F.array("first", "to"))).alias("segment")).select(
        "segment", F.greatest("lo", starts).alias("start"), F.least("end", ends).alias("end"), "width", "lo",
        "rec").where(F.col("start") < F.col("end"))
    # Segments first + 1 to to - 1 are covered: groups of 2^k of them, each inside the range, its double not.
    # Of the ranges between the same two segments one can win, so only one is spread over groups.
    across = placed.where(F.col("to") - F.col("first") > 1).groupBy("first", "to").agg(best)
    groups = across.select(
        "best.*", (F.col("first") + 1).alias("a"), F.col("to").alias("b"),
        F.explode_outer(F.sequence(F.lit(0), F.lit(count.bit_length()))).alias("k")).withColumns({
            "_from": F.expr("shiftright(a + shiftleft(1, k) - 1, k)"), "_to": F.expr("shiftright(b, k) - 1"),
        }).where(F.col("_from") <= F.col("_to"))
    whole = groups.select("*", F.explode_outer(F.array_distinct(F.array("_from", "_to"))).alias("group")).where(F.expr(
        "shiftleft(shiftright(group, 1), k + 1) < a OR shiftleft(shiftright(group, 1) + 1, k + 1) > b")) \
        .groupBy("k", "group").agg(best)  # at most two rows a segment
    covering = whole.select("best", F.explode_outer(F.sequence(
        F.expr("shiftleft(group, k)"), F.expr("shiftleft(group + 1, k) - 1"))).alias("segment")).groupBy(
        "segment").agg(F.min("best").alias("best")).select(
        "segment", starts.alias("start"), ends.alias("end"), "best.*")
    # Clipped ranges that have become equal are one, so many ranges of one start are few rows.
    clipped = ended.unionByName(covering).groupBy("segment", "start", "end").agg(best)
    kinds = {f.name: f.dataType for f in ranges.schema}
    return clipped.select("segment", "start", "end", "best.*").groupBy("segment").applyInArrow(
        _swept, T.StructType([T.StructField("lo", kinds["lo"]), T.StructField("end", kinds["end"]),
                              T.StructField("rec", kinds["rec"])]))

"""IPv6 ranges on 32 hex digits: cutting nested ranges, look-up, splitters.

Addresses compare as text, so 128 bits need no arithmetic.  Nothing here depends on how addresses
cluster: rows are dealt to segments between splitters, which are quantiles of a sample of the keys at
hand, so a segment holds about its share also where all addresses lie in one provider's block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.functions.ranges import range_of
from relaylens.operators import cutting

DIGITS = "0123456789abcdef"
LENGTH = 32
BEYOND = "g"  # after the last address
#: Segments per shuffle partition, so that a task's segments average out, and at most.
PER_PARTITION, MOST_SEGMENTS = 16, 4096
SAMPLED = 20  # keys per segment


def successor(h: Column) -> Column:
    """The next address; null after the last one."""
    tail = LENGTH - F.length(F.rtrim(h, F.lit("f")))
    at = LENGTH - tail
    return F.when(at > 0, F.concat(
        F.substring(h, F.lit(1), at - 1),
        F.translate(F.substring(h, at, F.lit(1)), DIGITS[:-1], DIGITS[1:]), F.repeat(F.lit("0"), tail)))


def predecessor(h: Column) -> Column:
    """The address before; null before the first one."""
    tail = LENGTH - F.length(F.rtrim(h, F.lit("0")))
    at = LENGTH - tail
    return F.when(at > 0, F.concat(
        F.substring(h, F.lit(1), at - 1),
        F.translate(F.substring(h, at, F.lit(1)), DIGITS[1:], DIGITS[:-1]), F.repeat(F.lit("f"), tail)))


def width(lo: Column, hi: Column) -> Column:
    """``hi - lo`` as two unsigned 64-bit halves, which order as the difference does."""
    def half(c: Column, start: int) -> Column:
        return F.conv(F.substring(c, start, 16), 16, 10).cast("decimal(20,0)")

    low = half(hi, 17) - half(lo, 17)
    borrow = low < 0
    return F.struct(
        (half(hi, 1) - half(lo, 1) - borrow.cast("int")).cast("decimal(21,0)").alias("high"),
        F.when(borrow, low + F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(low)
        .cast("decimal(21,0)").alias("low"))


def blocks(lo: Column, hi: Column) -> Column:
    """Prefixes whose blocks make up the range, none of them inside another one.

    A block of the next shorter prefix that lies in the range is taken whole, so there are at most 15 at
    each end for each length, and one for an aligned network.
    """
    levels = F.sequence(F.lit(1), F.lit(LENGTH))
    digits = F.lit(list(DIGITS))
    shared = F.size(F.filter(levels, lambda n: F.substring(lo, F.lit(1), n) == F.substring(hi, F.lit(1), n)))
    zeros = LENGTH - F.length(F.rtrim(lo, F.lit("0")))
    efs = LENGTH - F.length(F.rtrim(hi, F.lit("f")))

    def edge(c: Column, aligned: Column, beyond) -> Column:
        """The block at one end and, level by level, its siblings towards the other end."""
        last = F.greatest(shared + 1, LENGTH - aligned)
        siblings = F.flatten(F.transform(
            F.filter(levels, lambda n: (n >= shared + 2) & (n <= last)),
            lambda n: F.transform(
                F.filter(digits, lambda d: beyond(d, F.substring(c, n, F.lit(1)))),
                lambda d: F.concat(F.substring(c, F.lit(1), n - 1), d))))
        return F.array_append(siblings, F.substring(c, F.lit(1), last))

    middle = F.transform(
        F.filter(digits, lambda d: (d > F.substring(lo, shared + 1, F.lit(1)))
                 & (d < F.substring(hi, shared + 1, F.lit(1)))),
        lambda d: F.concat(F.substring(lo, F.lit(1), shared), d))
    whole = (zeros >= LENGTH - shared) & (efs >= LENGTH - shared)
    return F.when(whole, F.array(F.substring(lo, F.lit(1), shared))).otherwise(F.concat(
        edge(lo, zeros, lambda d, own: d > own), middle, edge(hi, efs, lambda d, own: d < own)))


def splitters(keys: DataFrame) -> list[str]:
    """Borders of segments that hold about equally many of the keys (column ``at``).

    The sample is the keys of smallest hash, so it is the same in every run; its size is bounded by the
    number of shuffle partitions, not by the data.
    """
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = min(MOST_SEGMENTS, PER_PARTITION * partitions)
    drawn = sorted({r["at"] for r in keys.select("at").orderBy(
        F.xxhash64("at"), "at").limit(SAMPLED * segments).collect()})
    return sorted({drawn[i * len(drawn) // segments] for i in range(1, segments)}) if drawn else []


def segment(at: Column, borders: list[str]) -> Column:
    return range_of(at, borders).cast("int")


def disjoint(ranges: DataFrame) -> DataFrame:
    """Cut overlapping ranges (``lo6``, ``hi6``) into disjoint ones; the narrowest wins everywhere.

    Every range meets the cut points of the segments of its two ends only (see cutting).
    """
    payload = [c for c in ranges.columns if c not in ("lo6", "hi6")]
    w = width(F.col("lo6"), F.col("hi6"))
    # Digits order as the numbers do; a struct would not travel as one comparable value.
    wide = F.concat(*[F.lpad(w[c].cast("string"), 20, "0") for c in ("high", "low")])
    base = ranges.where(F.col("lo6") <= F.col("hi6")).select(
        F.col("lo6").alias("lo"), F.coalesce(successor(F.col("hi6")), F.lit(BEYOND)).alias("end"),
        wide.alias("width"), F.struct(*payload).alias("rec"))
    return cutting.pieces(base, BEYOND, splitters, segment).select(
        F.col("lo").alias("lo6"), F.when(F.col("end") == BEYOND, F.lit("f" * LENGTH)).otherwise(
            predecessor(F.col("end"))).alias("hi6"), "rec.*")


def overlapping(dims: dict[str, DataFrame]) -> set[str]:
    """Names of the tables (``lo6``, ``hi6``) in which two ranges share an address.

    Of overlapping ranges two are neighbours in the order of their starts, so a range meets only the
    next one; the borders between segments are met here, from one row per segment.
    """
    rows = None
    for name, dim in dims.items():
        own = dim.where(F.col("lo6") <= F.col("hi6")).select(
            F.lit(name).alias("name"), F.col("lo6").alias("at"), F.col("hi6").alias("end"))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return set()
    borders = splitters(rows)
    order = Window.partitionBy("name", "segment").orderBy("at", "end")
    sums = rows.withColumn("segment", segment(F.col("at"), borders)).withColumn(
        "next", F.lead("at").over(order)).groupBy("name", "segment").agg(
        F.min("at").alias("first"), F.max_by("end", F.struct("at", "end")).alias("end"),
        F.max(F.coalesce(F.col("next") <= F.col("end"), F.lit(False))).alias("met")).collect()
    found, before = set(), {}
    for r in sorted(sums, key=lambda r: r["segment"]):  # at most MOST_SEGMENTS rows a table
        if r["met"] or before.get(r["name"], "") >= r["first"]:
            found.add(r["name"])
        before[r["name"]] = r["end"]
    return found


def lookup(ips: DataFrame, dims: dict[str, DataFrame], payload) -> DataFrame:
    """Add to each address (``ip_hex``) one struct per dimension: ``payload(dim)`` of its range.

    The ranges of a dimension are disjoint.  A range is copied to each segment that it touches, at most
    one copy more per border; inside a segment a running ``last`` in the order of addresses carries the
    latest range to each address.
    """
    keys = ips.select(F.col("ip_hex").alias("at"))
    valid = {n: d.where(F.col("lo6") <= F.col("hi6")) for n, d in dims.items()}
    for dim in valid.values():
        keys = keys.unionByName(dim.select(F.col("lo6").alias("at")))
    borders = splitters(keys)
    bounds = F.lit(borders).cast("array<string>")
    marks = ips.select(
        segment(F.col("ip_hex"), borders).alias("segment"), F.col("ip_hex").alias("at"),
        F.lit(1).alias("kind"), F.struct(*ips.columns).alias("ask"))
    for name, dim in valid.items():
        copies = dim.select(
            "lo6", F.struct("hi6", payload(dim).alias("rec")).alias(name), F.explode(F.sequence(
                segment(F.col("lo6"), borders), segment(F.col("hi6"), borders))).alias("segment"))
        start = F.when(F.col("segment") > 0, F.get(bounds, F.col("segment") - 1))
        marks = marks.unionByName(copies.select(
            "segment", F.greatest("lo6", start).alias("at"), F.lit(0).alias("kind"), name),
            allowMissingColumns=True)
    order = Window.partitionBy("segment").orderBy("at", "kind") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.select("at", "kind", "ask", *[
        F.last(n, ignorenulls=True).over(order).alias(n) for n in dims]).where(F.col("kind") == 1)
    return found.select("ask.*", *[
        F.when(F.col("at") <= F.col(f"{n}.hi6"), F.col(f"{n}.rec")).alias(n) for n in dims])

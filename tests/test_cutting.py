import random

import pytest
from pyspark.sql import functions as F

from relaylens.operators import cutting, geo, ranges6


def brute(rows, last):
    """Pieces by trying every range at every cut point; ``rows`` are (lo, end, name)."""
    cuts = sorted({p for lo, end, _ in rows for p in (lo, end)})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        open_ = [(end - lo, lo, name) for lo, end, name in rows if lo <= a < end]
        if open_:
            out.append((a, b, min(open_)[2]))
    return out


@pytest.mark.parametrize("per_partition", [1, 16, 200])
def test_pieces_are_those_of_every_range_at_every_cut_point(spark, monkeypatch, per_partition):
    monkeypatch.setattr(ranges6, "PER_PARTITION", per_partition)
    rng = random.Random(per_partition)
    rows = [(0, 5000, "all"), (0, 5000, "all again"), (0, 1, "first"), (4999, 5000, "last")]
    for i in range(400):  # a third start at one point, some cover most segments, some repeat
        lo = 100 if i % 3 == 0 else rng.randrange(4900)
        rows.append((lo, min(lo + rng.choice([1, 2, 50, 700, 4000]) + i % 7, 5000), f"r{i:03}"))
    rows += rows[50:90]
    df = spark.createDataFrame(
        [(lo, end, end - lo, (name,)) for lo, end, name in rows],
        "lo long, end long, width long, rec struct<name:string>")
    got = cutting.pieces(df, 1 << 40, ranges6.splitters, ranges6.segment)
    assert sorted((r.lo, r.end, r.rec.name) for r in got.collect()) == brute(rows, 5000)


def test_cut_ipv6_ranges_up_to_the_last_address(spark):
    top = (1 << 128) - 1
    rows = [(0, top, "all"), (top, top, "end"), (top - 9, top, "tail"), (0, 0, "zero"), (5, 4, "void")]
    df = spark.createDataFrame([(f"{lo:032x}", f"{hi:032x}", c) for lo, hi, c in rows],
                               "lo6 string, hi6 string, country string")
    got = sorted((int(r.lo6, 16), int(r.hi6, 16), r.country) for r in ranges6.disjoint(df).collect())
    assert got == [(0, 0, "zero"), (1, top - 10, "all"), (top - 9, top - 1, "tail"), (top, top, "end")]
    assert ranges6.disjoint(df.limit(0)).collect() == [] == geo.disjoint_ranges(
        spark.createDataFrame([], "lo long, hi long, country string")).collect()


def test_a_wide_range_is_few_rows_however_many_segments(spark, capsys):
    """The cut joins no key with all cut points: no join is in its plan."""
    df = spark.range(50).select(
        F.lpad(F.hex("id"), 32, "0").alias("lo6"), F.lit("f" * 32).alias("hi6"), F.lit("x").alias("country"))
    ranges6.disjoint(df).explain()
    assert "Join" not in capsys.readouterr().out

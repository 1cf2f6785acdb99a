import random

from pyspark.sql import functions as F

from relaylens import schemas
from relaylens.operators import geo
from relaylens.plans.analysis import Dimensions, address_intel


def test_narrowest_range_wins(spark):
    rng = random.Random(5)
    top = 1 << 32
    ranges = [(0, top - 1, "all"), (5, 5, "one"), (65530, 65540, "edge")]
    for i in range(150):
        width = rng.choice([1, 3, 256, 65536, 70000, 1 << 24, 1 << 28])
        lo = rng.randrange(top - width) if i % 2 else rng.randrange(200_000)
        ranges.append((lo, min(lo + width - 1, top - 1), f"r{i}"))
    ranges.append((ranges[7][0], ranges[7][1], "z-duplicate"))
    dim = spark.createDataFrame(ranges, "lo long, hi long, country string")
    points = {0, 5, 6, 65529, 65530, 65535, 65536, 65540, 65541, top - 1}
    for lo, hi, _ in ranges:
        points |= {lo, hi, max(lo - 1, 0), min(hi + 1, top - 1), (lo + hi) // 2}
    asked = spark.createDataFrame([(str(p), p) for p in points], "ip string, ip_num long")
    got = {r.ip_num: r.c for r in geo.range_lookup(
        asked, {"d": geo.disjoint_ranges(dim)}).select(
            "ip_num", F.col("d.country").alias("c")).collect()}
    assert len(got) == len(points)
    for p in points:
        best = min((hi - lo, lo, hi, name) for lo, hi, name in ranges if lo <= p <= hi)
        assert got[p] == best[3], p


def test_disjoint_lookup_misses_gaps_and_keeps_other_rows(spark):
    dim = spark.createDataFrame([(10, 20, "a"), (65530, 200_000, "b")],
                                "lo long, hi long, country string")
    asked = spark.createDataFrame(
        [("w", 9), ("x", 20), ("y", 21), ("z", 131_072), ("v6", None)], "ip string, ip_num long")
    got = dict(geo.range_lookup(asked, {"d": dim}).select("ip", "d.country").collect())
    assert got == {"w": None, "x": "a", "y": None, "z": "b", "v6": None}


def dims(spark):
    city = spark.createDataFrame(
        [(0, (1 << 31) - 1, "Land", "LD"), (1 << 31, (1 << 32) - 1, None, None)],
        "lo long, hi long, country string, country_code string")
    asn = spark.createDataFrame(
        [(0, 1 << 30, "AS1", "Lawson Net"), (1 << 31, (1 << 32) - 1, "AS2", "Plain")],
        schemas.ASN_RANGES)
    second = spark.createDataFrame(
        [(1 << 31, (1 << 32) - 1, "Other", "Second ISP")],
        "lo long, hi long, country string, isp string")
    ptr = spark.createDataFrame([("5.5.5.5", "five.example")], schemas.PTR)
    return city, asn, second, ptr


def usage(spark):
    values = ["5.5.5.5"] * 3 + ["70.1.1.1", "200.1.1.1", "10.0.0.1", "bad", "2607:f8b0::1"]
    return spark.createDataFrame([(v,) for v in values], "ip string")


def test_intel(spark):
    city, asn, second, ptr = dims(spark)
    got = {r.ip: r for r in geo.ip_intel(usage(spark), city, asn, second, ptr).collect()}
    five = got["5.5.5.5"]
    assert (five.uses, five.country, five.isp, five.reverse_dns) == (
        3, "Land", "Lawson Net", "five.example")
    assert five.infrastructure_type == "datacenter/hosting", "a keyword matches inside a word"
    assert five.sources == ["range_table", "ptr_lookup"]
    assert got["70.1.1.1"].infrastructure_type == "unknown"
    other = got["200.1.1.1"]
    assert (other.country, other.isp, other.asn) == ("Other", "Second ISP", "AS2")
    assert other.sources == ["range_table", "second_source"]
    assert got["10.0.0.1"].infrastructure_type == "internal network"
    assert got["bad"].error == "invalid IP address"
    assert got["2607:f8b0::1"].error is None


def test_offline_leaves_out_the_second_source(spark):
    city, asn, *_ = dims(spark)
    got = {r.ip: r for r in geo.ip_intel(usage(spark), city, asn).collect()}
    assert got["200.1.1.1"].country is None and got["5.5.5.5"].reverse_dns is None


def test_hot_addresses_reach_every_message(spark, monkeypatch):
    monkeypatch.setattr(geo, "HOT_ADDRESSES", 1)
    facts = spark.range(300).select(
        F.col("id").cast("string").alias("email_id"),
        F.array(F.lit("5.5.5.5"), F.concat(F.lit("7.7.7."), (F.col("id") % 20).cast("string")))
        .alias("lookup_ips"))
    city, *_ = dims(spark)
    intel = address_intel(facts, Dimensions(city))
    got = geo.attach_intel(facts, intel).select(
        F.size("intel").alias("n"), geo.intel_of(F.lit("5.5.5.5"))["country"].alias("c")).collect()
    assert len(got) == 300 and all((r.n, r.c) == (2, "Land") for r in got)


def wide(n):
    return f"{n:032x}"


def test_blocks_make_up_the_range(spark):
    from relaylens.operators import ranges6

    rng, top = random.Random(11), (1 << 128) - 1
    ranges = [(0, top), (0, 0), (top, top), (0, 15), (1, 16), (16, 31), (15, 16), (1 << 127, top)]
    for _ in range(60):
        lo = rng.getrandbits(128) >> rng.choice([0, 4, 90, 120])
        ranges.append((lo, min(top, lo + (rng.getrandbits(128) >> rng.choice([1, 8, 64, 100, 120])))))
    df = spark.createDataFrame([(wide(a), wide(b)) for a, b in ranges], "lo6 string, hi6 string")
    got = df.select("lo6", "hi6", ranges6.blocks(F.col("lo6"), F.col("hi6")).alias("b"),
                    ranges6.successor(F.col("hi6")).alias("after"),
                    ranges6.predecessor(F.col("lo6")).alias("before"),
                    ranges6.width(F.col("lo6"), F.col("hi6")).alias("w")).collect()
    for r in got:
        lo, hi = int(r.lo6, 16), int(r.hi6, 16)
        covered = sorted((int(b.ljust(32, "0"), 16), int(b.ljust(32, "f"), 16)) for b in r.b)
        assert covered[0][0] == lo and covered[-1][1] == hi
        assert all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:]))
        assert len(r.b) <= 2 * 15 * 32
        assert r.after == (wide(hi + 1) if hi < top else None)
        assert r.before == (wide(lo - 1) if lo else None)
        assert (int(r.w.high) << 64) + int(r.w.low) == hi - lo


def six_points(ranges):
    top = (1 << 128) - 1
    points = set()
    for lo, hi, _ in ranges:
        points |= {lo, hi, max(lo - 1, 0), min(hi + 1, top), (lo + hi) // 2}
    return sorted(points)


def test_nested_ipv6_ranges_give_the_narrowest(spark, monkeypatch):
    from relaylens.operators import ranges6

    monkeypatch.setattr(ranges6, "PER_PARTITION", 3)
    rng, net = random.Random(3), 0x2A0226F7 << 96
    ranges = [(0, (1 << 128) - 1, "all"), (net, net + (1 << 96) - 1, "block"),
              (net - 5, net + 5, "border"), (net + 7, net + 7, "one"), (net + 7, net + 7, "a-twin")]
    for i in range(120):
        size = 1 << rng.choice([0, 1, 7, 40, 64, 80, 94])
        lo = net + rng.randrange(1 << 96) // size * size - rng.choice([0, 0, 3])
        ranges.append((lo, lo + size - 1 + rng.choice([0, 0, 9]), f"r{i}"))
    dim = spark.createDataFrame([(None, None, wide(a), wide(b), c) for a, b, c in ranges],
                                "lo long, hi long, lo6 string, hi6 string, country string")
    points = six_points(ranges)
    asked = spark.createDataFrame([(wide(p), None, wide(p)) for p in points],
                                  "ip string, ip_num long, ip_hex string")
    dims = geo.without_overlaps({"d": dim, "plain": dim.where("country = 'block'")})
    assert ranges6.overlapping({"d": dims["d"]}) == set()
    got = {int(r.ip, 16): (r.a, r.b) for r in geo.range_lookup(asked, dims).select(
        "ip", F.col("d.country").alias("a"), F.col("plain.country").alias("b")).collect()}
    assert len(got) == len(points)
    for p in points:
        best = min((hi - lo, lo, name) for lo, hi, name in ranges if lo <= p <= hi)
        assert got[p] == (best[2], "block" if net <= p < net + (1 << 96) else None), wide(p)


def test_addresses_of_one_block_spread_over_segments(spark):
    from relaylens.operators import ranges6

    rng, net = random.Random(8), 0x2A0226F7 << 96
    keys = spark.createDataFrame([(wide(net + rng.getrandbits(90)),) for _ in range(20_000)], "at string")
    borders = ranges6.splitters(keys)
    sizes = [r["count"] for r in keys.groupBy(ranges6.segment(F.col("at"), borders).alias("s")).count().collect()]
    assert len(sizes) == len(borders) + 1 == 64  # 16 for each of the 4 shuffle partitions
    tasks = [r["count"] for r in keys.select(ranges6.segment(F.col("at"), borders).alias("s")).repartition(
        4, "s").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * sorted(sizes)[32] and max(tasks) < 2 * sorted(tasks)[2]


def test_checked_dimensions_are_disjoint_and_written_once(spark):
    city = spark.createDataFrame([(0, 100, "out"), (10, 20, "in")], "lo long, hi long, country string")
    asn = spark.createDataFrame([(0, 9, "AS1", "x")], schemas.ASN_RANGES)
    checked = Dimensions(city, asn).checked()
    assert checked.disjoint and checked.checked() is checked and checked.asn is asn
    assert sorted(tuple(r) for r in checked.city.collect()) == [(0, 9, "out"), (10, 20, "in"), (21, 100, "out")]
    used = spark.createDataFrame([("0.0.0.15",), ("0.0.0.50",)], "ip string")
    got = address_intel(used.select(F.array("ip").alias("lookup_ips")), checked).collect()
    assert len(got) == 2

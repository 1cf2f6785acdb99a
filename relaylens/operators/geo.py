"""IP intelligence: distinct addresses, range look-ups, fallbacks, classification.

Scale notes.  Addresses are reduced to distinct ones before any look-up (map-side combined, so a
relay that sits in a third of all mail costs one row).  The range look-up is an ordered merge
inside buckets instead of a ``between`` join, so no pairs are formed: /16 buckets for IPv4, which
hold at most 65,536 addresses, and segments between sampled splitters for IPv6 (ranges6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions import ip
from relaylens.functions.text import any_of, dense, unnest
from relaylens.operators import cutting, ranges6
from relaylens.operators.hops import is_public
from relaylens.session import stage

BUCKET = 65536
BEYOND = 1 << 62  # after the last address

GEO_FIELDS = ["country", "country_code", "region", "city", "lat", "lon", "timezone"]
NET_FIELDS = ["isp", "org", "asn", "asn_name", "reverse_dns"]
FLAG_FIELDS = ["is_hosting", "is_proxy_or_vpn", "is_mobile"]
RANGE_FIELDS = GEO_FIELDS + NET_FIELDS + FLAG_FIELDS
_TYPES = {"lat": "double", "lon": "double", **{f: "boolean" for f in FLAG_FIELDS}}

# IPs looked up more often than all but this many others are joined from a broadcast.
HOT_ADDRESSES = 1000


def distinct_ips(usage: DataFrame) -> DataFrame:
    """Each address once, with its number of uses.  ``usage`` has a column ``ip``."""
    return usage.where(F.col("ip").isNotNull()).groupBy("ip").agg(F.count("*").alias("uses"))


def gate(ips: DataFrame) -> DataFrame:
    """Mark addresses that must not be looked up (``error``); number the IPv4 ones (``ip_num``)
    and give the IPv6 ones their 32 hex digits (``ip_hex``)."""
    keyed = ips.withColumns({"_number": ip.v4_key(F.col("ip")), "_hex": ip.v6_key(F.col("ip"))})
    internal = keyed.withColumn("_internal", ip.internal_by_key(F.col("_number"), F.col("_hex")))
    mapped = F.col("_hex").startswith("0" * 20 + "ffff")
    return internal.withColumns({
        "error": F.when(F.col("_internal").isNull(), "invalid IP address")
        .when(F.col("_internal"), "private/internal IP"),
        "ip_num": F.when(~F.col("_internal"), F.coalesce(
            F.col("_number"),
            F.when(mapped, F.conv(F.substring("_hex", 25, 8), 16, 10).cast("long")))),
        "ip_hex": F.when(~F.col("_internal") & ~mapped, F.col("_hex")),
    }).drop("_internal", "_number", "_hex")


def range_lookup(ips: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Add one struct column per dimension: the record of the range that holds ``ip_num``.

    Each dimension has ``lo``, ``hi`` and disjoint ranges (see ``without_overlaps``), and for IPv6
    rows with ``lo6``, ``hi6`` of 32 hex digits instead.  The IPv4 ones
    share one shuffle: range starts and addresses are unioned, and a running ``last`` in address
    order carries the latest start to each address.  A range adds one row per /16 it touches,
    which for disjoint ranges is at most 65,536 rows over the whole dimension.
    """
    # Read for each family, and twice for the splitters of the second: parsed once.
    ips = stage(ips, "asked")
    known = ips.where(F.col("ip_num").isNotNull())
    asks = known.select(
        F.expr(f"ip_num div {BUCKET}").alias("bucket"), F.col("ip_num").alias("at"),
        F.lit(1).alias("kind"), F.struct(*ips.columns).alias("ask"),
    )
    marks = asks
    for name, dim in dims.items():
        record = F.struct("hi", _payload(dim).alias("rec"))
        pieces = dim.where(F.col("lo") <= F.col("hi")).select(
            "lo", record.alias(name),
            F.explode(F.expr(f"sequence(lo div {BUCKET}, hi div {BUCKET})")).alias("bucket"),
        )
        marks = marks.unionByName(
            pieces.select(
                "bucket", F.greatest("lo", F.col("bucket") * BUCKET).alias("at"),
                F.lit(0).alias("kind"), name,
            ),
            allowMissingColumns=True,
        )
    order = Window.partitionBy("bucket").orderBy("at", "kind") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.select(
        "at", "kind", "ask", *[F.last(n, ignorenulls=True).over(order).alias(n) for n in dims]
    ).where(F.col("kind") == 1)
    hits = found.select(
        "ask.*",
        *[F.when(F.col("at") <= F.col(f"{n}.hi"), F.col(f"{n}.rec")).alias(n) for n in dims],
    )
    others = ips.where(F.col("ip_num").isNull())
    wide = {n: d for n, d in dims.items() if "lo6" in d.columns}
    if wide and "ip_hex" in ips.columns:
        hits = hits.unionByName(ranges6.lookup(
            others.where(F.col("ip_hex").isNotNull()), wide, _payload), allowMissingColumns=True)
        others = others.where(F.col("ip_hex").isNull())
    return hits.unionByName(others, allowMissingColumns=True)


_KEYS = ("lo", "hi", "lo6", "hi6")


def _payload(dim: DataFrame) -> Column:
    return F.struct(*[c for c in dim.columns if c not in _KEYS])


def disjoint_ranges(ranges: DataFrame) -> DataFrame:
    """Cut overlapping ranges into disjoint ones; the narrowest range wins everywhere.

    Every range meets the cut points of the segments of its two ends only (see cutting).
    """
    payload = [c for c in ranges.columns if c not in ("lo", "hi")]
    base = ranges.where(F.col("lo") <= F.col("hi")).select(
        F.col("lo").cast("long"), (F.col("hi") + 1).cast("long").alias("end"),
        (F.col("hi") - F.col("lo")).cast("long").alias("width"), F.struct(*payload).alias("rec"))
    return cutting.pieces(base, BEYOND, ranges6.splitters, ranges6.segment).select(
        "lo", (F.col("end") - 1).alias("hi"), "rec.*")


def without_overlaps(dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables themselves where they are disjoint, else cut so that the narrowest range wins.

    A running look-up over nested ranges would lose the outer one, so this is always checked: all
    tables and both address families at once.  IPv4 bounds are compared as hex digits too.  Tables that
    had to be cut are written, as every look-up reads them more than once.
    """
    four = {f"4{n}": d.where(F.col("lo").isNotNull()).select(
        *[F.lpad(F.hex(c), 16, "0").alias(f"{c}6") for c in ("lo", "hi")]) for n, d in dims.items()}
    six = {f"6{n}": d for n, d in dims.items() if "lo6" in d.columns}
    met = ranges6.overlapping({**four, **six})
    out = {}
    for name, dim in dims.items():
        if f"4{name}" not in met and f"6{name}" not in met:
            out[name] = dim
            continue
        narrow = dim.where(F.col("lo").isNotNull())
        cut = disjoint_ranges(narrow) if f"4{name}" in met else narrow
        if "lo6" in dim.columns:
            wide = dim.where(F.col("lo").isNull())
            cut = cut.unionByName(ranges6.disjoint(wide) if f"6{name}" in met else wide)
        out[name] = stage(cut, name)
    return out


def _present(dim: DataFrame) -> DataFrame:
    """Give a dimension all look-up fields; the ones it lacks are null."""
    return dim.select(*_keys(dim), *[
        (F.col(f) if f in dim.columns else F.lit(None).cast(_TYPES.get(f, "string"))).alias(f)
        for f in RANGE_FIELDS
    ])


def _keys(dim: DataFrame) -> list[str]:
    return [c for c in _KEYS if c in dim.columns]


def classify(proxy: Column, hosting: Column, mobile: Column, isp: Column, org: Column,
             asn_name: Column) -> Column:
    """Infrastructure type; the order of the tests is the rule."""
    blob = F.lower(F.concat_ws(
        " ", *[F.coalesce(c, F.lit("")) for c in (isp, org, asn_name)]))
    named = (F.coalesce(isp, F.lit("")) != "") | (F.coalesce(asn_name, F.lit("")) != "")
    return (
        F.when(proxy, "proxy/vpn/anonymizer")
        .when(hosting, "datacenter/hosting")
        .when(blob.rlike(any_of(fv.HOSTING_KEYWORDS)), "datacenter/hosting")
        .when(mobile, "mobile network")
        .when(named, "residential/business ISP")
        .otherwise("unknown")
    )


def ip_intel(
    usage: DataFrame,
    city: DataFrame,
    asn: DataFrame | None = None,
    fallback: DataFrame | None = None,
    ptr: DataFrame | None = None,
    disjoint: bool = False,
) -> DataFrame:
    """One row per distinct address with everything known about it.

    ``disjoint`` says that no table has overlapping ranges; else that is checked here.

    ``fallback`` and ``ptr`` are the second source and the host names; leaving both out is the
    offline mode.  The second source fills in only where the first gave no country, and then its
    non-null values win.
    """
    dims = {"city": _present(city)}
    if asn is not None:
        dims["net"] = asn.select(*_keys(asn), "asn", "asn_name")
    if fallback is not None:
        dims["second"] = _present(fallback)
    if not disjoint:
        dims = without_overlaps(dims)
    looked = range_lookup(gate(distinct_ips(usage)), dims)
    use_second = (
        F.coalesce(F.col("city.country"), F.lit("")) == "" if fallback is not None else None
    )
    used_second = use_second & F.col("second").isNotNull() if fallback is not None else F.lit(False)
    first_hit = F.col("city").isNotNull()

    def value(field: str) -> Column:
        first = F.col(f"city.{field}")
        if asn is not None and field in ("asn", "asn_name", "isp"):
            # The network record counts only where the first source knows the address.
            net = F.col("net.asn_name" if field == "isp" else f"net.{field}")
            first = F.when(first_hit & F.col("net").isNotNull(), net).otherwise(first)
        if fallback is None:
            return first
        return F.when(use_second, F.coalesce(F.col(f"second.{field}"), first)).otherwise(first)

    rows = looked.select(
        "ip", "uses", "error", *[value(f).alias(f) for f in RANGE_FIELDS],
        first_hit.alias("_first"), F.coalesce(used_second, F.lit(False)).alias("_second"),
    )
    named = F.lit(False)
    if ptr is not None:
        names = ptr.groupBy("ip").agg(F.min("reverse_dns").alias("ptr_name"))
        rows = rows.join(names, "ip", "left")
        wanted = F.col("error").isNull() & (F.coalesce("reverse_dns", F.lit("")) == "")
        named = wanted & (F.coalesce("ptr_name", F.lit("")) != "")
        rows = rows.withColumn("_named", named).withColumn(
            "reverse_dns",
            F.when(wanted, F.col("ptr_name")).otherwise(F.col("reverse_dns")))
        named = F.col("_named")
    kind = F.when(F.col("error") == "private/internal IP", "internal network") \
        .when(F.col("error").isNotNull(), "unknown") \
        .otherwise(classify(*[F.col(c) for c in (
            "is_proxy_or_vpn", "is_hosting", "is_mobile", "isp", "org", "asn_name")]))
    return rows.select(
        "ip", "uses", *RANGE_FIELDS, kind.alias("infrastructure_type"),
        dense(
            F.when(F.col("_first"), F.lit("range_table")),
            F.when(F.col("_second"), F.lit("second_source")),
            F.when(named, F.lit("ptr_lookup")),
        ).alias("sources"),
        "error",
    )


INTEL_FIELDS = RANGE_FIELDS + ["infrastructure_type", "sources", "error"]


def with_lookup_ips(facts: DataFrame) -> DataFrame:
    """``lookup_ips``: every address of the message that some later step asks about."""
    public_hops = F.transform(F.filter("hops", is_public), lambda h: h["from_ip"])
    return facts.withColumn(
        "lookup_ips",
        F.array_distinct(F.concat(
            public_hops, dense("origin_ip", "edge_ip", "s1_ip", "s2_ip"))))


def attach_intel(facts: DataFrame, intel: DataFrame, key: str = "email_id",
                 addresses: str = "lookup_ips") -> DataFrame:
    """Add ``intel map<ip, record>`` for the addresses of each message.

    ``key`` is unique in ``facts``.  The address join is skew-safe: the most used addresses (at
    most HOT_ADDRESSES rows, by construction) come from a broadcast, and their messages get
    a key of their own for the shuffled join, so no address, and no null, gathers in one task.
    """
    record = F.struct(*[F.col(f) for f in INTEL_FIELDS])
    hot = intel.orderBy(F.desc("uses"), "ip").limit(HOT_ADDRESSES) \
        .select(F.col("ip").alias("hot_ip"), record.alias("hot_rec"))
    every = intel.select(F.col("ip").alias("cold_ip"), record.alias("cold_rec"))
    pairs = unnest(facts, addresses, key, item="ip")
    joined = (
        pairs.join(F.broadcast(hot), F.col("ip") == F.col("hot_ip"), "left")
        .withColumn(
            "_route",
            F.when(F.col("hot_ip").isNull(), F.col("ip"))
            .otherwise(F.concat(F.lit("~"), F.col(key).cast("string"))))
        .join(every, F.col("_route") == F.col("cold_ip"), "left")
        .select(key, "ip", F.coalesce("hot_rec", "cold_rec").alias("rec"))
        .where(F.col("rec").isNotNull())
    )
    # One entry per distinct address of one message: bounded by the message's own headers.
    maps = joined.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("ip", "rec"))).alias("intel"))
    return facts.join(maps, key, "left")


def intel_of(address: Column) -> Column:
    """Record of an address from the attached map; null when it has none."""
    return F.try_element_at("intel", F.coalesce(address, F.lit("")))

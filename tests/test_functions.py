import datetime
import difflib
import email.utils
import ipaddress
import random

from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions import dates, hosts, ip, rounding
from relaylens.operators import detection, location


def column(spark, values, type_="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {type_}")


def python_ip(text):
    s = text.strip("[]() \t\r\n")
    try:
        ipaddress.ip_address(s)
        return s
    except ValueError:
        return None


def python_private(text):
    try:
        o = ipaddress.ip_address(text)
    except ValueError:
        return True
    return bool(o.is_private or o.is_loopback or o.is_link_local or o.is_reserved
                or o.is_unspecified)


def python_internal(text):
    try:
        o = ipaddress.ip_address(text)
    except ValueError:
        return None
    return bool(o.is_private or o.is_loopback or o.is_link_local)


def test_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(1)
    values = ["::", "::1", "1::", ":::", "1:2", "[10.0.0.1]", "01.2.3.4", "::ffff:1.2.3.4",
              "::ffff:10.0.0.1", "64:ff9b::1", "1:2:3:4:5:6:1.2.3.4", "192.0.0.9", "192.0.0.10",
              "192.0.0.11", "100.64.0.1", "224.0.0.1", "2001:20::5", "ff02::1", "", "x",
              "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9"]
    for text in fv.PRIVATE_V4 + fv.PRIVATE_V6 + fv.PRIVATE_V6_EXCEPT + fv.RESERVED_V6:
        n = ipaddress.ip_network(text)
        make = ipaddress.IPv4Address if n.version == 4 else ipaddress.IPv6Address
        for k in (int(n[0]) - 1, int(n[0]), int(n[-1]), int(n[-1]) + 1):
            if 0 <= k < 1 << n.max_prefixlen:
                values.append(str(make(k)))
    for _ in range(400):
        values.append("".join(rng.choice("0129abF::..") for _ in range(rng.randint(2, 18))))
        values.append(":".join(rng.choice(["", "1", "ffff", "12345"])
                               for _ in range(rng.randint(2, 10))))
        values.append(".".join(str(rng.choice([0, 10, 127, 192, 255, 256])) for _ in range(4)))
    x = F.col("x")
    for r in column(spark, values).select(
            x, ip.valid_ip(x).alias("v"), ip.is_private_ip(x).alias("p"),
            ip.is_internal_ip(x).alias("i")).collect():
        assert (r.v, r.p, r.i) == (python_ip(r.x), python_private(r.x), python_internal(r.x)), r.x


def test_dates_agree_with_the_standard_library(spark):
    values = ["Mon, 01 Sep 2025 10:12:05 +0530", "01 Sep 2025 10:12 GMT",
              "1 Sep 25 10:12:05 -0000", "Mon, 1 Sep 2025 10:12:05 +0530 (IST)",
              "31 Feb 2025 10:00:00 +0000", "Mon, 01 Sep 2025 25:12:05 +0530", "nonsense", "",
              "01 September 2025 10:12:05 EST", "01-Sep-2025 10:12:05 +0000",
              "1 Sep 2025 10:12:05", "1 Sep 2025 10:12:05 XYZ", "1 Sep 2025 10:12:05+0530",
              "1 Sep 99 1:2:3 +0100", "29 Feb 2024 23:59:59 +9900", "29 Feb 2024 23:59:59 +0090",
              "29 Feb 2024 23:59:60 +0000", "29 Feb 2024 23:59:59 PDT"]
    got = column(spark, values).withColumn("v", dates.date_value(dates.date_parts(F.col("x"))))
    for r in got.collect():
        try:
            want = email.utils.parsedate_to_datetime(r.x)
        except Exception:
            assert r.v is None, r.x
            continue
        assert r.v.iso == want.isoformat()
        zoned = want if want.tzinfo else want.replace(tzinfo=datetime.timezone.utc)
        assert r.v.epoch == int(zoned.timestamp())
        assert (r.v.offset is None) == (want.tzinfo is None)


def test_rounding_is_exact(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(500)] + [k / 1000 for k in range(0, 3000, 5)] + [2.675]
    for r in column(spark, values, "double").select(
            "x", rounding.round_exact(F.col("x")).alias("r")).collect():
        assert r.r == round(r.x, 2), r.x


def test_hosts(spark):
    want = {
        "http://a.b.co.uk/x": ("a.b.co.uk", "b.co.uk"),
        "https://user@Evil.COM:80/p?x": ("evil.com", "evil.com"),
        "http://1.2.3.4/a": ("1.2.3.4", "1.2.3.4"), "http://a.unknowntld/": ("a.unknowntld",
                                                                           "a.unknowntld"),
        "http://[::1]:80/": ("::1", "::1"), "https://t.co": ("t.co", "t.co"),
    }
    host = hosts.url_host(F.col("x"))
    for r in column(spark, list(want)).select(
            "x", host.alias("h"), hosts.registered_domain(host).alias("d")).collect():
        assert (r.h, r.d) == want[r.x]
    relays = column(spark, ["mail.google.com", "[Google.com]", "notgoogle.com", "x.apple.com.", None])
    assert [r.r for r in relays.select(hosts.is_reputable(F.col("x")).alias("r")).collect()] == [
        True, True, False, True, False]


def test_lookalikes_agree_with_difflib(spark):
    rng = random.Random(3)
    values = ["paypa1.com", "googlemail.com", "google.com", "amaz0n.com", "chase.co", "ebay.com",
              ""]
    for _ in range(300):
        t = list(rng.choice(fv.TRUSTED_DOMAINS))
        for _ in range(rng.randint(1, 5)):
            t[rng.randrange(len(t))] = rng.choice("abcdeo01.lm")
        values.append("".join(t))
    df = column(spark, values).select(F.col("x").alias("rule_domain"), F.lit(True).alias("has_from"))
    for r in detection.with_lookalikes(df).collect():
        want = [t for t in fv.TRUSTED_DOMAINS if r.rule_domain and r.rule_domain != t
                and difflib.SequenceMatcher(None, r.rule_domain, t).ratio() > 0.75]
        assert r.lookalikes == want, r.rule_domain


def test_scripts_count_letters_only(spark):
    import unicodedata

    texts = ["नमस्ते hello", "Привет мир مرحبا ـ", "plain é", "தமிழ் 123 বাংলা", "“quoted”"]
    for r in column(spark, texts).select("x", location.scripts_of(F.col("x")).alias("s")).collect():
        want = {}
        for ch in r.x:
            for s in fv.SCRIPTS:
                if ch.isalpha() and s.upper() in unicodedata.name(ch, ""):
                    want[s] = want.get(s, 0) + 1
        assert [(s.script, s.letters) for s in r.s] == list(want.items())


def test_other_date_orders_agree_with_the_standard_library(spark):
    values = [
        "Sep 1 2025 10:12:00 +0530", "Mon Sep  1 10:12:00 2025", "1 Sep 10:12:00 2025 +0530",
        "Mon, 1 Sep 2025 10.12.00 +0530", "Mon, Sep 1 2025 10:12 GMT", "Sep  1 10:12:00 2025 -0500",
        "1 Sep 2025 10.12 +0000",
    ]
    got = column(spark, values).withColumn("v", dates.date_value(dates.date_parts(F.col("x"))))
    for r in got.collect():
        want = email.utils.parsedate_to_datetime(r.x)
        zoned = want if want.tzinfo else want.replace(tzinfo=datetime.timezone.utc)
        assert r.v is not None and r.v.epoch == int(zoned.timestamp()), (r.x, want, r.v)


def test_registered_domain_rules(spark):
    expected = {
        "www.example.ai": "example.ai", "evil.live": "evil.live", "login.shop.store": "shop.store",
        "x.y.com.co": "y.com.co", "pc.desk.corp": "corp", "localhost": "localhost", "ai": "ai",
        "a.b.co.in": "b.co.in", "1.2.3.4": "1.2.3.4", "": "", "a.b.gov.gh": "b.gov.gh",
    }
    got = column(spark, list(expected)).withColumn("d", hosts.registered_domain(F.col("x")))
    assert {r.x: r.d for r in got.collect()} == expected
    rules = ["com", "*.ck", "!www.ck"]
    listed = {"a.b.c.ck": "b.c.ck", "x.www.ck": "www.ck", "www.ck": "www.ck", "a.b.com": "b.com"}
    got = column(spark, list(listed)).withColumn("d", hosts.registered_domain(F.col("x"), rules))
    assert {r.x: r.d for r in got.collect()} == listed

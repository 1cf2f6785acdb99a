"""Suffix lists and models that are tables."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from relaylens.operators import model, suffixes


def test_rules_with_wildcards_and_exceptions(spark):
    rules = spark.createDataFrame([(r,) for r in [
        "com", "uk", "co.uk", "*.ck", "!www.ck", "*.kobe.jp", "jp", "!city.kobe.jp", "a.b.c", "co.uk"]], "rule string")
    want = {
        "www.example.com": "example.com", "com": "com", "x.y.co.uk": "y.co.uk", "co.uk": "co.uk",
        "a.b.other.ck": "b.other.ck", "other.ck": "other.ck", "www.ck": "www.ck", "sub.www.ck": "www.ck",
        "k.m.kobe.jp": "k.m.kobe.jp", "j.k.m.kobe.jp": "k.m.kobe.jp", "x.city.kobe.jp": "city.kobe.jp",
        "z.a.b.c": "z.a.b.c", "q.z.a.b.c": "z.a.b.c", "n.unlisted": "n.unlisted", "m.n.unlisted": "n.unlisted",
        "1.2.3.4": "1.2.3.4", "2001:db8::1": "2001:db8::1", "single": "single"}
    hosts = spark.createDataFrame([(h,) for h in [*want, "WWW.Example.COM.", "", None]], "host string")
    found = suffixes.registered_domains(hosts, rules)
    assert {r.host: r.domain for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert " IN (" not in plan and "INSET" not in plan


def slots(text):
    return {int(hashlib.md5(t.encode()).hexdigest()[:4], 16)
            for t in re.findall("[a-z0-9_]+", text.lower())}


def test_model_table_is_the_plain_formula(spark):
    rows = [(str(i), f"Subject {i % 3}", "cheap pills now" if i % 4 == 0 else "see you at the meeting", i % 4 == 0)
            for i in range(40)]
    mail = spark.createDataFrame([r[:3] for r in rows] + [("x", None, None)],
                                 "email_id string, subject string, body_plain string")
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows], "email_id string, label int")
    table = model.train_table(mail, labels)
    got = {r.email_id: r.ml_prob for r in model.table_probability(mail, table).collect()}
    known = [(slots(f"{s} {b}"), y) for _, s, b, y in rows]
    n1, n0 = sum(y for _, y in known), sum(not y for _, y in known)
    bias = math.log(n1 + 0.5) - math.log(n0 + 0.5)

    def margin(own):
        total = bias
        for slot in own:
            c1, c0 = (sum(slot in k for k, y in known if y == side) for side in (True, False))
            if c1 + c0:
                total += math.log((n0 + n1 + 1) / (c0 + c1 + 1)) * (
                    math.log(c1 + 0.5) - math.log(c0 + 0.5) - math.log(n1 + 1) + math.log(n0 + 1))
        return total

    for i, s, b, y in rows:
        assert abs(got[i] - 1 / (1 + math.exp(-margin(slots(f"{s} {b}"))))) < 1e-9
        assert (got[i] > 0.5) == y
    assert abs(got["x"] - 1 / (1 + math.exp(-bias))) < 1e-9
    assert table.where(F.col("slot") == -1).count() == 1

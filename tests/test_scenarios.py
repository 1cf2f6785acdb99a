import hashlib
import ipaddress

import mails
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from relaylens import schemas
from relaylens.operators import report
from relaylens.plans import analysis
from relaylens.sources import messages as sources
from relaylens.sources import reports as sinks
from relaylens.sources.mime import parse_messages


@pytest.fixture(scope="module")
def dims(spark):
    return analysis.Dimensions(spark.createDataFrame([], schemas.IP_RANGES))


@pytest.fixture(scope="module")
def rows(spark, dims, tmp_path_factory):
    """Every test message through the whole plan, offline and without any address data."""
    tree = mails.write(tmp_path_factory.mktemp("tree"))
    raw = sources.dedup_raw(sources.read_message_tree(spark, tree))
    parsed = parse_messages(raw).withColumn("ml_prob", F.lit(0.1))
    done = analysis.stage(analysis.analyze(parsed, dims), "scenarios")
    return {r["path"].rsplit("/", 1)[1]: r for r in done.collect()}, done


def test_tree_ids_and_copies(spark, rows, tmp_path):
    by_name, _ = rows
    assert len(by_name) == len(mails.ALL) - 1, "the copy is folded, the text file is not read"
    r = by_name["01_ordinary.eml"]
    assert r["email_id"] == hashlib.sha256(mails.ORDINARY.encode()).hexdigest()
    with pytest.raises(AnalysisException):
        sources.read_messages(spark, str(tmp_path / "missing.eml")).collect()


@pytest.mark.parametrize("name, ip, summary, score, level, country, confidence", [
    ("01_ordinary.eml", "40.92.18.63", "authenticated", 5, "low", "Central Europe", "low"),
    ("02_spoofed.EML", "92.118.39.17", "failed", 60, "high", "US Eastern", "low"),
    ("03_injected.eml", "77.91.84.5", "failed", 80, "high", "Japan", "low"),
    ("04_submitted.eml", "49.36.201.14", "authenticated", 5, "low", "India", "high"),
    ("05_public_injected.eml", "77.91.84.5", "failed", 95, "high", "Japan", "low"),
])
def test_regression_bands(rows, name, ip, summary, score, level, country, confidence):
    r = rows[0][name]
    assert (r.origin_ip, r.auth_summary, r.trace_risk_score, r.trace_risk_level) == (
        ip, summary, score, level)
    assert (r.estimate.country, r.estimate.confidence) == (country, confidence)
    assert r.origin_basis == "edge_received_hop"


def test_delays_and_private_hops(rows):
    hops = rows[0]["03_injected.eml"].hops
    assert [h.delay_seconds for h in hops] == [-390.0, -75.0, None]
    assert [h.is_private_ip for h in hops] == [False, True, True]
    assert rows[0]["03_injected.eml"].origin_confidence == "low"
    mixed = rows[0]["07_private_submission.eml"].hops
    assert mixed[0].delay_seconds is None, "a -0000 date cannot be compared with a zoned one"


def test_walks(rows):
    chain = rows[0]["06_chain.eml"]
    assert (chain.origin_ip, chain.origin_basis, chain.origin_hop_index) == (
        "62.10.20.30", "reputable_relay_descent", 2)
    assert chain.via_provider and chain.origin_verified
    inner = rows[0]["07_private_submission.eml"]
    assert (inner.origin_ip, inner.origin_basis) == ("10.1.2.3", "esmtpsa_submission")
    assert inner.origin_geo.error == "private/internal IP"
    bare = rows[0]["08_bare.eml"]
    assert (bare.origin_ip, bare.origin_basis, bare.origin_confidence) == (
        "62.10.20.30", "x_originating_ip", "medium")
    assert bare.notes == ["No Received headers present."]
    forged = rows[0]["05_public_injected.eml"]
    assert len([n for n in forged.notes if n.startswith(("Trust walk", "Origin div"))]) == 2


def test_flags(rows):
    by_name = rows[0]
    assert by_name["01_ordinary.eml"].flags == []
    bases = [f.split(":")[0] for f in by_name["02_spoofed.EML"].flags]
    assert bases == ["SPF_FAIL", "DKIM_FAIL", "DMARC_FAIL", "REPLY_TO_MISMATCH",
                     "RETURN_PATH_MISMATCH", "IP_BASED_URL", "DISPLAY_NAME_IMPERSONATION"]
    assert by_name["03_injected.eml"].rule_score == 65
    assert by_name["10_multipart.eml"].flags == [
        "REPLY_TO_MISMATCH", "SHORTENED_URL:https://bit.ly/x",
        "SHORTENED_URL:https://www.microsoft.com/en",
        "ANCHOR_TEXT_MISMATCH:PayPallogin->example",
        "RISKY_ATTACHMENT:Run.EXE",
        "DISPLAY_NAME_IMPERSONATION:Google Team->other.example"]
    assert by_name["08_bare.eml"].financial_mentions == ["rs,"]


def test_artifacts_and_candidates(rows):
    r = rows[0]["04_submitted.eml"]
    assert r.artifacts["upi_ids"] == ["ybl"]
    assert r.artifacts["phone_numbers"] == ["7012345678"]
    assert r.artifacts["ifsc_codes"] == ["KKBK0004567"]
    assert r.artifacts["financial_mentions"] == ["Rs 1,340", "INR 1,340.00"]
    assert [(c.country, c.confidence_score) for c in r.candidates] == [
        ("India", 1.95), ("Unknown", 0.9)]
    assert r.report_phone == "7012345678"


def test_alignment_tolerates_sub_domains_and_the_rule_does_not(rows):
    r = rows[0]["10_multipart.eml"]
    assert [t for t in r.auth_flags if "Reply-To" in t] == []
    assert "REPLY_TO_MISMATCH" in r.flags


def test_missing_parties_are_empty_texts(rows):
    r = rows[0]["09_no_from.eml"]
    assert (r.report_sender, r.report_email, r.report_name) == ("", "", "")


def test_report_round_trip_listing_and_latest(spark, rows, tmp_path):
    done = report.final_report(rows[1], "email_id", "path").withColumns({
        "source_stem": sinks.source_stem(F.col("path")),
        "processed_at": F.timestamp_seconds(F.length("path"))}).drop("path")
    sinks.write_reports(done, str(tmp_path / "out"))
    (tmp_path / "out" / "broken.json").write_text("{not json\n")
    back = sinks.read_reports(spark, str(tmp_path / "out"))
    assert back.count() == done.count() + 1
    listed = sinks.list_reports(back).orderBy("no").collect()
    assert [r.no for r in listed] == list(range(1, len(listed) + 1))
    assert [r.file for r in listed] == sorted(r.file for r in listed)
    assert listed[0].error == "Error reading"
    assert sinks.latest_report(done).count() == 1
    one = done.where("source_stem = '01_ordinary'").first()
    assert one.email == "member@library.example" and one.sender == "clerk@outlook.com"
    assert one.risk_score == one.overall_assessment.combined_threat_score
    lines = sinks.summary_lines(rows[1]).collect()
    assert len(lines) == done.count() and all("Risk:" in r.line for r in lines)


def test_store_is_idempotent(spark, tmp_path):
    tree = mails.write(tmp_path / "tree")
    raw = sources.read_message_tree(spark, tree)
    store = str(tmp_path / "store")
    sources.store_raw(raw, store)
    sources.store_raw(raw, store)
    stored = spark.read.parquet(store)
    assert stored.count() == stored.select("email_id").distinct().count() == len(mails.ALL) - 1


def test_pending_and_mark(spark):
    items = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "email_id string, uid long")
    ledger = spark.createDataFrame([("b",)], "email_id string")
    assert [r.email_id for r in sources.pending_messages(items, ledger, k=1).collect()] == ["c"]
    mark = sources.high_water_mark(items.where("uid < 3"))
    assert [r.uid for r in sources.newer_than(items, mark).collect()] == [3]
    assert sources.high_water_mark(items.where("uid > 9")).first()[0] == 0


def test_identical_files_are_one_result_and_two_traces(spark, dims, tmp_path):
    for name in ("one.eml", "two.eml"):
        (tmp_path / name).write_bytes(mails.ORDINARY.encode())
    raw = sources.read_message_tree(spark, str(tmp_path))
    parsed = parse_messages(raw).withColumn("ml_prob", F.lit(0.1))
    assert [r.path.rsplit("/", 1)[1] for r in analysis.analyze(parsed, dims).collect()] == ["one.eml"]
    lines = sinks.summary_lines(analysis.trace_only(parsed, dims)).collect()
    assert sorted((r.file, r.ip) for r in lines) == [
        ("one.eml", "40.92.18.63"), ("two.eml", "40.92.18.63")]


def test_nested_ranges_keep_the_outer_record(spark):
    from relaylens.operators import geo

    def number(a, b, c, d):
        return ((a * 256 + b) * 256 + c) * 256 + d

    ranges = spark.createDataFrame(
        [(number(1, 0, 0, 0), number(1, 255, 255, 255), "Wide"),
         (number(1, 2, 0, 0), number(1, 2, 0, 255), "Narrow")], "lo long, hi long, country string")
    asked = spark.createDataFrame([("1.2.0.5",), ("1.2.3.4",), ("1.1.1.1",), ("9.9.9.9",)], "ip string")
    found = {r.ip: r.country for r in geo.ip_intel(asked, ranges).collect()}
    assert found == {"1.2.0.5": "Narrow", "1.2.3.4": "Wide", "1.1.1.1": "Wide", "9.9.9.9": None}


def test_ipv6_ranges_wide_and_narrow(spark):
    from relaylens.operators import geo

    def digits(text):
        return f"{int(ipaddress.ip_address(text)):032x}"

    ranges = spark.createDataFrame(
        [(digits("2000::"), digits("3fff:" + "ffff:" * 6 + "ffff"), "Wide"),
         (digits("2a02:908:10::"), digits("2a02:908:1f:" + "ffff:" * 4 + "ffff"), "Narrow")],
        "lo6 string, hi6 string, country string").selectExpr(
        "cast(null as long) as lo", "cast(null as long) as hi", "*")
    asked = {"2a02:908:12::7": "Narrow", "2a02:908:20::7": "Wide", "2a02:908:f::7": "Wide",
             "3fff::1": "Wide", "fe80::1": None, "1.2.3.4": None, "2001:4860::8": "Wide", "bad": None}
    table = spark.createDataFrame([(a,) for a in asked], "ip string")
    assert {r.ip: r.country for r in geo.ip_intel(table, ranges).collect()} == asked
    assert {r.ip: r.country for r in geo.ip_intel(table, ranges.unionByName(ranges)).collect()} == asked

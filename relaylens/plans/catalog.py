"""One query per operator, with its SQL counterpart, on relations derived from the given tables.

Row-local operators run straight from the scan.  Queries that need address intelligence read
two tables that are written once per session and data set to the shared folder: the facts
of all messages and their full results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.functions.text import dense, unnest
from relaylens.operators import (
    auth, detection, geo, hops, links, location, model, origin, report, suffixes,
)
from relaylens.plans import analysis, oracle
from relaylens.plans import workload as w
from relaylens.session import configure, last_changed, remove_staged, shared_dir, stage
from relaylens.sources import messages as sources
from relaylens.sources import report_store
from relaylens.sources import reports as sinks
from relaylens.sources.mime import parse_messages
from relaylens.streaming import monitor

ID = "email_id"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_STAGED: dict[tuple, DataFrame] = {}


def entry(name: str, sql: str | None = None, after_parsing: bool = False):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle.query(sql, after_parsing)
        return fn

    return add


def once(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    """A table of this session and data set, written on first use and again if the data change."""
    key = (spark.sparkContext.applicationId, sf_dir, last_changed(spark, sf_dir), name)
    if key not in _STAGED:
        _STAGED[key] = stage(build(spark, sf_dir), name)
    return _STAGED[key]


def written(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether some query of this session has written the shared table."""
    return (spark.sparkContext.applicationId, sf_dir, last_changed(spark, sf_dir), name) in _STAGED


def forget() -> None:
    """Let the next query write its shared tables anew; the ones so far are removed."""
    _STAGED.clear()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        remove_staged(spark)


def text(column: str | Column) -> Column:
    return F.array_join(column, " | ")


def named(columns: tuple[str, ...]) -> tuple[list[tuple[str, str]], str]:
    """Pairs and select list from ``name`` or ``name = oracle expression``."""
    pairs = [tuple(c.split(" = ", 1)) if " = " in c else (c, c) for c in columns]
    return pairs, ", ".join(f"{q} AS {n}" for n, q in pairs)


# --- shared inputs ---


def authenticated(spark, sf):
    return auth.with_authentication(w.mail(spark, sf))


def hopped(spark, sf):
    return hops.with_hops(w.mail(spark, sf))


def resolved(spark, sf):
    return analysis.trace_facts(w.mail(spark, sf))


def linked(spark, sf):
    return links.with_urls(w.page_mail(spark, sf))


def flagged(spark, sf):
    base = links.with_urls(auth.with_first_verdicts(w.mail(spark, sf)))
    return detection.with_rule_score(
        detection.with_flags(detection.with_lookalikes(detection.with_sender(base))))


def facts(spark, sf):
    return once(spark, sf, "facts", lambda sp, d: analysis.message_facts(w.mail(sp, d)))


def intel(spark, sf):
    return once(spark, sf, "intel",
                lambda sp, d: analysis.address_intel(facts(sp, d), w.dimensions(sp, d)))


def results(spark, sf):
    return once(spark, sf, "results",
                lambda sp, d: analysis.assessed(facts(sp, d), intel(sp, d)))


def results_once(spark, sf):
    """The results for a query that reads them once: they are not written for it, and only the columns that
    it asks for are worked out."""
    if written(spark, sf, "results"):
        return results(spark, sf)
    return analysis.assessed(facts(spark, sf), intel(spark, sf))


def parsed(spark, sf):
    return parse_messages(w.raw_mail(spark, sf))


# --- sources and sinks ---

_PATHS = "'/mail/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.eml'"


@entry("s3_content_id", f"SELECT {_PATHS} AS path, sha256(text) AS email_id FROM documents")
def s3(spark, sf):
    return sources.with_content_id(w.raw_documents(spark, sf)).select("path", ID)


@entry("s4_dedup_raw",
       f"SELECT sha256(text) AS email_id, min({_PATHS}) AS path FROM documents GROUP BY 1")
def s4(spark, sf):
    raw = sources.with_content_id(w.raw_documents(spark, sf))
    return sources.dedup_raw(raw).select(ID, "path")


@entry("s6_high_water_mark",
       "SELECT CAST(conv_id AS VARCHAR) AS box, turn AS uid, role FROM conversations WHERE turn > "
       "(SELECT coalesce(max(turn), 0) FROM conversations WHERE role = 'system')")
def s6(spark, sf):
    items = w.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("box"), F.col("turn").alias("uid"), "role")
    mark = sources.high_water_mark(items.where(F.col("role") == "system"))
    return sources.newer_than(items, mark)


@entry("s7_pending_messages",
       "SELECT CAST(doc_id AS VARCHAR) AS email_id, doc_id AS uid FROM documents "
       "WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s7(spark, sf):
    items = w.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias(ID), F.col("doc_id").alias("uid"))
    ledger = w.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias(ID))
    return sources.pending_messages(items, ledger)


@entry("s7_recovery_first",
       "SELECT CAST(doc_id AS VARCHAR) AS email_id, doc_id AS uid FROM documents "
       "WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 1")
def s7_first(spark, sf):
    items = w.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias(ID), F.col("doc_id").alias("uid"))
    ledger = w.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias(ID))
    return sources.pending_messages(items, ledger, k=1)


_REPORT = ("id, subject, email, sender, phone, ip, name, country, city, risk_score, "
           "classification, status, {score} AS combined_threat_score, overall_verdict")
_REPORT_SQL = "SELECT " + _REPORT.format(score="risk_score") + " FROM report"


def flat_report(reports: DataFrame, *more: str) -> DataFrame:
    names = [n.strip() for n in _REPORT.split("{")[0].split(",")[:-1]]
    return reports.select(
        *more, *names, F.col("overall_assessment.combined_threat_score"),
        F.col("overall_assessment.overall_verdict"))


def reports(spark, sf, source=results_once):
    return report.final_report(source(spark, sf), ID, "path").withColumn(
        "source_stem", sinks.source_stem(F.col("path"))).drop("path")


@entry("s9_write_reports", _REPORT_SQL.replace("SELECT id", "SELECT id AS source_stem, id"))
def s9(spark, sf):
    target = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    sinks.write_reports(reports(spark, sf), target)
    return flat_report(sinks.read_reports(spark, target), "source_stem")


def report_batches(spark, reports_, target, count=3):
    """The reports as batches by id; the first was published with half of its rows before."""
    done = stage(reports_, "reports")
    place = F.pmod(F.col("id").cast("long"), F.lit(count))
    report_store.publish(done.where(F.pmod(F.col("id").cast("long"), F.lit(2 * count)) == 0), target, 0)
    for batch in range(count):
        report_store.publish(done.where(place == batch), target, batch)
    return target


@entry("s9_published_batches", _REPORT_SQL.replace("SELECT id", "SELECT id AS source_stem, id"))
def s9_published(spark, sf):
    timed = reports(spark, sf).withColumn("processed_at", F.current_timestamp())
    target = report_batches(spark, timed, f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}")
    return flat_report(report_store.published(spark, target), "source_stem")


_CLOCK = "1700000000 + (CAST({c} AS BIGINT) * 7919) % 100003"


@entry("s10_latest_report",
       f"SELECT id, risk_score, {_CLOCK.format(c='k')} AS processed_at FROM report "
       f"ORDER BY {_CLOCK.format(c='k')} DESC, id DESC LIMIT 1")
def s10(spark, sf):
    timed = reports(spark, sf).withColumn("processed_at", F.expr(_CLOCK.format(c="id")))
    return sinks.latest_report(timed).select("id", "risk_score", "processed_at")


@entry("s10_latest_published",
       f"SELECT id, risk_score, {_CLOCK.format(c='k')} AS processed_at FROM report "
       f"ORDER BY {_CLOCK.format(c='k')} DESC, id DESC LIMIT 1")
def s10_published(spark, sf):
    timed = reports(spark, sf).withColumn("processed_at", F.expr(_CLOCK.format(c="id")))
    target = report_batches(spark, timed, f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}")
    return report_store.latest_published(spark, target).select("id", "risk_score", "processed_at")


@entry("s11_list_reports",
       "SELECT row_number() OVER (ORDER BY id) AS no, id AS file, "
       "overall_verdict AS verdict, CAST(risk_score AS VARCHAR) AS score, "
       "coalesce(nullif(trim(city || ' ' || country), ''), 'Unknown') AS origin, "
       "substr(coalesce(subject, 'N/A'), 1, 30) AS subject FROM report")
def s11(spark, sf):
    return sinks.list_reports(reports(spark, sf, results)).drop("error")


@entry("s12_export_batch",
       "SELECT split_part(path, '/', -1) AS file, trace_risk_score AS score, origin_ip AS ip, "
       "hop_count AS hops_count, 'trace_engine' AS module, '1.0.0' AS version, origin_basis AS basis, "
       "auth_summary AS summary FROM mail JOIN trace_risk USING (k) JOIN origin USING (k)")
def s12(spark, sf):
    traced = report.trace_report(results(spark, sf), ID, "path")
    target = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    sinks.export_batch(traced).write.text(target)

    def at(path: str) -> Column:
        return F.get_json_object("value", path)

    return spark.read.text(target).select(
        at("$.file").alias("file"),
        at("$.report.risk.trace_risk_score").cast("int").alias("score"),
        at("$.report.origin.probable_source_ip").alias("ip"),
        at("$.report.delivery_path.hops_count").cast("long").alias("hops_count"),
        at("$.report.module").alias("module"), at("$.report.version").alias("version"),
        at("$.report.origin.origin_basis").alias("basis"),
        at("$.report.authentication.summary").alias("summary"))


@entry("s13_summarize_messages",
       "SELECT split_part(path, '/', -1) AS file, coalesce(origin_ip, 'None') AS ip, "
       "coalesce(nullif(ecountry, ''), nullif(country, ''), 'Unknown') AS location, "
       "trace_risk_score AS risk FROM mail JOIN trace_risk USING (k) JOIN geo USING (k)")
def s13(spark, sf):
    return sinks.summary_lines(results(spark, sf)).drop("line")


@entry("s14_quarantine",
       "SELECT path, k % 13 <> 0 AS parsed, CASE WHEN k % 13 = 0 THEN 'LookupError' END AS reason "
       "FROM mail")
def s14(spark, sf):
    """Every thirteenth message names a charset that nobody knows and cannot be decoded."""
    # Good and bad rows are two reads of one table, so that every message is parsed once.
    outcome = parse_messages(w.raw_mail(spark, sf, broken=13)).select(ID, "path", "error")
    good, bad = sources.quarantine(stage(outcome, "outcome"))
    return good.select("path", F.lit(True).alias("parsed")).unionByName(bad.select(
        "path", F.lit(False).alias("parsed"), F.substring_index("error", ":", 1).alias("reason")),
        allowMissingColumns=True)


@entry("s5_stream_messages", _REPORT_SQL.replace("id, ", "k, ", 1), after_parsing=True)
def s5(spark, sf):
    """The documents as a stream of raw messages, through the monitor, to reports."""
    schema = w.table(spark, sf, "documents").schema
    # A glob keeps the path a folder for the stream, whether the table is one file or many.
    docs = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    raw = sources.with_content_id(w.raw_mail(spark, sf, docs))
    out = f"{shared_dir(spark)}/monitor-{uuid.uuid4().hex}"
    monitor.monitor(raw, w.dimensions(spark, sf), out, f"{out}/checkpoint",
                    w.given_probability, once=True).awaitTermination()
    done = monitor.reports_of(spark, out)
    return flat_report(done.withColumn("id", F.col("source_stem"))).withColumn(
        "k", F.col("id").cast("long")).drop("id")


@entry("s8_mark_processed", "SELECT count(*) AS reported, count(*) AS marked, 0 AS reprocessed "
                            "FROM mail")
def s8(spark, sf):
    """The same raw messages in two batches: the second one finds nothing left to do."""
    out = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    raw = sources.with_content_id(w.raw_mail(spark, sf))
    for batch in (0, 1):
        monitor.process_batch(raw, batch, w.dimensions(spark, sf), out, w.given_probability)
    done = monitor.reports_of(spark, out).groupBy().agg(
        F.count("*").alias("reported"),
        F.coalesce(F.sum((F.col("batch") == 1).cast("int")), F.lit(0)).cast("int")
        .alias("reprocessed"))
    marks = spark.read.parquet(f"{out}/ledger").agg(F.countDistinct(ID).alias("marked"))
    return done.withColumn("marked", marks.scalar()).select("reported", "marked", "reprocessed")


# --- parsing ---


@entry("p1_parse_messages", ""f"""SELECT path, trim(message_id) AS message_id,
 nullif(subject, '') AS subject, from_raw, to_raw, {oracle.PARSED_DATE} AS date_raw,
 received_spf, x_originating, (SELECT count(*) FROM rec WHERE rec.k = mail.k) AS received,
 error FROM (SELECT *, CAST(NULL AS VARCHAR) AS error FROM mail) mail""")
def p1(spark, sf):
    return parsed(spark, sf).select(
        "path", "message_id", "subject", "from_raw", "to_raw", "date_raw", "received_spf",
        F.try_element_at("x_headers", F.lit("X-Originating-IP")).alias("x_originating"),
        F.size("received").cast("long").alias("received"), "error")


@entry("p2_address_list", "SELECT path, CASE WHEN from_address IS NOT NULL THEN from_name END "
                          "AS from_name, from_address AS from_addr, reply_address AS reply_addr "
                          "FROM mail")
def p2(spark, sf):
    first = F.lit(1)
    return parsed(spark, sf).select(
        "path", F.try_element_at("from_addr", first)["name"].alias("from_name"),
        F.try_element_at("from_addr", first)["addr"].alias("from_addr"),
        F.try_element_at("reply_to", first)["addr"].alias("reply_addr"))


@entry("p3_strip_return_path",
       "SELECT email_id, trim(return_path_raw, '<>') AS return_path FROM mail")
def p3(spark, sf):
    return detection.with_sender(w.mail(spark, sf)).select(ID, "return_path")


@entry("p4_body_split", "SELECT path, sha256(body_plain) AS plain, sha256(body_html) AS html, "
                        "length(body_plain) AS plain_chars FROM mail")
def p4(spark, sf):
    return parsed(spark, sf).select(
        "path", F.sha2("body_plain", 256).alias("plain"), F.sha2("body_html", 256).alias("html"),
        F.length("body_plain").cast("long").alias("plain_chars"))


@entry("p5_trace_text", "SELECT path, sha256(full_text) AS trace_text FROM texts JOIN mail "
                        "USING (k)")
def p5(spark, sf):
    return parsed(spark, sf).select("path", F.sha2(F.concat(
        F.coalesce("subject", F.lit("")), F.lit("\n"), "trace_body"), 256).alias("trace_text"))


@entry("p6_attachment_facts", "SELECT path, 0 AS seq, file_name AS filename, "
                              "length(file_text) AS size, sha256(file_text) AS sha256 FROM mail "
                              "WHERE file_name IS NOT NULL")
def p6(spark, sf):
    return links.attachment_table(parsed(spark, sf), "path").drop("content_type")


@entry("p7_extract_urls_text",
       "SELECT k AS email_id, CAST(n - 1 AS INTEGER) AS seq, url FROM plinks WHERE n < 1000")
def p7(spark, sf):
    found = w.page_mail(spark, sf).withColumn("u", links.text_urls(F.col("body_plain")))
    return unnest(found, "u", ID, position="seq", item="url")


@entry("p8_extract_anchors", "SELECT k AS email_id, CAST(n - 1001 AS INTEGER) AS seq, url, "
                             "anchor_text FROM plinks WHERE n > 1000")
def p8(spark, sf):
    a = unnest(w.page_mail(spark, sf), "anchors", ID, position="seq", item="a")
    return a.select(ID, "seq", "a.url", "a.anchor_text")


@entry("p9_merge_urls",
       "SELECT k AS email_id, CAST(seq AS INTEGER) AS seq, url, anchor_text FROM purls")
def p9(spark, sf):
    return links.url_table(linked(spark, sf)).select(ID, "seq", "url", "anchor_text")


@entry("p10_registered_domain", "SELECT k AS email_id, url, host, domain FROM purls")
def p10(spark, sf):
    return links.url_table(linked(spark, sf)).select(ID, "url", "host", "domain")


@entry("p10_registered_domain_by_table",
       "SELECT host, CASE WHEN regexp_full_match(host, '[0-9.]+') THEN host ELSE array_to_string("
       "list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - coalesce(best, 1) % 1000), "
       "len(string_split(host, '.'))), '.') END AS domain FROM named_hosts LEFT JOIN suffix_of USING (host)")
def p10_table(spark, sf):
    return suffixes.registered_domains(w.hosts(spark, sf), w.suffixes(spark, sf))


@entry("p11_message_meta", "SELECT email_id, nullif(trim(message_id), '') AS message_id, "
                           "nullif(subject, '') AS subject, from_raw AS from_text, "
                           "to_raw AS to_text, date_raw AS date_text FROM mail")
def p11(spark, sf):
    return report.with_meta(w.mail(spark, sf)).select(
        ID, F.col("meta_message_id").alias("message_id"), F.col("meta_subject").alias("subject"),
        F.col("meta_from").alias("from_text"), F.col("meta_to").alias("to_text"),
        F.col("meta_date").alias("date_text"))


@entry("p12_parse_sender_recipient",
       "SELECT email_id, CASE WHEN contains(from_raw, '<') THEN "
       "trim(regexp_extract(from_raw, '^([^<]*)<', 1)) ELSE '' END AS name, "
       "coalesce(CASE WHEN contains(from_raw, '<') THEN regexp_extract(from_raw, '<([^>]+)>', 1) "
       "ELSE from_raw END, '') AS sender, coalesce(CASE WHEN contains(to_raw, '<') THEN "
       "regexp_extract(to_raw, '<([^>]+)>', 1) ELSE to_raw END, '') AS email FROM mail")
def p12(spark, sf):
    return report.with_parties(w.mail(spark, sf)).select(
        ID, F.col("report_name").alias("name"), F.col("report_sender").alias("sender"),
        F.col("report_email").alias("email"))


# --- authentication ---


@entry("a1_auth_first_match",
       "SELECT email_id, auth_spf AS spf, auth_dkim AS dkim, auth_dmarc AS dmarc FROM auth")
def a1(spark, sf):
    return auth.with_first_verdicts(w.mail(spark, sf)).select(
        ID, F.col("auth_spf").alias("spf"), F.col("auth_dkim").alias("dkim"),
        F.col("auth_dmarc").alias("dmarc"))


@entry("a2_auth_verdicts",
       "SELECT email_id, spf_result, dkim_result, dmarc_result FROM trace_auth")
def a2(spark, sf):
    return authenticated(spark, sf).select(ID, "spf_result", "dkim_result", "dmarc_result")


@entry("a3_auth_details",
       "SELECT email_id, spf_domain, spf_client_ip, dkim_domain, dmarc_policy FROM trace_auth")
def a3(spark, sf):
    return authenticated(spark, sf).select(
        ID, "spf_domain", "spf_client_ip", "dkim_domain", "dmarc_policy")


@entry("a4_received_spf_fallback",
       "SELECT t.email_id, received_spf, spf_result, spf_domain, spf_client_ip "
       "FROM trace_auth t JOIN mail m ON m.k = t.k")
def a4(spark, sf):
    return authenticated(spark, sf).select(
        ID, "received_spf", "spf_result", "spf_domain", "spf_client_ip")


@entry("a5_auth_summary", "SELECT email_id, auth_summary FROM trace_auth")
def a5(spark, sf):
    return authenticated(spark, sf).select(ID, "auth_summary")


@entry("a6_auth_flag_text",
       f"SELECT email_id, {oracle.joined('txt', 'ord')} AS texts FROM mail LEFT JOIN auth_texts "
       "USING (k) GROUP BY email_id")
def a6(spark, sf):
    return authenticated(spark, sf).select(ID, text("auth_texts").alias("texts"))


_DOMAINS = ["from_domain", "return_path_domain", "reply_to_domain", "sender_domain"]


@entry("a7_address_domain", f"SELECT email_id, {', '.join(_DOMAINS)} FROM domains")
def a7(spark, sf):
    return authenticated(spark, sf).select(ID, *_DOMAINS)


@entry("a8_domain_alignment",
       f"SELECT email_id, {oracle.joined('txt', 'ord')} AS texts FROM mail LEFT JOIN align_texts "
       "USING (k) GROUP BY email_id")
def a8(spark, sf):
    return authenticated(spark, sf).select(ID, text("alignment_texts").alias("texts"))


# --- relay path ---


def _hop_entry(name: str, *columns: str) -> None:
    """A query over the hop table; ``spark name = oracle expression`` per column."""
    pairs, sql = named(columns)

    @entry(name, f"SELECT CAST(k AS VARCHAR) AS email_id, i AS hop_index, {sql} FROM hops")
    def run(spark, sf):
        return hops.hop_table(hopped(spark, sf)).select(ID, "hop_index", *[n for n, _ in pairs])


_hop_entry("h1_explode_hops", "raw")
_hop_entry("h2_normalize_header", "raw")
_hop_entry("h3_hop_from_host", "from_host")
_hop_entry("h4_hop_from_ip", "from_ip")
_hop_entry("h5_helo_literal", "helo_literal_ip")
_hop_entry("h7_is_private_ip", "from_ip", "is_private_ip")
_hop_entry("h8_hop_by_host", "by_host")
_hop_entry("h9_hop_protocol_tls", "protocol", "is_tls")
_hop_entry("h10_hop_auth_user", "auth_user")
_hop_entry("h11_hop_timestamp", "ts", "tz_offset",
           "timestamp = strftime(local_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN tz_offset IS NULL "
           "THEN '' ELSE tz_offset[1:3] || ':' || tz_offset[4:5] END")
_hop_entry("h12_hop_delay", "delay_seconds = delay")
_hop_entry("o1_is_reputable", "from_host", "by_host", "is_relay")


@entry("h6_valid_ip", f"SELECT ip, {oracle._is_ip('ip')} AS valid FROM usage GROUP BY ip")
def h6(spark, sf):
    from relaylens.functions.ip import valid_ip

    used = geo.distinct_ips(unnest(facts(spark, sf), "lookup_ips", item="ip"))
    return used.select("ip", valid_ip(F.col("ip")).isNotNull().alias("valid"))


@entry("h13_negative_delay", "SELECT CAST(k AS VARCHAR) AS email_id, i AS hop_index, delay AS "
                             "delay_seconds FROM hops WHERE delay < -30")
def h13(spark, sf):
    table = hops.hop_table(hopped(spark, sf))
    return table.where(F.col("delay_seconds") < -30).select(ID, "hop_index", "delay_seconds")


@entry("h14_bottom_public_hop",
       "SELECT x.email_id, claimed_hop_ip AS bottom_ip, claimed_index AS bottom_index, "
       "coalesce(notes, '') AS notes FROM edges x LEFT JOIN (SELECT k, string_agg("
       + oracle.fmt(hops.fv.LEGACY_NOTE_SKEW, "i", "CAST(delay AS BIGINT)")
       + ", ' | ' ORDER BY i) AS notes FROM hops WHERE delay < -30 GROUP BY k) n ON n.k = x.k")
def h14(spark, sf):
    return hops.with_bottom_hop(hopped(spark, sf)).select(
        ID, "bottom_ip", "bottom_index", text("bottom_notes").alias("notes"))


@entry("h15_route_view",
       "SELECT CAST(h.k AS VARCHAR) AS email_id, CAST(count(*) OVER (PARTITION BY h.k) AS INTEGER)"
       " AS hop_count, CAST(row_number() OVER (PARTITION BY h.k ORDER BY i DESC) - 1 AS INTEGER) "
       "AS position, i AS hop_index, from_ip, CASE WHEN pub THEN g.country END AS country, "
       "CASE WHEN pub THEN g.city END AS city, CASE WHEN pub THEN g.isp END AS isp, "
       "CASE WHEN pub THEN g.infra END AS infra FROM hops h LEFT JOIN intel g ON g.ip = h.from_ip")
def h15(spark, sf):
    r = unnest(results(spark, sf), "route", ID, "hop_count", position="position", item="r")
    return r.select(
        ID, "hop_count", "position", F.col("r.index").alias("hop_index"), "r.from_ip",
        "r.geo.country", "r.geo.city", "r.geo.isp",
        F.col("r.geo.infrastructure_type").alias("infra"))


# --- origin ---


def _origin_entry(name: str, *columns: str) -> None:
    pairs, sql = named(columns)

    @entry(name, f"SELECT email_id, {sql} FROM origin")
    def run(spark, sf):
        return resolved(spark, sf).select(ID, *[n for n, _ in pairs])


_origin_entry("o2_x_origin_ip", "x_ip")
_origin_entry("o4_edge_hop", "edge_ip", "edge_index")
_origin_entry("o5_claimed_origin", "claimed_ip")
_origin_entry("o7_trust_walk", "walk_ip", "walk_index", "walk_basis")
_origin_entry("o8_via_provider", "via_provider = via")
_origin_entry("o9_x_origin_override", "origin_ip", "origin_basis",
              "origin_hop_index = walk_index")
_origin_entry("o10_origin_verified", "claimed_ip", "origin_ip", "origin_verified")
_origin_entry("o11_origin_confidence", "origin_confidence")
_origin_entry(
    "o12_attribution_note",
    "attribution_note = CASE WHEN hop_count = 0 THEN 'No Received headers found.' ELSE "
    + oracle.fmt(hops.fv.ATTRIBUTION, "replace(origin_basis, '_', ' ')",
                 "coalesce(origin_ip, 'unknown')", "coalesce(edge_ip, 'none')",
                 "coalesce(claimed_ip, 'none')") + " END")


@entry("o3_no_hops_origin",
       "SELECT email_id, origin_ip, origin_basis, origin_confidence FROM origin "
       "WHERE hop_count = 0")
def o3(spark, sf):
    bare = origin.with_origin(origin.with_client_ip(hopped_auth(spark, sf)))
    return bare.where(F.size("received") == 0).select(
        ID, "origin_ip", "origin_basis", "origin_confidence")


def hopped_auth(spark, sf):
    return hops.with_hops(authenticated(spark, sf))


@entry("o6_tripwire_notes",
       f"SELECT email_id, {oracle.joined('note', 'ord')} AS notes FROM mail LEFT JOIN notes "
       "USING (k) GROUP BY email_id")
def o6(spark, sf):
    return resolved(spark, sf).select(ID, text("notes").alias("notes"))


# --- address intelligence ---


def addresses(spark, sf):
    """Every address that messages ask about.  Only the steps that name them run; where the facts are
    written already they are read instead."""
    if written(spark, sf, "facts"):
        return unnest(facts(spark, sf), "lookup_ips", item="ip")
    return once(spark, sf, "addresses", lambda sp, d: unnest(resolved(sp, d), "lookup_ips", item="ip"))


@entry("g1_distinct_ips", "SELECT ip, uses FROM ips")
def g1(spark, sf):
    return geo.distinct_ips(addresses(spark, sf))


@entry("g2_gate_ip", "SELECT ip, error, num AS ip_num FROM ips")
def g2(spark, sf):
    return geo.gate(geo.distinct_ips(addresses(spark, sf))).select("ip", "error", "ip_num")


@entry("g3_geo_range_join",
       "SELECT ip, country, country_code, region, city, lat, lon, timezone FROM ips "
       "LEFT JOIN city ON num BETWEEN lo AND hi OR six BETWEEN lo6 AND hi6")
def g3(spark, sf):
    known = geo.gate(geo.distinct_ips(addresses(spark, sf)))
    found = geo.range_lookup(known, {"city": w.city(spark, sf)})
    return found.select("ip", *[F.col(f"city.{f}") for f in geo.GEO_FIELDS])


@entry("g3_geo_range_join_overlaps",
       "SELECT ip, arg_min(country, {'w': hi - lo, 'l': lo, 'h': hi}) AS country FROM ips "
       "LEFT JOIN many_ranges ON num BETWEEN lo AND hi GROUP BY ip")
def g3_overlaps(spark, sf):
    known = geo.gate(geo.distinct_ips(addresses(spark, sf)))
    found = geo.range_lookup(known, {"o": geo.disjoint_ranges(w.overlaps(spark, sf))})
    return found.select("ip", F.col("o.country"))


@entry("g4_asn_range_join", "SELECT ip, asn, asn_name FROM ips LEFT JOIN net "
                            "ON num BETWEEN lo AND hi OR six BETWEEN lo6 AND hi6")
def g4(spark, sf):
    known = geo.gate(geo.distinct_ips(addresses(spark, sf)))
    return geo.range_lookup(known, {"n": w.asn(spark, sf)}).select("ip", "n.asn", "n.asn_name")


def six_lookup(spark, sf, label):
    """Addresses of one provider's block against nested ranges of it."""
    known = geo.gate(geo.distinct_ips(w.six_addresses(spark, sf)))
    dims = geo.without_overlaps({"d": w.six_ranges(spark, sf, label)})
    return geo.range_lookup(known, dims).select("ip", f"d.{label}")


@entry("g3_geo_range_join_v6", "SELECT ip, label AS country FROM six_found")
def g3_v6(spark, sf):
    return six_lookup(spark, sf, "country")


@entry("g4_asn_range_join_v6", "SELECT ip, label AS asn FROM six_found")
def g4_v6(spark, sf):
    return six_lookup(spark, sf, "asn")


@entry("g5_geo_fallback_v6",
       "SELECT ip, coalesce(early, label) AS country, CASE WHEN early IS NOT NULL THEN 'range_table' "
       "WHEN label IS NOT NULL THEN 'second_source' ELSE '' END AS sources FROM six_found")
def g5_v6(spark, sf):
    every = w.six_ranges(spark, sf, "country")
    found = geo.ip_intel(w.six_addresses(spark, sf), every.where(F.col("country") < "m"), fallback=every)
    return found.select("ip", "country", text("sources").alias("sources"))


def _intel_entry(name: str, *columns: str) -> None:
    pairs, sql = named(columns)

    @entry(name, f"SELECT ip, {sql} FROM intel")
    def run(spark, sf):
        rows = analysis.address_intel(facts(spark, sf), w.dimensions(spark, sf))
        return rows.withColumn("sources", text("sources")).select("ip", *[n for n, _ in pairs])


_intel_entry("g5_geo_fallback", "country", "country_code", "city", "isp", "is_hosting")
_intel_entry("g6_reverse_dns", "reverse_dns", "error")
_intel_entry("g7_lookup_sources", "sources")
_intel_entry("g8_classify_infra", "infrastructure_type = infra")


@entry("g9_edge_geo",
       "SELECT o.email_id, o.edge_ip, g.country AS edge_country, g.infra AS edge_infra FROM "
       "origin o LEFT JOIN intel g ON g.ip = o.edge_ip AND o.edge_ip IS DISTINCT FROM o.origin_ip")
def g9(spark, sf):
    return results(spark, sf).select(
        ID, "edge_ip", F.col("edge_geo.country").alias("edge_country"),
        F.col("edge_geo.infrastructure_type").alias("edge_infra"))


@entry("g10_relay_to_sender_override",
       "SELECT email_id, country, cc AS country_code, region, city, "
       "CASE WHEN relay THEN gcountry END AS relay_country, "
       "CASE WHEN relay THEN isp END AS relay_isp, CASE WHEN relay OR direct "
       "THEN 'sender_device_signal_fusion' END AS location_source "
       "FROM geo WHERE origin_ip IS NOT NULL")
def g10(spark, sf):
    g = results(spark, sf).where(F.col("origin_geo").isNotNull())
    return g.select(ID, *[F.col(f"origin_geo.{f}") for f in (
        "country", "country_code", "region", "city", "relay_country", "relay_isp",
        "location_source")])


# --- sender location ---


def signal_rows(frame: DataFrame) -> DataFrame:
    r = unnest(frame, "signals", ID, position="position", item="s")
    return r.select(ID, *[F.col(f"s.{f}") for f in (
        "seq", "signal_id", "name", "weight", "value", "estimated_location", "evidence",
        "country", "country_code", "credited", "city", "region", "ip", "isp")])


def _signal_entry(name: str, *ids: str) -> None:
    quoted = ", ".join(oracle.s(i) for i in ids)

    @entry(name, "SELECT CAST(k AS VARCHAR) AS email_id, signal_id, weight, value, "
                 "est AS estimated_location, evidence, country, cc AS country_code, credited "
                 f"FROM signals WHERE signal_id IN ({quoted})")
    def run(spark, sf):
        rows = signal_rows(results(spark, sf)).where(F.col("signal_id").isin(*ids))
        return rows.select(ID, "signal_id", "weight", "value", "estimated_location", "evidence",
                           "country", "country_code", "credited")


_signal_entry("l1_sig_submission_ip", "S1_ESMTPSA_SUBMISSION_IP")
_signal_entry("l2_sig_x_origin", "S2_X_ORIGINATING_IP")
_signal_entry("l3_sig_timezone", "S3_DATE_TIMEZONE")
_signal_entry("l9_sig_infra", "S6_INFRASTRUCTURE_GEO")


def _artifact_entry(name: str, kind: str) -> None:
    @entry(name, f"SELECT CAST(k AS VARCHAR) AS email_id, CAST(n - 1 AS INTEGER) AS seq, value "
                 f"FROM artifacts WHERE kind = {oracle.s(kind)}")
    def run(spark, sf):
        found = location.with_artifacts(w.mail(spark, sf))
        return unnest(found, kind, ID, position="seq", item="value")


_artifact_entry("l4_sig_upi", "upi_ids")
_artifact_entry("l5_sig_phone", "phone_numbers")
_artifact_entry("l6_sig_ifsc", "ifsc_codes")
_artifact_entry("l7_sig_currency", "financial_mentions")


@entry("l8_sig_script", "SELECT CAST(k AS VARCHAR) AS email_id, CAST(n - 1 AS INTEGER) AS seq, "
                        "script, CAST(letters AS INTEGER) AS letters FROM scripts")
def l8(spark, sf):
    found = location.with_artifacts(w.mail(spark, sf))
    return unnest(found, "scripts", ID, position="seq", item="s").select(
        ID, "seq", "s.script", "s.letters")


def candidate_rows(spark, sf):
    r = unnest(results(spark, sf), "candidates", ID, position="position", item="c")
    return r.withColumn("place", F.col("position") + 1)


@entry("l10_credit_by_country", "SELECT CAST(k AS VARCHAR) AS email_id, country, "
                                "cc AS country_code, city, region, ip, isp, score FROM ranked")
def l10(spark, sf):
    return candidate_rows(spark, sf).select(
        ID, *[F.col(f"c.{f}") for f in ("country", "country_code", "city", "region", "ip", "isp")],
        F.col("c.confidence_score").alias("score"))


@entry("l11_rank_candidates", "SELECT CAST(k AS VARCHAR) AS email_id, CAST(rnk AS INTEGER) AS "
                              "place, country, score FROM ranked")
def l11(spark, sf):
    return candidate_rows(spark, sf).select(
        ID, "place", "c.country", F.col("c.confidence_score").alias("score"))


@entry("l12_signals_matched", "SELECT CAST(k AS VARCHAR) AS email_id, country, matched "
                              "FROM ranked")
def l12(spark, sf):
    return candidate_rows(spark, sf).select(
        ID, "c.country", text("c.signals_matched").alias("matched"))


@entry("l13_location_confidence", "SELECT email_id, confidence FROM estimate")
def l13(spark, sf):
    return results(spark, sf).select(ID, "estimate.confidence")


@entry("l14_primary_estimate",
       "SELECT email_id, country, cc AS country_code, city, region, device_ip, confidence, "
       "CAST(evidence_count AS INTEGER) AS evidence_count, basis FROM estimate")
def l14(spark, sf):
    return results(spark, sf).select(
        ID, *[F.col(f"estimate.{f}") for f in (
            "country", "country_code", "city", "region", "device_ip", "confidence",
            "evidence_count")], text("estimate.basis").alias("basis"))


@entry("l15_artifacts",
       "SELECT CAST(k AS VARCHAR) AS email_id, kind, string_agg(value, ' | ' ORDER BY n) AS vals "
       "FROM artifacts GROUP BY ALL UNION ALL SELECT CAST(k AS VARCHAR), 'detected_scripts', "
       "string_agg(script || ' (' || letters || ' chars)', ' | ' ORDER BY n) FROM scripts "
       "GROUP BY ALL UNION ALL SELECT CAST(k AS VARCHAR), 'client_ips', "
       "concat_ws(' | ', s1_ip, s2_ip) FROM s12 WHERE s1_ip IS NOT NULL OR s2_ip IS NOT NULL")
def l15(spark, sf):
    pairs = results(spark, sf).select(ID, F.map_entries("artifacts").alias("a"))
    return unnest(pairs, "a", ID, item="e").where(F.size("e.value") > 0).select(
        ID, F.col("e.key").alias("kind"), text("e.value").alias("vals"))


# --- detection ---


def _flag_entry(name: str, base: Callable[[DataFrame], DataFrame], flags: Callable[[], Column],
                *types: str) -> None:
    """A query that builds only the flags it is asked for."""
    quoted = ", ".join(oracle.s(t) for t in types)

    @entry(name, "SELECT CAST(k AS VARCHAR) AS email_id, flag, count(*) AS times FROM flags "
                 f"WHERE split_part(flag, ':', 1) IN ({quoted}) GROUP BY k, flag")
    def run(spark, sf):
        rows = unnest(base(w.mail(spark, sf)).withColumn("flags", flags()), "flags", ID, item="flag")
        return rows.where(detection.base_type(F.col("flag")).isin(*types)).groupBy(ID, "flag").agg(
            F.count("*").alias("times"))


def _one(flag: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: dense(flag())


def _with_body(mail: DataFrame) -> DataFrame:
    return mail.withColumn("_body", detection.body_text())


def _with_lookalikes(mail: DataFrame) -> DataFrame:
    return detection.with_lookalikes(detection.with_sender(mail))


_flag_entry("d1_flag_auth", auth.with_first_verdicts, detection.auth_flags,
            "SPF_FAIL", "SPF_SOFTFAIL", "DKIM_FAIL", "DMARC_FAIL")
_flag_entry("d2_flag_reply_to", detection.with_sender, _one(detection.reply_to_flag),
            "REPLY_TO_MISMATCH")
_flag_entry("d3_flag_return_path", detection.with_sender, _one(detection.return_path_flag),
            "RETURN_PATH_MISMATCH")
_flag_entry("d4_flag_lookalike", _with_lookalikes, detection.lookalike_flags, "LOOKALIKE_DOMAIN")
_flag_entry("d5_flag_urgency", _with_body, _one(detection.urgency_flag), "URGENCY_LANGUAGE")
_flag_entry("d6_flag_ip_url", links.with_urls, detection.url_flags, "IP_BASED_URL")
_flag_entry("d7_flag_short_url", links.with_urls, detection.url_flags, "SHORTENED_URL")
_flag_entry("d8_flag_anchor_mismatch", links.with_urls, detection.url_flags, "ANCHOR_TEXT_MISMATCH")
_flag_entry("d10_flag_display_name", detection.with_sender, detection.display_name_flags,
            "DISPLAY_NAME_IMPERSONATION")
_flag_entry("d11_flag_bec", _with_body, _one(detection.bec_flag), "BEC_LANGUAGE_PATTERN")


@entry("d9_flag_attachment",
       "SELECT email_id, 'RISKY_ATTACHMENT:' || filename AS flag FROM pattach WHERE "
       + " OR ".join(f"ends_with(lower(filename), {oracle.s(e)})"
                     for e in hops.fv.RISKY_EXTENSIONS))
def d9(spark, sf):
    found = w.part_attachments(spark, sf).withColumn("flags", detection.attachment_flags())
    return unnest(found, "flags", ID, item="flag")


@entry("d12_flag_list", "SELECT email_id, flags FROM scored")
def d12(spark, sf):
    return flagged(spark, sf).select(ID, text("flags").alias("flags"))


@entry("d13_rule_score", "SELECT email_id, CAST(rule_score AS INTEGER) AS rule_score FROM scored")
def d13(spark, sf):
    return flagged(spark, sf).select(ID, "rule_score")


@entry("d14_model_score")
def d14(spark, sf):
    """Trained on the labelled documents (toxic = positive), scored on all messages."""
    labels = w.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias(ID), F.col("toxic").cast("double").alias("label"))
    mail = w.mail(spark, sf).select(ID, "subject", "body_plain")
    fitted = model.train(mail.join(labels, ID))
    return model.with_probability(mail, fitted).select(ID, "ml_prob")


@entry("d14_model_table",
       "SELECT email_id, round(1 / (1 + exp(-sum(idf * weight))), 6) AS ml_prob FROM (SELECT email_id, "
       "unnest(list_append(slots, -1)) AS slot FROM mail_slots) m JOIN model_table USING (slot) GROUP BY email_id")
def d14_table(spark, sf):
    """The model is a table trained on the labelled documents, the score a sparse dot product."""
    labels = w.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias(ID), F.col("toxic").alias("label"))
    mail = w.mail(spark, sf).select(ID, "subject", "body_plain")
    table = stage(model.train_table(mail, labels), "model")
    return model.table_probability(mail, table).select(ID, F.round("ml_prob", 6).alias("ml_prob"))


def _fraud_entry(name: str, *columns: str) -> None:
    pairs, sql = named(columns)

    @entry(name, f"SELECT email_id, {sql} FROM fraud")
    def run(spark, sf):
        return detection.with_fraud_score(flagged(spark, sf)).select(ID, *[n for n, _ in pairs])


_fraud_entry("d15_fraud_score", "fraud_score")
_fraud_entry("d16_fraud_category", "fraud_category")
_fraud_entry("d17_detection_confidence", "detection_confidence = c")
_fraud_entry("d18_confidence_label", "confidence_label")


# --- risk and reports ---


@entry("f1_trace_risk", "SELECT email_id, CAST(trace_risk_score AS INTEGER) AS trace_risk_score "
                        "FROM trace_risk")
def f1(spark, sf):
    return results(spark, sf).select(ID, "trace_risk_score")


@entry("f2_trace_level",
       "SELECT email_id, CASE WHEN trace_risk_score >= 60 THEN 'high' WHEN trace_risk_score >= 30 "
       "THEN 'medium' ELSE 'low' END AS trace_risk_level FROM trace_risk")
def f2(spark, sf):
    return results(spark, sf).select(ID, "trace_risk_level")


@entry("f3_risk_reasons", "SELECT email_id, risk_reasons FROM trace_risk")
def f3(spark, sf):
    return results(spark, sf).select(ID, text("risk_reasons").alias("risk_reasons"))


@entry("f4_combined_score", "SELECT email_id, combined AS combined_score FROM verdict")
def f4(spark, sf):
    return results(spark, sf).select(ID, "combined_score")


@entry("f5_overall_verdict", "SELECT email_id, overall_verdict FROM verdict")
def f5(spark, sf):
    return results(spark, sf).select(ID, "overall_verdict")


@entry("f6_status_label", "SELECT email_id, status_label, classification FROM verdict")
def f6(spark, sf):
    return results(spark, sf).select(ID, "status_label", "classification")


@entry("f7_resolved_location", "SELECT id AS email_id, country, city FROM report")
def f7(spark, sf):
    return results(spark, sf).select(
        ID, F.col("report_country").alias("country"), F.col("report_city").alias("city"))


@entry("f8_report_phone", "SELECT id AS email_id, phone FROM report")
def f8(spark, sf):
    return results(spark, sf).select(ID, F.col("report_phone").alias("phone"))


@entry("f9_final_report", _REPORT_SQL)
def f9(spark, sf):
    """From the scan to the report in one go, with its own staged tables."""
    done = analysis.analyze(w.mail(spark, sf), w.dimensions(spark, sf))
    return flat_report(report.final_report(done))


# Leaves of the unified report: path in the report and its SQL.
_NOTE = ("CASE WHEN g.hop_count = 0 THEN 'No Received headers found.' ELSE " + oracle.fmt(
    hops.fv.ATTRIBUTION, "replace(g.origin_basis, '_', ' ')", "coalesce(g.origin_ip, 'unknown')",
    "coalesce(g.edge_ip, 'none')", "coalesce(g.claimed_ip, 'none')") + " END")
_LEAVES = {
    "pipeline_version": "'1.0.0'", "raw_file_path": "m.path",
    "message_meta.message_id": "nullif(trim(m.message_id), '')",
    "message_meta.subject": "nullif(m.subject, '')", "message_meta.from": "m.from_raw",
    "message_meta.to": "m.to_raw", "message_meta.date": "m.date_raw",
    "phishing_detection.fraud_score": "v.fraud_score", "phishing_detection.category": "v.fraud_category",
    "phishing_detection.confidence": "v.c", "phishing_detection.confidence_label": "v.confidence_label",
    "phishing_detection.flags": "v.flags",
    "phishing_detection.ml_confidence": "round(((v.k * 37) % 1001) / 1000.0, 3)",
    "origin_trace.delivery_path.hops_count": "CAST(g.hop_count AS INTEGER)",
    "origin_trace.delivery_path.notes": "n.notes",
    "origin_trace.origin.probable_source_ip": "g.origin_ip",
    "origin_trace.origin.origin_basis": "g.origin_basis",
    "origin_trace.origin.origin_hop_index": "g.walk_index",
    "origin_trace.origin.confidence": "g.origin_confidence",
    "origin_trace.origin.via_provider": "g.via", "origin_trace.origin.attribution_note": _NOTE,
    "origin_trace.origin.geo.country": "CASE WHEN g.origin_ip IS NOT NULL THEN g.country END",
    "origin_trace.origin.geo.city": "CASE WHEN g.origin_ip IS NOT NULL THEN g.city END",
    "origin_trace.origin.edge_ip": "g.edge_ip", "origin_trace.origin.edge_geo.country": "x.country",
    "origin_trace.origin.edge_geo.infrastructure_type": "x.infra",
    "origin_trace.origin.claimed_origin_ip": "g.claimed_ip",
    "origin_trace.origin.claimed_is_verified": "g.origin_verified",
    "origin_trace.origin.spf_edge_ip": "a.spf_client_ip",
    "origin_trace.origin.spf_edge_geo.country": "x.country",
    "origin_trace.authentication.spf.result": "a.spf_result",
    "origin_trace.authentication.spf.domain": "a.spf_domain",
    "origin_trace.authentication.spf.client_ip": "a.spf_client_ip",
    "origin_trace.authentication.dkim.result": "a.dkim_result",
    "origin_trace.authentication.dkim.domain": "a.dkim_domain",
    "origin_trace.authentication.dmarc.result": "a.dmarc_result",
    "origin_trace.authentication.dmarc.policy": "a.dmarc_policy",
    "origin_trace.authentication.summary": "a.auth_summary",
    **{f"origin_trace.authentication.{d}": f"d.{d}" for d in _DOMAINS},
    **{f"origin_trace.sender_location_estimate.primary_estimate.{f}": q for f, q in {
        "country": "e.country", "country_code": "e.cc", "city": "e.city", "region": "e.region",
        "device_ip": "e.device_ip", "confidence": "e.confidence", "basis": "e.basis",
        "evidence_count": "CAST(e.evidence_count AS INTEGER)"}.items()},
    "origin_trace.risk.trace_risk_score": "CAST(t.trace_risk_score AS INTEGER)",
    "origin_trace.risk.trace_risk_level": "CASE WHEN t.trace_risk_score >= 60 THEN 'high' "
                                          "WHEN t.trace_risk_score >= 30 THEN 'medium' ELSE 'low' END",
    "origin_trace.risk.reasons": "t.risk_reasons",
    "overall_assessment.combined_threat_score": "v.combined",
    "overall_assessment.overall_verdict": "v.overall_verdict",
    **{f"final_output.{f}": f"r.{f}" for f in (
        "id", "subject", "email", "sender", "phone", "ip", "name", "country", "city", "risk_score",
        "classification", "status")},
    "final_output.overall_assessment.combined_threat_score": "r.risk_score",
    "final_output.overall_assessment.overall_verdict": "r.overall_verdict",
}
_LISTS = ("phishing_detection.flags", "origin_trace.delivery_path.notes", "origin_trace.risk.reasons",
          "origin_trace.sender_location_estimate.primary_estimate.basis")


def _leaf(path: str) -> str:
    return path.replace(".", "_")


@entry("f10_unified_report",
       "SELECT m.email_id, " + ", ".join(f"{q} AS {_leaf(p)}" for p, q in _LEAVES.items())
       + " FROM mail m JOIN (SELECT * RENAME (trace_risk_score AS t1) FROM verdict) v ON v.k = m.k "
       "JOIN geo g ON g.k = m.k JOIN trace_risk t ON t.k = m.k JOIN trace_auth a ON a.k = m.k "
       "JOIN domains d ON d.k = m.k LEFT JOIN estimate e ON e.k = m.k JOIN report r ON r.k = m.k "
       f"JOIN (SELECT k, {oracle.joined('note', 'ord')} AS notes FROM mail LEFT JOIN notes USING (k) GROUP BY k) n "
       "ON n.k = m.k LEFT JOIN intel x ON x.ip = g.edge_ip AND g.edge_ip IS DISTINCT FROM g.origin_ip")
def f10(spark, sf):
    u = report.unified_report(results_once(spark, sf))
    return u.select(ID, *[
        (text(F.col(p)) if p in _LISTS else F.col(p)).alias(_leaf(p)) for p in _LEAVES])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages have a forged or unverified origin, and where do they come from?"""
    spark = configure(spark)
    traced = analysis.trace_only(w.mail(spark, sf_dir), w.dimensions(spark, sf_dir))
    return traced.where(~F.col("origin_verified")).select(
        ID, "origin_ip", "origin_basis", "claimed_ip",
        F.col("origin_geo.country").alias("country"), "trace_risk_score", "trace_risk_level")



"""Mail-shaped relations derived from the benchmark tables.

Flat columns come from one SQL text with a few dialect switches, so that the comparison engine
derives exactly the same input; packing them into the ``messages`` schema is done here.  All
derivations are row-local projections of the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens import schemas
from relaylens.operators.links import html_anchors
from relaylens.plans.analysis import Dimensions
from relaylens.session import spread

HOPS = 4


def _case(expr: str, options: list[str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(options))
    return f"CASE {expr} {arms} ELSE {default} END"


def _q(*texts: str) -> list[str]:
    return ["NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts]


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _two(expr: str) -> str:
    return f"lpad({_text(expr)}, 2, '0')"


def _public_ip(s: str) -> str:
    """Address from a number; every third one is the same, very busy address."""
    return (
        f"CASE WHEN ({s}) % 3 = 0 THEN '62.41.7.19' ELSE "
        f"{_text(f'11 + (({s}) * 37) % 180')} || '.' || {_text(f'(({s}) * 91) % 256')} || '.' || "
        f"{_text(f'(({s}) * 53) % 256')} || '.' || {_text(f'1 + ({s}) % 254')} END"
    )


def _hop_ip(s: str) -> str:
    return (
        f"CASE WHEN ({s}) % 23 = 5 THEN '2607:f8b0:4864::' || {_text(f'({s}) % 10')} "
        f"WHEN ({s}) % 23 = 7 THEN 'fe80::1' "
        f"WHEN ({s}) % 23 = 9 THEN 'IPv6:2607:f8b0::5' "
        f"WHEN ({s}) % 29 = 3 THEN '01.2.3.4' "
        f"WHEN ({s}) % 7 = 0 THEN '10.' || {_text(f'({s}) % 256')} || '.0.7' "
        f"WHEN ({s}) % 11 = 1 THEN '203.0.113.' || {_text(f'({s}) % 254')} "
        f"ELSE {_public_ip(s)} END"
    )


def _received(i: str, s: str, ip: str) -> str:
    """One Received header as text, from message ``k``, hop ``i``, its serial and address."""
    host = f"CASE WHEN k % 4 = 0 THEN 'mail' || {_text(i)} || '.google.com' ELSE " \
        + _case(f"{s} % 9", [
            "'mail-qk7.google.com'", "'relay.example.net'", "'smtp.outlook.com'",
            f"'host' || {_text(s)} || '.rackhost.cc'", f"'[' || {ip} || ']'",
            "'mx.yahoo.co.in'", "'desk-12.corp'", "'a1.amazonses.com'", "'notgoogle.com'"]) \
        + " END"
    paren = (
        f"CASE WHEN {s} % 31 = 0 THEN '' WHEN {s} % 5 = 4 THEN ' ([' || {ip} || '])' "
        f"ELSE ' (unknown [' || {ip} || '])' END"
    )
    by = "CASE WHEN k % 4 = 0 THEN 'mx.google.com' ELSE " + _case(f"{s} % 6", _q(
        "mx.lyceum.ac.in", "mx.google.com", "relay.corp.example.com", "smtp.gmail.com",
        "edge.example.org", "in.mailgun.org")) + " END"
    proto = _case(f"{s} % 6", _q("ESMTPS", "SMTP", "esmtp", "ESMTPSA", "SMTPSA", "UTF8SMTPTLS"))
    user = f"CASE {s} % 10 WHEN 3 THEN ' (authenticated as office@corp.example.com)' " \
        "WHEN 7 THEN ' auth=user7' ELSE '' END"
    zone = f"CASE {s} % 8 WHEN 2 THEN '-0000' WHEN 3 THEN 'GMT' WHEN 4 THEN '+0000' " \
        "WHEN 5 THEN '-0500' ELSE '+0530' END"
    stamp = (
        f"CASE WHEN {s} % 37 = 0 THEN 'not a date' ELSE 'Mon, ' || {_two('1 + k % 27')} || "
        f"' Sep 2025 ' || {_two('(k * 7) % 24')} || ':' || "
        f"{_two(f'40 - 10 * {i} + ({s} * 13) % 17')} || ':' || {_two(f'{s} % 60')} || ' ' || "
        f"{zone} END"
    )
    return (
        f"'from ' || {host} || {paren} || '  by ' || {by} || ' with ' || {proto} || ' id x' || "
        f"{_text('k')} || {user} || ' for <reader@lyceum.ac.in>; ' || {stamp}"
    )


_HOP_COUNT = (
    "CASE k % 12 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 "
    "WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 3 WHEN 8 THEN 3 ELSE 4 END"
)


def received_sql() -> str:
    """Comparison form: (k, i, received), one row per hop, newest first."""
    return f"""
SELECT k, i, {_received('i', 's', 'ip')} AS received FROM (
 SELECT k, i, s, {_hop_ip('s')} AS ip FROM (
  SELECT k, i, k * {HOPS} + i AS s FROM (
   SELECT doc_id AS k, unnest([0, 1, 2, 3]) AS i FROM documents) a
  WHERE i < {_HOP_COUNT}) b) c"""


def _with_received(flat: DataFrame) -> DataFrame:
    """The same hops as an array in the message row: no explode, no regrouping."""
    numbers = F.expr(
        f"transform(slice(array(0, 1, 2, 3), 1, {_HOP_COUNT}), "
        f"i -> named_struct('i', i, 's', k * {HOPS} + i))")
    addressed = F.expr(
        f"transform(_n, x -> named_struct('i', x.i, 's', x.s, 'ip', {_hop_ip('x.s')}))")
    texts = F.expr(f"transform(_a, x -> {_received('x.i', 'x.s', 'x.ip')})")
    return flat.withColumn("_n", numbers).withColumn("_a", addressed) \
        .withColumn("received", texts).drop("_n", "_a")


_SNIPPETS = _q(
    "Please act now and verify your account .",
    "Kindly handle this wire transfer and keep this between us .",
    "Pay to fees.office@okaxis or shop@ybl or x@okaxis today",
    "Helpline +91 7012345678 or 8123456789 now",
    "Bank IFSC KKBK0004567 and HDFC0004321 here",
    "Amount INR 1,340.75 or Rs. 300 due",
    "Open http://45.61.7.45/form now",
    "See https://bit.ly/abc and http://t.co/x now",
    "नमस्ते दोस्त अभी",
    "Привет друг",
    "See https://www.microsoft.com/en and https://sub.shop.co.uk/a?b=1 now",
    "Send gift cards , urgent payment , Rs.5,000 to abc@paytm phone 9123456780 now",
    "مرحبا வணக்கம்",
    "See https://a.example.com/x and https://a.example.com/x now",
    "",
    "ગુજરાતી বাংলা తెలుగు",
)
_HTML = _q(
    '<p>Dear user <a href="https://evil.example.org/login">PayPal login</a></p>',
    '<a href="https://www.paypal.com/home">PayPal</a> <a href="http://10.1.2.3/a">Amazon deals</a>',
    '<a class="b" href="https://a.example.com/x"><b>Google Docs</b></a> urgent payment',
    '<a href="https://www.microsoft.com/en">Microsoft and Apple</a> <a href="/rel">x</a>',
)
FROM_DOMAINS = [
    "gmail.com", "paypal.com", "paypa1.com", "sbi.co.in", "mail.corp.example.com",
    "googlemail.com", "amazon.com", "amaz0n.com", "bankofamerica.com", "chase.com",
    "micros0ft.com", "example.org", "apple.com", "Lyceum.ac.in",
]
_NAMES = [
    "", "PayPal Security", "Dr Okafor", "Harbour Bank Desk", "IT Support", "CEO Office",
    "Amazon Billing", "HR Desk", "Google Alerts", "Chase Helpdesk", "Accounts Team",
]


def mail_sql(documents: str = "documents") -> str:
    """Flat mail columns, one row per document."""
    verdicts = "' (sender IP is ' || ip0 || ') smtp.mailfrom=bounce@' || from_dom || '; '"
    auth1 = _case("k % 9", [
        "NULL",
        f"'mx.lyceum.ac.in; spf=pass' || {verdicts} || 'dkim=pass header.d=' || from_dom || "
        "'; dmarc=pass (p=NONE) header.from=x'",
        f"'mx.lyceum.ac.in; spf=fail' || {verdicts} || 'dkim=fail; dmarc=fail (p=REJECT)'",
        "'mx.lyceum.ac.in; spf=softfail; dkim=none; dmarc=none'",
        f"'mx.lyceum.ac.in;   SPF=Pass' || {verdicts} || 'dkim=fail header.i=@' || from_dom || "
        "'; dmarc=pass'",
        "'mx.lyceum.ac.in; dkim=permerror; spf=pass'",
        "'mx.lyceum.ac.in; spf=bogus; dkim=neutral'",
        "'one.example.org; dkim=pass header.d=a.com'",
        "'mx.lyceum.ac.in; dmarc=fail'",
    ])
    auth2 = "CASE WHEN k % 9 = 7 THEN 'two.example.org; dkim=fail; spf=temperror; p=none' END"
    rspf = _case("k % 8", _q(
        "pass (domain of a@b.example designates 45.12.13.14) client-ip=45.12.13.14; "
        "envelope-from=a@b.example;",
        "Fail  (not permitted) client-ip=[62.1.2.3];", "softfail (weak)", "odd value",
    ))
    reply = _case("k % 5", [
        "NULL", "'desk@' || from_dom", "'replies@mailbox.onion'", "'noreply@mail.' || from_dom",
        "NULL"])
    path = _case("k % 7", [
        "NULL", "'<bounce@' || from_dom || '>'", "'<x@bounce.' || from_dom || '>'",
        "'<support@other-alerts.com>'", "'<>'", "NULL", "NULL"])
    to_name = _case("k % 6", _q("Reader", "", "Student One", "", None, ""))
    to_addr = _case("k % 6", _q(
        "reader@lyceum.ac.in", "reader@lyceum.ac.in", "s1@lyceum.ac.in", "v2@example.org",
        None, "v3@example.org"))
    zone = _case("k % 10", _q(
        "+0530", "+0000", "-0500", "+0530", "-0800", "+0900", "+0100", "GMT", "+1234", ""))
    attachment = _case("k % 8", _q("invoice.PDF", "setup.EXE", "page.html", "notes.txt", "run.js"))
    return f"""
SELECT CAST(k AS STRING) AS email_id, k, '/mail/' || CAST(k AS STRING) || '.eml' AS path,
 '<m' || CAST(k AS STRING) || '@example.org> ' AS message_id,
 CASE WHEN k % 17 = 3 THEN '' ELSE replace(substr(text, 1, 40), chr(10), ' ') END AS subject,
 from_name, from_address,
 CASE WHEN from_address IS NULL THEN NULL WHEN from_name = '' THEN from_address
  ELSE from_name || ' <' || from_address || '>' END AS from_raw,
 {to_name} AS to_name, {to_addr} AS to_address,
 CASE WHEN k % 6 = 4 THEN NULL WHEN ({to_name}) = '' THEN {to_addr}
  ELSE {to_name} || ' <' || {to_addr} || '>' END AS to_raw,
 CASE WHEN k % 41 = 7 THEN NULL ELSE 'Mon, 01 Sep 2025 10:12:00 ' || {zone} END AS date_raw,
 {reply} AS reply_address, {path} AS return_path_raw,
 CASE WHEN k % 6 = 0 THEN 'Agent <agent@example.org>' END AS sender_raw,
 {auth1} AS auth1, {auth2} AS auth2, {rspf} AS received_spf,
 CASE WHEN k % 10 = 0 THEN '[' || {_public_ip('k * 5 + 1')} || ']'
  WHEN k % 10 = 1 THEN '10.1.1.1' END AS x_originating,
 CASE WHEN k % 10 = 2 THEN 'unknown' END AS x_sender,
 CASE WHEN k % 10 = 1 THEN {_public_ip('k * 5 + 2')} END AS x_client,
 text || ' ' || chr(10) || {_case('k % 16', _SNIPPETS)} || ' ' || chr(10) AS body_plain,
 {_case('k % 7', _HTML, "''")} AS body_html,
 {attachment} AS file_name, 'file body ' || CAST(k % 300 AS STRING) AS file_text,
 CAST((k * 37) % 1001 AS DOUBLE) / 1000 AS ml_prob
FROM (
 SELECT doc_id AS k, text, {_hop_ip(f'doc_id * {HOPS}')} AS ip0,
  {_case('doc_id % 11', _q(*_NAMES))} AS from_name,
  {_case('doc_id % 14', _q(*FROM_DOMAINS))} AS from_dom,
  CASE WHEN doc_id % 97 <> 50 THEN 'user' || CAST(doc_id % 50 AS STRING) || '@' ||
   {_case('doc_id % 14', _q(*FROM_DOMAINS))} END AS from_address
 FROM {documents}
) d"""


CITY_SQL = """
SELECT CAST(n_nationkey AS BIGINT) * 171798692 AS lo,
 CAST(n_nationkey AS BIGINT) * 171798692 + 171798691 AS hi,
 CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_name END AS country,
 CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 'N' || CAST(n_nationkey AS STRING) END
  AS country_code,
 r_name AS region,
 CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'City ' || CAST(n_nationkey AS STRING) END AS city,
 CAST(n_nationkey AS DOUBLE) * 1.5 AS lat, CAST(n_nationkey AS DOUBLE) * -2 AS lon,
 'UTC' AS timezone, n_nationkey % 4 = 2 AS is_hosting, n_nationkey % 4 = 1 AS is_proxy_or_vpn,
 n_nationkey % 4 = 3 AS is_mobile, CAST(NULL AS STRING) AS lo6, CAST(NULL AS STRING) AS hi6
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT NULL, NULL, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_name END,
 CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 'N' || CAST(n_nationkey AS STRING) END, r_name,
 'City ' || CAST(n_nationkey AS STRING), CAST(n_nationkey AS DOUBLE), CAST(n_nationkey AS DOUBLE), 'UTC',
 n_nationkey % 4 = 2, n_nationkey % 4 = 1, n_nationkey % 4 = 3,
 '2607f8b04864' || lpad(CAST(n_nationkey AS STRING), 20, '0'),
 '2607f8b04864' || lpad(CAST(n_nationkey AS STRING), 20, '0')
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 10
UNION ALL
SELECT NULL, NULL, r_name, 'R0', r_name, NULL, 1.0, 2.0, 'UTC', false, false, true,
 rpad('26', 32, '0'), rpad('2607f8b00', 32, 'f')
FROM region WHERE r_regionkey = 0"""

ASN_SQL = f"""
SELECT CAST(n_nationkey AS BIGINT) * 171798692 + 1000000 AS lo,
 CAST(n_nationkey AS BIGINT) * 171798692 + 151000000 AS hi,
 'AS' || CAST(64500 + n_nationkey AS STRING) AS asn,
 {_case('n_nationkey % 7', ["'Google LLC'", "'Amazon.com Inc'", "'Hetzner Online'",
                            "n_name || ' Telecom'", "'Laws Broadband'", "NULL", "'Zoho Corp'"])}
  AS asn_name, CAST(NULL AS STRING) AS lo6, CAST(NULL AS STRING) AS hi6
FROM nation
UNION ALL
SELECT NULL, NULL, 'AS6', 'Laws Broadband', rpad('2607f8b048640', 32, '0'), rpad('2607f8b048640', 32, 'f')
FROM region WHERE r_regionkey = 0"""

FALLBACK_SQL = """
SELECT CAST(r_regionkey AS BIGINT) * 858993460 AS lo,
 CAST(r_regionkey AS BIGINT) * 858993460 + 858993459 AS hi,
 r_name AS country, 'R' || CAST(r_regionkey AS STRING) AS country_code,
 CAST(NULL AS STRING) AS city, r_name || ' Net' AS isp, r_regionkey = 2 AS is_hosting,
 CAST(NULL AS STRING) AS lo6, CAST(NULL AS STRING) AS hi6
FROM region
UNION ALL
SELECT NULL, NULL, r_name, 'R1', NULL, r_name || ' Six', false, rpad('2607f8b04864', 32, '0'),
 rpad('2607f8b04864', 32, 'f')
FROM region WHERE r_regionkey = 1"""

PTR_SQL = f"""
SELECT {_public_ip('s_suppkey')} AS ip, 'host' || CAST(s_suppkey AS STRING) || '.isp.example'
 AS reverse_dns
FROM supplier"""

# Overlapping ranges of very different widths, one per customer.
OVERLAP_SQL = """
SELECT (c_custkey * 2654435761) % 4294967296 AS lo,
 least((c_custkey * 2654435761) % 4294967296 + width - 1, 4294967295) AS hi,
 c_name AS country
FROM (SELECT c_custkey, c_name, CASE c_custkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 300
 WHEN 2 THEN 65536 WHEN 3 THEN 70000 WHEN 4 THEN 1000000 WHEN 5 THEN 20000000
 WHEN 6 THEN 100000000 ELSE 300000000 END AS width FROM customer) c"""

# Addresses of one provider, all under 2a02:26f7::/32, one per order.
SIX_ADDRESS_SQL = """
SELECT '2a02:26f7:' || substr(net, 9, 4) || ':' || substr(net, 13, 4) || '::' || host AS ip,
 net || lpad(host, 16, '0') AS six
FROM (SELECT lower(hex(3027024741845172224 + (CAST(o_orderkey AS BIGINT) * 2654435761) % 4294967296)) AS net,
 lower(hex(CAST(o_custkey AS BIGINT) % 65536)) AS host FROM orders) o"""

# Ranges inside it in three sizes of networks, unaligned ones, and ones across its borders; one per part.
SIX_RANGE_SQL = """
SELECT label, lo64, hi64, lower(hex(lo64)) || repeat('0', 16) AS lo6,
 lower(hex(hi64)) || repeat('f', 16) AS hi6
FROM (SELECT label, lo64, lo64 + CASE p % 5 WHEN 0 THEN 16777215 WHEN 1 THEN 65535 WHEN 2 THEN 255
 WHEN 3 THEN (p % 777) * 12345678 ELSE (p % 7) * 100000003 END AS hi64
FROM (SELECT p, label, base + CASE p % 5 WHEN 0 THEN (p * 7919) % 256 * 16777216
 WHEN 1 THEN (p * 104729) % 65536 * 65536 WHEN 2 THEN (p * 15485863) % 16777216 * 256
 WHEN 3 THEN -1 - (p % 1000) * 429496 ELSE (p * 48271) % 4294967296 END AS lo64
FROM (SELECT CAST(p_partkey AS BIGINT) AS p, p_name AS label, 3027024741845172224 AS base FROM part) a) b) c"""

# A suffix list with wildcards and exceptions, one rule per part, and hosts for it, one per customer.
SUFFIX_SQL = """
SELECT CASE p % 7 WHEN 0 THEN '*.w' || p WHEN 1 THEN '!city.w' || (p - 1) WHEN 2 THEN 'co.x' || p
 WHEN 3 THEN 'x' || (p - 1) WHEN 4 THEN 'a.b.y' || p WHEN 5 THEN 'y' || (p - 1) ELSE 'Z' || p END AS rule
FROM (SELECT CAST(p_partkey AS BIGINT) AS p FROM part) a"""

HOST_SQL = """
SELECT CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'www.' ELSE 'K.l.' END || CASE c % 7
 WHEN 0 THEN 'shop.w' || m WHEN 1 THEN 'city.w' || m WHEN 2 THEN 'co.x' || (m + 2) WHEN 3 THEN 'x' || (m + 2)
 WHEN 4 THEN 'a.b.y' || (m + 4) WHEN 5 THEN 'b.y' || (m + 4) ELSE 'mail.q' || m END AS host
FROM (SELECT c, c - c % 7 AS m, (c - c % 7) / 7 AS k7, CAST(floor(c / 7) AS BIGINT) AS k
 FROM (SELECT CAST(c_custkey AS BIGINT) AS c FROM customer) a) b
UNION ALL SELECT '10.1.2.' || CAST(n_nationkey AS STRING) FROM nation
UNION ALL SELECT 'Com.W7.' FROM region"""

URLS_SQL = """
SELECT CAST(page_id AS STRING) AS email_id, url AS page_url,
 replace(html, 'href="/', 'href="' || CASE page_id % 5 WHEN 0 THEN 'https://www.example.com/'
  WHEN 1 THEN 'http://185.220.101.45/' WHEN 2 THEN 'https://bit.ly/'
  WHEN 3 THEN 'https://shop.example.co.uk/' ELSE 'https://www.paypal.com/' END) AS body_html,
 'Visit ' || url || ' or https://www.example.com/The now' AS body_plain
FROM pages"""

ATTACHMENTS_SQL = f"""
SELECT CAST(p_partkey AS STRING) AS email_id,
 CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE p_name || {_case('p_partkey % 9', _q(
     '.exe', '.PDF', '.Js', '.html', '.txt', '.iso', '.bat.zip', '.vbs', ''))} END AS filename,
 p_type AS content_type, p_name AS payload
FROM part"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(
        _with_names(sql, names),
        **{n: table(spark, sf_dir, n) for n in names})


def _with_names(sql: str, names: tuple[str, ...]) -> str:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return sql


def flat_mail(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents") if documents is None else documents)
    return _with_received(spark.sql(_with_names(mail_sql(), ("documents",)), documents=docs))


def pack(flat: DataFrame) -> DataFrame:
    """Flat columns to the ``messages`` schema (plus ``ml_prob``)."""

    def party(name: str, addr: str):
        pair = F.struct(F.col(name).alias("name") if name else F.lit("").alias("name"),
                        F.col(addr).alias("addr"))
        return F.when(F.col(addr).isNotNull(), F.array(pair)).otherwise(
            F.array().cast("array<struct<name:string,addr:string>>"))

    headers = {"X-Originating-IP": "x_originating", "X-Sender-IP": "x_sender",
               "X-Client-IP": "x_client"}
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(v).alias("v"))
                  for k, v in headers.items()]),
        lambda e: e["v"].isNotNull())
    file = F.struct(
        F.col("file_name").alias("filename"), F.lit("application/octet-stream")
        .alias("content_type"), F.length("file_text").cast("long").alias("size"),
        F.sha2("file_text", 256).alias("sha256"))
    packed = flat.withColumns({
        "from_addr": party("from_name", "from_address"),
        "to_addr": party("to_name", "to_address"), "reply_to": party("", "reply_address"),
        "auth_headers": F.array_compact(F.array("auth1", "auth2")),
        "x_headers": F.map_from_entries(entries),
        "trace_body": F.concat("body_plain", F.when(
            F.col("body_html") != "", F.concat(F.lit("\n"), "body_html")).otherwise("")),
        "anchors": html_anchors(F.col("body_html")),
        "attachments": F.when(F.col("file_name").isNotNull(), F.array(file)).otherwise(
            F.array().cast(
                "array<struct<filename:string,content_type:string,size:bigint,sha256:string>>")),
        "error": F.lit(None).cast("string"),
    })
    names = [p.split()[0] for p in schemas.MESSAGES.replace("\n", " ").split(", ")]
    return packed.select(*names, "ml_prob")


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(flat_mail(spark, sf_dir))


def city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, CITY_SQL, "nation", "region")


def asn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, ASN_SQL, "nation", "region")


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, FALLBACK_SQL, "region")


def ptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, PTR_SQL, "supplier")


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, OVERLAP_SQL, "customer")


def six_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, SIX_ADDRESS_SQL, "orders").select("ip")


def six_ranges(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Nested and overlapping IPv6 ranges whose only field is ``label``."""
    nothing = F.lit(None).cast("bigint")
    return _query(spark, sf_dir, SIX_RANGE_SQL, "part").select(
        nothing.alias("lo"), nothing.alias("hi"), "lo6", "hi6", F.col("label").alias(label))


def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, SUFFIX_SQL, "part")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, HOST_SQL, "customer", "nation", "region")


def page_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _query(spark, sf_dir, URLS_SQL, "pages")
    return flat.withColumn("anchors", html_anchors(F.col("body_html")))


def part_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _query(spark, sf_dir, ATTACHMENTS_SQL, "part")
    return flat.select("email_id", F.array(F.struct(
        "filename", "content_type", F.length("payload").cast("long").alias("size"),
        F.when(F.col("payload") != "", F.sha2("payload", 256)).alias("sha256"),
    )).alias("attachments"))


def dimensions(spark: SparkSession, sf_dir: str) -> Dimensions:
    return Dimensions(city(spark, sf_dir), asn(spark, sf_dir), fallback(spark, sf_dir),
                      ptr(spark, sf_dir))


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw contents: many of them are exact copies."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.format_string("/mail/%010d.eml", "doc_id").alias("path"),
        F.encode("text", "UTF-8").alias("content"))


def raw_mail(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None,
             broken: int = 0) -> DataFrame:
    """The derived mail written out as message bytes, to go through the MIME stage.

    With ``broken`` the text of every so many messages names a charset that does not exist.
    """
    m = flat_mail(spark, sf_dir, documents)
    nl = F.lit("\r\n")

    def header(name: str, value):
        value = F.col(value) if isinstance(value, str) else value
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, nl)).otherwise("")

    def encoded(c):
        return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")

    def part(head, body, condition=F.lit(True)):
        return F.when(condition, F.concat(
            F.lit("--=_b\r\nContent-Type: "), head,
            F.lit("\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
            F.base64(F.encode(body, "UTF-8")), nl)).otherwise("")

    file_head = F.concat(
        F.lit("application/octet-stream\r\nContent-Disposition: attachment; filename=\""),
        F.col("file_name"), F.lit("\""))
    text_head = F.lit("text/plain; charset=utf-8") if not broken else F.when(
        F.col("k") % broken == 0, F.lit("text/plain; charset=x-nobody")).otherwise(
        F.lit("text/plain; charset=utf-8"))
    subject = F.concat(F.lit("=?utf-8?b?"), encoded(F.col("subject")), F.lit("?="))
    text = F.concat(
        F.array_join(F.transform(
            "received", lambda r: F.concat(F.lit("Received: "), r, nl)), ""),
        header("Authentication-Results", "auth1"), header("Authentication-Results", "auth2"),
        header("Received-SPF", "received_spf"), header("Return-Path", "return_path_raw"),
        header("X-Originating-IP", "x_originating"), header("X-Sender-IP", "x_sender"),
        header("X-Client-IP", "x_client"), header("From", "from_raw"), header("To", "to_raw"),
        header("Reply-To", "reply_address"), header("Sender", "sender_raw"),
        F.when(F.col("subject") != "", header("Subject", subject)).otherwise(""),
        header("Date", "date_raw"), header("Message-ID", F.trim("message_id")),
        F.lit("MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=\"=_b\"\r\n\r\n"),
        part(text_head, F.col("body_plain")),
        part(F.lit("text/html; charset=utf-8"), F.col("body_html"), F.col("body_html") != ""),
        part(file_head, F.col("file_text"), F.col("file_name").isNotNull()),
        F.lit("--=_b--\r\n"),
    )
    return m.select("path", F.encode(text, "UTF-8").alias("content"))


def given_probability(messages: DataFrame) -> DataFrame:
    """The workload's supplied probability, from the message number in the path."""
    k = F.regexp_extract("path", r"(\d+)\.eml$", 1).cast("long")
    return messages.withColumn("ml_prob", ((k * 37) % 1001).cast("double") / 1000)

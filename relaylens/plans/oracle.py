"""The same questions as plain SQL over long tables, for comparison by another engine.

Written independently of the DataFrame plans: hops, flags, signals and credits are long tables
here, combined by windows, joins and aggregates.
"""

from __future__ import annotations

from relaylens import fixed_values as fv
from relaylens.functions.hosts import URL_PATTERN
from relaylens.functions.ip import IPV4_PATTERN, IPV6_PATTERN
from relaylens.functions.text import any_of
from relaylens.operators.links import ANCHOR_PATTERN
from relaylens.plans import workload as w


def s(text: str) -> str:
    """SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(column: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, {s(pattern)}, {group}), '')"


def fmt(template: str, *args: str) -> str:
    """printf-style text as concatenation."""
    pieces = template.replace("%d", "%s").split("%s")
    out = s(pieces[0])
    for arg, piece in zip(args, pieces[1:]):
        out += f" || CAST({arg} AS VARCHAR) || {s(piece)}"
    return f"({out})"


def joined(items: str, order: str, where: str = "TRUE") -> str:
    return f"coalesce(string_agg({items}, ' | ' ORDER BY {order}) FILTER (WHERE {where}), '')"


def _private_v4(n: str) -> str:
    import ipaddress

    def inside(networks):
        return " OR ".join(
            f"{n} BETWEEN {int(x[0])} AND {int(x[-1])}"
            for x in map(ipaddress.ip_network, networks))

    return f"(({inside(fv.PRIVATE_V4)}) AND NOT ({inside(fv.PRIVATE_V4_EXCEPT)}))"


def _v6_hex(c: str) -> str:
    """The 32 hex digits of an IPv6 text without a dotted tail."""
    def groups(part):
        return (f"array_to_string(list_transform(list_filter(string_split(split_part({c}, '::', {part}), ':'), "
                "lambda g: g <> ''), lambda g: lpad(lower(g), 4, '0')), '')")

    left, right = groups(1), groups(2)
    return f"({left} || repeat('0', 32 - len({left}) - len({right})) || {right})"


def _in_v6(h: str, networks: list[str]) -> str:
    import ipaddress

    return "(" + " OR ".join(f"{h} BETWEEN '{int(x[0]):032x}' AND '{int(x[-1]):032x}'"
                             for x in map(ipaddress.ip_network, networks)) + ")"


def _private_v6(h: str) -> str:
    return f"({_in_v6(h, fv.PRIVATE_V6)} AND NOT {_in_v6(h, fv.PRIVATE_V6_EXCEPT)})"


def _v4_number(c: str) -> str:
    return "(" + " + ".join(
        f"TRY_CAST(split_part({c}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)
    ) + ")"


def _is4(c: str) -> str:
    return f"regexp_matches({c}, {s(IPV4_PATTERN)})"


def _is_ip(c: str) -> str:
    return f"({_is4(c)} OR regexp_matches({c}, {s(IPV6_PATTERN)}))"


def _relay(c: str) -> str:
    return (f"coalesce(regexp_matches(trim(lower({c}), '[]().'), "
            f"{s('(^|[.])(' + any_of(fv.REPUTABLE_RELAYS) + ')$')}), FALSE)")


_IP_SCAN = r"(?:^|[\[\s(])((?:\d{1,3}\.){3}\d{1,3}|[A-Fa-f0-9:]{2,45}:[A-Fa-f0-9:]*)"


def _first_ip(c: str) -> str:
    return (f"list_filter(regexp_extract_all({c}, {s(_IP_SCAN)}, 1), "
            f"lambda x: {_is_ip('x')})[1]")


def _domain(c: str) -> str:
    return (f"CASE WHEN contains({c}, '@') THEN "
            f"trim(lower(substr({c}, strpos({c}, '@') + 1)), '[]().') END")


def _inner(c: str) -> str:
    return f"CASE WHEN contains({c}, '<') THEN regexp_extract({c}, '<([^<>]*)>', 1) ELSE {c} END"


def _unrelated(a: str, b: str) -> str:
    return (f"({a} <> {b} AND NOT ends_with({a}, '.' || {b}) "
            f"AND NOT ends_with({b}, '.' || {a}))")


def _in(c: str, values: list[str]) -> str:
    return f"{c} IN ({', '.join(s(v) for v in values)})"


_OK = ", ".join(s(r) for r in fv.AUTH_RESULTS)
_SUFFIX_DEPTHS = sorted({x.count(".") + 1 for x in fv.PUBLIC_SUFFIXES})


def _host(c: str) -> str:
    return f"lower(regexp_extract({c}, '^[a-z]+://([^/:?#]*)', 1))"


def _registered(h: str) -> str:
    arms = [f"WHEN regexp_matches({h}, '^[0-9.]+$') THEN {h}"]
    for depth in reversed(_SUFFIX_DEPTHS):
        level = [x for x in fv.PUBLIC_SUFFIXES if x.count(".") + 1 == depth]
        tail = f"array_to_string(string_split({h}, '.')[-{depth}:], '.')"
        arms.append(f"WHEN {_in(tail, level)} THEN "
                    f"array_to_string(string_split({h}, '.')[-{depth + 1}:], '.')")
    return f"CASE {' '.join(arms)} ELSE string_split({h}, '.')[-1] END"


def _content_found(pattern: str, group: int) -> str:
    return f"regexp_extract_all(full_text, {s(pattern)}, {group})"


def _signal(seq, sid, name, weight, value, estimate, evidence, country, code, credited="TRUE",
            city="NULL", region="NULL", ip="NULL", isp="NULL"):
    return (
        f"k, {seq} AS seq, {sid} AS signal_id, {name} AS name, CAST({weight} AS DOUBLE) AS weight,"
        f" {value} AS value, {estimate} AS est, {evidence} AS evidence, {country} AS country,"
        f" {code} AS cc, {credited} AS credited, CAST({city} AS VARCHAR) AS city,"
        f" CAST({region} AS VARCHAR) AS region, CAST({ip} AS VARCHAR) AS ip,"
        f" CAST({isp} AS VARCHAR) AS isp"
    )


def _address_signal(seq, sid, name, weight, address, evidence):
    country = "coalesce(nullif(g.country, ''), 'Unknown')"
    return "SELECT " + _signal(
        seq, s(sid), s(name), weight, address,
        f"trim(coalesce(g.city, '') || ', ' || {country}, ', ')", evidence, country,
        "coalesce(nullif(g.country_code, ''), 'XX')", "TRUE", "g.city", "g.region", address,
        "g.isp")


def _intel_value(f: str) -> str:
    has = {"isp": "n.asn_name", "asn": "n.asn", "asn_name": "n.asn_name"}
    first = "CASE WHEN (c.lo IS NOT NULL OR c.lo6 IS NOT NULL) AND " \
        f"(n.lo IS NOT NULL OR n.lo6 IS NOT NULL) THEN {has[f]} END" \
        if f in has else f"c.{f}"
    if f in ("country", "country_code", "city", "isp", "is_hosting"):
        first = f"CASE WHEN c.country IS NULL THEN coalesce(f.{f}, {first}) ELSE {first} END"
    return f"{first} AS {f}"


def _zone_values() -> str:
    return ", ".join(f"({s(z)}, {s(c)}, {s(cc)})" for z, (c, cc) in fv.TIMEZONE_COUNTRIES.items())


_CONTENT = {
    "upi_ids": ("(?i)" + fv.UPI_PATTERN, 1), "phone_numbers": (fv.PHONE_PATTERN, 0),
    "ifsc_codes": (fv.IFSC_PATTERN, 0), "financial_mentions": ("(?i)" + fv.RUPEE_PATTERN, 0),
}


def _found_union() -> str:
    return " UNION ALL ".join(
        f"SELECT k, {s(key)} AS kind, {i} AS pos, unnest(v) AS value, "
        f"generate_subscripts(v, 1) AS n FROM (SELECT k, {_content_found(p, g)} AS v FROM texts) q"
        for i, (key, (p, g)) in enumerate(_CONTENT.items()))


def _script_union() -> str:
    return " UNION ALL ".join(
        f"SELECT k, {s(name)} AS script, {i} AS rank, "
        f"len(regexp_extract_all(full_text, {s(letter)}, 0)) AS letters, "
        f"length(regexp_extract(full_text, {s('(?s)^(.*?)' + letter)}, 1)) AS position FROM texts"
        for i, name in enumerate(fv.SCRIPTS)
        for letter in [_script_letters(name)])


def _script_letters(name: str) -> str:
    # No class intersection here, so marks and digits are listed by what letters are not.
    marks = {
        "Devanagari": r"[\x{904}-\x{939}\x{93D}\x{950}\x{958}-\x{961}]",
        "Bengali": r"[\x{985}-\x{9B9}\x{9BD}\x{9CE}\x{9DC}-\x{9E1}]",
        "Tamil": r"[\x{B83}-\x{BB9}\x{BD0}]", "Telugu": r"[\x{C05}-\x{C39}\x{C3D}]",
        "Gujarati": r"[\x{A85}-\x{AB9}\x{ABD}\x{AD0}]", "Arabic": r"[\x{620}-\x{64A}]",
        "Cyrillic": r"[\x{400}-\x{481}\x{48A}-\x{52F}]",
    }
    return marks[name]


def _flag(group: int, item: str, text: str, source: str, where: str) -> str:
    return f"SELECT k, {group} AS grp, {item} AS item, {text} AS flag FROM {source} WHERE {where}"


def _trusted_values() -> str:
    return ", ".join(f"({i}, {s(t)}, {s(t.split('.')[0])})"
                     for i, t in enumerate(fv.TRUSTED_DOMAINS))


def _lookalike_values() -> str:
    """Exact ratios of the finite sender domains of the workload, from the standard library."""
    from difflib import SequenceMatcher

    rows = [
        f"({s(d.lower())}, {i}, {s(t)})"
        for d in w.FROM_DOMAINS for i, t in enumerate(fv.TRUSTED_DOMAINS)
        if d.lower() != t and SequenceMatcher(None, d.lower(), t).ratio() > fv.LOOKALIKE_RATIO
    ]
    return ", ".join(rows)


def _flags_sql() -> str:
    own, path = "rule_domain", "return_path"
    words = [b.split()[0] for b in fv.IMPERSONATION_BRANDS]
    names = ", ".join(f"({i}, {s(x)})" for i, x in enumerate(words))

    parts = [
        _flag(1, "0", "CASE auth_spf WHEN 'fail' THEN 'SPF_FAIL' ELSE 'SPF_SOFTFAIL' END", "auth",
              "auth_spf IN ('fail', 'softfail')"),
        _flag(1, "1", "'DKIM_FAIL'", "auth", "auth_dkim = 'fail'"),
        _flag(1, "2", "'DMARC_FAIL'", "auth", "auth_dmarc = 'fail'"),
        _flag(2, "0", "'REPLY_TO_MISMATCH'", "sender",
              f"from_address IS NOT NULL AND reply_domain <> '' AND reply_domain <> {own}"),
        _flag(2, "1", "'RETURN_PATH_MISMATCH'", "sender",
              f"from_address IS NOT NULL AND {path} <> '' AND {own} <> '' "
              f"AND NOT contains(lower({path}), {own})"),
        f"SELECT k, 3, t.i, 'LOOKALIKE_DOMAIN:' || rule_domain || '~' || t.trusted FROM sender "
        f"JOIN (VALUES {_lookalike_values()}) t(d, i, trusted) ON t.d = rule_domain",
        _flag(4, "0", "'URGENCY_LANGUAGE'", "bodies",
              " OR ".join(f"contains(body, {s(t)})" for t in fv.URGENCY_TERMS)),
        _flag(5, "seq * 100", "'IP_BASED_URL:' || url", "urls",
              r"regexp_matches(host, '^\d{1,3}(\.\d{1,3}){3}$')"),
        _flag(5, "seq * 100 + 1", "'SHORTENED_URL:' || url", "urls",
              " OR ".join(f"contains(host, {s(t)})" for t in fv.URL_SHORTENERS)),
        f"SELECT k, 5, seq * 100 + 2 + t.i, 'ANCHOR_TEXT_MISMATCH:' || anchor_text || '->' || "
        f"domain FROM urls JOIN (VALUES {_trusted_values()}) t(i, trusted, brand) "
        f"ON contains(lower(anchor_text), t.brand) AND domain <> t.trusted",
        _flag(6, "0", "'RISKY_ATTACHMENT:' || file_name", "mail",
              " OR ".join(f"ends_with(lower(file_name), {s(e)})" for e in fv.RISKY_EXTENSIONS)),
        f"SELECT k, 7, t.i, 'DISPLAY_NAME_IMPERSONATION:' || from_name || '->' || {own} FROM "
        f"sender JOIN (VALUES {names}) t(i, word) ON contains(lower(from_name), t.word) "
        f"AND NOT contains({own}, t.word) WHERE from_name <> '' AND contains(from_address, '@')",
        _flag(8, "0", "'BEC_LANGUAGE_PATTERN'", "bodies",
              " OR ".join(f"contains(body, {s(t)})" for t in fv.BEC_TERMS)),
    ]

    return " UNION ALL ".join(parts)


def _case_of(c: str, table: dict, default: str) -> str:
    arms = " ".join(
        f"WHEN {s(k)} THEN {v if isinstance(v, int) else s(v)}" for k, v in table.items())
    return f"CASE {c} {arms} ELSE {default} END"


CTES: dict[str, str] = {
    "mail": w.mail_sql(),
    "rec": w.received_sql(),
    "auth": f"""
SELECT *, coalesce(lower({rx('raw1', r'(?i)spf=(\w+)')}), 'none') AS auth_spf,
 coalesce(lower({rx('raw1', r'(?i)dkim=(\w+)')}), 'none') AS auth_dkim,
 coalesce(lower({rx('raw1', r'(?i)dmarc=(\w+)')}), 'none') AS auth_dmarc,
 lower({rx('raw2', r'(?i)spf=([a-z]+)')}) AS spf0, lower({rx('raw2', r'(?i)dkim=([a-z]+)')}) AS dkim0,
 lower({rx('raw2', r'(?i)dmarc=([a-z]+)')}) AS dmarc0,
 lower(split_part(trim(received_spf), ' ', 1)) AS word
FROM (SELECT k, email_id, received_spf,
  CASE WHEN auth1 IS NULL THEN '' ELSE auth1 || coalesce(' | ' || auth2, '') END AS raw1,
  CASE WHEN auth1 IS NULL THEN '' ELSE regexp_replace(auth1, '\\s+', ' ', 'g')
   || coalesce(' ; ' || auth2, '') END AS raw2 FROM mail) m""",
    "trace_auth": f"""
SELECT *, CASE WHEN 'fail' IN (spf_result, dkim_result, dmarc_result)
  OR 'permerror' IN (spf_result, dkim_result, dmarc_result) OR spf_result = 'softfail'
  THEN 'failed'
 WHEN spf_result = 'unknown' AND dkim_result = 'unknown' AND dmarc_result = 'unknown'
  THEN 'unknown'
 WHEN spf_result = 'pass' AND dkim_result = 'pass' AND dmarc_result = 'pass'
  THEN 'authenticated' ELSE 'partially_authenticated' END AS auth_summary
FROM (SELECT k, email_id,
 CASE WHEN spf0 IN ({_OK}) THEN spf0 WHEN word IN ({_OK}) THEN word ELSE 'unknown' END AS spf_result,
 coalesce(lower({rx('raw2', r'(?i)smtp\.mailfrom=(?:.*?@)?([A-Za-z0-9.\-]+)')}),
  lower({rx('received_spf', r'(?i)envelope-from=(?:.*?@)?([A-Za-z0-9.\-]+)')})) AS spf_domain,
 coalesce(lower({rx('raw2', r'(?i)sender ip is \[?([0-9a-fA-F.:]+)\]?')}),
  lower({rx('received_spf', r'(?i)client-ip=\[?([0-9a-fA-F.:]+)\]?')})) AS spf_client_ip,
 CASE WHEN dkim0 IN ({_OK}) THEN dkim0 ELSE 'unknown' END AS dkim_result,
 lower({rx('raw2', r'(?i)header\.[di]=@?([A-Za-z0-9.\-]+)')}) AS dkim_domain,
 CASE WHEN dmarc0 IN ({_OK}) THEN dmarc0 ELSE 'unknown' END AS dmarc_result,
 lower({rx('raw2', r'(?i)\bp=([a-z]+)')}) AS dmarc_policy FROM auth) a""",
    "domains": f"""
SELECT k, email_id, {_domain('from_address')} AS from_domain,
 {_domain(_inner('return_path_raw'))} AS return_path_domain,
 {_domain('reply_address')} AS reply_to_domain, {_domain(_inner('sender_raw'))} AS sender_domain
FROM mail""",
    "auth_texts": f"""
SELECT k, 1 AS ord, {fmt(fv.AUTH_SPF_FLAG, 'upper(spf_result)', "coalesce(spf_domain, 'domain')")}
 AS txt FROM trace_auth WHERE auth_summary = 'failed' AND spf_result IN ('fail', 'softfail')
UNION ALL SELECT k, 2, {s(fv.AUTH_DKIM_FLAG)} FROM trace_auth WHERE auth_summary = 'failed'
 AND dkim_result = 'fail'
UNION ALL SELECT k, 3, {fmt(fv.AUTH_DMARC_FLAG, "coalesce(dmarc_policy, 'none')")} FROM trace_auth
 WHERE auth_summary = 'failed' AND dmarc_result = 'fail'
UNION ALL SELECT k, 4, {s(fv.AUTH_NONE_FLAG)} FROM trace_auth WHERE auth_summary = 'unknown'""",
    "align_texts": f"""
SELECT k, 5 AS ord, {fmt(fv.ALIGN_RETURN_PATH_FLAG, 'from_domain', 'return_path_domain')} AS txt
FROM domains WHERE {_unrelated('from_domain', 'return_path_domain')}
UNION ALL SELECT k, 6, {fmt(fv.ALIGN_REPLY_TO_FLAG, 'reply_to_domain', 'from_domain')}
FROM domains WHERE {_unrelated('from_domain', 'reply_to_domain')}""",
    "hop1": f"""
SELECT *, {rx('raw', r'(?i)from\s+(\[?[A-Za-z0-9._:\-]+\]?)(?:\s+\(([^)]*)\))?', 1)} AS host,
 {rx('raw', r'(?i)from\s+(\[?[A-Za-z0-9._:\-]+\]?)(?:\s+\(([^)]*)\))?', 2)} AS paren,
 substr(raw, greatest(strpos(lower(raw), 'from '), 1)) AS rest,
 {rx('raw', r'(?i)\bby\s+([A-Za-z0-9._\-]+)')} AS by_host,
 upper({rx('raw', r'(?i)\bwith\s+([A-Za-z0-9+\-]+)')}) AS protocol,
 {rx('raw', r'(?i)\b(?:authenticated\s+as|auth=)\s*([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+|[A-Za-z0-9._\-]+)')}
  AS auth_user, trim(regexp_extract(raw, ';([^;]*)$', 1)) AS d
FROM (SELECT k, i, trim(regexp_replace(received, '\\s+', ' ', 'g')) AS raw FROM rec) r""",
    "hop2": f"""
SELECT *, trim(host, '[]') AS from_host, coalesce({_first_ip('paren')},
  CASE WHEN {_is_ip("trim(host, '[]()')")} THEN trim(host, '[]()') END, {_first_ip('rest')})
  AS from_ip, coalesce({_is_ip("trim(host, '[]()')")}, FALSE) AS helo_literal_ip,
 CASE WHEN d LIKE 'Mon, %' THEN make_timestamp(2025, 9, CAST(d[6:7] AS BIGINT),
  CAST(d[18:19] AS BIGINT), CAST(d[21:22] AS BIGINT), CAST(d[24:25] AS DOUBLE)) END AS local_ts,
 CASE WHEN d LIKE 'Mon, %' THEN d[27:] END AS zone
FROM hop1""",
    "hop3": f"""
SELECT *, CASE zone WHEN '-0000' THEN NULL WHEN 'GMT' THEN '+0000' ELSE zone END AS tz_offset,
 local_ts - to_minutes(CASE zone WHEN '+0530' THEN 330 WHEN '-0500' THEN -300 ELSE 0 END) AS ts,
 CASE WHEN from_ip IS NULL THEN FALSE WHEN {_is4('from_ip')} THEN
  {_private_v4(_v4_number('from_ip'))} ELSE {_private_v6('hex_ip')} OR {_in_v6('hex_ip', fv.RESERVED_V6)}
  END AS is_private_ip,
 coalesce(contains(protocol, 'TLS') OR protocol IN ('ESMTPS', 'ESMTPSA', 'SMTPS'), FALSE)
  AS is_tls, {_relay('by_host')} OR {_relay('from_host')} AS is_relay
FROM (SELECT *, {_v6_hex('from_ip')} AS hex_ip FROM hop2) h""",
    "hops": """
SELECT *, from_ip IS NOT NULL AND NOT is_private_ip AS pub,
 CASE WHEN (zone = '-0000') = (lead(zone) OVER w = '-0000')
  THEN CAST(epoch(ts) - epoch(lead(ts) OVER w) AS DOUBLE) END AS delay
FROM hop3 WINDOW w AS (PARTITION BY k ORDER BY i)""",
    "xip": f"""
SELECT k, email_id, coalesce({', '.join(
        f"CASE WHEN {_is4(c)} AND NOT {_private_v4(_v4_number(c))} THEN {c} END" for c in (
            "trim(x_originating, '[]')", 'x_sender', 'x_client'))}) AS x_ip FROM mail""",
    "edges": """
SELECT x.k, x.email_id, x_ip, coalesce(hop_count, 0) AS hop_count, edge_index, edge_hop_ip,
 claimed_hop_ip, claimed_index, coalesce(skewed, FALSE) AS skewed,
 CASE WHEN hop_count > 0 THEN coalesce(edge_hop_ip, spf_client_ip) END AS edge_ip, auth_summary
FROM xip x JOIN trace_auth USING (k) LEFT JOIN (
 SELECT k, count(*) AS hop_count, min(i) FILTER (pub) AS edge_index,
  arg_min(from_ip, i) FILTER (pub) AS edge_hop_ip, arg_max(from_ip, i) FILTER (pub)
  AS claimed_hop_ip, max(i) FILTER (pub) AS claimed_index, bool_or(coalesce(delay < -30, FALSE))
  AS skewed FROM hops GROUP BY k) h USING (k)""",
    "steps": """
SELECT h.*, edge_index, min(CASE WHEN is_relay THEN 1 ELSE 0 END) OVER (PARTITION BY h.k ORDER BY i
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
FROM hops h JOIN edges e ON h.k = e.k WHERE i >= edge_index""",
    "walks": """
SELECT k, max(i) FILTER (good) AS walk_hop, arg_max(from_ip, i) FILTER (good) AS walk_hop_ip,
 arg_max(pub, i) FILTER (good) AS walk_pub, min(i) FILTER (i > edge_index AND reach = 0) AS stop,
 bool_or(i = edge_index AND is_relay) AS via_provider
FROM (SELECT *, i > edge_index AND reach = 1 AND
 (pub OR (coalesce(protocol = 'ESMTPSA', FALSE) AND from_ip IS NOT NULL)) AS good FROM steps) q
GROUP BY k""",
    "origin": f"""
SELECT *, CASE WHEN hop_count = 0 THEN FALSE ELSE coalesce(claimed_ip = origin_ip, FALSE) END
 AS origin_verified,
 CASE WHEN hop_count = 0 THEN CASE WHEN x_ip IS NULL THEN 'low' ELSE 'medium' END
  WHEN skewed OR origin_ip IS NULL THEN 'low'
  WHEN auth_summary IN ('failed', 'authenticated') OR origin_basis <> 'edge_received_hop'
  THEN 'high' ELSE 'medium' END AS origin_confidence
FROM (SELECT *, CASE WHEN hop_count = 0 THEN x_ip WHEN via AND x_ip IS NOT NULL THEN x_ip
  ELSE walk_ip END AS origin_ip,
 CASE WHEN hop_count = 0 THEN CASE WHEN x_ip IS NULL THEN 'no_received_headers'
   ELSE 'x_originating_ip' END
  WHEN via AND x_ip IS NOT NULL THEN 'x_originating_ip' ELSE walk_basis END AS origin_basis,
 CASE WHEN hop_count = 0 THEN x_ip ELSE claimed_hop_ip END AS claimed_ip
FROM (SELECT e.*, coalesce(via_provider, FALSE) AS via, stop, coalesce(walk_hop_ip, edge_ip) AS walk_ip,
 coalesce(walk_hop, edge_index) AS walk_index, CASE WHEN walk_hop IS NULL
  THEN 'edge_received_hop' WHEN walk_pub THEN 'reputable_relay_descent'
  ELSE 'esmtpsa_submission' END AS walk_basis
 FROM edges e LEFT JOIN walks USING (k)) a) b""",
    "notes": f"""
SELECT k, -1 AS ord, {s(fv.NOTE_NO_RECEIVED)} AS note FROM origin WHERE hop_count = 0
UNION ALL SELECT k, i * 2, {fmt(fv.NOTE_SKEW, 'i', 'CAST(delay AS BIGINT)')} FROM hops
 WHERE delay < -30
UNION ALL SELECT k, i * 2 + 1, {fmt(fv.NOTE_LITERAL, 'i', 'from_ip')} FROM hops
 WHERE helo_literal_ip AND pub
UNION ALL SELECT k, 1000, {fmt(fv.NOTE_WALK_STOPPED, 'stop', 'claimed_hop_ip')} FROM origin
 WHERE stop IS NOT NULL AND claimed_hop_ip IS DISTINCT FROM walk_ip
UNION ALL SELECT k, 1001, {fmt(fv.NOTE_DIVERGENCE, 'origin_ip', 'claimed_ip')} FROM origin
 WHERE hop_count > 0 AND claimed_ip <> origin_ip""",
    "s12": """
SELECT x.k, s1_ip, x_ip, CASE WHEN x_ip IS DISTINCT FROM s1_ip THEN x_ip END AS s2_ip
FROM xip x LEFT JOIN (SELECT k, arg_min(from_ip, i) AS s1_ip FROM hops
 WHERE pub AND (protocol IN ('ESMTPSA', 'SMTPSA') OR auth_user IS NOT NULL) GROUP BY k) h
USING (k)""",
    "usage": """
SELECT k, from_ip AS ip FROM hops WHERE pub
UNION SELECT k, origin_ip FROM origin WHERE origin_ip IS NOT NULL
UNION SELECT k, edge_ip FROM origin WHERE edge_ip IS NOT NULL
UNION SELECT k, s1_ip FROM s12 WHERE s1_ip IS NOT NULL
UNION SELECT k, s2_ip FROM s12 WHERE s2_ip IS NOT NULL""",
    "ips": f"""
SELECT ip, uses, CASE WHEN internal IS NULL THEN 'invalid IP address'
 WHEN internal THEN 'private/internal IP' END AS error,
 CASE WHEN NOT internal AND {_is4('ip')} THEN {_v4_number('ip')} END AS num,
 CASE WHEN NOT internal AND contains(ip, ':') THEN hex_ip END AS six
FROM (SELECT ip, count(*) AS uses, CASE WHEN {_is4('ip')} THEN {_private_v4(_v4_number('ip'))}
 WHEN regexp_matches(ip, {s(IPV6_PATTERN)}) THEN {_private_v6('hex_ip')} END AS internal, hex_ip
 FROM (SELECT *, {_v6_hex('ip')} AS hex_ip FROM usage) x GROUP BY ip, hex_ip) u""",
    "city": w.CITY_SQL, "net": w.ASN_SQL, "second": w.FALLBACK_SQL, "ptr": w.PTR_SQL,
    "intel1": f"""
SELECT i.ip, i.uses, i.error, {', '.join(_intel_value(f) for f in (
        'country', 'country_code', 'region', 'city', 'lat', 'lon', 'timezone', 'isp', 'asn',
        'asn_name', 'is_hosting', 'is_proxy_or_vpn', 'is_mobile'))},
 CASE WHEN i.error IS NULL THEN p.reverse_dns END AS reverse_dns,
 c.lo IS NOT NULL OR c.lo6 IS NOT NULL AS hit1,
 c.country IS NULL AND (f.lo IS NOT NULL OR f.lo6 IS NOT NULL) AS hit2
FROM ips i LEFT JOIN city c ON i.num BETWEEN c.lo AND c.hi OR i.six BETWEEN c.lo6 AND c.hi6
LEFT JOIN net n ON i.num BETWEEN n.lo AND n.hi OR i.six BETWEEN n.lo6 AND n.hi6
LEFT JOIN second f ON i.num BETWEEN f.lo AND f.hi OR i.six BETWEEN f.lo6 AND f.hi6
LEFT JOIN (SELECT ip, min(reverse_dns) AS reverse_dns FROM ptr GROUP BY ip) p ON p.ip = i.ip""",
    "intel": f"""
SELECT *, CASE WHEN error = 'private/internal IP' THEN 'internal network'
 WHEN error IS NOT NULL THEN 'unknown' WHEN is_proxy_or_vpn THEN 'proxy/vpn/anonymizer'
 WHEN is_hosting THEN 'datacenter/hosting'
 WHEN regexp_matches(lower(coalesce(isp, '') || '  ' || coalesce(asn_name, '')),
  {s(any_of(fv.HOSTING_KEYWORDS))}) THEN 'datacenter/hosting'
 WHEN is_mobile THEN 'mobile network' WHEN isp <> '' OR asn_name <> ''
 THEN 'residential/business ISP' ELSE 'unknown' END AS infra,
 concat_ws(' | ', CASE WHEN hit1 THEN 'range_table' END, CASE WHEN hit2 THEN 'second_source' END,
  CASE WHEN reverse_dns <> '' THEN 'ptr_lookup' END) AS sources FROM intel1""",
    "texts": """
SELECT k, email_id, subject || chr(10) || body_plain || CASE WHEN body_html <> ''
 THEN chr(10) || body_html ELSE '' END AS full_text FROM mail""",
    "found": _found_union(),
    "artifacts": """
SELECT k, kind, pos, value, row_number() OVER (PARTITION BY k, kind ORDER BY n) AS n
FROM (SELECT k, kind, pos, value, min(n) AS n FROM found GROUP BY ALL) f""",
    "scripts": f"""
SELECT *, row_number() OVER (PARTITION BY k ORDER BY position, rank) AS n
FROM ({_script_union()}) u WHERE letters > 0""",
    "zones": f"""
SELECT z.k, z.zone, v.country, v.cc FROM (SELECT k, {rx('date_raw', r'([+\-]\d{4})')} AS zone
FROM mail) z JOIN (VALUES {_zone_values()}) v(zone, country, cc) ON v.zone = z.zone""",
    "sig1": f"""
{_address_signal(1, 'S1_ESMTPSA_SUBMISSION_IP', 'Authenticated SMTP Client IP', 0.90, 's1_ip', fmt(
        fv.EVIDENCE_SUBMISSION, 's1_ip', "coalesce(g.country, 'Unknown')", "coalesce(g.isp, 'ISP')"))}
FROM s12 LEFT JOIN intel g ON g.ip = s1_ip WHERE s1_ip IS NOT NULL
UNION ALL {_address_signal(2, 'S2_X_ORIGINATING_IP', 'Provider Stamped Client IP', 0.90, 's2_ip', fmt(
        fv.EVIDENCE_X_ORIGIN, 's2_ip', "coalesce(g.country, 'Unknown')", "coalesce(g.isp, 'ISP')"))}
FROM s12 LEFT JOIN intel g ON g.ip = s2_ip WHERE s2_ip IS NOT NULL
UNION ALL SELECT {_signal(3, "'S3_DATE_TIMEZONE'", "'Mail Client Timezone Offset'", 0.30, 'zone',
                          'country', fmt(fv.EVIDENCE_TIMEZONE, 'zone', 'country'), 'country',
                          'cc')} FROM zones
UNION ALL {' UNION ALL '.join(
        'SELECT ' + _signal(4 + i, s(sid), s(name), weight, 'shown', "'India'",
                            fmt(fv.EVIDENCE_CONTENT, s(name.lower()), 'shown'), "'India'", "'IN'")
        + f" FROM (SELECT k, string_agg(value, ', ' ORDER BY n) FILTER (n <= 3) AS shown "
          f"FROM artifacts WHERE kind = {s(key)} GROUP BY k) a"
        for i, (key, sid, name, weight) in enumerate(fv.CONTENT_SIGNALS))}
UNION ALL SELECT {_signal('7 + n', "'S5_UNICODE_SCRIPT'", "'Regional Script: ' || script", 0.20,
                          "letters || ' chars'",
                          f"CASE WHEN {_in('script', fv.INDIC_SCRIPTS)} THEN 'India' "
                          "ELSE 'International' END",
                          fmt(fv.EVIDENCE_SCRIPT, 'letters', 'script'),
                          f"CASE WHEN {_in('script', fv.INDIC_SCRIPTS)} THEN 'India' "
                          "ELSE 'International' END",
                          f"CASE WHEN {_in('script', fv.INDIC_SCRIPTS)} THEN 'IN' ELSE 'XX' END",
                          _in('script', fv.INDIC_SCRIPTS))} FROM scripts""",
    "signals": f"""
SELECT * FROM sig1 UNION ALL
{_address_signal(16, 'S6_INFRASTRUCTURE_GEO', 'Relay Infrastructure IP Geolocation', 0.25,
                 'origin_ip', fmt(fv.EVIDENCE_INFRA, 'origin_ip', 'g.infra'))}
FROM origin LEFT JOIN intel g ON g.ip = origin_ip
WHERE origin_ip IS NOT NULL AND k NOT IN (SELECT k FROM sig1 WHERE credited)""",
    "ranked": """
SELECT k, country, cc, city, region, ip, isp, round_even(score, 2) AS score, first_seq,
 row_number() OVER (PARTITION BY k ORDER BY score DESC, first_seq) AS rnk,
 (SELECT string_agg(signal_id, ' | ' ORDER BY seq) FROM signals z WHERE z.k = c.k
  AND contains(z.est, c.country)) AS matched
FROM (SELECT k, country, arg_min(cc, seq) AS cc, arg_min({'v': city}, seq).v AS city,
 arg_min({'v': region}, seq).v AS region, arg_min({'v': ip}, seq).v AS ip,
 arg_min({'v': isp}, seq).v AS isp, list_reduce(list(weight ORDER BY seq), lambda a, b: a + b) AS score,
 min(seq) AS first_seq FROM signals WHERE credited GROUP BY k, country) c""",
    "estimate": """
SELECT m.k, m.email_id, r.country, r.cc, r.city, r.region, r.ip AS device_ip,
 CASE WHEN s1_ip IS NOT NULL OR x_ip IS NOT NULL THEN 'high'
  WHEN n >= 2 AND r.score >= 0.60 THEN 'medium' WHEN r.k IS NOT NULL THEN 'low'
  ELSE 'unknown' END AS confidence, coalesce(n, 0) AS evidence_count, coalesce(basis, '') AS basis
FROM mail m LEFT JOIN s12 USING (k) LEFT JOIN ranked r ON r.k = m.k AND r.rnk = 1
LEFT JOIN (SELECT k, count(*) AS n, string_agg(evidence, ' | ' ORDER BY seq) AS basis
 FROM signals GROUP BY k) q ON q.k = m.k""",
    "geo0": f"""
SELECT o.*, g.ip AS gip, g.country AS gcountry, g.country_code AS gcc, g.region AS gregion,
 g.city AS gcity, g.isp, g.infra, g.reverse_dns, g.error, g.is_proxy_or_vpn,
 e.country AS ecountry, e.cc AS ecc, e.city AS ecity, e.region AS eregion, e.confidence AS econf,
 o.origin_ip IS NOT NULL AND (via OR regexp_matches(lower(coalesce(g.isp, '')),
  {s(any_of(fv.RELAY_PROVIDERS))})) AND coalesce(e.country, '') <> '' AS relay
FROM origin o LEFT JOIN intel g ON g.ip = o.origin_ip JOIN estimate e ON e.k = o.k""",
    "geo": """
SELECT *, CASE WHEN relay OR direct THEN ecountry ELSE gcountry END AS country,
 CASE WHEN relay OR direct THEN ecc ELSE gcc END AS cc,
 CASE WHEN relay THEN coalesce(eregion, '') ELSE gregion END AS region,
 CASE WHEN relay THEN coalesce(ecity, '') WHEN direct THEN coalesce(nullif(ecity, ''), gcity)
  ELSE gcity END AS city
FROM (SELECT *, NOT relay AND origin_ip IS NOT NULL AND econf = 'high' AS direct FROM geo0) g""",
    "risks": f"""
SELECT k, 1 AS ord, CASE auth_summary WHEN 'failed' THEN 45 WHEN 'unknown' THEN 15 ELSE 10 END AS pts,
 CASE auth_summary WHEN 'failed' THEN {s(fv.RISK_AUTH_FAILED)} WHEN 'unknown'
 THEN {s(fv.RISK_AUTH_UNKNOWN)} ELSE {s(fv.RISK_AUTH_PARTIAL)} END AS reason
 FROM trace_auth WHERE auth_summary <> 'authenticated'
UNION ALL SELECT k, 2, 10, arg_min(txt, ord) FROM align_texts WHERE
 regexp_matches(lower(txt), 'differs from|impersonation|spoofing') GROUP BY k
UNION ALL SELECT k, 3, 15, {fmt(fv.RISK_CLAIMED, 'claimed_ip', "coalesce(origin_ip, 'None')")}
 FROM origin WHERE NOT origin_verified AND claimed_ip IS NOT NULL
 AND claimed_ip IS DISTINCT FROM origin_ip
UNION ALL SELECT k, 10 + ord, CASE WHEN contains(note, 'NEGATIVE') THEN 15 ELSE 10 END, note
 FROM notes WHERE contains(note, 'NEGATIVE time delta') OR contains(note, 'IP literal')
UNION ALL SELECT k, 5000, 20, {s(fv.RISK_NO_RECEIVED)} FROM origin WHERE hop_count = 0
UNION ALL SELECT k, 5001, CASE WHEN infra = 'proxy/vpn/anonymizer' THEN 15 ELSE 10 END,
 CASE WHEN infra = 'proxy/vpn/anonymizer' THEN {fmt(fv.RISK_PROXY, 'origin_ip')}
 ELSE {fmt(fv.RISK_HOSTING, 'origin_ip', "coalesce(isp, 'Hosting')")} END
 FROM geo WHERE infra IN ('proxy/vpn/anonymizer', 'datacenter/hosting')
UNION ALL SELECT k, 5002, 5, {fmt(fv.RISK_NO_PTR, 'origin_ip')} FROM geo
 WHERE origin_ip IS NOT NULL AND reverse_dns IS NULL AND error IS NULL""",
    "trace_risk": """
SELECT m.k, m.email_id, least(coalesce(sum(pts), 0), 100) AS trace_risk_score,
 coalesce(string_agg(reason, ' | ' ORDER BY ord), '') AS risk_reasons
FROM mail m LEFT JOIN risks r ON r.k = m.k GROUP BY m.k, m.email_id""",
    "sender": """
SELECT k, email_id, from_name, from_address,
 CASE WHEN contains(from_address, '@') THEN lower(split_part(from_address, '@', -1)) ELSE '' END
  AS rule_domain, lower(split_part(reply_address, '@', -1)) AS reply_domain,
 trim(return_path_raw, '<>') AS return_path FROM mail""",
    "bodies": "SELECT k, email_id, lower(body_plain || ' ' || body_html) AS body FROM mail",
    "pmail": f"SELECT email_id AS k, email_id, body_html, body_plain FROM ({w.URLS_SQL}) u",
    "links": f"""
SELECT k, unnest(v) AS url, generate_subscripts(v, 1) AS n, NULL AS anchor_text
FROM (SELECT k, regexp_extract_all(body_plain, {s(URL_PATTERN)}, 0) AS v FROM mail) p
UNION ALL SELECT k, regexp_extract(a, {s(ANCHOR_PATTERN)}, 1), 1000 + n,
 nullif(trim(regexp_replace(regexp_extract(a, {s(ANCHOR_PATTERN)}, 2), '<[^>]*>', '', 'g')), '')
FROM (SELECT k, unnest(v) AS a, generate_subscripts(v, 1) AS n FROM (
 SELECT k, regexp_extract_all(body_html, {s(ANCHOR_PATTERN)}, 0) AS v FROM mail) h0) h""",
    "urls0": f"""
SELECT k, url, min(n) AS n, arg_max({{'v': anchor_text}}, n).v AS anchor_text, {_host('url')}
 AS host FROM links GROUP BY k, url""",
    "urls": f"""
SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS seq, {_registered('host')}
 AS domain FROM urls0""",
    "flags": _flags_sql(),
    "pattach": f"SELECT email_id, filename, payload FROM ({w.ATTACHMENTS_SQL}) a",
    "many_ranges": w.OVERLAP_SQL,
    "mail_slots": """
SELECT email_id, list_distinct(list_transform(regexp_extract_all(lower(coalesce(subject, '') || ' ' ||
 coalesce(body_plain, '')), '[a-z0-9_]+'), lambda t: CAST('0x' || md5(t)[1:4] AS INTEGER))) AS slots
FROM mail""",
    "slot_counts": """
SELECT toxic AS label, slots FROM mail_slots JOIN labels ON email_id = CAST(doc_id AS VARCHAR)
WHERE toxic IS NOT NULL""",
    "class_sizes": """
SELECT count(*) FILTER (label = 0) AS all0, count(*) FILTER (label = 1) AS all1 FROM slot_counts""",
    "model_table": """
SELECT slot, ln((all0 + all1 + 1.0) / (count(*) + 1.0)) AS idf,
 ln(count(*) FILTER (label = 1) + 0.5) - ln(count(*) FILTER (label = 0) + 0.5)
 - (ln(all1 + 1.0) - ln(all0 + 1.0)) AS weight
FROM (SELECT label, unnest(slots) AS slot FROM slot_counts) x, class_sizes GROUP BY slot, all0, all1
UNION ALL SELECT -1, 1.0, ln(all1 + 0.5) - ln(all0 + 0.5) FROM class_sizes""",
    "listed": f"SELECT DISTINCT lower(rule) AS rule FROM ({w.SUFFIX_SQL}) s",
    "named_hosts": f"SELECT DISTINCT trim(lower(host), '.') AS host FROM ({w.HOST_SQL}) h",
    "suffix_of": """
SELECT host, max(CASE WHEN rule[1] = '!' THEN 1000 + len(string_split(rule, '.')) - 1
 ELSE len(string_split(rule, '.')) END) AS best FROM named_hosts JOIN listed
ON regexp_full_match(host, '(.*\\.)?' || replace(replace(ltrim(rule, '!'), '.', '\\.'), '*', '[^.]+'))
GROUP BY host""",
    "six_asked": f"SELECT DISTINCT ip, six FROM ({w.SIX_ADDRESS_SQL}) a",
    "six_ranges": w.SIX_RANGE_SQL,
    "six_found": """
SELECT ip, arg_min(label, {'w': hi64 - lo64, 'l': lo64, 'c': label}) AS label,
 arg_min(label, {'w': hi64 - lo64, 'l': lo64, 'c': label}) FILTER (label < 'm') AS early
FROM six_asked LEFT JOIN six_ranges ON six BETWEEN lo6 AND hi6 GROUP BY ip""",
    "scored": f"""
SELECT m.k, m.email_id, m.ml_prob, least(coalesce(sum({_case_of(
        "split_part(flag, ':', 1)", fv.FLAG_WEIGHTS, str(fv.DEFAULT_FLAG_WEIGHT))}) FILTER (flag IS NOT NULL), 0), 100)
  AS rule_score, count(DISTINCT CASE WHEN flag IS NULL THEN NULL ELSE {_case_of(
        "split_part(flag, ':', 1)", fv.FLAG_CATEGORIES, "'other'")} END) AS categories,
 coalesce(string_agg(flag, ' | ' ORDER BY grp, item), '') AS flags
FROM mail m LEFT JOIN flags f ON f.k = m.k GROUP BY m.k, m.email_id, m.ml_prob""",
    "fraud0": """
SELECT *, CAST(round_even(CAST(0.7 AS DOUBLE) * rule_score + CAST(0.3 AS DOUBLE) * (ml_prob * 100), 0)
 AS INTEGER) AS fraud_score FROM scored""",
    "fraud": """
SELECT *, CASE WHEN fraud_score >= 75 THEN 'phishing' WHEN fraud_score >= 40 THEN 'suspicious'
 ELSE 'legitimate' END AS fraud_category,
 CASE WHEN c >= 0.75 THEN 'Very High' WHEN c >= 0.55 THEN 'High' WHEN c >= 0.35 THEN 'Moderate'
 WHEN c >= 0.15 THEN 'Low' ELSE 'Very Low' END AS confidence_label
FROM (SELECT *, round_even(least(CAST(0.5 AS DOUBLE) * (categories / CAST(5 AS DOUBLE))
 + CAST(0.3 AS DOUBLE) * least(least(abs(fraud_score - 40), abs(fraud_score - 75))
  / CAST(37.5 AS DOUBLE), 1)
 + CAST(0.2 AS DOUBLE) * (abs(ml_prob - CAST(0.5 AS DOUBLE)) * 2), 1), 2) AS c FROM fraud0) f""",
    "verdict": """
SELECT *, CASE WHEN combined >= 70 OR fraud_category = 'phishing' THEN 'PHISHING_MALICIOUS'
 WHEN combined >= 35 OR fraud_category = 'suspicious' THEN 'SUSPICIOUS' ELSE 'LEGITIMATE' END
 AS overall_verdict,
 CASE WHEN combined >= 70 OR fraud_category = 'phishing' THEN 'High Risk'
 WHEN combined >= 35 OR fraud_category = 'suspicious' THEN 'Moderate Risk' ELSE 'Low Risk' END
 AS status_label, upper(fraud_category[1]) || fraud_category[2:] AS classification
FROM (SELECT f.*, t.trace_risk_score, t.risk_reasons,
 CAST((6 * fraud_score + 4 * trace_risk_score + 5) // 10 AS INTEGER) AS combined
 FROM fraud f JOIN trace_risk t USING (k)) q""",
    "report": """
SELECT m.k, m.path, m.email_id AS id, nullif(m.subject, '') AS subject,
 coalesce(m.to_address, m.to_raw, '') AS email, coalesce(m.from_address, m.from_raw, '') AS sender,
 coalesce(a.value, '') AS phone, g.origin_ip AS ip, CASE WHEN m.from_address IS NULL THEN ''
 ELSE m.from_name END AS name,
 coalesce(nullif(g.country, ''), nullif(g.ecountry, ''), '') AS country,
 coalesce(nullif(g.city, ''), nullif(g.ecity, ''), '') AS city, v.combined AS risk_score,
 v.classification, v.status_label AS status, v.overall_verdict
FROM mail m JOIN geo g ON g.k = m.k JOIN verdict v ON v.k = m.k
LEFT JOIN artifacts a ON a.k = m.k AND a.kind = 'phone_numbers' AND a.n = 1""",
}


for _name in ("links", "urls0", "urls"):
    CTES["p" + _name] = CTES[_name].replace("FROM mail", "FROM pmail") \
        .replace("FROM links", "FROM plinks").replace("FROM urls0", "FROM purls0")


def _needs(sql: str, names: list[str]) -> set[str]:
    import re

    words = set(re.findall(r"(?i:FROM|JOIN)\s+([a-z_0-9]+)", sql))
    return words & set(names)


# The MIME stage normalises dates: a named zone becomes an offset, a missing one -0000.
PARSED_DATE = ("CASE WHEN ends_with(date_raw, ' ') THEN date_raw || '-0000' "
               "ELSE replace(date_raw, 'GMT', '+0000') END")


def query(select: str, after_parsing: bool = False) -> str:
    """The select with the CTEs it needs, in definition order.

    ``after_parsing`` is for messages that went through the MIME stage.
    """
    names = list(CTES)
    wanted: set[str] = set()
    todo = _needs(select, names)
    while todo:
        name = todo.pop()
        wanted.add(name)
        todo |= _needs(CTES[name], names) - wanted
    ctes = dict(CTES)
    if after_parsing:
        ctes["zones"] = ctes["zones"].replace("date_raw", PARSED_DATE)
    body = ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in names if n in wanted)
    return f"WITH {body}\n{select}" if body else select

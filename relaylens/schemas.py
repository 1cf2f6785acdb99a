"""Table schemas as Spark DDL."""

MESSAGES = """
    email_id string, path string, message_id string, subject string, from_raw string,
    to_raw string, date_raw string,
    from_addr array<struct<name:string,addr:string>>,
    to_addr array<struct<name:string,addr:string>>,
    reply_to array<struct<name:string,addr:string>>,
    return_path_raw string, sender_raw string, auth_headers array<string>,
    received_spf string, received array<string>, x_headers map<string,string>,
    body_plain string, body_html string, trace_body string,
    anchors array<struct<url:string,anchor_text:string>>,
    attachments array<struct<filename:string,content_type:string,size:bigint,sha256:string>>,
    error string
"""

RAW = "path string, modificationTime timestamp, length bigint, content binary"

IP_RANGES = """
    lo bigint, hi bigint, country string, country_code string, region string, city string,
    lat double, lon double, timezone string, isp string, org string, asn string,
    asn_name string, reverse_dns string, is_hosting boolean, is_proxy_or_vpn boolean,
    is_mobile boolean
"""

ASN_RANGES = "lo bigint, hi bigint, asn string, asn_name string"

PTR = "ip string, reverse_dns string"

REPORT = """
    id string, subject string, email string, sender string, phone string, ip string,
    name string, country string, city string, risk_score int, classification string,
    status string,
    overall_assessment struct<combined_threat_score:int,overall_verdict:string>
"""

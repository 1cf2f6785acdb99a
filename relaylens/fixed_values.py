"""Word lists, weights and tables that decide the results.

Fixed values: every constant here must keep its content and its order, because flags, scores
and tie-breaks are defined by them.  Nothing in this module grows with the data.
"""

# --- Fixed values: phishing detection ---

TRUSTED_DOMAINS = [
    "google.com", "microsoft.com", "paypal.com", "amazon.com",
    "apple.com", "bankofamerica.com", "chase.com",
]

URGENCY_TERMS = [
    "urgent", "verify your account", "account suspended", "act now",
    "wire transfer", "gift card", "password expires", "immediate action",
    "last chance", "offer expires",
]

BEC_TERMS = [
    "wire transfer", "change of bank details", "update payment information",
    "urgent payment", "invoice attached", "new account number",
    "confidential transaction", "gift cards", "purchase gift cards",
    "keep this between us", "don't discuss with anyone",
]

IMPERSONATION_BRANDS = [
    "microsoft", "google", "paypal", "amazon", "apple", "bank of america",
    "chase", "irs", "ceo", "cfo", "hr department", "it support", "helpdesk",
]

RISKY_EXTENSIONS = [".exe", ".scr", ".js", ".vbs", ".html", ".htm", ".iso", ".bat"]

URL_SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly"]

LOOKALIKE_RATIO = 0.75

FLAG_WEIGHTS = {
    "SPF_FAIL": 20, "DKIM_FAIL": 20, "DMARC_FAIL": 20, "SPF_SOFTFAIL": 10,
    "REPLY_TO_MISMATCH": 15, "RETURN_PATH_MISMATCH": 10,
    "DISPLAY_NAME_IMPERSONATION": 25, "URGENCY_LANGUAGE": 8,
    "RISKY_ATTACHMENT": 25, "BEC_LANGUAGE_PATTERN": 18,
}
DEFAULT_FLAG_WEIGHT = 12

FLAG_CATEGORIES = {
    "SPF_FAIL": "auth", "DKIM_FAIL": "auth", "DMARC_FAIL": "auth", "SPF_SOFTFAIL": "auth",
    "REPLY_TO_MISMATCH": "identity", "RETURN_PATH_MISMATCH": "identity",
    "DISPLAY_NAME_IMPERSONATION": "identity", "LOOKALIKE_DOMAIN": "identity",
    "URGENCY_LANGUAGE": "language", "BEC_LANGUAGE_PATTERN": "language",
    "IP_BASED_URL": "url", "SHORTENED_URL": "url", "ANCHOR_TEXT_MISMATCH": "url",
    "RISKY_ATTACHMENT": "attachment",
}
FLAG_CATEGORY_COUNT = 5

# --- Fixed values: authentication ---

AUTH_RESULTS = ["pass", "fail", "softfail", "neutral", "none", "temperror", "permerror", "policy"]

# --- Fixed values: relay path and origin ---

REPUTABLE_RELAYS = [
    "google.com", "googlemail.com", "gmail.com", "1e100.net",
    "outlook.com", "hotmail.com", "microsoft.com", "office365.com",
    "yahoo.com", "yahoo.co.in", "yahoodns.net", "sendgrid.net",
    "mailgun.org", "amazonses.com", "zoho.com", "protonmail.ch", "apple.com",
]

CLIENT_IP_HEADERS = ["X-Originating-IP", "X-Sender-IP", "X-Client-IP", "X-Apparently-From"]

SKEW_SECONDS = -30

# --- Fixed values: IP intelligence ---

HOSTING_KEYWORDS = [
    "amazon", "aws", "google", "microsoft", "azure", "digitalocean", "ovh", "hetzner",
    "linode", "vultr", "hosting", "datacenter", "vps",
]

RELAY_PROVIDERS = [
    "google", "microsoft", "yahoo", "zoho", "apple", "fastmail", "mailgun", "sendgrid", "amazon",
]

# --- Fixed values: sender location ---

TIMEZONE_COUNTRIES = {
    "+0530": ("India", "IN"), "+0600": ("Bangladesh", "BD"), "+0500": ("Pakistan", "PK"),
    "+0800": ("China / Singapore", "CN"), "+0900": ("Japan", "JP"),
    "+0300": ("Saudi Arabia / Russia", "RU"), "+0200": ("Eastern Europe", "ZA"),
    "+0100": ("Central Europe", "DE"), "+0000": ("United Kingdom / UTC", "GB"),
    "-0400": ("US Eastern", "US"), "-0500": ("US Eastern", "US"), "-0800": ("US Pacific", "US"),
}

UPI_PATTERN = (
    r"\b[a-zA-Z0-9.\-_]{2,64}@(okaxis|okhdfcbank|okicici|oksbi|paytm|ybl|ibl|upi|apl)\b"
)
PHONE_PATTERN = r"(?:\+91[\-\s]?)?[6789]\d{9}\b"
IFSC_PATTERN = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
RUPEE_PATTERN = r"(?:₹|Rs\.?|INR)\s*[\d,]+(?:\.\d{2})?"

# key, signal id, name, weight
CONTENT_SIGNALS = [
    ("upi_ids", "S4_UPI_VPA", "Indian UPI / VPA Payment Handle", 0.45),
    ("phone_numbers", "S4_PHONE_NUMBER", "Indian Telecom Number", 0.40),
    ("ifsc_codes", "S4_IFSC_CODE", "Indian Banking IFSC Code", 0.45),
    ("financial_mentions", "S4_CURRENCY_INR", "Indian Rupee Currency Context", 0.35),
]

SCRIPTS = ["Devanagari", "Bengali", "Tamil", "Telugu", "Gujarati", "Arabic", "Cyrillic"]
INDIC_SCRIPTS = ["Devanagari", "Bengali", "Tamil", "Telugu", "Gujarati"]

# --- Fixed values: non-public networks (IANA special-purpose registries) ---

PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
PRIVATE_V4_EXCEPT = ["192.0.0.9/32", "192.0.0.10/32"]

PRIVATE_V6 = [
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
]
PRIVATE_V6_EXCEPT = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
]
RESERVED_V6 = [
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3",
    "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9",
]

# --- Fixed values: e-mail dates (RFC 2822 and its obsolete zones) ---

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONE_OFFSETS = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}

# --- Fixed values: a snapshot of common public suffixes.  Other top-level domains follow the
# --- general rule of registered_domain(), to which a full list can be passed.

PUBLIC_SUFFIXES = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev",
    "io", "co", "me", "tv", "cc", "xyz", "online", "site", "shop", "top", "club", "cloud",
    "in", "co.in", "net.in", "org.in", "gov.in", "ac.in", "edu.in", "nic.in", "res.in", "firm.in",
    "uk", "co.uk", "org.uk", "gov.uk", "ac.uk", "me.uk", "net.uk", "ltd.uk", "plc.uk",
    "us", "ca", "mx", "com.mx", "br", "com.br", "org.br", "gov.br", "ar", "com.ar",
    "de", "fr", "it", "es", "nl", "be", "ch", "at", "se", "no", "dk", "fi", "pl", "com.pl",
    "pt", "ie", "cz", "gr", "ro", "hu", "eu", "ru", "com.ru", "ua", "com.ua", "tr", "com.tr",
    "cn", "com.cn", "net.cn", "org.cn", "gov.cn", "hk", "com.hk", "tw", "com.tw", "sg", "com.sg",
    "jp", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "kr", "co.kr", "or.kr",
    "au", "com.au", "net.au", "org.au", "gov.au", "edu.au", "nz", "co.nz", "org.nz",
    "za", "co.za", "org.za", "ng", "com.ng", "ke", "co.ke", "il", "co.il", "ae", "sa", "com.sa",
    "id", "co.id", "my", "com.my", "th", "co.th", "ph", "com.ph", "vn", "com.vn",
    "pk", "com.pk", "bd", "com.bd", "lk", "np", "com.np", "ly", "gl", "gd", "onion",
]

# Labels under which there are no public domains, and labels that stand for a kind of owner
# below a country code.
SPECIAL_USE_LABELS = [
    "corp", "example", "home", "internal", "intranet", "invalid", "lan", "local", "localdomain",
    "localhost", "private", "test",
]
SECOND_LEVEL_LABELS = ["ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "or", "org"]

# --- Fixed values: patterns of authentication results (case is ignored) ---

SPF_RESULT = r"spf=([a-z]+)"
DKIM_RESULT = r"dkim=([a-z]+)"
DMARC_RESULT = r"dmarc=([a-z]+)"
SPF_MAIL_DOMAIN = r"smtp\.mailfrom=(?:.*?@)?([A-Za-z0-9.\-]+)"
SPF_ENVELOPE_DOMAIN = r"envelope-from=(?:.*?@)?([A-Za-z0-9.\-]+)"
SPF_SENDER_IP = r"sender ip is \[?([0-9a-fA-F.:]+)\]?"
SPF_CLIENT_IP = r"client-ip=\[?([0-9a-fA-F.:]+)\]?"
DKIM_DOMAIN = r"header\.[di]=@?([A-Za-z0-9.\-]+)"
DMARC_POLICY = r"\bp=([a-z]+)"

# --- Fixed values: texts of notes, flags and reasons (printf style) ---

NOTE_NO_RECEIVED = "No Received headers present."
NOTE_SKEW = "Hop %d: NEGATIVE time delta (%ds) — forged header or skewed clock."
NOTE_LITERAL = "Hop %d: sender identified by raw IP literal [%s]."
NOTE_WALK_STOPPED = (
    "Trust walk stopped at Hop %d: intermediate writer untrusted. "
    "Claimed IP [%s] treated as unverified."
)
NOTE_DIVERGENCE = (
    "Origin divergence: verified edge IP [%s] differs from claimed [%s] (forgery tripwire)."
)
LEGACY_NOTE_SKEW = "Hop %d: NEGATIVE time delta (%ds) — possible forged header."
ATTRIBUTION = "Traced via %s: %s (Edge: %s, Claimed: %s)."
ATTRIBUTION_NO_RECEIVED = "No Received headers found."

AUTH_SPF_FLAG = "SPF %s: origin IP not authorized for %s."
AUTH_DKIM_FLAG = "DKIM verification FAILED — altered content or forged signature."
AUTH_DMARC_FLAG = "DMARC FAILED (policy=%s) — From: domain not aligned."
AUTH_NONE_FLAG = "No Authentication-Results headers recorded by edge receiver."
ALIGN_RETURN_PATH_FLAG = (
    "From domain (%s) differs from Return-Path (%s) — possible sender impersonation."
)
ALIGN_REPLY_TO_FLAG = "Reply-To domain (%s) differs from From (%s) — replies route elsewhere."

RISK_AUTH_FAILED = "Email authentication failed (SPF/DKIM/DMARC)."
RISK_AUTH_UNKNOWN = "No authentication results available."
RISK_AUTH_PARTIAL = "Partial authentication passed."
RISK_CLAIMED = "Forged header tripwire: Claimed IP [%s] differs from edge [%s]."
RISK_NO_RECEIVED = "No Received headers present — possible local injection."
RISK_PROXY = "Origin IP [%s] is a known proxy/VPN/Tor node."
RISK_HOSTING = "Origin IP [%s] is datacenter/cloud infrastructure (%s)."
RISK_NO_PTR = "Origin IP [%s] has no reverse DNS (PTR) record."

EVIDENCE_SUBMISSION = "Client authenticated at submission hop with IP %s (%s, %s)."
EVIDENCE_X_ORIGIN = "Webmail header stamped client IP %s (%s, %s)."
EVIDENCE_TIMEZONE = "Sender client system clock configured with timezone offset %s (%s)."
EVIDENCE_CONTENT = "Found %s in message: %s."
EVIDENCE_SCRIPT = "Message contains %d characters in %s script."
EVIDENCE_INFRA = "Fallback to relay IP %s (%s)."

# --- Fixed value: name of the tracing module in exported results ---

TRACE_MODULE = "trace_engine"

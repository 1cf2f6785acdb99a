"""The whole analysis as one plan: messages -> facts -> address intelligence -> reports.

Shuffles from messages to reports: the distinct addresses, the /16 buckets, the address join and
its regrouping, and the facts by message id.  Bodies never take part in any of them, because every
per-message step that reads text runs before the first shuffle and the texts are then dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from relaylens.functions.text import unnest
from relaylens.operators import auth, detection, geo, hops, links, location, origin, report, risk
from relaylens.session import stage
from relaylens.sources.messages import dedup_messages

TEXT_COLUMNS = [
    "body_plain", "body_html", "trace_body", "anchors", "attachments", "received",
    "auth_headers", "auth_raw", "received_spf", "x_headers", "from_addr", "to_addr", "reply_to",
    "urls",
]


@dataclass(frozen=True)
class Dimensions:
    """Look-up tables.  Leaving out ``fallback`` and ``ptr`` is the offline mode.

    Ranges may overlap: the narrowest one that holds an address wins (geo.without_overlaps).  That
    is checked whenever they are used, or once by ``checked``.
    """

    city: DataFrame
    asn: DataFrame | None = None
    fallback: DataFrame | None = None
    ptr: DataFrame | None = None
    disjoint: bool = False

    def checked(self) -> Dimensions:
        """The same look-ups with disjoint ranges; tables that had to be cut are written once."""
        if self.disjoint:
            return self
        given = {n: d for n in ("city", "asn", "fallback") if (d := getattr(self, n)) is not None}
        return replace(self, disjoint=True, **geo.without_overlaps(given))


def trace_facts(messages: DataFrame) -> DataFrame:
    """Trace side, row-local part."""
    staged = origin.with_client_ip(hops.with_hops(auth.with_authentication(messages)))
    staged = location.with_submission_ip(origin.with_origin(staged))
    staged = location.with_artifacts(staged)
    return report.with_parties(report.with_meta(geo.with_lookup_ips(staged)))


def message_facts(messages: DataFrame) -> DataFrame:
    """Both sides, row-local part; needs ``ml_prob``.  Texts are dropped at the end."""
    facts = detection.with_detection(links.with_urls(trace_facts(messages)))
    return facts.drop(*TEXT_COLUMNS)


def address_intel(facts: DataFrame, dims: Dimensions) -> DataFrame:
    usage = unnest(facts, "lookup_ips", item="ip")
    return geo.ip_intel(usage, dims.city, dims.asn, dims.fallback, dims.ptr, dims.disjoint)


def located(facts: DataFrame, intel: DataFrame, key: str = "email_id") -> DataFrame:
    """Facts with intel, signals, candidates, estimate and the origin geography."""
    known = geo.attach_intel(facts, intel, key)
    fused = location.with_estimate(location.with_ranking(location.with_signals(known)))
    return location.with_origin_geo(location.with_artifact_map(fused))


def traced(facts: DataFrame, intel: DataFrame, key: str = "email_id") -> DataFrame:
    """Trace result of each message: located, with route and risk."""
    return risk.with_trace_risk(location.with_route(located(facts, intel, key)))


def assessed(facts: DataFrame, intel: DataFrame, key: str = "email_id") -> DataFrame:
    """Full result of each message, ready for either report shape."""
    return report.with_resolved_place(risk.with_verdict(traced(facts, intel, key)))


def analyze(messages: DataFrame, dims: Dimensions) -> DataFrame:
    """Messages (with ``ml_prob``) to full results, with the two tables that are read more than
    once written in between: facts (parsed once) and address records (looked up once).

    Identical messages are one result; they are folded on the narrow facts.  The facts feed both the
    address list and the final join; a lost executor costs a re-read instead of a re-parse.
    """
    facts = stage(dedup_messages(message_facts(messages)), "facts")
    return assessed(facts, stage(address_intel(facts, dims), "intel"))


def trace_only(messages: DataFrame, dims: Dimensions) -> DataFrame:
    """The trace side alone, for batch tracing without detection: one result per ``path``, so
    identical files are traced each."""
    facts = stage(trace_facts(messages).drop(*TEXT_COLUMNS), "facts")
    return traced(facts, stage(address_intel(facts, dims), "intel"), "path")

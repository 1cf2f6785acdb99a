"""Message meta data and the two report shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions.hosts import only_address
from relaylens.functions.rounding import round_exact
from relaylens.functions.text import first_of, null_if_empty

VERSION = "1.0.0"


def with_meta(messages: DataFrame) -> DataFrame:
    """Empty header texts become null; the message id is trimmed."""
    return messages.withColumns({
        "meta_message_id": null_if_empty(F.trim("message_id")),
        "meta_subject": null_if_empty(F.col("subject")),
        "meta_from": null_if_empty(F.col("from_raw")),
        "meta_to": null_if_empty(F.col("to_raw")),
        "meta_date": null_if_empty(F.col("date_raw")),
    })


def with_parties(messages: DataFrame) -> DataFrame:
    """Sender name and address and recipient address; the raw header where no address parses,
    and an empty text where the header is missing."""
    empty = F.lit("")
    sender, recipient = only_address("from_addr"), only_address("to_addr")
    return messages.withColumns({
        "report_sender": F.coalesce(null_if_empty(sender["addr"]), "from_raw", empty),
        "report_name": F.coalesce(sender["name"], empty),
        "report_email": F.coalesce(null_if_empty(recipient["addr"]), "to_raw", empty),
    })


def with_resolved_place(facts: DataFrame) -> DataFrame:
    """Country and city of the origin, else of the estimate, else empty; first phone found."""
    empty = F.lit("")
    geo, est = F.col("origin_geo"), F.col("estimate")
    return facts.withColumns({
        **{
            f"report_{f}": F.coalesce(null_if_empty(geo[f]), null_if_empty(est[f]), empty)
            for f in ("country", "city")
        },
        "report_phone": F.coalesce(first_of(F.col("phone_numbers")), empty),
    })


def _final_fields(key: str) -> list[Column]:
    """The 13 fields of the final report."""
    return [
        F.col(key).cast("string").alias("id"),
        F.col("meta_subject").alias("subject"),
        F.col("report_email").alias("email"), F.col("report_sender").alias("sender"),
        F.col("report_phone").alias("phone"), F.col("origin_ip").alias("ip"),
        F.col("report_name").alias("name"), F.col("report_country").alias("country"),
        F.col("report_city").alias("city"), F.col("combined_score").alias("risk_score"),
        F.col("classification"), F.col("status_label").alias("status"),
        F.struct(
            F.col("combined_score").alias("combined_threat_score"), "overall_verdict",
        ).alias("overall_assessment"),
    ]


def final_report(facts: DataFrame, key: str = "email_id", *carry: str) -> DataFrame:
    """The 13-field report."""
    return facts.select(*carry, *_final_fields(key))


def trace_report(facts: DataFrame, key: str = "email_id", *carry: str) -> DataFrame:
    """Everything the trace side knows about a message, nested."""
    return facts.select(
        *carry, F.col(key), F.lit(fv.TRACE_MODULE).alias("module"), F.lit(VERSION).alias("version"),
        F.struct(*[
            F.col(f"meta_{f}").alias(f) for f in ("message_id", "subject", "from", "to", "date")
        ]).alias("message_meta"),
        F.struct(
            F.col("hop_count").alias("hops_count"), F.col("route").alias("hops"), "notes",
        ).alias("delivery_path"),
        F.struct(
            F.col("origin_ip").alias("probable_source_ip"), "origin_basis", "origin_hop_index",
            F.col("origin_confidence").alias("confidence"), "via_provider", "attribution_note",
            F.col("origin_geo").alias("geo"), "edge_ip", "edge_geo",
            F.col("claimed_ip").alias("claimed_origin_ip"),
            F.col("origin_verified").alias("claimed_is_verified"),
            F.col("spf_client_ip").alias("spf_edge_ip"), F.col("edge_geo").alias("spf_edge_geo"),
        ).alias("origin"),
        F.struct(
            F.struct(F.col("spf_result").alias("result"), F.col("spf_domain").alias("domain"),
                     F.col("spf_client_ip").alias("client_ip")).alias("spf"),
            F.struct(F.col("dkim_result").alias("result"), F.col("dkim_domain").alias("domain"))
            .alias("dkim"),
            F.struct(F.col("dmarc_result").alias("result"), F.col("dmarc_policy").alias("policy"))
            .alias("dmarc"),
            F.col("auth_summary").alias("summary"), F.col("auth_flags").alias("flags"),
            "from_domain", "return_path_domain", "reply_to_domain", "sender_domain",
        ).alias("authentication"),
        F.struct(
            F.col("estimate").alias("primary_estimate"),
            F.col("candidates").alias("ranked_candidates"), "signals",
            F.col("artifacts").alias("investigation_artifacts"),
        ).alias("sender_location_estimate"),
        F.struct("trace_risk_score", "trace_risk_level", F.col("risk_reasons").alias("reasons"))
        .alias("risk"),
    )


def unified_report(facts: DataFrame, key: str = "email_id") -> DataFrame:
    """Trace, detection, assessment and final report of a message in one nested row."""
    detection = F.struct(
        "fraud_score", F.col("fraud_category").alias("category"),
        F.col("detection_confidence").alias("confidence"), "confidence_label", "flags",
        round_exact(F.col("ml_prob"), 3).alias("ml_confidence"),
    )
    overall = F.struct(
        F.col("combined_score").alias("combined_threat_score"), "overall_verdict")
    traced = trace_report(
        facts.withColumns({
            "_detection": detection, "_overall": overall, "_final": F.struct(*_final_fields(key))}),
        key, "path", "_detection", "_overall", "_final")
    return traced.select(
        F.lit(VERSION).alias("pipeline_version"), key, F.col("path").alias("raw_file_path"),
        "message_meta", F.col("_detection").alias("phishing_detection"),
        F.struct("delivery_path", "origin", "authentication", "sender_location_estimate", "risk")
        .alias("origin_trace"),
        F.col("_overall").alias("overall_assessment"), F.col("_final").alias("final_output"),
    )

"""Trace risk, combined score and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions.text import dense, first_of, null_if_empty


def _points(score: int, reason: Column) -> Column:
    return F.struct(F.lit(score).alias("points"), reason.alias("reason"))


def with_trace_risk(facts: DataFrame) -> DataFrame:
    """``trace_risk_score``, ``trace_risk_level``, ``risk_reasons``; the score is the sum of the
    points listed with the reasons, so the two cannot disagree."""
    summary, geo = F.col("auth_summary"), F.col("origin_geo")
    identity = first_of(F.filter(
        "auth_flags", lambda t: F.lower(t).rlike("differs from|impersonation|spoofing")))
    proxy = F.coalesce(geo["is_proxy_or_vpn"], F.lit(False)) \
        | (geo["infrastructure_type"] == "proxy/vpn/anonymizer")
    notes = F.transform(
        F.filter("notes", lambda n: n.rlike("NEGATIVE time delta|IP literal")),
        lambda n: F.when(F.contains(n, F.lit("NEGATIVE time delta")), _points(15, n))
        .otherwise(_points(10, n)))
    before = dense(
        F.when(summary == "failed", _points(45, F.lit(fv.RISK_AUTH_FAILED)))
        .when(summary == "unknown", _points(15, F.lit(fv.RISK_AUTH_UNKNOWN)))
        .when(summary == "partially_authenticated", _points(10, F.lit(fv.RISK_AUTH_PARTIAL))),
        F.when(identity.isNotNull(), _points(10, identity)),
        F.when(
            ~F.col("origin_verified") & F.col("claimed_ip").isNotNull()
            & ~F.col("claimed_ip").eqNullSafe(F.col("origin_ip")),
            _points(15, F.format_string(
                fv.RISK_CLAIMED, "claimed_ip", F.coalesce("origin_ip", F.lit("None"))))),
    )
    after = dense(
        F.when(F.col("hop_count") == 0, _points(20, F.lit(fv.RISK_NO_RECEIVED))),
        F.when(proxy, _points(15, F.format_string(fv.RISK_PROXY, geo["ip"])))
        .when(
            geo["infrastructure_type"] == "datacenter/hosting",
            _points(10, F.format_string(
                fv.RISK_HOSTING, geo["ip"],
                F.coalesce(null_if_empty(geo["isp"]), F.lit("Hosting"))))),
        F.when(
            geo.isNotNull() & geo["reverse_dns"].isNull() & geo["error"].isNull(),
            _points(5, F.format_string(fv.RISK_NO_PTR, geo["ip"]))),
    )
    score = F.least(
        F.aggregate("_points", F.lit(0), lambda acc, p: acc + p["points"]), F.lit(100))
    risk = F.col("trace_risk_score")
    return (
        facts.withColumn("_points", F.concat(before, notes, after))
        .withColumns({
            "trace_risk_score": score,
            "risk_reasons": F.transform("_points", lambda p: p["reason"]),
        })
        .withColumn("trace_risk_level",
                    F.when(risk >= 60, "high").when(risk >= 30, "medium").otherwise("low"))
        .drop("_points")
    )


def with_verdict(facts: DataFrame) -> DataFrame:
    """Combined score (exact integer rounding: the tenths digit is even, so no ties), verdict,
    status and classification."""
    combined = F.expr("CAST((6 * fraud_score + 4 * trace_risk_score + 5) DIV 10 AS INT)")
    score, category = F.col("combined_score"), F.col("fraud_category")

    def by_level(high: str, middle: str, low: str) -> Column:
        return (
            F.when((score >= 70) | (category == "phishing"), high)
            .when((score >= 35) | (category == "suspicious"), middle).otherwise(low)
        )

    return facts.withColumn("combined_score", combined).withColumns({
        "overall_verdict": by_level("PHISHING_MALICIOUS", "SUSPICIOUS", "LEGITIMATE"),
        "status_label": by_level("High Risk", "Moderate Risk", "Low Risk"),
        "classification": F.initcap(category),
    })

"""Origin resolution by a top-down trust walk, as array expressions inside the message row.

The walk is not a loop: hop i is reachable exactly when no hop from the edge to i-1 is an
unknown relay, so the index of the first unknown relay at or below the edge decides everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions import ip
from relaylens.functions.remember import remembered
from relaylens.functions.text import dense, first_of, last_of
from relaylens.operators.hops import has_skew, is_public


@remembered
def _client_ip() -> Column:
    candidates = dense(*[
        F.regexp_extract(
            F.try_element_at("x_headers", F.lit(name)), r"(?:\d{1,3}\.){3}\d{1,3}", 0)
        for name in fv.CLIENT_IP_HEADERS
    ])
    return first_of(
        F.filter(candidates, lambda c: ip.is_ipv4(c) & ~ip.is_private_ip(c)))


def with_client_ip(messages: DataFrame) -> DataFrame:
    """``x_ip``: first public IPv4 that one of the client headers carries."""
    return messages.withColumn("x_ip", _client_ip())


def _hop_notes(h: Column) -> Column:
    return dense(
        F.when(
            has_skew(h),
            F.format_string(fv.NOTE_SKEW, h["index"], h["delay_seconds"].cast("long")),
        ),
        F.when(
            h["helo_literal_ip"] & is_public(h),
            F.format_string(fv.NOTE_LITERAL, h["index"], h["from_ip"]),
        ),
    )


@remembered
def _origin_columns() -> list[dict[str, Column]]:
    found = {
        "hop_count": F.size("hops"),
        "_edge": first_of(F.filter("hops", is_public)),
        "_claimed": last_of(F.filter("hops", is_public)),
        "_skewed": F.exists("hops", has_skew),
    }
    edge = {
        "edge_index": F.col("_edge.index"),
        "edge_ip": F.when(F.col("hop_count") > 0,
                          F.coalesce(F.col("_edge.from_ip"), "spf_client_ip")),
        "claimed_hop_ip": F.col("_claimed.from_ip"),
        "via_provider": F.coalesce(F.col("_edge.is_relay"), F.lit(False)),
        "break_index": first_of(F.filter(
            "hops", lambda h: (h["index"] >= F.col("_edge.index")) & ~h["is_relay"]))["index"],
    }

    def reached(h: Column) -> Column:
        below = h["index"] > F.col("edge_index")
        trusted = F.col("break_index").isNull() | (h["index"] <= F.col("break_index"))
        submitted = (h["protocol"] == "ESMTPSA") & h["from_ip"].isNotNull()
        return below & trusted & (is_public(h) | F.coalesce(submitted, F.lit(False)))

    walked = {
        "walk_ip": F.coalesce(F.col("_walk.from_ip"), "edge_ip"),
        "walk_index": F.coalesce(F.col("_walk.index"), "edge_index"),
        "walk_basis": F.when(F.col("_walk").isNull(), "edge_received_hop")
        .when(is_public(F.col("_walk")), "reputable_relay_descent")
        .otherwise("esmtpsa_submission"),
    }

    empty = F.col("hop_count") == 0
    override = ~empty & F.col("via_provider") & F.col("x_ip").isNotNull()
    resolved = {
        "origin_ip": F.when(empty | override, F.col("x_ip")).otherwise(F.col("walk_ip")),
        "origin_basis": F.when(empty & F.col("x_ip").isNull(), "no_received_headers")
        .when(empty | override, "x_originating_ip").otherwise(F.col("walk_basis")),
        "origin_hop_index": F.col("walk_index"),
        "claimed_ip": F.when(empty, F.col("x_ip")).otherwise(F.col("claimed_hop_ip")),
    }
    verified = ~empty & F.coalesce(F.col("claimed_ip") == F.col("origin_ip"), F.lit(False))

    stop = F.col("break_index") + 1
    stopped = (stop < F.col("hop_count")) & ~F.col("claimed_hop_ip").eqNullSafe(F.col("walk_ip"))
    tail = dense(
        F.when(stopped, F.format_string(fv.NOTE_WALK_STOPPED, stop, "claimed_hop_ip")),
        F.when(
            F.col("claimed_ip").isNotNull() & F.col("origin_ip").isNotNull()
            & ~F.col("origin_verified"),
            F.format_string(fv.NOTE_DIVERGENCE, "origin_ip", "claimed_ip"),
        ),
    )
    notes = F.when(empty, F.array(F.lit(fv.NOTE_NO_RECEIVED))).otherwise(
        F.array_distinct(F.concat(F.flatten(F.transform("hops", _hop_notes)), tail)))
    confidence = (
        F.when(empty, F.when(F.col("x_ip").isNotNull(), "medium").otherwise("low"))
        .when(F.col("_skewed") | F.col("origin_ip").isNull(), "low")
        .when(
            F.col("auth_summary").isin("failed", "authenticated")
            | (F.col("origin_basis") != "edge_received_hop"),
            "high",
        ).otherwise("medium")
    )
    attribution = F.when(empty, F.lit(fv.ATTRIBUTION_NO_RECEIVED)).otherwise(
        F.format_string(
            fv.ATTRIBUTION, F.replace("origin_basis", F.lit("_"), F.lit(" ")),
            F.coalesce("origin_ip", F.lit("unknown")), F.coalesce("edge_ip", F.lit("none")),
            F.coalesce("claimed_ip", F.lit("none")),
        ))
    return [
        found, edge, {"_walk": last_of(F.filter("hops", reached))}, walked, resolved,
        {"origin_verified": verified},
        {"notes": notes, "origin_confidence": confidence, "attribution_note": attribution},
    ]


def with_origin(messages: DataFrame) -> DataFrame:
    """Needs hops, x_ip and the trace verdicts; adds the origin columns and ``notes``."""
    for columns in _origin_columns():
        messages = messages.withColumns(columns)
    return messages.drop("_edge", "_claimed", "_skewed", "_walk")

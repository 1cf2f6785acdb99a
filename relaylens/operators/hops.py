"""Relay path: one struct per Received header, kept as an array inside the message row.

A message's hops never leave its row, so parsing, delays and the walk over them need no shuffle
and no per-key group, and a message with very many hops costs no more than its own bytes.
``hop_table`` explodes them when a long table is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions import ip
from relaylens.functions.dates import date_parts, date_value
from relaylens.functions.hosts import is_reputable
from relaylens.functions.remember import remembered
from relaylens.functions.text import all_groups, first_group, first_of, last_of, squeeze, unnest

# What each pattern reads is part of the result.
FROM_PATTERN = r"(?i)from\s+(\[?[A-Za-z0-9._:\-]+\]?)(?:\s+\(([^)]*)\))?"
BY_PATTERN = r"(?i)\bby\s+([A-Za-z0-9._\-]+)"
WITH_PATTERN = r"(?i)\bwith\s+([A-Za-z0-9+\-]+)"
AUTH_USER_PATTERN = (
    r"(?i)\b(?:authenticated\s+as|auth=)\s*([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+|[A-Za-z0-9._\-]+)"
)
IP_PATTERN = (
    r"(?:(?<=\[)|(?<=\s)|(?<=\()|^)((?:\d{1,3}\.){3}\d{1,3}|[A-Fa-f0-9:]{2,45}:[A-Fa-f0-9:]*)"
)


def first_valid_ip(text: Column) -> Column:
    return first_of(
        F.filter(all_groups(text, IP_PATTERN, 1), lambda x: ip.is_ipv4(x) | ip.is_ipv6(x))
    )


def _read(v: Column) -> Column:
    """Pieces of one header, each found by one pattern."""
    start = F.locate("from ", F.lower(v))
    return F.struct(
        v.alias("raw"),
        first_group(v, FROM_PATTERN, 1).alias("host"),
        first_group(v, FROM_PATTERN, 2).alias("paren"),
        F.substring(v, F.when(start > 0, start).otherwise(1), F.length(v)).alias("rest"),
        first_group(v, BY_PATTERN).alias("by_host"),
        F.upper(first_group(v, WITH_PATTERN)).alias("protocol"),
        first_group(v, AUTH_USER_PATTERN).alias("auth_user"),
        F.when(F.contains(v, F.lit(";")), date_parts(F.substring_index(v, ";", -1))).alias("date"),
    )


def _resolve(h: Column) -> Column:
    """Address by priority (inside the parenthesis, literal HELO, rest of the text) and date."""
    literal = ip.valid_ip(h["host"])
    return F.struct(
        h["raw"].alias("raw"),
        F.btrim(h["host"], F.lit("[]")).alias("from_host"),
        F.coalesce(first_valid_ip(h["paren"]), literal, first_valid_ip(h["rest"]))
        .alias("from_ip"),
        literal.isNotNull().alias("helo_literal_ip"),
        h["by_host"].alias("by_host"), h["protocol"].alias("protocol"),
        h["auth_user"].alias("auth_user"), date_value(h["date"]).alias("date"),
    )


@remembered
def _hop_columns() -> list[dict[str, Column]]:
    read = F.transform(
        F.coalesce("received", F.array().cast("array<string>")),
        lambda h: _read(F.trim(squeeze(h))),
    )

    def final(h: Column, i: Column) -> Column:
        older = F.try_element_at(F.col("_hops"), i + 2)["date"]
        newer = h["date"]
        comparable = newer["offset"].isNull() == older["offset"].isNull()
        private = F.when(h["from_ip"].isNull(), F.lit(False)).otherwise(
            ip.is_private_ip(h["from_ip"]))
        tls = F.contains(h["protocol"], F.lit("TLS")) \
            | h["protocol"].isin("ESMTPS", "ESMTPSA", "SMTPS")
        return F.struct(
            i.alias("index"), h["raw"].alias("raw"), h["from_host"].alias("from_host"),
            h["from_ip"].alias("from_ip"), h["by_host"].alias("by_host"),
            h["protocol"].alias("protocol"), newer["iso"].alias("timestamp"),
            newer["epoch"].alias("epoch"), newer["offset"].alias("tz_offset"),
            private.alias("is_private_ip"),
            F.coalesce(tls, F.lit(False)).alias("is_tls"),
            F.when(comparable, newer["epoch"] - older["epoch"]).cast("double")
            .alias("delay_seconds"),
            h["auth_user"].alias("auth_user"), h["helo_literal_ip"].alias("helo_literal_ip"),
            (is_reputable(h["by_host"]) | is_reputable(h["from_host"])).alias("is_relay"),
        )

    return [
        {"_read": read}, {"_hops": F.transform("_read", _resolve)},
        {"hops": F.transform("_hops", final)},
    ]


def with_hops(messages: DataFrame) -> DataFrame:
    """Add ``hops array<struct<...>>``, newest first, index from 0."""
    for columns in _hop_columns():
        messages = messages.withColumns(columns)
    return messages.drop("_read", "_hops")


def is_public(h: Column) -> Column:
    return h["from_ip"].isNotNull() & ~h["is_private_ip"]


def has_skew(h: Column) -> Column:
    return F.coalesce(h["delay_seconds"] < fv.SKEW_SECONDS, F.lit(False))


def hop_table(messages_with_hops: DataFrame, key: str = "email_id") -> DataFrame:
    """Long form, one row per hop."""
    h = unnest(messages_with_hops, "hops", key, item="h")
    fields = [
        "raw", "from_host", "from_ip", "by_host", "protocol", "timestamp", "tz_offset",
        "is_private_ip", "is_tls", "delay_seconds", "auth_user", "helo_literal_ip", "is_relay",
    ]
    return h.select(
        key, F.col("h.index").alias("hop_index"), *[F.col(f"h.{f}") for f in fields],
        F.timestamp_seconds("h.epoch").alias("ts"),
    )


def with_bottom_hop(messages_with_hops: DataFrame) -> DataFrame:
    """Deepest public hop and the plain skew notes."""
    bottom = last_of(F.filter("hops", is_public))
    notes = F.transform(
        F.filter("hops", has_skew),
        lambda h: F.format_string(
            fv.LEGACY_NOTE_SKEW, h["index"], h["delay_seconds"].cast("long")),
    )
    return messages_with_hops.withColumns({
        "bottom_ip": bottom["from_ip"], "bottom_index": bottom["index"], "bottom_notes": notes,
    })

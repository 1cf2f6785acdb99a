"""Sender location: weighted signals per message, fused into ranked countries.

Everything is row-local.  A message has at most 16 signals, so ranking inside the row is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions.remember import remembered
from relaylens.functions.rounding import round_exact
from relaylens.functions.text import (
    all_groups, bind, constant, dense, first_of, null_if_empty, quoted,
)
from relaylens.operators.geo import intel_of
from relaylens.operators.hops import is_public

_UNICODE = "(?U)"


def with_artifacts(messages: DataFrame) -> DataFrame:
    """Payment handles, phones, bank codes, amounts and scripts found in subject and body.

    The handle pattern keeps its suffix group, as the signal is about the payment network.
    """
    text = F.concat(
        F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("trace_body", F.lit("")))

    def found(pattern: str, group: int = 0) -> Column:
        return F.array_distinct(all_groups(F.col("_text"), pattern, group))

    return messages.withColumn("_text", text).withColumns({
        # Only a text with the sign can match, and the pattern tries every word of the others.
        "upi_ids": F.when(F.contains(F.col("_text"), F.lit("@")), found(
            f"{_UNICODE}(?i){fv.UPI_PATTERN}", 1)).otherwise(F.array().cast("array<string>")),
        "phone_numbers": found(_UNICODE + fv.PHONE_PATTERN),
        "ifsc_codes": found(_UNICODE + fv.IFSC_PATTERN),
        "financial_mentions": found(f"{_UNICODE}(?i){fv.RUPEE_PATTERN}"),
        "scripts": _scripts(),
    }).drop("_text")


@remembered
def _scripts() -> Column:
    return scripts_of(F.col("_text"))


def _script_class(name: str) -> str:
    # The Arabic tatweel is a letter by name but of the common script.
    return rf"\p{{Is{name}}}" + ("\u0640" if name == "Arabic" else "")


def scripts_of(text: Column) -> Column:
    """array<struct<script, letters>> in order of first appearance.

    One scan settles most messages: only text with a letter of some listed script is counted, and of it
    only the characters that can belong to one, in their order.
    """
    # All listed scripts lie in these ranges; a plain range test is far cheaper per character
    # than a script look-up.
    possible = r"\x{400}-\x{1FFF}\x{2C00}-\x{10FFFF}"
    return F.when(text.rlike(f"[{possible}]"), bind(
        F.regexp_replace(text, f"[^{possible}]+", ""), _listed_scripts)).otherwise(
        F.array().cast("array<struct<script:string,letters:int>>"))


def _listed_scripts(text: Column) -> Column:
    entries = []
    for i, name in enumerate(fv.SCRIPTS):
        letter = rf"[{_script_class(name)}&&[\p{{L}}]]"
        others = rf"[^{_script_class(name)}]|[^\p{{L}}]"
        entries.append(F.when(
            text.rlike(letter),
            F.struct(
                F.length(F.regexp_extract(text, rf"(?s)^(.*?){letter}", 1)).alias("position"),
                F.lit(i).alias("rank"), F.lit(name).alias("script"),
                F.length(F.regexp_replace(text, others, "")).alias("letters")),
        ))
    return F.transform(
        F.sort_array(dense(*entries)),
        lambda s: F.struct(s["script"].alias("script"), s["letters"].alias("letters")))


def with_submission_ip(messages: DataFrame) -> DataFrame:
    """``s1_ip``: first public hop with an authenticated submission.  ``s2_ip``: the client
    header address, unless it is the same one."""

    def submitted(h: Column) -> Column:
        return (F.coalesce(h["protocol"].isin("ESMTPSA", "SMTPSA"), F.lit(False))
                | h["auth_user"].isNotNull()) & is_public(h)

    return messages.withColumn(
        "s1_ip", first_of(F.filter("hops", submitted))["from_ip"]
    ).withColumn(
        "s2_ip", F.when(~F.col("x_ip").eqNullSafe(F.col("s1_ip")), F.col("x_ip")))


def _signal(seq: int, signal_id: Column, name: Column, weight: Column, value: Column,
            estimate: Column, evidence: Column, country: Column, code: Column,
            credited: Column, city=None, region=None, address=None, isp=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(seq).alias("seq"), signal_id.alias("signal_id"), name.alias("name"),
        weight.cast("double").alias("weight"), value.alias("value"),
        estimate.alias("estimated_location"), evidence.alias("evidence"),
        country.alias("country"), code.alias("country_code"), credited.alias("credited"),
        (city if city is not None else none).alias("city"),
        (region if region is not None else none).alias("region"),
        (address if address is not None else none).alias("ip"),
        (isp if isp is not None else none).alias("isp"),
    )


def _address_signal(seq: int, sid: str, name: str, weight: float, address: Column,
                    geo: Column, evidence: Column) -> Column:
    country = F.coalesce(null_if_empty(geo["country"]), F.lit("Unknown"))
    place = F.btrim(
        F.concat(F.coalesce(geo["city"], F.lit("")), F.lit(", "), country), F.lit(", "))
    return _signal(
        seq, F.lit(sid), F.lit(name), F.lit(weight), address, place, evidence, country,
        F.coalesce(null_if_empty(geo["country_code"]), F.lit("XX")), F.lit(True),
        geo["city"], geo["region"], address, geo["isp"],
    )


@remembered
def network_signals() -> dict[str, Column]:
    """Columns for the two client-address signals, the clock and the last resort."""
    s1, s2 = F.col("_g1"), F.col("_g2")

    def described(text: str, address: Column, geo: Column) -> Column:
        return F.format_string(
            text, address, F.coalesce(null_if_empty(geo["country"]), F.lit("Unknown")),
            F.coalesce(null_if_empty(geo["isp"]), F.lit("ISP")))

    zone = F.col("date_zone")
    countries = constant({k: c for k, (c, _) in fv.TIMEZONE_COUNTRIES.items()})
    codes = constant({k: cc for k, (_, cc) in fv.TIMEZONE_COUNTRIES.items()})
    country = F.try_element_at(countries, zone)
    return {
        "_sig1": F.when(F.col("s1_ip").isNotNull(), _address_signal(
            1, "S1_ESMTPSA_SUBMISSION_IP", "Authenticated SMTP Client IP", 0.90,
            F.col("s1_ip"), s1, described(fv.EVIDENCE_SUBMISSION, F.col("s1_ip"), s1))),
        "_sig2": F.when(F.col("s2_ip").isNotNull(), _address_signal(
            2, "S2_X_ORIGINATING_IP", "Provider Stamped Client IP", 0.90,
            F.col("s2_ip"), s2, described(fv.EVIDENCE_X_ORIGIN, F.col("s2_ip"), s2))),
        "_sig3": F.when(country.isNotNull(), _signal(
            3, F.lit("S3_DATE_TIMEZONE"), F.lit("Mail Client Timezone Offset"), F.lit(0.30),
            zone, country, F.format_string(fv.EVIDENCE_TIMEZONE, zone, country),
            country, F.try_element_at(codes, zone), F.lit(True))),
    }


@remembered
def content_signals() -> list[Column]:
    out = []
    for i, (key, sid, name, weight) in enumerate(fv.CONTENT_SIGNALS):
        shown = F.array_join(F.slice(F.col(key), 1, 3), ", ")
        out.append(F.when(F.size(key) > 0, _signal(
            4 + i, F.lit(sid), F.lit(name), F.lit(weight), shown, F.lit("India"),
            F.format_string(fv.EVIDENCE_CONTENT, F.lit(name.lower()), shown),
            F.lit("India"), F.lit("IN"), F.lit(True))))
    return out


@remembered
def script_signals() -> Column:
    def one(s: Column, i: Column) -> Column:
        indic = s["script"].isin(fv.INDIC_SCRIPTS)
        where = F.when(indic, "India").otherwise("International")
        signal = _signal(
            0, F.lit("S5_UNICODE_SCRIPT"), F.concat(F.lit("Regional Script: "), s["script"]),
            F.lit(0.20), F.concat(s["letters"].cast("string"), F.lit(" chars")), where,
            F.format_string(fv.EVIDENCE_SCRIPT, s["letters"], s["script"]), where,
            F.when(indic, "IN").otherwise("XX"), indic)
        return signal.withField("seq", i + 8)

    return F.transform("scripts", one)


@remembered
def last_resort_signal() -> Column:
    return _address_signal(
        16, "S6_INFRASTRUCTURE_GEO", "Relay Infrastructure IP Geolocation", 0.25,
        F.col("origin_ip"), F.col("_g6"),
        F.format_string(
            fv.EVIDENCE_INFRA, "origin_ip",
            F.coalesce(F.col("_g6.infrastructure_type"), F.lit("datacenter"))))


def with_signals(facts: DataFrame) -> DataFrame:
    """``signals``: ordered array of structs.  Needs intel, artifacts, s1_ip, s2_ip, origin_ip."""
    staged = facts.withColumns({
        "_g1": intel_of(F.col("s1_ip")), "_g2": intel_of(F.col("s2_ip")),
        "_g6": intel_of(F.col("origin_ip")),
        "date_zone": null_if_empty(
            F.regexp_extract(F.coalesce("date_raw", F.lit("")), r"([+\-]\d{4})\b", 1)),
    }).withColumns(network_signals()).withColumn(
        "_found",
        F.concat(dense("_sig1", "_sig2", "_sig3", *content_signals()), script_signals()))
    nothing = ~F.exists("_found", lambda s: s["credited"])
    return staged.withColumn(
        "signals",
        F.when(nothing & F.col("origin_ip").isNotNull(),
               F.concat("_found", F.array(last_resort_signal()))).otherwise(F.col("_found")),
    ).drop("_g1", "_g2", "_g6", "_sig1", "_sig2", "_sig3", "_found")


def with_ranking(facts: DataFrame) -> DataFrame:
    """``candidates``: countries by summed weight, best first; ties keep the first credited.

    Weights are added in signal order in doubles, so sums and their order are reproducible.
    """
    credits = facts.withColumn("_credits", F.filter("signals", lambda s: s["credited"])) \
        .withColumn("_countries",
                    F.array_distinct(F.transform("_credits", lambda s: s["country"])))

    def scored(country: Column) -> Column:
        own = F.filter("_credits", lambda s: s["country"] == country)
        total = F.aggregate(own, F.lit(0.0), lambda acc, s: acc + s["weight"])
        matched = F.transform(
            F.filter("signals", lambda s: F.contains(s["estimated_location"], country)),
            lambda s: s["signal_id"])
        return bind(F.element_at(own, 1), lambda first: F.struct(
            (-total).alias("order"), first["seq"].alias("first_seq"),
            country.alias("country"), first["country_code"].alias("country_code"),
            first["city"].alias("city"), first["region"].alias("region"),
            first["ip"].alias("ip"), first["isp"].alias("isp"),
            total.alias("score"), matched.alias("signals_matched"),
        ))

    ranked = F.transform(
        F.sort_array(F.transform("_countries", scored)),
        lambda c: F.struct(
            *[c[f].alias(f) for f in ("country", "country_code", "city", "region", "ip", "isp")],
            round_exact(c["score"], 2).alias("confidence_score"),
            c["signals_matched"].alias("signals_matched"), c["first_seq"].alias("first_seq"),
        ))
    return credits.withColumn("candidates", ranked).drop("_credits", "_countries")


def with_estimate(facts: DataFrame) -> DataFrame:
    """``estimate``: the best candidate with confidence and evidence."""
    top = first_of(F.col("candidates"))
    confidence = (
        F.when(F.col("s1_ip").isNotNull() | F.col("x_ip").isNotNull(), "high")
        .when((F.size("signals") >= 2) & (F.col("_top.confidence_score") >= 0.60), "medium")
        .when(F.col("_top").isNotNull(), "low").otherwise("unknown")
    )
    return facts.withColumn("_top", top).withColumn("estimate", F.struct(
        F.col("_top.country").alias("country"), F.col("_top.country_code").alias("country_code"),
        F.col("_top.city").alias("city"), F.col("_top.region").alias("region"),
        F.col("_top.ip").alias("device_ip"), confidence.alias("confidence"),
        F.size("signals").alias("evidence_count"),
        F.transform("signals", lambda s: s["evidence"]).alias("basis"),
    )).drop("_top")


def with_artifact_map(facts: DataFrame) -> DataFrame:
    """``artifacts map<kind, values>``, every kind present, values distinct in found order."""
    scripts = F.transform(
        "scripts", lambda s: F.format_string("%s (%d chars)", s["script"], s["letters"]))
    kinds = {
        "client_ips": F.array_distinct(dense("s1_ip", "s2_ip")),
        **{k: F.col(k) for k, *_ in fv.CONTENT_SIGNALS},
        "detected_scripts": scripts,
    }
    return facts.withColumn(
        "artifacts", F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), v)]))


def with_origin_geo(facts: DataFrame) -> DataFrame:
    """``origin_geo`` (after the relay-to-sender override) and ``edge_geo``."""
    geo, est = F.col("_geo"), F.col("estimate")
    provider = F.col("via_provider") | F.coalesce(
        F.lower(geo["isp"]).rlike("|".join(quoted(p) for p in fv.RELAY_PROVIDERS)), F.lit(False))
    has_country = F.coalesce(est["country"], F.lit("")) != ""
    relay = F.col("_relay")
    direct = F.col("_direct")
    fields = [c for c in ("lat", "lon", "timezone", "isp", "org", "asn", "asn_name",
                          "reverse_dns", "is_hosting", "is_proxy_or_vpn", "is_mobile",
                          "infrastructure_type", "sources", "error")]
    empty = F.lit("")

    def moved(field: str) -> Column:
        return F.when(relay, geo[field])

    overridden = F.when(geo.isNotNull(), F.struct(
        F.col("origin_ip").alias("ip"),
        F.when(relay | direct, est["country"]).otherwise(geo["country"]).alias("country"),
        F.when(relay | direct, est["country_code"]).otherwise(geo["country_code"])
        .alias("country_code"),
        F.when(relay, F.coalesce(est["region"], empty)).otherwise(geo["region"]).alias("region"),
        F.when(relay, F.coalesce(est["city"], empty))
        .when(direct, F.coalesce(null_if_empty(est["city"]), geo["city"]))
        .otherwise(geo["city"]).alias("city"),
        *[geo[f].alias(f) for f in fields],
        moved("country").alias("relay_country"), moved("country_code").alias("relay_country_code"),
        moved("city").alias("relay_city"), moved("isp").alias("relay_isp"),
        F.when(relay | direct, "sender_device_signal_fusion").alias("location_source"),
    ))
    edge = F.when(~F.col("edge_ip").eqNullSafe(F.col("origin_ip")), intel_of(F.col("edge_ip")))
    return (
        facts.withColumn("_geo", intel_of(F.col("origin_ip")))
        .withColumn("_relay", provider & has_country)
        .withColumn("_direct", ~F.col("_relay") & (est["confidence"] == "high"))
        .withColumns({"origin_geo": overridden, "edge_geo": edge})
        .drop("_geo", "_relay", "_direct")
    )


def with_route(facts: DataFrame) -> DataFrame:
    """``route``: hops oldest first, public ones with their geo fields."""
    names = ["country", "country_code", "city", "lat", "lon", "isp", "asn", "infrastructure_type"]

    def viewed(h: Column) -> Column:
        geo = intel_of(h["from_ip"])
        return bind(
            F.when(is_public(h), geo),
            lambda g: h.withField(
                "geo", F.when(g.isNotNull(), F.struct(*[g[n].alias(n) for n in names]))))

    return facts.withColumn("route", F.transform(F.reverse("hops"), viewed))

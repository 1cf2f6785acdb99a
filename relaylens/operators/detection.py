"""Rule flags, rule score, fraud score and confidence.  Row-local: one projection per message."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens import fixed_values as fv
from relaylens.functions.hosts import domain_after_last_at
from relaylens.functions.remember import remembered
from relaylens.functions.rounding import round_exact, round_half_even_int
from relaylens.functions.text import any_of, constant, contains_any, dense, unnest

_NONE = "array<string>"


def _no_flags() -> Column:
    return F.array().cast(_NONE)


def with_sender(messages: DataFrame) -> DataFrame:
    """Columns of the first From and Reply-To address that the rules read."""
    sender = F.try_element_at("from_addr", F.lit(1))
    return messages.withColumns({
        "has_from": F.size(F.coalesce("from_addr", F.array().cast(
            "array<struct<name:string,addr:string>>"))) > 0,
        "sender_name": sender["name"], "sender_addr": sender["addr"],
        "rule_domain": F.coalesce(domain_after_last_at(sender["addr"]), F.lit("")),
        "reply_rule_domain": domain_after_last_at(
            F.try_element_at("reply_to", F.lit(1))["addr"]),
        "return_path": F.btrim("return_path_raw", F.lit("<>")),
    })


@remembered
def auth_flags() -> Column:
    spf = F.col("auth_spf")
    return dense(
        F.when(spf == "fail", "SPF_FAIL").when(spf == "softfail", "SPF_SOFTFAIL"),
        F.when(F.col("auth_dkim") == "fail", "DKIM_FAIL"),
        F.when(F.col("auth_dmarc") == "fail", "DMARC_FAIL"),
    )


@remembered
def reply_to_flag() -> Column:
    reply, own = F.col("reply_rule_domain"), F.col("rule_domain")
    return F.when(F.col("has_from") & (reply != "") & (reply != own), "REPLY_TO_MISMATCH")


@remembered
def return_path_flag() -> Column:
    path, own = F.col("return_path"), F.col("rule_domain")
    return F.when(
        F.col("has_from") & (path != "") & (own != "") & ~F.contains(F.lower(path), own),
        "RETURN_PATH_MISMATCH")


def lookalike_candidates(domain: Column) -> Column:
    """Trusted domains that might be similar enough: an upper bound in native expressions.

    Matching characters cannot exceed what both words have in common, counted with repeats.
    """
    known = constant([
        (("name", t), ("size", len(t)),
         ("letters", [(("ch", c), ("n", t.count(c))) for c in dict.fromkeys(t)]))
        for t in fv.TRUSTED_DOMAINS
    ])

    def near(t: Column) -> Column:
        common = F.aggregate(
            t["letters"], F.lit(0),
            lambda acc, x: acc + F.least(
                F.length(domain) - F.length(F.replace(domain, x["ch"], F.lit(""))), x["n"]))
        bound = 2.0 * common / (F.length(domain) + t["size"])
        return (domain != t["name"]) & (bound > fv.LOOKALIKE_RATIO)

    return F.transform(F.filter(known, near), lambda t: t["name"])


@remembered
def _near_own_domain() -> Column:
    return lookalike_candidates(F.col("rule_domain"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _similar(domain: pd.Series, candidates: pd.Series) -> pd.Series:
    """Keep the candidates whose matching-block ratio with the domain exceeds the limit."""
    from difflib import SequenceMatcher

    known: dict[tuple[str, str], bool] = {}

    def close(d: str, t: str) -> bool:
        if (d, t) not in known:
            known[d, t] = SequenceMatcher(None, d, t).ratio() > fv.LOOKALIKE_RATIO
        return known[d, t]

    return pd.Series([
        None if c is None else [t for t in c if close(d, t)]
        for d, c in zip(domain, candidates)
    ])


def with_lookalikes(messages: DataFrame) -> DataFrame:
    """``lookalikes array<string>``: trusted domains that the sender's domain resembles.

    The exact ratio runs in Arrow batches and only for the few rows that pass the native bound;
    all others send nulls.  No join on the domain, so a popular domain is no hot key.
    """
    staged = messages.withColumn(
        "_near", F.when(F.col("has_from") & (F.col("rule_domain") != ""), _near_own_domain())
    ).withColumn("_near", F.when(F.size("_near") > 0, F.col("_near")))
    asked = F.when(F.col("_near").isNotNull(), F.col("rule_domain"))
    return staged.withColumn("_close", _similar(asked, F.col("_near"))).withColumn(
        "lookalikes", F.coalesce("_close", _no_flags())).drop("_near", "_close")


@remembered
def lookalike_flags() -> Column:
    return F.transform("lookalikes", lambda t: F.concat(
        F.lit("LOOKALIKE_DOMAIN:"), F.col("rule_domain"), F.lit("~"), t))


def body_text() -> Column:
    return F.lower(F.concat(
        F.coalesce("body_plain", F.lit("")), F.lit(" "), F.coalesce("body_html", F.lit(""))))


@remembered
def urgency_flag() -> Column:
    return F.when(contains_any(F.col("_body"), fv.URGENCY_TERMS), "URGENCY_LANGUAGE")


@remembered
def bec_flag() -> Column:
    return F.when(contains_any(F.col("_body"), fv.BEC_TERMS), "BEC_LANGUAGE_PATTERN")


def ip_url_flag(u: Column) -> Column:
    return F.when(u["host"].rlike(r"^\d{1,3}(\.\d{1,3}){3}$"),
                  F.concat(F.lit("IP_BASED_URL:"), u["url"]))


def short_url_flag(u: Column) -> Column:
    return F.when(contains_any(u["host"], fv.URL_SHORTENERS),
                  F.concat(F.lit("SHORTENED_URL:"), u["url"]))


def anchor_flags(u: Column) -> Column:
    """One flag per trusted brand that the link text names and the link does not belong to."""
    brands = constant([
        (("brand", t.split(".")[0]), ("domain", t)) for t in fv.TRUSTED_DOMAINS])
    named = F.filter(brands, lambda b: F.coalesce(
        F.contains(F.lower(u["anchor_text"]), b["brand"]) & (u["domain"] != b["domain"]),
        F.lit(False)))
    return F.transform(named, lambda b: F.concat(
        F.lit("ANCHOR_TEXT_MISMATCH:"), u["anchor_text"], F.lit("->"), u["domain"]))


@remembered
def url_flags() -> Column:
    return F.flatten(F.transform(
        "urls", lambda u: F.concat(dense(ip_url_flag(u), short_url_flag(u)), anchor_flags(u))))


def is_risky_file(filename: Column) -> Column:
    return F.lower(filename).rlike("(?:" + any_of(fv.RISKY_EXTENSIONS) + ")$")


@remembered
def attachment_flags() -> Column:
    risky = F.filter(
        F.coalesce("attachments", F.array().cast(
            "array<struct<filename:string,content_type:string,size:bigint,sha256:string>>")),
        lambda a: F.coalesce(is_risky_file(a["filename"]), F.lit(False)))
    return F.transform(risky, lambda a: F.concat(F.lit("RISKY_ATTACHMENT:"), a["filename"]))


@remembered
def display_name_flags() -> Column:
    """One flag per brand word that the display name has and the domain has not."""
    name, domain = F.col("sender_name"), F.col("rule_domain")
    usable = (F.coalesce(name, F.lit("")) != "") & F.contains(F.col("sender_addr"), F.lit("@"))
    text = F.concat(F.lit("DISPLAY_NAME_IMPERSONATION:"), name, F.lit("->"), domain)
    words = constant([b.split()[0] for b in fv.IMPERSONATION_BRANDS])
    claimed = F.filter(
        words, lambda x: F.contains(F.lower(name), x) & ~F.contains(domain, x))
    return F.when(usable, F.transform(claimed, lambda x: text)).otherwise(_no_flags())


def with_flags(messages: DataFrame) -> DataFrame:
    """``flags array<string>`` in the fixed order.  Needs sender, lookalikes, urls, verdicts."""
    return messages.withColumn("_body", body_text()).withColumn(
        "flags",
        F.concat(
            auth_flags(), dense(reply_to_flag(), return_path_flag()), lookalike_flags(),
            dense(urgency_flag()), url_flags(), attachment_flags(), display_name_flags(),
            dense(bec_flag()),
        )).drop("_body")


def base_type(flag: Column) -> Column:
    return F.substring_index(flag, ":", 1)


def with_rule_score(messages: DataFrame) -> DataFrame:
    weights = constant(fv.FLAG_WEIGHTS)
    total = F.aggregate(
        F.transform("flags", lambda f: F.coalesce(
            F.try_element_at(weights, base_type(f)), F.lit(fv.DEFAULT_FLAG_WEIGHT))),
        F.lit(0), lambda acc, w: acc + w)
    return messages.withColumn("rule_score", F.least(total, F.lit(100)))


def flag_table(messages_with_flags: DataFrame, key: str = "email_id") -> DataFrame:
    """Long form: one row per flag with its type, detail, weight and category."""
    f = unnest(messages_with_flags, "flags", key, position="seq", item="flag")
    base = base_type(F.col("flag"))
    return f.select(
        key, "seq", "flag", base.alias("base_type"),
        F.when(F.contains(F.col("flag"), F.lit(":")),
               F.substring(F.col("flag"), F.instr("flag", ":") + 1, F.length("flag")))
        .alias("detail"),
        F.coalesce(F.try_element_at(constant(fv.FLAG_WEIGHTS), base),
                   F.lit(fv.DEFAULT_FLAG_WEIGHT)).alias("weight"),
        F.coalesce(F.try_element_at(constant(fv.FLAG_CATEGORIES), base), F.lit("other"))
        .alias("category"),
    )


def with_fraud_score(messages: DataFrame, probability: str = "ml_prob") -> DataFrame:
    """Fraud score, category, confidence and its label.  Needs flags and rule_score."""
    p = F.col(probability)
    categories = constant(fv.FLAG_CATEGORIES)
    hit = F.size(F.array_distinct(F.transform(
        "flags", lambda f: F.coalesce(
            F.try_element_at(categories, base_type(f)), F.lit("other")))))
    score = F.col("fraud_score")
    distance = F.least(F.abs(score - 40), F.abs(score - 75))
    raw = (0.5 * (hit / float(fv.FLAG_CATEGORY_COUNT))
           + 0.3 * F.least(distance / 37.5, F.lit(1.0))
           + 0.2 * (F.abs(p - 0.5) * 2))
    c = F.col("detection_confidence")
    return (
        messages
        .withColumn(
            "fraud_score", round_half_even_int(0.7 * F.col("rule_score") + 0.3 * (p * 100)))
        .withColumns({
            "fraud_category": F.when(score >= 75, "phishing").when(score >= 40, "suspicious")
            .otherwise("legitimate"),
            "detection_confidence": round_exact(F.least(raw, F.lit(1.0)), 2),
        })
        .withColumn(
            "confidence_label",
            F.when(c >= 0.75, "Very High").when(c >= 0.55, "High").when(c >= 0.35, "Moderate")
            .when(c >= 0.15, "Low").otherwise("Very Low"))
    )


def with_detection(messages: DataFrame, probability: str = "ml_prob") -> DataFrame:
    """All rule checks and the fraud score.  Needs the first verdicts, urls and a probability."""
    flagged = with_flags(with_lookalikes(with_sender(messages)))
    return with_fraud_score(with_rule_score(flagged), probability)

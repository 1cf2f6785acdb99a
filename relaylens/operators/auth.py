"""Authentication verdicts and identity alignment.  Row-local: no shuffle, one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions.hosts import address_of, domain_after_first_at, only_address
from relaylens.functions.text import dense, first_group, null_if_empty, squeeze


def with_first_verdicts(messages: DataFrame) -> DataFrame:
    """Rule view: first ``mechanism=word`` over all Authentication-Results, ``none`` if absent."""
    joined = F.coalesce(F.array_join("auth_headers", " | "), F.lit(""))

    def verdict(mechanism: str) -> Column:
        found = first_group(F.col("auth_raw"), rf"(?i){mechanism}=(\w+)")
        return F.coalesce(F.lower(found), F.lit("none"))

    return messages.withColumn("auth_raw", joined).withColumns({
        "auth_spf": verdict("spf"), "auth_dkim": verdict("dkim"), "auth_dmarc": verdict("dmarc"),
    })


def with_trace_verdicts(messages: DataFrame) -> DataFrame:
    """Trace view: whitelisted verdicts and details, with Received-SPF filling the gaps."""
    text = F.coalesce(
        F.array_join(F.transform("auth_headers", squeeze), " ; "), F.lit("")
    )

    def found(pattern: str, column: str = "_auth_text") -> Column:
        return F.lower(first_group(F.col(column), "(?i)" + pattern))

    def verdict(column: str) -> Column:
        return F.when(F.col(column).isin(fv.AUTH_RESULTS), F.col(column)).otherwise("unknown")

    first_word = F.lower(F.substring_index(F.trim("_spf_text"), " ", 1))
    return (
        messages
        .withColumns({"_auth_text": text, "_spf_text": squeeze(F.col("received_spf"))})
        .withColumns({
            "_spf": found(fv.SPF_RESULT),
            "_dkim": found(fv.DKIM_RESULT),
            "_dmarc": found(fv.DMARC_RESULT),
            "_spf_word": F.when(first_word.isin(fv.AUTH_RESULTS), first_word),
        })
        .withColumns({
            "spf_result": F.when(F.col("_spf").isin(fv.AUTH_RESULTS), F.col("_spf"))
            .otherwise(F.coalesce("_spf_word", F.lit("unknown"))),
            "spf_domain": F.coalesce(
                found(fv.SPF_MAIL_DOMAIN),
                found(fv.SPF_ENVELOPE_DOMAIN, "_spf_text"),
            ),
            "spf_client_ip": F.coalesce(
                found(fv.SPF_SENDER_IP),
                found(fv.SPF_CLIENT_IP, "_spf_text"),
            ),
            "dkim_result": verdict("_dkim"),
            "dkim_domain": found(fv.DKIM_DOMAIN),
            "dmarc_result": verdict("_dmarc"),
            "dmarc_policy": found(fv.DMARC_POLICY),
        })
        .drop("_auth_text", "_spf_text", "_spf", "_dkim", "_dmarc", "_spf_word")
    )


def with_auth_summary(messages: DataFrame) -> DataFrame:
    """One summary word and the verdict texts, from the trace verdicts."""
    spf, dkim, dmarc = (F.col(f"{m}_result") for m in ("spf", "dkim", "dmarc"))

    def each(value: str) -> Column:
        return (spf == value) & (dkim == value) & (dmarc == value)

    failed = spf.isin("fail", "permerror", "softfail") | dkim.isin("fail", "permerror") \
        | dmarc.isin("fail", "permerror")
    summary = (
        F.when(failed, "failed").when(each("unknown"), "unknown")
        .when(each("pass"), "authenticated").otherwise("partially_authenticated")
    )
    texts = F.when(
        F.col("auth_summary") == "failed",
        dense(
            F.when(
                spf.isin("fail", "softfail"),
                F.format_string(
                    fv.AUTH_SPF_FLAG, F.upper(spf), F.coalesce("spf_domain", F.lit("domain"))
                ),
            ),
            F.when(dkim == "fail", F.lit(fv.AUTH_DKIM_FLAG)),
            F.when(
                dmarc == "fail",
                F.format_string(fv.AUTH_DMARC_FLAG, F.coalesce("dmarc_policy", F.lit("none"))),
            ),
        ),
    ).when(
        F.col("auth_summary") == "unknown", F.array(F.lit(fv.AUTH_NONE_FLAG))
    ).otherwise(F.array().cast("array<string>"))
    return messages.withColumn("auth_summary", summary).withColumn("auth_texts", texts)


def with_alignment(messages: DataFrame) -> DataFrame:
    """Identity domains, and a text for each one that is not the From domain or its relative."""

    def unrelated(a: Column, b: Column) -> Column:
        dot = F.lit(".")
        return ~((a == b) | F.endswith(a, F.concat(dot, b)) | F.endswith(b, F.concat(dot, a)))

    f, rp, rt = (F.col(c) for c in ("from_domain", "return_path_domain", "reply_to_domain"))
    return messages.withColumns({
        "from_domain": domain_after_first_at(only_address("from_addr")["addr"]),
        "return_path_domain": domain_after_first_at(address_of(F.col("return_path_raw"))),
        "reply_to_domain": domain_after_first_at(only_address("reply_to")["addr"]),
        "sender_domain": domain_after_first_at(address_of(F.col("sender_raw"))),
    }).withColumn(
        "alignment_texts",
        dense(
            F.when(
                unrelated(null_if_empty(f), null_if_empty(rp)),
                F.format_string(fv.ALIGN_RETURN_PATH_FLAG, f, rp),
            ),
            F.when(
                unrelated(null_if_empty(f), null_if_empty(rt)),
                F.format_string(fv.ALIGN_REPLY_TO_FLAG, rt, f),
            ),
        ),
    )


def with_authentication(messages: DataFrame) -> DataFrame:
    """Everything above; ``auth_flags`` holds the verdict texts, then the alignment texts."""
    staged = with_trace_verdicts(with_first_verdicts(messages))
    staged = with_alignment(with_auth_summary(staged))
    return staged.withColumn("auth_flags", F.concat("auth_texts", "alignment_texts"))

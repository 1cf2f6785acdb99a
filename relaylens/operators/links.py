"""URLs and attachments of a message, row-local, with long forms for table work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.functions.hosts import URL_PATTERN, registered_domain, url_host
from relaylens.functions.remember import remembered
from relaylens.functions.text import all_groups, null_if_empty, unnest

ANCHOR_PATTERN = r'(?is)<a\s[^>]*?href="(https?://[^"]+)"[^>]*>(.*?)</a>'


def text_urls(body: Column) -> Column:
    return all_groups(F.coalesce(body, F.lit("")), URL_PATTERN, 0)


def html_anchors(html: Column) -> Column:
    """Anchors by pattern, for HTML that did not come through the message parser."""
    whole = all_groups(F.coalesce(html, F.lit("")), ANCHOR_PATTERN, 0)
    return F.transform(whole, lambda a: F.struct(
        F.regexp_extract(a, ANCHOR_PATTERN, 1).alias("url"),
        null_if_empty(F.trim(F.regexp_replace(
            F.regexp_extract(a, ANCHOR_PATTERN, 2), r"<[^>]*>", ""))).alias("anchor_text"),
    ))


@remembered
def _url_columns() -> list[dict[str, Column]]:
    plain = F.transform(
        text_urls(F.col("body_plain")),
        lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("anchor_text")))
    every = F.concat(plain, F.coalesce(
        "anchors", F.array().cast("array<struct<url:string,anchor_text:string>>")))
    ordered = F.sort_array(F.transform("_links", lambda x, i: F.struct(
        x["url"].alias("url"), i.alias("seq"), x["anchor_text"].alias("anchor_text"))))
    heads = F.filter("_sorted", lambda x, i: (i == 0) | (
        x["url"] != F.try_element_at(F.col("_sorted"), F.greatest(i, F.lit(1)))["url"]))
    tails = F.filter("_sorted", lambda x, i: ~F.coalesce(
        x["url"] == F.try_element_at(F.col("_sorted"), i + 2)["url"], F.lit(False)))
    merged = F.sort_array(F.zip_with(heads, tails, lambda a, b: F.struct(
        a["seq"].alias("seq"), a["url"].alias("url"), b["anchor_text"].alias("anchor_text"))))
    hosted = F.transform(merged, lambda u: F.struct(
        u["seq"].alias("seq"), u["url"].alias("url"), u["anchor_text"].alias("anchor_text"),
        F.coalesce(url_host(u["url"]), F.lit("")).alias("host")))
    return [{"_links": every}, {"_sorted": ordered}, {"_hosted": hosted}]


def _with_domain(suffixes: list[str] | None) -> Column:
    return F.transform("_hosted", lambda u: F.struct(
        u["seq"].alias("seq"), u["url"].alias("url"), u["anchor_text"].alias("anchor_text"),
        u["host"].alias("host"), registered_domain(u["host"], suffixes).alias("domain")))


@remembered
def _with_known_domain() -> Column:
    return _with_domain(None)


def with_urls(messages: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """``urls array<struct<seq, url, anchor_text, host, domain>>`` keyed by URL.

    The first position of a URL and its last anchor text count.  Sorting by (url, position) puts
    all copies of a URL side by side, so keeping group heads and tails is linear after the sort
    instead of comparing every pair of links of a message.
    """
    for columns in _url_columns():
        messages = messages.withColumns(columns)
    return messages.withColumn(
        "urls", _with_domain(suffixes) if suffixes else _with_known_domain()
    ).drop("_links", "_sorted", "_hosted")


def url_table(messages_with_urls: DataFrame, key: str = "email_id") -> DataFrame:
    u = unnest(messages_with_urls, "urls", key, position="seq", item="u")
    return u.select(key, "seq", "u.url", "u.domain", "u.anchor_text", "u.host")


def attachment_table(messages: DataFrame, key: str = "email_id") -> DataFrame:
    a = unnest(messages, "attachments", key, position="seq", item="a")
    return a.select(key, "seq", "a.filename", "a.content_type", "a.size", "a.sha256")

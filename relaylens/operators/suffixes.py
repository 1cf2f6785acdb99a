"""Registered domains by a suffix list that is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _last(host: str, labels: Column) -> Column:
    return F.call_function("substring_index", F.col(host), F.lit("."), -labels)


def registered_domains(hosts: DataFrame, suffixes: DataFrame, host: str = "host",
                       rule: str = "rule") -> DataFrame:
    """``host`` and ``domain`` of each different host.

    ``suffixes`` holds one rule a row: ``co.uk``, a wildcard (``*.ck``: any one label before the name) or an
    exception (``!www.ck``), which wins over all others; else the longest suffix wins, and without
    one it is the last label.  The domain has one label more than the suffix; a host that is itself a
    suffix, and an address, stay as they are.

    A host is written as its endings, one row per label, which meet the rules by equal keys; so the
    list can have any length, and neither list nor hosts become literals of the plan.  Hosts are made
    distinct first.  The endings that most hosts share (``com``) leave it to Spark to broadcast the
    list by its size, or to split the skewed side of the join.
    """
    names = hosts.select(F.btrim(F.lower(host), F.lit(".")).alias("host")).where(
        F.col("host") != "").distinct()
    parts = F.split("host", r"\.")
    address = F.col("host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.contains("host", F.lit(":"))
    endings = names.where(~address).select("host", F.size(parts).alias("labels"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(n.alias("n"), _last("host", n).alias("ending")))).alias("e"))
    text = F.lower(F.col(rule))
    rules = suffixes.select(
        F.regexp_replace(text, r"^(\*\.|!)", "").alias("name"),
        F.when(text.startswith("!"), -1).when(text.startswith("*."), 1).otherwise(0).alias("more")).distinct()
    found = endings.join(rules, F.col("e.ending") == F.col("name")).where(
        F.col("e.n") + F.col("more") <= F.col("labels")).groupBy("host").agg(F.max(F.struct(
            (F.col("more") == -1).alias("exception"), (F.col("e.n") + F.col("more")).alias("n"))).alias("best"))
    known = names.join(found.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    depth = F.coalesce(F.col("best.n"), F.lit(1)) + 1
    return known.select("host", F.when(address, F.col("host")).otherwise(
        _last("host", depth)).alias("domain"))

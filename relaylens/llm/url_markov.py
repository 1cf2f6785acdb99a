"""URL filter: rules, and for other URLs the ratio of two character language models.

DataFrame operations only.  The URLs that a rule allows train one model and those that a rule blocks
the other.  A model is a variable-order Markov model over the characters of host and path: each
character is predicted from up to ``ORDER`` characters before it, with Witten-Bell smoothing, and a
context that was never seen falls back to the next shorter one.  A URL's score is the difference of
the two log-likelihoods per character.  The threshold is calibrated on the labelled URLs of every
fifth hash value, which train nothing: it lies half way between the ``TAIL`` quantile of the accepted
and the 1 - ``TAIL`` quantile of the rejected scores.

* Equal (host, path) are folded first, so a common URL costs one row.
* A model is never collected: runs of ORDER + 1 characters are counted (map-side combined), each
  distinct run gets its log-ratio once, and URLs are joined to these and summed.
* Rules are a list in the plan, meant for some hundreds at most.

Defined cases: a null URL or one without ``://`` has an empty host and path and is judged by the
method like any other; without labelled URLs on both sides the score is 0 and the verdict allow; two
fitting rules of equal length cannot differ; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.llm.common import written

ALLOW, BLOCK = "allow", "block"
ORDER = 4
ALPHABET = 256
TAIL = 0.05
#: So many different characters may be broadcast; with more of them the joins are shuffled.
LETTERS = 1 << 16
FOLDS = 5
Rule = tuple[str, str, str]  # verdict, host, path


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both empty without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(F.col(f"`{url}`"), pattern, 1)
    upper = "".join(map(chr, range(65, 91)))
    return pages.withColumns({
        "host": F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")),
        "path": F.coalesce(F.regexp_extract(F.col(f"`{url}`"), pattern, 2), F.lit(""))})


def with_rule(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` (its host and path) and ``by_rule`` (its verdict), both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return urls.withColumns({"rule": rule, "by_rule": verdict})


def _runs(urls: DataFrame) -> DataFrame:
    """One row per character of a URL (and its end): the run of ORDER + 1 characters up to it."""
    padded = F.concat(F.lit("\x02" * ORDER), "address", F.lit("\x03"))
    return urls.withColumn("padded", padded).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.length("padded") - ORDER))).withColumn(
        "run", F.expr(f"substring(padded, at, {ORDER + 1})")).drop("padded", "at")


def _log_ratios(counts: DataFrame) -> DataFrame:
    """``run``, ``ratio``: log P(last | before) of the accepted model minus that of the rejected one."""
    orders = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ORDER)))).withColumn(
        "gram", F.expr(f"right(run, k + 1)"))
    grams = orders.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    contexts = grams.withColumn("context", F.expr("left(gram, length(gram) - 1)")).groupBy("context").agg(
        F.sum("good").alias("good_all"), F.count_if(F.col("good") > 0).alias("good_kinds"),
        F.sum("bad").alias("bad_all"), F.count_if(F.col("bad") > 0).alias("bad_kinds"))
    # The shortest contexts and runs are few and stand in every URL: one row per character at most.
    short = written(contexts.where(F.length("context") <= 1), "short_contexts")
    letters = written(grams.where(F.length("gram") == 1), "letters")
    few = short.count() <= LETTERS and letters.count() <= LETTERS
    sent = F.broadcast if few else (lambda df: df)
    asked = orders.select("run", "k", "gram", F.expr("left(gram, k)").alias("context"))
    known = asked.where("k = 0").join(sent(letters), "gram").join(sent(short), "context").unionByName(
        asked.where("k = 1").join(grams, "gram").join(sent(short), "context")).unionByName(
        asked.where("k > 1").join(grams, "gram").join(contexts, "context"))
    steps = known.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(
        "k", "good", "good_all", "good_kinds", "bad", "bad_all", "bad_kinds"))).alias("steps"))

    def probability(side: str) -> Column:
        def step(p: Column, s: Column) -> Column:
            total, kinds = s[f"{side}_all"], s[f"{side}_kinds"]
            return F.when(total == 0, p).otherwise((s[side] + kinds * p) / (total + kinds))

        return F.aggregate("steps", F.lit(1.0 / ALPHABET), step)

    return steps.select("run", (F.ln(probability("good")) - F.ln(probability("bad"))).alias("ratio"))


def scores(urls: DataFrame) -> DataFrame:
    """``host``, ``path``, ``by_rule``, ``held`` and ``score`` of each distinct URL of ``urls``."""
    held = F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)) == 0
    distinct = urls.groupBy("host", "path").agg(F.min("by_rule").alias("by_rule")).withColumns({
        "address": F.concat("host", "path"), "held": held})
    runs = _runs(distinct)

    def trained(verdict: str) -> Column:
        return F.count_if((F.col("by_rule") == verdict) & ~F.col("held"))

    counts = written(runs.groupBy("run").agg(
        trained(ALLOW).alias("good"), trained(BLOCK).alias("bad")), "runs")
    seen = counts.agg(F.sum("good"), F.sum("bad")).first()
    if not all(seen):
        return distinct.withColumn("score", F.lit(0.0)).drop("address")
    ratios = _log_ratios(counts).withColumnRenamed("run", "_run")
    return runs.join(ratios, F.col("run") == F.col("_run")).groupBy("host", "path").agg(
        F.first("by_rule").alias("by_rule"), F.first("held").alias("held"),
        F.avg("ratio").alias("score"))


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` for each row."""
    ruled = with_rule(with_parts(pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))), rules)
    scored = written(scores(ruled), "scores")
    tails = scored.where("held").groupBy("by_rule").agg(
        F.percentile_approx("score", F.lit(TAIL)).alias("low"),
        F.percentile_approx("score", F.lit(1 - TAIL)).alias("high"))
    tail = {r["by_rule"]: r for r in tails.collect()}  # three rows at most
    threshold = 0.0
    if ALLOW in tail and BLOCK in tail:
        threshold = (tail[ALLOW]["low"] + tail[BLOCK]["high"]) / 2
    found = scored.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "score")
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK))
    return ruled.join(found, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left") \
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

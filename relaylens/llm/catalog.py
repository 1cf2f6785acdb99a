"""One registered query per corpus operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.llm import (
    basic_factors, boosted_quality, cross_parsing, hyperplane_dedup, merge_dropout, oracle,
    order_minhash, packing, quartile_digest, signature_search, snapshot_collapse, splitter_sharding,
    superkmer_dedup, url_markov,
)
from relaylens.llm.common import table
from relaylens.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir.rstrip("/"))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@entry("op1_cost_balanced_packing")
def op1(spark, sf):
    import public_tokenizers

    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: Verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@entry("op2_url_markov_ratio")
def op2(spark, sf):
    return url_markov.judge(table(spark, sf, "pages"), URL_RULES)


@entry("op3_order_minhash", oracle.NEAR_DUPLICATES)
def op3(spark, sf):
    return order_minhash.dedup(table(spark, sf, "documents")).withColumn(
        "kept", F.col("doc_id") == F.col("class_id"))


@entry("op4_quartile_digest")
def op4(spark, sf):
    return quartile_digest.with_edited(table(spark, sf, "documents"))


@entry("op5_hyperplane_dedup", oracle.EMBEDDINGS)
def op5(spark, sf):
    return hyperplane_dedup.dedup(table(spark, sf, "embeddings"))


@entry("op6_splitter_sharding")
def op6(spark, sf):
    return splitter_sharding.shard(table(spark, sf, "documents"))


@entry("op7_snapshot_collapse", snapshot_collapse.ORACLE)
def op7(spark, sf):
    return snapshot_collapse.collapse(table(spark, sf, "conversations"))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@entry("op8_cross_parsing_language")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    training = cross_parsing.training_texts(docs.where(~held_out()))
    return cross_parsing.identify(docs, training).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


@entry("op9_super_kmer_dedup", oracle.PASSAGES)
def op9(spark, sf):
    return superkmer_dedup.remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@entry("op10_merge_dropout")
def op10(spark, sf):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = merge_dropout.encode(table(spark, sf, "documents"), model).withColumn(
        "n_ids", F.size("ids").cast("long"))
    kept = ("doc_id", "variant", "n_ids", "ids_crc32", "text_sha256")
    return merge_dropout.decode(encoded, model, kept).select(
        *kept, F.sha2("text", 256).alias("decoded_sha256"))


@entry("op11_bloom_signatures", oracle.RANKED)
def op11(spark, sf):
    return signature_search.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the hash of its id, repeats a piece of its own from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    n = F.size("_words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
    rewritten = F.array_join(F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_words", place(i).cast("int"))), " ")
    chosen = h % 10 == 0
    return docs.select("doc_id", "text").withColumn("_words", F.when(chosen, F.regexp_extract_all(
        "text", F.lit(r"[^\x20\x09-\x0D]+"), 0))).select(
        "doc_id", F.when(chosen & (n > 0), rewritten).otherwise(F.col("text")).alias("text"))


@entry("op12_basic_factor_runs", oracle.PERIODIC)
def op12(spark, sf):
    found = basic_factors.periodic_runs(with_periods(table(spark, sf, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def unseen():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@entry("op13_boosted_quality")
def op13(spark, sf):
    docs = table(spark, sf, "documents")
    trees = boosted_quality.train(docs, table(spark, sf, "labels"), ~unseen())
    return boosted_quality.score(docs, trees).select(
        "doc_id", unseen().alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

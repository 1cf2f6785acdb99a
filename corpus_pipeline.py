"""The corpus pipeline: language identification, near-duplicate removal, removal of repeated
passages, and packing.  Each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylens.llm import catalog, cross_parsing, order_minhash, packing, superkmer_dedup
from relaylens.llm.common import written
from relaylens.session import configure, remove_staged, staged_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told; ``lang`` becomes the operator's decision, also
    where a label was given.

    A null, empty or letterless text goes.  Rows of one id, repeated rows and rows without an id are
    judged each by its own text.  Columns other than those of documents are dropped.
    """
    docs = docs.select(*COLUMNS)
    training = cross_parsing.training_texts(docs.where(~catalog.held_out()))
    return cross_parsing.with_language(docs, training).where(
        F.col("lang_pred") != cross_parsing.UNDECIDED).withColumn(
        "lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: the one with the smallest id.

    Of repeated rows one stays; rows of one id with different texts are documents of their own; a text
    without words is alike to no other; rows without an id stay.
    """
    docs = docs.select(*COLUMNS)
    found = written(order_minhash.dedup(docs), "classes")
    own = F.when(F.col("class_key").isNull(), F.col("doc_id"))
    stays = found.where(F.col("doc_id").isNotNull()).groupBy("class_key", own).agg(
        F.min(F.struct("doc_id", "text_key")).alias("first")).select(
        F.col("first.doc_id").alias("_stays"), F.col("first.text_key").alias("_key"))
    repeated = found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    single = stays.join(repeated, F.col("_stays") == F.col("_id"), "left_anti")
    several = stays.join(repeated, F.col("_stays") == F.col("_id"), "left_semi")
    # Only the rows of ids that come more than once are told apart by their texts.
    named = order_minhash.with_text_key(docs.join(repeated, F.col("doc_id") == F.col("_id"), "left_semi"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_text_key").orderBy("text", "source", "n_chars"))
    told = named.join(several, (F.col("doc_id") == F.col("_stays")) & F.col("_text_key").eqNullSafe(
        F.col("_key")), "left_semi").withColumn("_nth", nth).where(F.col("_nth") == 1)
    return docs.join(single, F.col("doc_id") == F.col("_stays"), "left_semi").unionByName(
        told.select(*COLUMNS)).unionByName(docs.where(F.col("doc_id").isNull()))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand in an earlier document too; documents that lose all words go.

    A text that loses nothing, a null and an empty one among them, stays as it is; of equal ids and of
    rows without an id none is earlier.
    """
    cut = superkmer_dedup.remove_repeats(docs, keep=("lang", "source", "n_chars"), join_untouched=False)
    changed = F.col("n_removed") > 0
    return cut.where(~changed | (F.col("n_removed") < F.col("n_words"))).select(
        "doc_id", F.col("kept_text").alias("text"), "kept.lang", "kept.source",
        F.when(changed, F.length("kept_text")).otherwise(F.col("kept.n_chars")).cast("long")
        .alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences; a null or empty text is its end token alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("packing", pack)]

# Neither a suffix automaton nor a tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = staged_tables()
        docs = written(stage(spark, docs, sf_dir), name)
        remove_staged(spark, before, keep=1)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)

"""Phishing probability from subject and body with a Spark ML pipeline."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 16  # four hex digits of a word's hash


def model_text() -> Column:
    return F.concat(
        F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body_plain", F.lit("")))


def train(labelled: DataFrame, label: str = "label", features: int = 1 << 16,
          iterations: int = 10) -> PipelineModel:
    """Fit on subject, body_plain and a 0/1 label.  Nothing but the weights reaches the driver."""
    stages = [
        RegexTokenizer(inputCol="_model_text", outputCol="_tokens", pattern=r"\W+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=iterations,
                           rawPredictionCol="_raw", probabilityCol="_probability",
                           predictionCol="_prediction"),
    ]
    return Pipeline(stages=stages).fit(labelled.withColumn("_model_text", model_text()))


def with_probability(messages: DataFrame, model: PipelineModel,
                     column: str = "ml_prob") -> DataFrame:
    """Add the probability of the positive class."""
    scored = model.transform(messages.withColumn("_model_text", model_text()))
    return scored.withColumn(column, vector_to_array("_probability")[1]).drop(
        "_model_text", "_tokens", "_counts", "_features", "_raw", "_probability", "_prediction")


def word_slots(text: Column) -> Column:
    """The distinct slots of the words of a text, 0 to SLOTS - 1."""
    return F.array_distinct(F.transform(
        F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0),
        lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int")))


def train_table(messages: DataFrame, labels: DataFrame, label: str = "label",
                key: str = "email_id") -> DataFrame:
    """A linear model as a table: ``slot``, ``idf`` and ``weight``, and a row of slot -1 with the bias.

    The weight is the smoothed log odds of a word's slot in the messages of the two classes.  Texts become
    slots before they meet the labels, so no text is shuffled; counts combine on the map side.
    """
    slots = messages.select(F.col(key), word_slots(model_text()).alias("slots"))
    known = slots.join(labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")),
                       F.col(key) == F.col("_key")).select("label", "slots")
    sides = [F.sum(F.when(F.col("label") == c, 1).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    totals = known.agg(*sides)
    counts = known.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(*sides)
    all_ = totals.select(F.col("n0").alias("all0"), F.col("n1").alias("all1"))  # one row

    def odds(one: str, zero: str) -> Column:
        return F.log(F.col(one) + 0.5) - F.log(F.col(zero) + 0.5)

    weights = counts.join(F.broadcast(all_)).select(
        "slot", F.log((F.col("all0") + F.col("all1") + 1.0) / (F.col("n0") + F.col("n1") + 1.0)).alias("idf"),
        (odds("n1", "n0") - (F.log(F.col("all1") + 1.0) - F.log(F.col("all0") + 1.0))).alias("weight"))
    bias = totals.select(F.lit(-1).alias("slot"), F.lit(1.0).alias("idf"), odds("n1", "n0").alias("weight"))
    return weights.unionByName(bias)


def table_probability(messages: DataFrame, table: DataFrame, key: str = "email_id",
                      column: str = "ml_prob") -> DataFrame:
    """``key`` and the probability: a sparse dot product of slots and weights, as a join and a sum.

    The table has at most SLOTS + 1 rows by construction, so it is broadcast.  Slots of a message
    are distinct and bounded by its own words; sums combine before the shuffle.
    """
    slots = messages.select(key, F.explode(F.array_append(word_slots(model_text()), F.lit(-1))).alias("_slot"))
    joined = slots.join(F.broadcast(table), F.col("_slot") == F.col("slot"))
    margin = joined.groupBy(key).agg(F.sum(F.col("idf") * F.col("weight")).alias("margin"))
    return margin.select(key, (1 / (1 + F.exp(-F.col("margin")))).alias(column))

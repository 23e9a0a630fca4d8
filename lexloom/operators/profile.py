"""Profiles of generated documents by model and word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import word_count
from lexloom.storage import staged


def counted(documents: DataFrame, model: str, word: str) -> DataFrame:
    """(model, word, words): the words of each document."""
    return documents.select(F.col(model).alias("model"), F.col(word).alias("word"), word_count(F.col("text")).alias("words"))


def by_model_and_word(rows: DataFrame) -> DataFrame:
    """(model, word, docs, words, avg_words) of documents that aren't empty."""
    return rows.filter(F.col("words") > 0).groupBy("model", "word").agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.avg("words").alias("avg_words"))


def by_word(groups: DataFrame) -> DataFrame:
    """(word, docs, avg_words, mean_of_avgs, sd_of_avgs, top_model, low_model): weighted and plain averages over models; ties by name."""
    return groups.groupBy("word").agg(
        F.sum("docs").alias("docs"), (F.sum("words") / F.sum("docs")).alias("avg_words"), F.avg("avg_words").alias("mean_of_avgs"), F.stddev_samp("avg_words").alias("sd_of_avgs"),
        F.max_by("model", F.struct("avg_words", "model")).alias("top_model"), F.min_by("model", F.struct("avg_words", "model")).alias("low_model"),
    )


def by_model(rows: DataFrame) -> DataFrame:
    """(model, docs, mean, median, most, least, words) over all documents, the empty ones too."""
    return rows.groupBy("model").agg(F.count("*").alias("docs"), F.avg("words").alias("mean_words"), F.median("words").alias("median_words"), F.max("words").alias("most_words"), F.min("words").alias("least_words"), F.sum("words").alias("words"))


#: Columns of a pivot at most.
MAX_MODELS = 1_000


def pivoted(rows: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Documents per word, a column for each model, by default of all that occur; 0 where there are none, an error above MAX_MODELS."""
    groups = rows.groupBy("word", "model").agg(F.count("*").alias("n"))
    if models is None:
        groups = staged(groups, "pivot")
        found = groups.select("model").filter(F.col("model").isNotNull()).distinct().limit(MAX_MODELS + 1).collect()
        if len(found) > MAX_MODELS:
            raise ValueError(f"more than {MAX_MODELS} models")
        models = sorted(r.model for r in found)
    return groups.groupBy("word").pivot("model", models).agg(F.sum("n")).fillna(0) if models else groups.select("word").distinct()


def totals(rows: DataFrame, most: int = 30) -> DataFrame:
    """(word, docs, models): the ``most`` words with most documents; ties by word, a missing word last."""
    by = rows.groupBy("word").agg(F.count("*").alias("docs"), F.countDistinct("model").alias("models"))
    return by.orderBy(F.desc("docs"), F.asc_nulls_last("word")).limit(most)

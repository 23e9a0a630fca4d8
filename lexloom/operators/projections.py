"""Projections of differently shaped toxicity sources to (text, hint, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(column: Column) -> Column:
    value = column.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def _largest(columns: list[str]) -> Column:
    values = [_number(F.col(c)) for c in columns]
    return values[0] if len(values) == 1 else F.greatest(*values)


def comment_style(df: DataFrame, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``text`` or else ``comment_text``, and ``toxicity``; rows without a number are dropped."""
    rows = df.select(*keep, F.coalesce(F.nullif("text", F.lit("")), "comment_text").alias("text"), _number(F.col("toxicity")).alias("hint"), F.lit(source).alias("source"))
    return rows.filter(F.col("hint").isNotNull())


def prompt_style(df: DataFrame, source: str, continuation: list[str], prompt: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The continuation's text and greatest attribute; the prompt's where they are empty or the attribute is 0 or missing."""
    text = F.coalesce(F.nullif("continuation_text", F.lit("")), "prompt_text")
    hint = F.coalesce(F.nullif(_largest(continuation), F.lit(0.0)), _largest(prompt))
    return df.select(*keep, text.alias("text"), hint.alias("hint"), F.lit(source).alias("source")).filter(F.col("hint").isNotNull())


def label_style(df: DataFrame, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """1 for labels with ``hate``, 0.8 for those with ``offen``; others are dropped."""
    label = F.lower(F.trim("label"))
    hint = F.when(label.contains("hate"), 1.0).when(label.contains("offen"), 0.8)
    return df.select(*keep, "text", hint.alias("hint"), F.lit(source).alias("source")).filter(F.col("hint").isNotNull())


def multi_label_style(df: DataFrame, source: str, labels: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The greatest of several labels; rows without any number are dropped."""
    rows = df.select(*keep, F.coalesce(F.nullif("comment_text", F.lit("")), "text").alias("text"), _largest(labels).alias("hint"), F.lit(source).alias("source"))
    return rows.filter(F.col("hint").isNotNull())


def binary_style(df: DataFrame, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A 0/1 label as number; rows of 0 or without a number are dropped."""
    return df.select(*keep, "text", _number(F.col("label")).alias("hint"), F.lit(source).alias("source")).filter(F.col("hint") > 0)

"""Screening of candidates with a pluggable classifier; unscored rows stay apart from safe ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.spans import spans_text
from lexloom.functions.text import unsafe_verdict

MOST_SHOWN = 4_096
MOST_CHARS = 20_000
#: Tokens (stretches without white space) of a text that a classifier takes.
MOST_TOKENS = 4096
_TOKEN = r"[ \t\n\r\f\x0B]*[^ \t\n\r\f\x0B]+"

Classifier = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def complete(doc_len: Column, disp_len: Column, most: int = MOST_SHOWN) -> Column:
    """Whether a document was shown whole and isn't too long; missing lengths count as 0."""
    shown = F.coalesce(disp_len, F.lit(0))
    return (F.coalesce(doc_len, F.lit(0)) == shown) & (shown <= most)


def cut_for_model(text: Column, tokens: int = MOST_TOKENS, chars: int = MOST_CHARS) -> Column:
    """At most so many tokens of a text, and of these at most so many characters."""
    found = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.left(F.when(F.size(found) > tokens, F.array_join(F.slice(found, 1, tokens), "")).otherwise(text), F.lit(chars))


def pattern_answer(pattern: str) -> Callable[[Column], Column]:
    """A classifier that finds a text unsafe where a pattern stands in it, in lower case."""
    return lambda text: F.when(F.lower(text).rlike(pattern), "UNSAFE").otherwise("SAFE")


def rendered_prompt(text: Column, system: str, template: str | None = None) -> Column:
    """The prompt of a classifier: a template with ``{system}`` and ``{text}``, or plain lines where it is missing or has no ``{text}``."""
    if template is None or "{text}" not in template:
        template = "{system}\n\nUser: {text}\nAssistant:"
    before, after = template.replace("{system}", system).split("{text}", 1)
    return F.concat(F.lit(before), text, F.lit(after))


def any_above(probabilities: Column, bound: float = 0.5) -> Column:
    """Whether any of several label probabilities reaches the bound."""
    return F.coalesce(F.exists(probabilities, lambda p: p >= bound), F.lit(False))


def model_answer(predict: Classifier) -> Callable[[Column], Column]:
    """A classifier over batches of texts as a Column function; the model loads once per task."""
    return F.pandas_udf(predict, "string")


def multi_label_answer(predict: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], bound: float = 0.5) -> Callable[[Column], Column]:
    """A classifier that gives a list of label probabilities for each text: unsafe if any reaches the bound."""
    probabilities = F.pandas_udf(predict, "array<double>")
    return lambda text: F.when(any_above(probabilities(text), bound), "UNSAFE").otherwise("SAFE")


def screened(candidates: DataFrame, answer: Callable[[Column], Column]) -> DataFrame:
    """(candidate_id, word, text, is_all_doc, is_unsafe): null ``is_unsafe`` where a text is partial, blank or unreadable.

    Texts are cut to the classifier's limits, and stored so.
    """
    rows = candidates.select("candidate_id", F.col("seed").alias("word"), complete(F.col("doc_len"), F.col("disp_len")).alias("is_all_doc"), F.coalesce(cut_for_model(spans_text(F.col("spans_json"))), F.lit("")).alias("text"))
    scored = F.col("is_all_doc") & (F.trim("text") != "")
    return rows.select("candidate_id", "word", "text", "is_all_doc", F.when(scored, unsafe_verdict(answer(F.col("text")))).alias("is_unsafe"))

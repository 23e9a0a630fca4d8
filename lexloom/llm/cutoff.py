"""Cutoff that keeps a target fraction of each group: sketch-bracketed exact selection.

A Greenwald-Khanna sketch per group (``percentile_approx``, rank error at most 1/accuracy) gives a grid of
quantiles; two grid points bracket the wanted rank. The records above the bracket are only counted, the values
inside are counted by value and sorted, and the running count finds the exact cutoff. A bracket that turns out
not to hold the rank (which the counts show) is replaced by the whole range, so the result never rests on the sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.storage import staged

#: Grid points of the sketch and its accuracy; a bracket spans the cell of the wanted rank and one on each side.
GRID = 512
ACCURACY = 10_000
#: Bracketed records of one group that one task may sort; above it, the bracket is sketched again.
MAX_SORTED = 2_000_000
#: Targets up to this many rows are broadcast.
MAX_TARGETS = 10_000


def valid_score(score: Column) -> Column:
    """True for a score that is neither null nor NaN and lies between 0 and 1."""
    return F.coalesce(score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0), F.lit(False))


def scored_records(df: DataFrame, record: str, source: str, score: str) -> DataFrame:
    """Distinct records with a valid score as (source, record_id, score); null record ids and sources are left out.

    A record delivered again counts once; should its copies differ, the one with the greatest score stands.
    """
    rows = df.select(F.lower(F.trim(F.col(source))).alias("source"), F.col(record).alias("record_id"), F.col(score).cast("double").alias("score"))
    rows = rows.filter(valid_score(F.col("score")) & F.col("record_id").isNotNull() & F.col("source").isNotNull())
    best = rows.groupBy("record_id").agg(F.max(F.struct("score", "source")).alias("best"))
    return best.select("best.source", "record_id", (F.col("best.score") + F.lit(0.0)).alias("score"))


def _targets(targets: DataFrame) -> DataFrame:
    """One target per source, clamped to 0..1; null fractions give no target, of several the greatest stands."""
    rows = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_fraction").cast("double").alias("target_fraction"))
    rows = rows.filter(F.col("source").isNotNull() & F.col("target_fraction").isNotNull() & ~F.isnan("target_fraction"))
    return rows.groupBy("source").agg(F.least(F.greatest(F.max("target_fraction"), F.lit(0.0)), F.lit(1.0)).alias("target_fraction"))


def cutoffs(records: DataFrame, targets: DataFrame, max_sorted: int = MAX_SORTED) -> DataFrame:
    """(source, target_fraction, n_valid, cutoff, n_kept) for each source with a target and at least one record.

    ``records`` is (source, record_id, score), read several times, so best a staged table. ``cutoff`` is the greatest
    score at which at least ``target_fraction`` of the records is kept; ties at it are all kept; a fraction of 0 keeps
    the records of the greatest score. Empty inputs give an empty result.
    """
    wanted = _targets(targets)
    few = wanted.limit(MAX_TARGETS + 1).count() <= MAX_TARGETS
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    counts = records.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    share = 3.0 / GRID + 2.0 / ACCURACY
    rounds = 1 if counts * share <= max_sorted else 1 + math.ceil(math.log(counts * share / max_sorted) / -math.log(share))

    scores = records.join(small(wanted), "source").select("source", "score", "target_fraction")
    state = (
        scores.groupBy("source", "target_fraction").agg(F.count("*").alias("n_valid"))
        .select("source", "target_fraction", "n_valid", F.greatest(F.ceil(F.col("target_fraction") * F.col("n_valid")), F.lit(1)).cast("bigint").alias("need"))
        .select("*", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("bigint").alias("above"), F.col("n_valid").alias("inside"))
    )
    state = staged(state, "cutoff-bracket")
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    for _ in range(rounds):
        inner = scores.select("source", "score").join(small(state), "source").filter(F.col("score").between(F.col("lo"), F.col("hi")))
        sketch = inner.groupBy("source").agg(F.percentile_approx("score", grid, ACCURACY).alias("q"))
        cell = F.floor((1.0 - (F.col("need") - F.col("above")) / F.col("inside")) * GRID).cast("int")
        tight = state.join(small(sketch), "source").select(
            *state.columns,
            F.element_at("q", F.greatest(cell, F.lit(1))).alias("new_lo"),
            F.element_at("q", F.least(cell + 3, F.lit(GRID + 1))).alias("new_hi"),
        )
        tight = staged(tight, "cutoff-bracket")
        kept = scores.select("source", "score").join(small(tight.select("source", "new_lo", "new_hi")), "source")
        seen = kept.groupBy("source").agg(
            F.count_if(F.col("score") > F.col("new_hi")).alias("new_above"),
            F.count_if(F.col("score").between(F.col("new_lo"), F.col("new_hi"))).alias("new_inside"),
        )
        holds = (F.col("new_above") < F.col("need")) & (F.col("need") <= F.col("new_above") + F.col("new_inside"))
        pick = lambda new, old: F.when(holds, F.col(new)).otherwise(F.col(old)).alias(old)
        state = tight.join(small(seen), "source").select(
            "source", "target_fraction", "n_valid", "need", pick("new_lo", "lo"), pick("new_hi", "hi"), pick("new_above", "above"), pick("new_inside", "inside")
        )
        state = staged(state, "cutoff-bracket")
    bracketed = scores.select("source", "score").join(small(state), "source").filter(F.col("score").between(F.col("lo"), F.col("hi")))
    by_value = bracketed.groupBy("source", "target_fraction", "n_valid", "need", "above", "score").agg(F.count("*").alias("n"))
    running = F.col("above") + F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("score")))
    reached = by_value.select("source", "target_fraction", "n_valid", "need", "score", running.alias("kept")).filter(F.col("kept") >= F.col("need"))
    at = reached.groupBy("source", "target_fraction", "n_valid").agg(F.max(F.struct("score", "kept")).alias("at"))
    return at.select("source", "target_fraction", "n_valid", F.col("at.score").alias("cutoff"), F.col("at.kept").alias("n_kept"))


def keep_fraction(df: DataFrame, targets: DataFrame, record: str = "record_id", source: str = "source", score: str = "hint") -> tuple[DataFrame, DataFrame]:
    """The kept records (source, record_id) and the report of :func:`cutoffs`."""
    records = staged(scored_records(df, record, source, score), "cutoff-records")
    report = staged(cutoffs(records, targets), "cutoffs")
    kept = records.join(F.broadcast(report.select("source", "cutoff")), "source") if _few(targets) else records.join(report.select("source", "cutoff"), "source")
    return kept.filter(F.col("score") >= F.col("cutoff")).select("source", "record_id"), report


def _few(targets: DataFrame) -> bool:
    """Whether the targets, and so one row per source, stay within the broadcast bound."""
    return targets.limit(MAX_TARGETS + 1).count() <= MAX_TARGETS

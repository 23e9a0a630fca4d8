"""Top-k corpora over sources under proportionally apportioned quotas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import normalized
from lexloom.operators.ranks import numbered
from lexloom.storage import staged

#: Sources up to this many rows of quotas are broadcast.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Gate:
    """Bounds of the quality gate."""

    min_len: int = 5
    max_len: int = 0
    floor: float = 0.5
    floors: dict[str, float] = field(default_factory=dict)
    language: str = "en"
    limit: int = 0


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row per key; rows are sorted after the shuffle only, as few come twice."""
    return rows.repartition(key).dropDuplicates([key])


def deliveries_once(records: DataFrame, key: str = "record_id") -> DataFrame:
    """One row per key with a source name without case and blanks; rows without a key are left out.

    Deliveries of a record are alike but for ``ingested_at``, which is dropped.
    """
    rows = once(records.drop("ingested_at").filter(F.col(key).isNotNull()), key)
    return rows.withColumn("source", F.lower(F.trim("source")))


def _language_of(label: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(label), "[-_]"), 1))


def quality_gate(records: DataFrame, gate: Gate = Gate(), key: str = "record_id", detect: Callable[[Column], Column] | None = None) -> DataFrame:
    """(source, ord, text, hint) of records with a long enough text in ASCII, the language and a hint from the floor on.

    The language is that of the label, or of ``detect``, a function from texts to languages. One that isn't known counts as the wanted one; a null, NaN hint fails, as does a row without key or source. A
    record that is delivered again counts once: deliveries are alike, so the gate comes first and only what passes is
    shuffled. With a limit, the first of each source by key.
    """
    text = normalized(F.col("text"))
    if gate.max_len:
        text = F.left(text, F.lit(gate.max_len))
    lang = _language_of(F.col("lang") if detect is None else detect(text))
    known = F.length(lang) == 2
    source = F.lower(F.trim("source"))
    floor = F.lit(gate.floor)
    for name, value in gate.floors.items():
        floor = F.when(source == name, value).otherwise(floor)
    rows = records.filter(F.col(key).isNotNull() & F.col("source").isNotNull() & F.col("hint").isNotNull() & ~F.isnan("hint") & (F.col("hint") >= floor))
    rows = rows.filter(F.coalesce(~known | (lang == gate.language), F.lit(True)))
    # a one-row generator keeps the filter from being moved below, where it would make the text again
    rows = rows.select(source.alias("source"), F.col(key).alias("ord"), F.explode(F.array(text)).alias("text"), "hint")
    rows = once(rows.filter(F.length("text") >= gate.min_len), "ord")
    if gate.limit:
        rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("ord"))).filter(F.col("rn") <= gate.limit).drop("rn")
    return rows


def counts(rows: DataFrame) -> DataFrame:
    """(source, n), before any dedup."""
    return rows.groupBy("source").agg(F.count("*").alias("n"))


def apportion(by_source: DataFrame, total: int | Column, weight: str = "n", out: str = "cap") -> DataFrame:
    """Largest-remainder shares of ``total``; leftovers go to the largest fractions, ties to the greatest name; all 0 if nothing is there.

    ``by_source`` has one row per source, few enough for one task.
    """
    every = Window.partitionBy(F.lit(1))
    total = F.lit(total) if isinstance(total, int) else total
    rows = by_source.select("*", F.sum(weight).over(every).alias("_all"), total.alias("_total"))
    rows = rows.select("*", F.when(F.col("_all") > 0, F.col(weight) / F.col("_all") * F.col("_total")).otherwise(0.0).alias("_raw"))
    rows = rows.select("*", F.floor("_raw").alias("_base"), (F.col("_raw") - F.floor("_raw")).alias("_frac"))
    left = F.col("_total") - F.sum("_base").over(every)
    rank = F.row_number().over(every.orderBy(F.desc("_frac"), F.desc("source")))
    share = F.when(F.col("_all") > 0, F.col("_base") + (rank <= left).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return rows.select(*by_source.columns, share.alias(out))


def first_of_texts(rows: DataFrame) -> DataFrame:
    """Of equal texts of a source the first row by order; the first of each partition are found before the shuffle."""
    first = Window.partitionBy("source", "text").orderBy("ord")
    return rows.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn")


def ranked_by_source(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` best rows of each source by hint, ties by order, with ``rank``; of equal texts of a source the first stands.

    A source may hold any share of the rows: they are numbered in ranges and not in one task, without their texts, which
    are joined to what is kept.
    """
    rows = staged(first_of_texts(rows), "to-rank")
    numbers = numbered(rows.select("source", "ord", (-F.col("hint")).alias("_worse")), ["source"], ["_worse", "ord"])
    kept = numbers.filter(F.col("rank") < most).select("source", "ord", (F.col("rank") + 1).cast("int").alias("rank"))
    return rows.join(kept, ["source", "ord"])


def topk_corpus(rows: DataFrame, target: int, reserve: float = 1.2) -> DataFrame:
    """(source, ord, text, tox_score, rank, part): each source's best rows up to its quota, then the refill.

    Quotas share ``target`` by the counts of ``rows``; each source keeps a reserve of ``reserve`` times its quota, from
    which a shortfall is refilled in proportion to what is left there. One round of refilling always suffices.
    """
    rows = staged(rows, "gated")
    caps = staged(apportion(counts(rows), target), "caps")
    few = caps.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    small = F.broadcast(caps) if few else caps
    ranked = ranked_by_source(rows, int(target * reserve) + 1).join(small.select("source", "cap"), "source")
    ranked = staged(ranked.filter(F.col("rank") <= F.greatest(F.col("cap"), F.ceil(F.col("cap") * F.lit(reserve)))), "ranked")
    held = ranked.groupBy("source").agg(F.count_if(F.col("rank") <= F.col("cap")).alias("taken"), F.count_if(F.col("rank") > F.col("cap")).alias("extra"))
    short = F.lit(target) - F.sum("taken").over(Window.partitionBy(F.lit(1)))
    wanted = F.least(short, F.sum("extra").over(Window.partitionBy(F.lit(1))))
    held = held.withColumn("_short", F.greatest(wanted, F.lit(0)))
    refill = apportion(held, F.col("_short"), "extra", "more").select("source", "more")
    out = ranked.join(F.broadcast(refill) if few else refill, "source").filter(F.col("rank") <= F.col("cap") + F.col("more"))
    part = F.when(F.col("rank") <= F.col("cap"), "quota").otherwise("refill")
    return out.select("source", "ord", "text", F.col("hint").alias("tox_score"), "rank", part.alias("part"))

"""Phonotactics: syllables by maximal onset, frequency tables, pseudowords, and spelling by a beam over weighted spellings."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.sampling import u01
from lexloom.functions.text import readable, without_stress

# The vowels of the phone set.
VOWELS = ["AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW", "AX", "AXR", "IX", "UX"]
#: Spellings of phones with their costs; vowels outside the phone table go to the nearest listed one.
SPELLINGS: dict[str, list[tuple[str, float]]] = {
    "AA": [("a", 0.4), ("o", 0.9)], "AE": [("a", 0.2)], "AH": [("u", 0.6), ("a", 0.8)], "AO": [("o", 0.5), ("au", 1.0)], "AW": [("ow", 0.5), ("ou", 0.7)], "AY": [("i", 0.5), ("y", 0.9)],
    "EH": [("e", 0.2)], "ER": [("er", 0.3), ("ur", 0.9)], "EY": [("a", 0.7), ("ai", 0.8)], "IH": [("i", 0.2)], "IY": [("ee", 0.6), ("y", 0.8)], "OW": [("o", 0.4), ("oa", 1.0)], "OY": [("oy", 0.4)],
    "UH": [("oo", 0.6), ("u", 0.8)], "UW": [("oo", 0.5), ("u", 0.8)], "AX": [("a", 0.5)], "AXR": [("er", 0.4)], "IX": [("i", 0.4)], "UX": [("u", 0.5)],
    "CH": [("ch", 0.2)], "DH": [("th", 0.2)], "HH": [("h", 0.1)], "JH": [("j", 0.4), ("g", 0.9)], "K": [("k", 0.5), ("c", 0.6)], "NG": [("ng", 0.2)], "SH": [("sh", 0.2)], "TH": [("th", 0.2)],
    "Y": [("y", 0.1)], "ZH": [("zh", 0.5), ("s", 1.1)],
}


#: A phone for each letter, where no dictionary is at hand.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", "AE B K D EH F G HH IH JH K L M N AO P K R S T AH V W S IY Z".split()))


def is_vowel(phone: Column) -> Column:
    """Whether a phone, stress aside, is a vowel."""
    return without_stress(phone).isin(VOWELS)


def with_stress(phones: Column) -> Column:
    """Phones in which each vowel without a stress digit has stress 1."""
    return F.transform(phones, lambda p: F.when(p.isin(VOWELS), F.concat(p, F.lit("1"))).otherwise(p))


def dictionary(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, phones) of lines ``WORD PH PH ...``; comments and lines without phones are skipped, stress is dropped."""
    parts = F.split(F.trim(column), r"\s+")
    rows = lines.filter(~F.col(column).startswith(";;;")).select(F.element_at(parts, 1).alias("word"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), without_stress).alias("phones"))
    return rows.filter(F.size("phones") > 0)


def spelled_out(words: DataFrame) -> DataFrame:
    """(word, phones) of words, in upper case, by a phone for each letter; words without a letter have none and are left out."""
    letters = F.filter(F.split(F.lower("word"), ""), lambda c: c.isin(list(LETTERS)))
    table = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    rows = words.select(F.upper("word").alias("word"), F.transform(letters, lambda c: F.element_at(table, c)).alias("phones")).distinct()
    return rows.filter(F.size("phones") > 0)


def first_dictionary(spark: SparkSession, paths: list[str], words: DataFrame) -> DataFrame:
    """The pronunciations of the first file that holds any, or else of ``words`` by :func:`spelled_out`."""
    for path in paths:
        try:
            found = dictionary(spark.read.text(path))
        except AnalysisException:
            continue
        if found.limit(1).count():
            return found
    return spelled_out(words)


def legal_onsets(words: DataFrame) -> DataFrame:
    """(onset): the distinct consonant clusters before the first vowel, as text; the empty one always."""
    first = F.array_position(F.transform("phones", lambda p: is_vowel(p)), True)
    cluster = F.when(first > 0, F.slice("phones", F.lit(1), first.cast("int") - 1)).otherwise(F.col("phones"))
    return words.select(F.array_join(cluster, " ").alias("onset")).union(words.sparkSession.createDataFrame([("",)], "onset string")).distinct()


def syllables(words: DataFrame, onsets: list[str]) -> DataFrame:
    """(word, at, onset, nucleus, coda): syllables by maximal onset, in order; words without a vowel have none.

    A cluster between vowels gives the longest legal suffix to the next syllable; of an illegal start the rest is dropped.
    ``onsets`` are the legal ones, at most a few thousand.
    """
    legal = set(onsets)
    vowels = set(VOWELS)

    def onset_of(cluster: list[str]) -> list[str]:
        return next(cluster[i:] for i in range(len(cluster) + 1) if " ".join(cluster[i:]) in legal)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, phones in zip(batch["word"], batch["phones"]):
                phones = list(phones)
                at = [i for i, p in enumerate(phones) if p in vowels]
                edges = [*at, len(phones)]
                onset = onset_of(phones[: at[0]]) if at else []
                for n, (v, following) in enumerate(zip(at, edges[1:])):
                    cluster = phones[v + 1 : following]
                    ahead = onset_of(cluster) if n + 1 < len(at) else []
                    coda = cluster[: len(cluster) - len(ahead)]
                    rows.append((word, n, " ".join(onset), phones[v], " ".join(coda)))
                    onset = ahead
            yield pd.DataFrame(rows, columns=["word", "at", "onset", "nucleus", "coda"])

    return words.select("word", "phones").mapInPandas(cut, "word string, at int, onset string, nucleus string, coda string")


def frequency_tables(cut: DataFrame) -> DataFrame:
    """(kind, value, n): how often each onset, nucleus, coda and number of syllables occurs."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("onset", "nucleus", "coda")])).alias("x")
    parts = cut.select(each).select("x.*")
    sizes = cut.groupBy("word").agg(F.count("*").cast("string").alias("value")).select(F.lit("syllables").alias("kind"), "value")
    return parts.unionByName(sizes).groupBy("kind", "value").agg(F.count("*").alias("n"))


#: Rows of the frequency tables that a draw takes at most; they go to all tasks.
MAX_VALUES = 200_000


def _drawn(values: list[tuple[str, int]], u: Column) -> Column:
    """A value drawn by its count: the first whose running share exceeds ``u``."""
    names, upto = np.array([v for v, _ in values], object), np.cumsum([n for _, n in values])
    shares = upto / upto[-1]

    @F.pandas_udf("string")
    def draw(x: pd.Series) -> pd.Series:
        return pd.Series(names[np.minimum(np.searchsorted(shares, x.to_numpy(), side="right"), len(names) - 1)])

    return draw(u)


def pronunciations(tables: DataFrame, n: int, words: DataFrame, most_syllables: int = 3, seed: int = 42) -> DataFrame:
    """(attempt, phones): ``n`` pronunciations of 1 to 3 syllables drawn from the tables, without those of real words; an error for tables of more than MAX_VALUES rows."""
    rows = tables.limit(MAX_VALUES + 1).collect()
    if len(rows) > MAX_VALUES:
        raise ValueError(f"frequency tables of more than {MAX_VALUES} rows")
    rows = sorted((r.kind, r.value, r.n) for r in rows)
    of = {k: [(v, c) for kind, v, c in rows if kind == k] for k in ("onset", "nucleus", "coda")}
    sizes = [(v, c) for kind, v, c in rows if kind == "syllables" and int(v) <= most_syllables]
    if not sizes or not of["nucleus"]:
        return tables.sparkSession.createDataFrame([], "attempt bigint, phones string")
    ids = tables.sparkSession.range(n).select(F.col("id").alias("attempt"))
    cells = [_drawn(of[k], u01(seed, F.col("attempt"), f"{k}{i}")).alias(f"{k}{i}") for i in range(most_syllables) for k in ("onset", "nucleus", "coda")]
    drawn = ids.select("attempt", _drawn(sizes, u01(seed, F.col("attempt"), "size")).alias("size"), *cells)
    parts = [F.when(F.col("size").cast("int") > i, F.concat_ws(" ", f"onset{i}", f"nucleus{i}", f"coda{i}")) for i in range(most_syllables)]
    drawn = drawn.select("attempt", F.trim(F.regexp_replace(F.concat_ws(" ", *parts), " +", " ")).alias("phones"))
    real = words.select(F.array_join("phones", " ").alias("phones")).distinct()
    return drawn.join(real, "phones", "left_anti").select("attempt", "phones")


def spelled(phones: list[str], n_best: int = 5, beam: int = 32, spellings: dict[str, list[tuple[str, float]]] = SPELLINGS) -> list[str]:
    """The spellings of least cost, best first; ties by text. ``spellings`` gives those of each phone with their costs; an unknown phone is its name."""
    states = [(0.0, "")]
    for p in phones:
        choices = spellings.get(p.rstrip("0123456789"), [(p.lower(), 0.1)])
        states = heapq.nsmallest(beam, {text + s: cost + c for cost, text in states for s, c in choices}.items(), key=lambda x: (x[1], x[0]))
        states = [(cost, text) for text, cost in states]
    return [t for c, t in sorted(states) if math.isfinite(c)][:n_best]


def pseudowords(drawn: DataFrame, n: int, least: int = 3, most: int = 12) -> DataFrame:
    """(word, attempt): the first ``n`` distinct readable spellings, the best readable one of each attempt."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(a, i, s) for a, p in zip(batch["attempt"], batch["phones"]) for i, s in enumerate(spelled(p.split()))]
            yield pd.DataFrame(rows, columns=["attempt", "place", "word"])

    rows = drawn.mapInPandas(spell, "attempt bigint, place int, word string").filter(readable(F.col("word"), least, most))
    best = rows.groupBy("attempt").agg(F.min_by("word", "place").alias("word"))
    return best.groupBy("word").agg(F.min("attempt").alias("attempt")).orderBy("attempt").limit(n)

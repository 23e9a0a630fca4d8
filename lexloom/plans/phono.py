"""Phonotactics over the pronunciations of a word list, and pseudowords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import phono
from lexloom.plans.base import Plans
from lexloom.storage import staged
from lexloom.tables import table

plans = Plans()
#: Legal onsets that the cut into syllables takes at most.
MAX_ONSETS = 100_000

_LETTERS = "MAP {" + ", ".join(f"'{a}': '{p}'" for a, p in phono.LETTERS.items()) + "}"
_VOWELS = "[" + ", ".join(f"'{v}'" for v in phono.VOWELS) + "]"
_WORDS = f"""(SELECT DISTINCT upper(trim(words)) AS word, list_transform(regexp_extract_all(lower(trim(words)), '[a-z]'), lambda c: {_LETTERS}[c]) AS phones FROM word_list WHERE regexp_matches(lower(trim(words)), '[a-z]'))"""
_IS_VOWEL = f"list_transform(phones, lambda p: list_contains({_VOWELS}, p))"
_ONSETS = f"(SELECT DISTINCT array_to_string(phones[1:coalesce(list_position({_IS_VOWEL}, true), len(phones) + 1) - 1], ' ') AS onset FROM {_WORDS} UNION SELECT '')"
# each vowel of a word, what stands before it and after it, cut at the longest legal onset
_LONGEST = "list_min(list_filter(range(1, len({0}) + 2), lambda k: list_contains(legal, array_to_string({0}[k:], ' '))))"
_SYLLABLES = f"""(SELECT word, n, array_to_string(before[{_LONGEST.format('before')}:], ' ') AS onset, nucleus, array_to_string(CASE WHEN last THEN after ELSE after[:{_LONGEST.format('after')} - 1] END, ' ') AS coda FROM
    (SELECT word, legal, n, phones[vs[n]] AS nucleus, n = len(vs) AS last, phones[CASE WHEN n = 1 THEN 1 ELSE vs[n - 1] + 1 END:vs[n] - 1] AS before, phones[vs[n] + 1:CASE WHEN n = len(vs) THEN len(phones) ELSE vs[n + 1] - 1 END] AS after FROM
        (SELECT word, phones, vs, legal, unnest(range(1, len(vs) + 1)) AS n FROM
            (SELECT word, phones, list_filter(range(1, len(phones) + 1), lambda i: list_contains({_VOWELS}, phones[i])) AS vs FROM {_WORDS}), (SELECT list(onset) AS legal FROM {_ONSETS}))))"""


def _dictionary(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "word_list").select(F.trim("words").alias("word")).filter(F.col("word").isNotNull())
    return phono.first_dictionary(spark, [f"{folder}/pronunciations.txt"], words)


def _syllables(words: DataFrame) -> DataFrame:
    onsets = [r.onset for r in phono.legal_onsets(words).limit(MAX_ONSETS + 1).collect()]
    if len(onsets) > MAX_ONSETS:
        raise ValueError(f"more than {MAX_ONSETS} onsets")
    return staged(phono.syllables(words, onsets), "syllables")


@plans.query(f"SELECT word, array_to_string(phones, ' ') AS phones, array_to_string(list_transform(phones, lambda p: CASE WHEN list_contains({_VOWELS}, p) THEN p || '1' ELSE p END), ' ') AS stressed FROM {_WORDS}")
def src_pronunciations(spark: SparkSession, folder: str) -> DataFrame:
    """Pronunciations of the word list: no dictionary is at hand, so letters stand for phones."""
    return _dictionary(spark, folder).select("word", F.array_join("phones", " ").alias("phones"), F.array_join(phono.with_stress(F.col("phones")), " ").alias("stressed"))


@plans.query(_ONSETS[1:-1])
def phono_onsets(spark: SparkSession, folder: str) -> DataFrame:
    return phono.legal_onsets(_dictionary(spark, folder))


@plans.query(f"SELECT word, (n - 1)::INT AS \"at\", onset, nucleus, coda FROM {_SYLLABLES}")
def phono_syllables(spark: SparkSession, folder: str) -> DataFrame:
    return _syllables(_dictionary(spark, folder))


@plans.query(
    f"""WITH s AS (SELECT * FROM {_SYLLABLES}) SELECT 'onset' AS kind, onset AS value, count(*) AS n FROM s GROUP BY onset UNION ALL SELECT 'nucleus', nucleus, count(*) FROM s GROUP BY nucleus
        UNION ALL SELECT 'coda', coda, count(*) FROM s GROUP BY coda UNION ALL SELECT 'syllables', k::VARCHAR, count(*) FROM (SELECT count(*) AS k FROM s GROUP BY word) GROUP BY k"""
)
def phono_tables(spark: SparkSession, folder: str) -> DataFrame:
    return phono.frequency_tables(_syllables(_dictionary(spark, folder)))


@plans.query()
def phono_pseudowords(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred readable pseudowords that aren't pronounced like a real word."""
    words = staged(_dictionary(spark, folder), "pronunciations")
    tables = phono.frequency_tables(_syllables(words))
    return phono.pseudowords(phono.pronunciations(tables, 5_000, words), 100)

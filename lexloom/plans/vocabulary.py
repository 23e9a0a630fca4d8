"""Word counts, unions of word lists and enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.functions.text import WORD
from lexloom.operators import vocab
from lexloom.plans.base import Plans
from lexloom.tables import table

plans = Plans()
TOP = 11_000

_WORD = WORD.replace("'", "''")
_TOKENS = f"(SELECT unnest(list_transform(regexp_extract_all(text, '{_WORD}'), lambda w: lower(w))) AS word FROM documents WHERE text IS NOT NULL)"
_COUNTS = f"(SELECT word, count(*) AS count FROM {_TOKENS} GROUP BY word)"
_BASE = "(SELECT word, count FROM (SELECT trim(words) AS word, count, row_number() OVER (PARTITION BY trim(words) ORDER BY row_ix DESC, count DESC) AS rn FROM word_list WHERE source = 'csv' AND count IS NOT NULL AND trim(words) <> '') WHERE rn = 1)"
_LISTED = "(SELECT DISTINCT trim(words) AS word FROM word_list WHERE source = 'wordfreq' AND regexp_matches(trim(words), '^[A-Za-z''-]+$') AND length(trim(words)) >= 2)"
_UNION = f"""(SELECT word, count, 'csv' AS source FROM {_BASE} UNION ALL SELECT l.word, coalesce(c.count, 0), 'wordfreq' FROM {_LISTED} l LEFT JOIN {_COUNTS} c USING (word) WHERE l.word NOT IN (SELECT word FROM {_BASE}))"""


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.word_counts(table(spark, folder, "documents"))


def _list(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "word_list").select("row_ix", F.col("words").alias("word"), "count", "source")


def _base(spark: SparkSession, folder: str) -> DataFrame:
    rows = _list(spark, folder).filter(F.col("source") == "csv")
    return vocab.counted_list(rows.select("word", "count", F.struct("row_ix", "count").alias("ord")))


@plans.query(f"SELECT word, count FROM {_COUNTS}")
def vocab_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder)


@plans.query(f"SELECT word, count, row_number() OVER (ORDER BY count DESC, word) AS rank FROM {_COUNTS} ORDER BY count DESC, word LIMIT {TOP}")
def vocab_topk(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.top(_counts(spark, folder), TOP)


@plans.query(f"SELECT word, count, source FROM {_UNION}")
def vocab_union(spark: SparkSession, folder: str) -> DataFrame:
    listed = _list(spark, folder).filter(F.col("source") == "wordfreq").select(F.trim("word").alias("word"))
    return vocab.union_with_list(_base(spark, folder), listed, _counts(spark, folder))


@plans.query("SELECT trim(words) AS word, min(row_ix) AS ord FROM word_list WHERE length(trim(words)) >= 2 GROUP BY 1")
def src_first_words(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.first_words(_list(spark, folder).withColumnRenamed("row_ix", "ord"), least=2)


@plans.query("SELECT word, ord FROM (SELECT trim(words) AS word, min(row_ix) AS ord FROM word_list WHERE trim(words) <> '' GROUP BY 1) ORDER BY ord, word LIMIT 500")
def src_trial_words(spark: SparkSession, folder: str) -> DataFrame:
    """The first 500 distinct words, as a trial run takes them."""
    return vocab.first_words(_list(spark, folder).withColumnRenamed("row_ix", "ord")).orderBy("ord", "word").limit(500)


@plans.query(f"SELECT word, count FROM {_COUNTS} WHERE word NOT IN (SELECT word FROM {_BASE})")
def vocab_uncounted(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a resumed count still has to count, with their counts."""
    counts = _counts(spark, folder)
    return counts.join(vocab.uncounted(counts, _base(spark, folder)), "word", "left_semi")


@plans.query(f"SELECT word, coalesce(c.count, b.count) AS count FROM {_BASE} b FULL JOIN {_COUNTS} c USING (word)")
def vocab_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.upserted(_base(spark, folder), _counts(spark, folder))


ROOTS, BEAM, DEPTH = 50_000, 10, 2
#: A public subword vocabulary.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

_PROMPTS = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in vocab.ROOT_PROMPTS) + "]"
_PLACED = "[^A-Za-z0-9]*" + _WORD
_ROOTED = f"""(SELECT word, 1 + len(list_filter([1, 2, 3, 4], lambda i: length(before) >= i AND list_contains({_PROMPTS}, right(before, i)))) AS roots FROM
    (SELECT lower(substr(m, length(before) + 1)) AS word, before FROM (SELECT m, regexp_extract(m, '^[^A-Za-z0-9]*') AS before FROM (SELECT unnest(regexp_extract_all(text, '{_PLACED}')) AS m FROM documents WHERE text IS NOT NULL))))"""
_PIECES = f"(SELECT word, roots, '▁' || substr(word, 1, 3) AS p1, substr(word, 4, 3) AS p2, substr(word, 7, 3) AS p3 FROM {_ROOTED})"
_OK2, _OK3 = (f"regexp_matches(p{i}, '^[A-Za-z''-]+$')" for i in (2, 3))
_ENUMERATED = f"""
    WITH roots AS (SELECT p1, count(*) AS n, sum(roots) AS roots FROM {_PIECES} WHERE regexp_matches(p1, '^▁[A-Za-z0-9][A-Za-z0-9''-]*$') GROUP BY p1 ORDER BY roots DESC, p1 LIMIT {ROOTS}),
    two AS (SELECT p1, p2, n FROM (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY n DESC, p2) AS rn FROM (SELECT p1, p2, count(*) AS n FROM {_PIECES} WHERE p2 <> '' AND {_OK2} AND p1 IN (SELECT p1 FROM roots) GROUP BY ALL)) WHERE rn <= {BEAM}),
    three AS (SELECT p1, p2, p3, n FROM (SELECT *, row_number() OVER (PARTITION BY p1, p2 ORDER BY n DESC, p3) AS rn FROM (SELECT x.p1, x.p2, x.p3, count(*) AS n FROM {_PIECES} x JOIN two ON x.p1 = two.p1 AND x.p2 = two.p2 WHERE x.p3 <> '' AND {_OK3} GROUP BY ALL)) WHERE rn <= {BEAM})
    SELECT word, max(n) AS n FROM (SELECT substr(p1, 2) AS word, n FROM roots UNION ALL SELECT substr(p1, 2) || p2, n FROM two UNION ALL SELECT substr(p1, 2) || p2 || p3, n FROM three) WHERE length(word) >= 2 GROUP BY word"""


@plans.query(f"SELECT word, count(*) AS n, sum(roots)::BIGINT AS roots FROM {_ROOTED} GROUP BY word")
def vocab_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Words with their places after the root prompts."""
    return vocab.rooted_counts(table(spark, folder, "documents"))


@plans.query(_ENUMERATED)
def vocab_enumerate(spark: SparkSession, folder: str) -> DataFrame:
    """Enumeration over pieces of three characters, which SQL can follow."""
    words = vocab.rooted_counts(table(spark, folder, "documents"))
    return vocab.enumerate_words(words.select(vocab.chunks(F.col("word")).alias("pieces"), "n", "roots"), ROOTS, BEAM, DEPTH)


@plans.query()
def vocab_enumerate_subwords(spark: SparkSession, folder: str) -> DataFrame:
    """Enumeration over the pieces of a public vocabulary, with the words of the vocabulary that the corpus lacks at 0."""
    with open(PIECES, "rb") as f:
        model = f.read()
    found = vocab.enumerate_words(vocab.subwords(vocab.rooted_counts(table(spark, folder, "documents")), model), ROOTS, BEAM, DEPTH)
    extra = vocab.vocabulary_words(vocab.vocabulary(spark, PIECES)).select("word", F.lit(0).cast("bigint").alias("n"))
    return found.unionByName(extra).groupBy("word").agg(F.max("n").alias("n"))


@plans.query(
    f"""SELECT word, length(word) >= 2 AND regexp_matches(word, '^[A-Za-z''-]+$') AS legal, length(word) >= 2 AND regexp_matches(word, '^[A-Za-z]+$') AS plain,
        regexp_matches(word, '^[a-z]+$') AND length(word) BETWEEN 3 AND 12 AND len(list_filter(range(1, length(word) - 1), lambda i: word[i] = word[i + 1] AND word[i] = word[i + 2])) = 0
        AND len(list_filter(range(1, length(word) + 1), lambda i: len(list_filter(range(3, length(word) // 2 + 1), lambda k: i + 2 * k - 1 <= length(word) AND substr(word, i, k) = substr(word, i + k, k))) > 0)) = 0 AS readable FROM {_COUNTS}"""
)
def vocab_word_tests(spark: SparkSession, folder: str) -> DataFrame:
    word = F.col("word")
    return _counts(spark, folder).select("word", text.legal_word(word).alias("legal"), text.legal_word(word, apostrophe=False, hyphen=False).alias("plain"), text.readable(word).alias("readable"))


@plans.query("SELECT word, arg_max(count, ord) AS count FROM (SELECT trim(words) AS word, count, row_ix AS ord, row_number() OVER (PARTITION BY trim(words) ORDER BY row_ix DESC, count DESC) AS rn FROM word_list WHERE count IS NOT NULL AND trim(words) <> '') WHERE rn = 1 GROUP BY word")
def src_count_map(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of a list by word: the last valid one stands."""
    rows = _list(spark, folder).select("word", F.col("count"), F.struct("row_ix", "count").alias("ord"))
    return vocab.counted_list(rows)

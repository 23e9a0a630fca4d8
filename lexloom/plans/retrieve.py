"""Retrieval from the documents by phrase and boolean queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import WORD, words
from lexloom.operators import index
from lexloom.plans.base import Plans
from lexloom.tables import table

plans = Plans()
#: Queries besides the seeds of the candidates, made of words that the corpus has.
PHRASES = ["last week", "the new committee", "in the middle of the night"]
BOOLEAN = ["committee AND (week OR night)", "the librarian AND last year's budget", "the moderator OR the choir"]
PROMPTS = ["the", "of", "new", "last", "last-minute"]

_WORD = WORD.replace("'", "''")
_POSTINGS = f"(SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{_WORD}'), lambda w: lower(w)) AS t FROM documents WHERE text IS NOT NULL))"


_LISTED = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in PHRASES + BOOLEAN) + "]"
# the distinct seeds of the candidates and the queries above, cut into clauses, phrases and terms
_QUERIES = f"(SELECT DISTINCT query FROM (SELECT trim(seed) AS query FROM unsafe_candidates UNION ALL SELECT unnest({_LISTED})) WHERE query <> '' AND lower(query) <> 'nan')"
_CLAUSES = f"""(SELECT query, row_number() OVER (PARTITION BY query ORDER BY i) - 1 AS clause, count(*) OVER (PARTITION BY query) AS clauses, part FROM
    (SELECT query, trim(trim(part), '()') AS part, i FROM (SELECT query, unnest(p) AS part, unnest(range(len(p))) AS i FROM (SELECT query, regexp_split_to_array(query, '\\s+AND\\s+') AS p FROM {_QUERIES}))) WHERE trim(part) <> '')"""
_PHRASES = f"(SELECT query, clauses, clause, trim(phrase) AS phrase FROM (SELECT query, clauses, clause, unnest(regexp_split_to_array(part, '\\s+OR\\s+')) AS phrase FROM {_CLAUSES}) WHERE trim(phrase) <> '')"
_TERM_ROWS = f"(SELECT query, clauses, clause, phrase, len(t) AS size, unnest(range(len(t))) AS \"at\", unnest(t) AS term FROM (SELECT *, list_transform(regexp_extract_all(phrase, '{_WORD}'), lambda w: lower(w)) AS t FROM {_PHRASES}))"


def _all(spark: SparkSession, folder: str) -> list[str]:
    """The distinct seeds of the candidates, of which there are few, and the queries above."""
    seeds = table(spark, folder, "unsafe_candidates").select(F.trim("seed").alias("seed")).filter((F.col("seed") != "") & (F.lower("seed") != "nan")).distinct().limit(index.MAX_TERMS + 1).collect()
    return sorted({r.seed for r in seeds} | {*PHRASES, *BOOLEAN})


_HITS = f"(SELECT query, clauses, clause, phrase, doc_id, pos - \"at\" AS start FROM {_POSTINGS} JOIN {_TERM_ROWS} USING (term) GROUP BY query, clauses, clause, phrase, size, doc_id, pos - \"at\" HAVING count(*) = size)"


_FOUND = f"""(SELECT query, doc_id, min(start) AS start FROM (SELECT query, clauses, doc_id, start, len(list_distinct(list(clause) OVER (PARTITION BY query, doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {index.NEAR} FOLLOWING))) AS seen
    FROM (SELECT DISTINCT query, clauses, clause, doc_id, start FROM {_HITS})) WHERE seen = clauses GROUP BY query, doc_id)"""


@plans.query(f"SELECT phrase, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM {_HITS} GROUP BY phrase")
def src_phrase_find(spark: SparkSession, folder: str) -> DataFrame:
    return index.phrase_counts(table(spark, folder, "documents"), _all(spark, folder))


@plans.query(f"SELECT * FROM {_FOUND}")
def src_boolean_find(spark: SparkSession, folder: str) -> DataFrame:
    return index.matching(table(spark, folder, "documents"), _all(spark, folder))


_PER = 200
_RANKED = f"(SELECT query, doc_id, (doc_id % 4)::INT AS shard, row_number() OVER (PARTITION BY query, doc_id % 4 ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY query, doc_id % 4) AS n FROM {_FOUND})"
_EACH = max(1, _PER // 4)
_IS_CNF = "(query LIKE '% AND %' OR query LIKE '% OR %')"
_STRIDED = f"rank % greatest(1, n // {_EACH}) = 0 AND rank // greatest(1, n // {_EACH}) < {_EACH}"
_EVEN = f"list_contains(list_transform(range({_EACH}), lambda i: floor(i * n / {_EACH})::BIGINT), rank)"
_CHOSEN = f"""(SELECT * EXCLUDE (taken) FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shard, rank) AS taken FROM {_RANKED}
    WHERE n <= {_EACH} OR CASE WHEN {_IS_CNF} THEN {_STRIDED} ELSE {_EVEN} END) WHERE taken <= {_PER})"""


@plans.query(
    f"""SELECT query AS seed, CASE WHEN query LIKE '% AND %' OR query LIKE '% OR %' THEN 'cnf' ELSE 'simple' END AS mode, shard, rank AS ptr_or_rank, doc_id AS doc_ix, n_tokens AS doc_len, least(n_tokens, 10000) AS disp_len FROM
    (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query, rank) AS rn FROM {_CHOSEN}) JOIN (SELECT doc_id, len(regexp_extract_all(text, '{_WORD}')) AS n_tokens FROM documents) USING (doc_id) WHERE rn = 1"""
)
def harvest_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return index.harvest(table(spark, folder, "documents"), _all(spark, folder), _PER).drop("text")


@plans.query(
    """SELECT seed, doc_ix, candidate_id FROM (SELECT seed, trim(doc_ix) AS doc_ix, candidate_id, row_number() OVER (PARTITION BY trim(doc_ix) ORDER BY seed NULLS FIRST, candidate_id) AS rn
       FROM unsafe_candidates WHERE trim(doc_ix) NOT IN ('', 'None')) WHERE rn = 1"""
)
def dedup_doc(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the first seed that found it; missing document numbers are no document."""
    rows = table(spark, folder, "unsafe_candidates").withColumn("doc_ix", F.trim("doc_ix")).filter(~F.col("doc_ix").isin("", "None"))
    hits = rows.select(F.col("doc_ix").alias("doc_id"), F.col("seed").alias("query"), F.col("candidate_id").alias("rank"))
    return index.first_per_document(hits).select(F.col("query").alias("seed"), F.col("doc_id").alias("doc_ix"), F.col("rank").alias("candidate_id"))


@plans.query(f"SELECT doc_id, len(t) AS doc_len, least(len(t), 50) AS disp_len, array_to_string(t[1:50], ' ') AS shown FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{_WORD}'), lambda w: lower(w)) AS t FROM documents WHERE text IS NOT NULL)")
def src_doc_window(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the window of tokens that is shown of them."""
    rows = table(spark, folder, "documents").filter(F.col("text").isNotNull()).select("doc_id", words(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("doc_len"), F.least(F.size("t"), F.lit(50)).alias("disp_len"), F.array_join(F.slice("t", 1, 50), " ").alias("shown"))


@plans.query(
    f"""SELECT prompt, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY n DESC, token) AS rank FROM (SELECT prompt, token, count(*) AS n FROM
        (SELECT term AS prompt, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS token FROM {_POSTINGS}) WHERE token IS NOT NULL AND prompt IN ({', '.join(f"'{p}'" for p in PROMPTS)}) GROUP BY ALL)) WHERE rank <= 10"""
)
def src_next_words(spark: SparkSession, folder: str) -> DataFrame:
    return index.next_words(table(spark, folder, "documents"), PROMPTS)


@plans.query("SELECT DISTINCT trim(doc_ix) AS doc_ix FROM unsafe_candidates WHERE trim(doc_ix) NOT IN ('', 'None') AND trim(doc_ix) NOT IN (SELECT doc_id::VARCHAR FROM documents)")
def join_unknown_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the candidates that the corpus doesn't have, as a resumed harvest skips those it has."""
    ids = table(spark, folder, "unsafe_candidates").select(F.trim("doc_ix").alias("doc_ix")).filter(~F.col("doc_ix").isin("", "None")).distinct()
    return ids.join(table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_ix")), "doc_ix", "left_anti")

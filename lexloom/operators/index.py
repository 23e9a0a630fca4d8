"""Retrieval by phrase and boolean queries over positional postings of the documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.sampling import even_stride, plain_stride
from lexloom.functions.text import is_boolean_query, words
from lexloom.operators.ranks import numbered
from lexloom.storage import staged

#: Terms of all queries together, at most; their table is broadcast.
MAX_TERMS = 100_000
NEAR = 100


def parse_query(query: str) -> list[list[str]]:
    """The clauses of a query in conjunctive form, each a list of alternative phrases."""
    out = []
    for clause in re.split(r"\s+AND\s+", query.strip()):
        phrases = [p.strip() for p in re.split(r"\s+OR\s+", clause.strip().strip("()")) if p.strip()]
        if phrases:
            out.append(phrases)
    return out


def _terms(queries: list[str]) -> list[tuple]:
    rows: list[tuple] = []
    for q in sorted(set(queries)):
        for clause, phrases in enumerate(parse_query(q)):
            for phrase in phrases:
                terms = [t.lower() for t in re.findall(r"[A-Za-z0-9]+(?:[’'\-][A-Za-z0-9]+)*", phrase)]
                rows += [(q, len(parse_query(q)), clause, phrase, len(terms), i, t) for i, t in enumerate(terms)]
    if len(rows) > MAX_TERMS:
        raise ValueError(f"queries of more than {MAX_TERMS} terms")
    return rows


def postings(documents: DataFrame, key: str = "doc_id", only: list[str] | None = None) -> DataFrame:
    """(doc_id, pos, term) of every word of every document, or of the words ``only``; positions from 0."""
    rows = documents.filter(F.col("text").isNotNull()).select(F.col(key).alias("doc_id"), words(F.col("text")).alias("t"))
    if only is None:
        return rows.select("doc_id", F.posexplode("t").alias("pos", "term"))
    placed = F.transform("t", lambda term, pos: F.struct(pos.alias("pos"), term.alias("term")))
    return rows.select("doc_id", F.explode(F.filter(placed, lambda x: x["term"].isin(only))).alias("x")).select("doc_id", "x.pos", "x.term")


def occurrences(documents: DataFrame, queries: list[str]) -> DataFrame:
    """(query, clauses, clause, phrase, doc_id, start) of each place where a phrase of a query stands.

    Words that no query has are dropped before the postings are made, so of a document only its hits are shuffled.
    """
    rows = _terms(queries)
    terms = F.broadcast(documents.sparkSession.createDataFrame(rows, "query string, clauses int, clause int, phrase string, size int, at int, term string"))
    hits = postings(documents, only=sorted({r[-1] for r in rows})).join(terms, "term")
    by = ["query", "clauses", "clause", "phrase", "size", "doc_id", (F.col("pos") - F.col("at")).alias("start")]
    return hits.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") == F.col("size")).drop("n", "size")


def phrase_counts(documents: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase, docs, hits) of each phrase; phrases that occur nowhere have no row."""
    return occurrences(documents, phrases).groupBy("phrase").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("hits"))


def matching(documents: DataFrame, queries: list[str], near: int = NEAR, max_clause_freq: int | None = None) -> DataFrame:
    """(query, doc_id, start): documents with a phrase of every clause within ``near`` words, and the first such place.

    ``max_clause_freq`` bounds, as a feature, the places of one clause of a query with several: of a more frequent
    clause those of least draw by document and place are looked at.
    """
    found = occurrences(documents, queries).select("query", "clauses", "clause", "doc_id", "start").distinct()
    if max_clause_freq is not None:
        found = _thinned(staged(found, "places"), max_clause_freq)
    ahead = Window.partitionBy("query", "doc_id").orderBy("start").rangeBetween(0, near)
    found = found.withColumn("seen", F.size(F.collect_set("clause").over(ahead))).filter(F.col("seen") == F.col("clauses"))
    return found.groupBy("query", "doc_id").agg(F.min("start").alias("start"))


def _thinned(found: DataFrame, most: int) -> DataFrame:
    by = ["query", "clause"]
    many = found.filter(F.col("clauses") > 1).groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*by)
    if many.isEmpty():
        return found
    many = F.broadcast(many)  # at most one row for each clause of the queries
    hot = numbered(found.join(many, by, "left_semi").withColumn("_draw", F.xxhash64("doc_id", "start")), by, ["_draw", "doc_id", "start"]).filter(F.col("rank") < most)
    return found.join(many, by, "left_anti").unionByName(hot.select(*found.columns))


def harvest(documents: DataFrame, queries: list[str], per_query: int, shards: int = 4, most_shown: int = 10_000, max_clause_freq: int | None = None) -> DataFrame:
    """(seed, mode, shard, ptr_or_rank, doc_ix, doc_len, disp_len, text): a sample of the matches of each query and shard.

    Shards take equal quotas, at least 1, and a query at most ``per_query`` in all, by shard and rank. A rank is the place
    of a match in its shard by ``doc_id``; phrases take evenly spaced ones, boolean queries every n-th. Of documents found
    by several queries the first query by name stands.
    """
    hits = matching(documents, queries, max_clause_freq=max_clause_freq).select("query", "doc_id", F.pmod("doc_id", F.lit(shards)).alias("shard"))
    hits = numbered(hits, ["query", "shard"], "doc_id")
    sizes = hits.groupBy("query", "shard").agg(F.count("*").alias("n"))
    each, zero = max(1, per_query // shards), F.lit(0).cast("bigint")
    ranks = F.when(is_boolean_query(F.col("query")), plain_stride(F.col("n"), each)).otherwise(even_stride(zero, F.col("n"), each))
    wanted = sizes.select("query", "shard", F.explode(ranks).alias("rank"))
    taken = wanted.withColumn("_taken", F.row_number().over(Window.partitionBy("query").orderBy("shard", "rank"))).filter(F.col("_taken") <= per_query).drop("_taken")
    chosen = first_per_document(hits.join(taken, ["query", "shard", "rank"]))
    tokens = words(F.col("text"))
    rows = chosen.join(documents.select("doc_id", "text"), "doc_id")
    mode = F.when(is_boolean_query(F.col("query")), "cnf").otherwise("simple")
    return rows.select(F.col("query").alias("seed"), mode.alias("mode"), "shard", F.col("rank").alias("ptr_or_rank"), F.col("doc_id").alias("doc_ix"), F.size(tokens).alias("doc_len"), F.least(F.size(tokens), F.lit(most_shown)).alias("disp_len"), "text")


def first_per_document(hits: DataFrame) -> DataFrame:
    """Of each document its hit with the first query, then the first rank."""
    by = Window.partitionBy("doc_id").orderBy("query", "rank")
    return hits.withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") == 1).drop("_rn")


def next_words(documents: DataFrame, prompts: list[str], most: int = 10) -> DataFrame:
    """(prompt, token, n, rank): the most frequent words after each prompt word; ties by word."""
    spark = documents.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(p,) for p in sorted(set(prompts))], "prompt string"))
    tokens = documents.filter(F.col("text").isNotNull()).select(words(F.col("text")).alias("t")).filter(F.size("t") > 1)
    pairs = tokens.select(F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("prompt"), F.slice("t", F.lit(2), F.size("t") - 1).alias("token"))).alias("p")).select("p.*")
    n = pairs.join(wanted, "prompt").groupBy("prompt", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("prompt").orderBy(F.desc("n"), "token"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= most)

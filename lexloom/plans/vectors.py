"""Neighbours, rankings and selections over word vectors.

A vector has two halves, which stand for the two encodings of a word; the stated query set is every row whose number is
divisible by 50, compared with all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.sampling import u01_sql
from lexloom.operators import similarity, vocab
from lexloom.operators.ranks import numbered
from lexloom.plans.base import Plans
from lexloom.plans.vocabulary import _COUNTS
from lexloom.storage import staged
from lexloom.tables import table

plans = Plans()
SIZE, HALF, K, CONTROLS = 128, 64, 200, 200

_VALID = f"(SELECT row_ix AS id, matrix::DOUBLE[] AS vec FROM word_matrix WHERE len(matrix) = {SIZE} AND len(list_filter(matrix, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(matrix, lambda x: x <> 0)) > 0)"
_HALVES = {"a": f"(SELECT id, vec[1:{HALF}] AS vec FROM {_VALID})", "b": f"(SELECT id, vec[{HALF + 1}:{SIZE}] AS vec FROM {_VALID})"}
_QUERY = "id % 50 = 0"


def _pairs(half: str, where: str = _QUERY) -> str:
    rows = f"(SELECT id, vec, sqrt(list_dot_product(vec, vec)) AS norm FROM {_HALVES[half]} WHERE len(list_filter(vec, lambda x: x <> 0)) > 0)"
    return f"""(SELECT q.id AS query, x.id AS id, list_dot_product(q.vec, x.vec) / ((q.norm + 1e-12) * (x.norm + 1e-12)) AS cosine,
        sqrt(greatest((q.norm + 1e-12)**2 + (x.norm + 1e-12)**2 - 2 * list_dot_product(q.vec, x.vec), 0)) AS distance FROM (SELECT * FROM {rows} WHERE {where}) q JOIN {rows} x ON q.id <> x.id)"""


def _near(half: str, metric: str, where: str = _QUERY, k: int = K) -> str:
    order = "round(-cosine, 9), id" if metric == "cosine" else "round(distance, 9), id"
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {order}) AS rank FROM {_pairs(half, where)}) WHERE rank <= {k})"


def _ranked(half: str, metric: str, where: str = _QUERY) -> str:
    value = "cosine" if metric == "cosine" else "distance"
    return f"(SELECT query, avg({value}) AS avg_topk, max({value}) FILTER (rank = 1) AS best, max(id) FILTER (rank = 1) AS best_id FROM {_near(half, metric, where)} GROUP BY query)"


def _half(spark: SparkSession, folder: str, half: str) -> DataFrame:
    vectors = similarity.part_of_vector(similarity.valid_vectors(table(spark, folder, "word_matrix"), SIZE), 1 if half == "a" else HALF + 1, HALF)
    return vectors.filter(F.exists("vec", lambda x: x != 0))


def _neighbours(spark: SparkSession, folder: str, half: str, metric: str, k: int = K) -> DataFrame:
    vectors = _half(spark, folder, half)
    return similarity.compared(vectors, vectors.filter(F.col("id") % 50 == 0), k, metric)


@plans.query(f"SELECT query, rank, id, round(cosine, 4) AS cosine, round(1 - cosine, 4) AS cosine_distance FROM {_near('a', 'cosine')}")
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    rows = _neighbours(spark, folder, "a", "cosine")
    return rows.select("query", "rank", "id", F.round("cosine", 4).alias("cosine"), F.round(1 - F.col("cosine"), 4).alias("cosine_distance"))


@plans.query(f"SELECT query, rank, id, round(distance, 3) AS distance FROM {_near('b', 'euclid')}")
def knn_euclid(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbours(spark, folder, "b", "euclid").select("query", "rank", "id", F.round("distance", 3).alias("distance"))


_NAMED = "(SELECT row_ix AS query, min(trim(words)) AS word FROM word_list WHERE trim(words) <> '' GROUP BY row_ix)"


def _names(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "word_list").filter(F.trim("words") != "")
    return words.groupBy(F.col("row_ix").alias("query")).agg(F.min(F.trim("words")).alias("word"))


def _with_best_word(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    return rows.join(_names(spark, folder).select(F.col("query").alias("best_id"), F.col("word").alias("best_word")), "best_id", "left")


@plans.query(
    f"""SELECT row_number() OVER (ORDER BY round(-avg_topk, 6), round(-best, 6), query) AS rank, query, round(avg_topk, 4) AS avg_topk, round(best, 4) AS best, best_id, w.word AS best_word
        FROM {_ranked('a', 'cosine')} LEFT JOIN (SELECT query AS best_id, word FROM {_NAMED}) w USING (best_id)"""
)
def rank_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking of queries by their mean cosine to the nearest, the most similar first, with the best word of each."""
    rows = similarity.ranked(similarity.summary(_neighbours(spark, folder, "a", "cosine")), {"avg_topk": True, "best": True, "query": False})
    return _with_best_word(rows, spark, folder).select("rank", "query", F.round("avg_topk", 4).alias("avg_topk"), F.round("best", 4).alias("best"), "best_id", "best_word")


@plans.query(
    f"""SELECT row_number() OVER (ORDER BY round(avg_topk, 6), query) AS rank, query, round(avg_topk, 3) AS avg_topk, round(best, 3) AS best, best_id, w.word AS best_word
        FROM {_ranked('b', 'euclid')} LEFT JOIN (SELECT query AS best_id, word FROM {_NAMED}) w USING (best_id)"""
)
def rank_euclid(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking of queries by their mean distance to the nearest, the nearest first."""
    rows = similarity.ranked(similarity.summary(_neighbours(spark, folder, "b", "euclid"), "euclid"), {"avg_topk": False, "query": False})
    return _with_best_word(rows, spark, folder).select("rank", "query", F.round("avg_topk", 3).alias("avg_topk"), F.round("best", 3).alias("best"), "best_id", "best_word")


@plans.query(f"SELECT row_number() OVER (ORDER BY coalesce(c.count, 0) DESC, w.word, query) AS rank, query, w.word, coalesce(c.count, 0) AS count FROM {_NAMED} w LEFT JOIN {_COUNTS} c ON lower(w.word) = c.word WHERE query % 50 = 0")
def rank_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking of the words of the queries by how often the documents have them."""
    rows = _names(spark, folder).filter(F.col("query") % 50 == 0).withColumn("low", F.lower("word"))
    counts = vocab.word_counts(table(spark, folder, "documents")).withColumnRenamed("word", "low")
    rows = rows.join(counts, "low", "left").select("query", "word", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    placed = numbered(rows.withColumn("_fewer", -F.col("count")), [], ["_fewer", "word", "query"])
    return placed.select((F.col("rank") + 1).alias("rank"), "query", "word", "count")


_DRAWN = f"id IN (SELECT id FROM {_HALVES['a']} WHERE len(list_filter(vec, lambda x: x <> 0)) > 0 ORDER BY {u01_sql(42, 'id', 'control')}, id LIMIT {CONTROLS})"


@plans.query(f"SELECT query, round(avg_topk, 4) AS avg_topk, round(best, 4) AS best, best_id FROM {_ranked('a', 'cosine', _DRAWN)}")
def real_control(spark: SparkSession, folder: str) -> DataFrame:
    """The same measure for a drawn control group of rows."""
    vectors = _half(spark, folder, "a")
    rows = similarity.summary(similarity.compared(vectors, similarity.sampled(vectors, CONTROLS), K))
    return rows.select("query", F.round("avg_topk", 4).alias("avg_topk"), F.round("best", 4).alias("best"), "best_id")


_METRICS = f"""(SELECT id, round(a.avg_topk, 6) AS cos_a, round(b.avg_topk, 6) AS cos_b, round(c.avg_topk, 6) AS euc_a, round(d.avg_topk, 6) AS euc_b, w.count
    FROM (SELECT query AS id, avg_topk FROM {_ranked('a', 'cosine')}) a FULL JOIN (SELECT query AS id, avg_topk FROM {_ranked('b', 'cosine')}) b USING (id)
    FULL JOIN (SELECT query AS id, avg_topk FROM {_ranked('a', 'euclid')}) c USING (id) FULL JOIN (SELECT query AS id, avg_topk FROM {_ranked('b', 'euclid')}) d USING (id)
    FULL JOIN (SELECT row_ix AS id, max(c.count) AS count FROM word_list JOIN {_COUNTS} c ON lower(trim(words)) = c.word WHERE row_ix % 50 = 0 GROUP BY row_ix) w USING (id))"""


def _flagged(rule: str) -> str:
    far = ">" if rule == "high" else "<"
    return f"""(SELECT id, '{rule}' AS euclid_rule, coalesce(cos_a < avg(cos_a) OVER () AND cos_b < avg(cos_b) OVER (), false) AS l,
        coalesce(euc_a {far} avg(euc_a) OVER () AND euc_b {far} avg(euc_b) OVER (), false) AS f, coalesce(count < avg(count) OVER (), false) AS r FROM {_METRICS})"""


@plans.query(" UNION ALL ".join(f"SELECT id, euclid_rule, l::INT AS cosine_low, f::INT AS euclid_far, r::INT AS freq_low, (l OR f OR r)::INT AS in_union, (l AND f AND r)::INT AS in_intersection FROM {_flagged(rule)}" for rule in ("high", "low")))
def select_by_means(spark: SparkSession, folder: str) -> DataFrame:
    """Rows flagged against the means of five metrics, which are joined by row, under both rules for the distance; a metric may be missing."""
    joined = None
    for half in ("a", "b"):
        vectors = _half(spark, folder, half)
        near = staged(similarity.compared_by(vectors, vectors.filter(F.col("id") % 50 == 0), K, ("cosine", "euclid")), "near")
        for kind, name in (("cosine", f"cos_{half}"), ("euclid", f"euc_{half}")):
            metric = similarity.summary(near.filter(F.col("metric") == kind), kind).select(F.col("query").alias("id"), F.col("avg_topk").alias(name))
            joined = metric if joined is None else joined.join(metric, "id", "full")
    words = table(spark, folder, "word_list").filter(F.col("row_ix") % 50 == 0).select(F.col("row_ix").alias("id"), F.lower(F.trim("words")).alias("word"))
    counts = words.join(vocab.word_counts(table(spark, folder, "documents")), "word").groupBy("id").agg(F.max("count").alias("count"))
    rows = staged(joined.join(counts, "id", "full"), "metrics")
    return similarity.select_by_means(rows).unionByName(similarity.select_by_means(rows, euclid_high=False))


@plans.query(f"SELECT query, count(*) AS n, round(avg(cosine), 4) AS avg_cosine, round(min(cosine), 4) AS min_cosine, round(max(cosine), 4) AS max_cosine FROM {_pairs('a')} GROUP BY query")
def sim_full(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of the whole similarity vector of each query."""
    vectors = _half(spark, folder, "a")
    every = similarity.similarity_figures(vectors, vectors.filter(F.col("id") % 50 == 0))
    return every.select("query", "n", *[F.round(c, 4).alias(c) for c in ("avg_cosine", "min_cosine", "max_cosine")])


@plans.query(f"SELECT query, id, round(cosine, 4) + 0.0 AS cosine FROM {_pairs('a', 'id IN (SELECT id FROM ' + _VALID + ' ORDER BY ' + u01_sql(42, 'id', 'control') + ', id LIMIT 20)')}")
def sim_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The whole similarity vectors of twenty drawn rows."""
    drawn = similarity.sampled(similarity.valid_vectors(table(spark, folder, "word_matrix"), SIZE).select("id"), 20)
    vectors = _half(spark, folder, "a")
    rows = similarity.compared(vectors, vectors.join(F.broadcast(drawn), "id", "left_semi"), 0)
    return rows.select("query", "id", (F.round("cosine", 4) + F.lit(0.0)).alias("cosine"))


@plans.query()
def vec_encoded(spark: SparkSession, folder: str) -> DataFrame:
    """The words of the list through a pluggable encoder."""
    words = table(spark, folder, "word_list").select(F.trim("words").alias("word")).filter(F.col("word") != "").distinct()
    return similarity.encoded(words, similarity.hashed_ngrams)


@plans.query(f"SELECT id, round(sqrt(list_dot_product(vec, vec)) + 1e-12, 4) AS norm FROM {_VALID}")
def vec_norms(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.valid_vectors(table(spark, folder, "word_matrix"), SIZE).select("id", F.round(similarity.norm(F.col("vec")), 4).alias("norm"))


@plans.query(f"SELECT bucket, place, round(avg(x), 4) + 0.0 AS mean FROM (SELECT id % 100 AS bucket, unnest(range({SIZE})) AS place, unnest(vec) AS x FROM {_VALID}) GROUP BY bucket, place")
def vec_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """Mean pooling of the vectors of a hundred groups."""
    vectors = similarity.valid_vectors(table(spark, folder, "word_matrix"), SIZE).select((F.col("id") % 100).alias("bucket"), "vec")
    return similarity.pooled(vectors, "bucket").select("bucket", F.posexplode("vec").alias("place", "x")).select("bucket", F.col("place").cast("bigint").alias("place"), (F.round("x", 4) + F.lit(0.0)).alias("mean"))


@plans.query(f"SELECT v.id, w.word, w.ord FROM {_VALID} v JOIN (SELECT row_ix AS id, min(trim(words)) AS word, min(row_ix) AS ord FROM word_list WHERE trim(words) <> '' GROUP BY row_ix) w USING (id)")
def join_words_to_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Words with a valid vector, with their place in the list; joined by row and not by position."""
    words = table(spark, folder, "word_list").filter(F.trim("words") != "").groupBy(F.col("row_ix").alias("id")).agg(F.min(F.trim("words")).alias("word"))
    return similarity.valid_vectors(table(spark, folder, "word_matrix"), SIZE).select("id").join(words, "id").select("id", "word", F.col("id").alias("ord"))


@plans.query()
def project_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest rows of one query and a draw of all others on their two main axes."""
    vectors = _half(spark, folder, "a")
    near_and_rest = sample_near_and_rest(spark, folder)
    return similarity.projected(vectors.join(near_and_rest.select("id").distinct(), "id"))


_TOP1 = f"(SELECT query, id FROM {_near('a', 'cosine', f'id = (SELECT min(id) FROM {_VALID})', 100)})"


@plans.query(f"SELECT id, 'near' AS part FROM {_TOP1} UNION ALL SELECT id, 'rest' FROM (SELECT id FROM {_HALVES['a']} WHERE len(list_filter(vec, lambda x: x <> 0)) > 0 AND id NOT IN (SELECT id FROM {_TOP1}) ORDER BY {u01_sql(42, 'id', 'control')}, id LIMIT 200)")
def sample_near_and_rest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows for a projection of one query: its nearest and a draw from all others."""
    vectors = _half(spark, folder, "a")
    near = similarity.compared(vectors, vectors.orderBy("id").limit(1), 100).select("id")
    rest = similarity.sampled(vectors.join(near, "id", "left_anti"), 200)
    return near.select("id", F.lit("near").alias("part")).unionByName(rest.select("id", F.lit("rest").alias("part")))

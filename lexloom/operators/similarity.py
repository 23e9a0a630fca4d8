"""Exact nearest neighbours of a stated query set, rankings by them, and selection by mean thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.sampling import u01
from lexloom.operators.ranks import numbered
from lexloom.storage import staged

#: Query vectors broadcast at a time, and similarities held at once.
BLOCK, CELLS = 16_384, 2_000_000
#: Digits to which similarities are compared.
DIGITS = 9
EPSILON = 1e-12


def valid_vectors(df: DataFrame, size: int, key: str = "row_ix", vector: str = "matrix") -> DataFrame:
    """(id, vec) of rows whose vector has ``size`` numbers, no NaN or null, and isn't all zeros; keys must be unique."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    rows = df.filter(F.col(key).isNotNull() & (F.size(v) == size) & ~bad & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(key).alias("id"), v.alias("vec"))


def part_of_vector(vectors: DataFrame, start: int, size: int) -> DataFrame:
    """The vectors cut to ``size`` numbers from place ``start`` (from 1) on."""
    return vectors.select("id", F.slice("vec", start, size).alias("vec"))


def norm(vector: Column) -> Column:
    """Euclidean length, plus a small number against division by zero."""
    return F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)) + EPSILON


def pooled(tokens: DataFrame, key: str = "id", vector: str = "vec", how: str = "mean", mask: str | None = None) -> DataFrame:
    """(key, vec): the mean or sum of the vectors of each key, number by number; with ``mask``, of those where it is true."""
    tokens = tokens if mask is None else tokens.filter(F.coalesce(F.col(mask).cast("boolean"), F.lit(False)))
    each = tokens.select(key, F.posexplode(vector).alias("at", "x"))
    merge = F.avg("x") if how == "mean" else F.sum("x")
    return each.groupBy(key, "at").agg(merge.alias("x")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _measured(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of some rows, their cosines and distances to all queries), NaN for a query itself."""
    q_norm = np.sqrt((q * q).sum(1)) + EPSILON
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, CELLS // max(1, len(ids)))):
            part = batch.slice(at, max(1, CELLS // max(1, len(ids))))
            own, x = part.column(0).to_numpy(), _matrix(part.column(1))
            dots = q @ x.T
            x_norm = np.sqrt((x * x).sum(1)) + EPSILON
            cos = dots / q_norm[:, None] / x_norm[None, :]
            dist = np.sqrt(np.maximum(q_norm[:, None] ** 2 + x_norm[None, :] ** 2 - 2 * dots, 0))
            cos[ids[:, None] == own[None, :]] = np.nan
            yield own, cos, dist


class _Best:
    """The ``k`` candidates of least cost of each query so far; costs that agree to DIGITS rank by id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.bound, self.waiting = k, np.full(queries, np.inf), 0
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, own: np.ndarray, cost: np.ndarray, cos: np.ndarray, dist: np.ndarray) -> None:
        if cost.shape[1] >= self.k:
            self.bound = np.minimum(self.bound, np.partition(cost, self.k - 1, 1)[:, self.k - 1])
        row, col = np.nonzero(cost <= self.bound[:, None] + 2 * 10.0**-DIGITS)
        keep = np.isfinite(cost[row, col])
        row, col = row[keep], col[keep]
        self.rows.append((row, own[col], cost[row, col], cos[row, col], dist[row, col]))
        self.waiting += len(row)
        if self.waiting > 4 * self.k * len(self.bound):
            self.compact()

    def compact(self) -> tuple[np.ndarray, ...]:
        row, own, cost, cos, dist = (np.concatenate(c) for c in zip(*self.rows)) if self.rows else (np.empty(0, int), np.empty(0, np.int64), *np.empty((3, 0)))
        order = np.lexsort((own, np.round(cost, DIGITS), row))
        sorted_row = row[order]
        starts = np.flatnonzero(np.r_[True, sorted_row[1:] != sorted_row[:-1]]) if len(row) else np.empty(0, int)
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        order = order[rank < self.k]
        full = rank == self.k - 1
        self.rows = [(row[order], own[order], cost[order], cos[order], dist[order])]
        self.bound[sorted_row[full]] = cost[order][rank[rank < self.k] == self.k - 1]
        self.waiting = 0
        return self.rows[0]


def _compared(batches: Iterator[pa.RecordBatch], shared, k: int, metrics: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of the whole task for each query and metric; all for ``k`` 0."""
    ids, q = shared.value
    best = {m: _Best(len(ids), k) for m in metrics} if k > 0 else {}
    names = ["metric", "query", "id", "cosine", "distance"]
    for own, cos, dist in _measured(batches, ids, q):
        for metric, found in best.items():
            cost = -cos if metric == "cosine" else np.where(np.isnan(cos), np.nan, dist)
            found.add(own, np.where(np.isnan(cost), np.inf, cost), cos, dist)
        if not best:
            row, col = np.nonzero(~np.isnan(cos))
            yield pa.RecordBatch.from_arrays([pa.array([metrics[0]] * len(row), pa.string()), pa.array(ids[row]), pa.array(own[col]), pa.array(cos[row, col]), pa.array(dist[row, col])], names)
    for metric, found in best.items():
        row, own, _, cos, dist = found.compact()
        yield pa.RecordBatch.from_arrays([pa.array([metric] * len(row), pa.string()), pa.array(ids[row]), pa.array(own), pa.array(cos), pa.array(dist)], names)


def _blocks(queries: DataFrame):
    """The query vectors in blocks of about BLOCK, each broadcast; the queries are evaluated once."""
    queries = staged(queries.select("id", "vec"), "queries")
    spark, blocks = queries.sparkSession, max(1, -(-queries.count() // BLOCK))
    for i in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow().sort_by("id")
        if block.num_rows:
            yield spark.sparkContext.broadcast((block["id"].to_numpy(), _matrix(block["vec"].combine_chunks())))


def compared_by(vectors: DataFrame, queries: DataFrame, k: int, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, query, id, cosine, distance, rank): the ``k`` nearest vectors of each query other than itself by each metric, or all for ``k`` 0.

    Values that agree to DIGITS digits rank by id. ``queries`` is a stated set (id, vec), broadcast in blocks of BLOCK
    against all vectors, so any number works and the vectors are never shuffled; each task keeps its k best for all
    metrics in one pass, and a window keeps the k best of all.
    """
    schema = "metric string, query bigint, id bigint, cosine double, distance double"
    out = None
    for shared in _blocks(queries):
        found = vectors.select("id", "vec").mapInArrow(lambda it, s=shared: _compared(it, s, k, metrics), schema)
        out = found if out is None else out.unionByName(found)
    out = vectors.sparkSession.createDataFrame([], schema) if out is None else out
    if k <= 0:
        return out
    cost = F.round(F.when(F.col("metric") == "cosine", -F.col("cosine")).otherwise(F.col("distance")), DIGITS)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("metric", "query").orderBy(cost, "id")))
    return ranked.filter(F.col("rank") <= k)


def compared(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """:func:`compared_by` one metric."""
    return compared_by(vectors, queries, k, (metric,)).drop("metric")


def _figures(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    ids, q = shared.value
    n, total = np.zeros(len(ids), np.int64), np.zeros(len(ids))
    least, most = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
    for _, cos, _ in _measured(batches, ids, q):
        there = ~np.isnan(cos)
        n += there.sum(1)
        total += np.where(there, cos, 0.0).sum(1)
        least, most = np.minimum(least, np.where(there, cos, np.inf).min(1)), np.maximum(most, np.where(there, cos, -np.inf).max(1))
    some = n > 0
    yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (ids, n, total, least, most)], ["query", "n", "total", "least", "most"])


def similarity_figures(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, n, avg_cosine, min_cosine, max_cosine) over the whole similarity vector of each query, summed up where it is made."""
    out = None
    for shared in _blocks(queries):
        found = vectors.select("id", "vec").mapInArrow(lambda it, s=shared: _figures(it, s), "query bigint, n bigint, total double, least double, most double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query bigint, n bigint, avg_cosine double, min_cosine double, max_cosine double")
    return out.groupBy("query").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avg_cosine"), F.min("least").alias("min_cosine"), F.max("most").alias("max_cosine"))


def summary(neighbours: DataFrame, metric: str = "cosine") -> DataFrame:
    """(query, avg_topk, best, best_id) of ranked neighbours; of equally near ones the smallest id."""
    value = F.col("cosine" if metric == "cosine" else "distance")
    return neighbours.groupBy("query").agg(F.avg(value).alias("avg_topk"), F.max(F.when(F.col("rank") == 1, value)).alias("best"), F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("best_id"))


def ranked(rows: DataFrame, order: dict[str, bool]) -> DataFrame:
    """``rows`` with their ``rank`` from 1 by the columns of ``order`` (True: greatest first), compared to six digits; numbered in ranges, so any number of rows works."""
    keys = {f"_k{i}": (-F.col(c) if down else F.col(c)) if c in ("query", "word", "id") else F.round(-F.col(c) if down else F.col(c), 6) for i, (c, down) in enumerate(order.items())}
    placed = numbered(rows.select("*", *[v.alias(k) for k, v in keys.items()]), [], list(keys))
    return placed.withColumn("rank", F.col("rank") + 1).drop(*keys)


def encoded(words: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], leading: str = " ") -> DataFrame:
    """(word, vec) by a pluggable encoder: ``load`` runs once in a task and gives a function from texts to rows of a matrix.

    Each word is encoded with a blank before it, as a word inside a text; null words are left out.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            names = batch.column(0).to_pylist()
            if names:
                x = np.asarray(model([leading + w for w in names]), np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["word", "vec"])

    return words.filter(F.col("word").isNotNull()).select("word").mapInArrow(encode, "word string, vec array<double>")


def hashed_ngrams(size: int = 64, least: int = 2, most: int = 4) -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: signed counts of character n-grams in ``size`` buckets, at unit length."""
    from zlib import crc32

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            for n in range(least, most + 1):
                for at in range(len(text) - n + 1):
                    h = crc32(text[at : at + n].encode())
                    out[i, h % size] += 1 if h >> 31 else -1
        return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), EPSILON)

    return encode


def sampled(vectors: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` vectors without replacement: those of least draw, ties by id."""
    return vectors.withColumn("_u", u01(seed, F.col("id"), "control")).orderBy("_u", "id").limit(n).drop("_u")


def projected(vectors: DataFrame, size: int = 2) -> DataFrame:
    """(id, place): the vectors on their ``size`` main axes, for a picture of a sample; no rows if there are fewer than two."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = staged(vectors.select("id", F.col("vec").cast("array<double>").alias("vec")), "to-project")
    if rows.limit(2).count() < 2:
        return rows.select("id", F.col("vec").alias("place")).limit(0)
    rows = rows.select("id", array_to_vector("vec").alias("x"))
    return PCA(k=size, inputCol="x", outputCol="y").fit(rows).transform(rows).select("id", vector_to_array("y").alias("place"))


def select_by_means(metrics: DataFrame, euclid_high: bool = True) -> DataFrame:
    """Flags of each row of (id, cos_a, cos_b, euc_a, euc_b, count) against the mean of each metric.

    A row is low in cosine if both cosines are below their means, far in distance if both are above (or below, if not
    ``euclid_high``), rare if its count is below. Means are over values rounded to six digits; missing values don't count and never
    pass, and a NaN mean lets nothing pass.
    """
    rule = "high" if euclid_high else "low"
    names = ["cos_a", "cos_b", "euc_a", "euc_b", "count"]
    rows = metrics.select("id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in names])
    means = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    rows = rows.crossJoin(F.broadcast(means))  # one row of means

    def passes(c: str, above: bool) -> Column:
        m = F.col(f"m_{c}")
        test = F.col(c) > m if above else F.col(c) < m
        return F.coalesce(test & ~F.isnan(m) & ~F.isnan(F.col(c)), F.lit(False))

    low, rare = passes("cos_a", False) & passes("cos_b", False), passes("count", False)
    far = passes("euc_a", euclid_high) & passes("euc_b", euclid_high)
    flags = {"cosine_low": low, "euclid_far": far, "freq_low": rare, "in_union": low | far | rare, "in_intersection": low & far & rare}
    return rows.select("id", F.lit(rule).alias("euclid_rule"), *[f.cast("int").alias(n) for n, f in flags.items()])

"""Long exact spans shared between records, by prefix-partitioned suffix trees over anchored suffixes.

A window of ``min_len`` characters always holds an anchor: a position whose prefix of 2/5 ``min_len`` characters has the
least hash of some window around it, so equal windows of two texts hold the same anchors at the same places. Only
suffixes that start at anchors are kept (about 1.6 % of all for 200 characters), and of these only those whose prefix
also stands in another record. They are partitioned by prefix into groups that fit in memory. Of each group the sorted
suffixes to the right and the sorted reversed texts to the left, with their longest common prefixes, stand for its two
suffix trees: a node of depth d holds the suffixes whose next d characters agree. A window that starts ``o`` characters
before its anchor is shared if a node of depth ``o`` on the left and one of depth ``min_len - o`` on the right have
suffixes of two records in common. The union of shared windows gives the spans.

A prefix that is too frequent for one task is lengthened until its groups fit: suffixes with all the same text around
them are taken as one, which a passage in many records makes of nearly all; the rest are cut by ever smaller ranges of
``o``, each grouped by the text that all its windows have in common, a prefix of the window's text around the anchor.
Texts are compared as they are, never by hashes alone. Every step is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.storage import staged

MIN_LEN = 200
#: Suffixes of one prefix that one task takes at most, and the suffixes that a task takes in all.
MAX_GROUP = 10_000
SUFFIXES_PER_TASK = 40_000
#: Keys with at least total / HOT_SHARE rows are hot: at most HOT_SHARE, so their table may be broadcast.
HOT_SHARE = 1_000
#: Ranges into which that of a frequent prefix is cut at a time.
PIECES = 6
#: Characters hashed at a time; a longer text is taken whole.
CHUNK_CHARS = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each ``w`` neighbours from i on; len(x) - w + 1 results."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, x[-1], x.dtype)]).reshape(-1, w)
    before = best.accumulate(blocks, 1).ravel()
    after = best.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return best(after[: n - w + 1], before[w - 1 : n])


class _Hashes:
    """Polynomial hashes of all substrings of a text given as code points."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        mixed = (codes.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)
        mixed ^= mixed >> _U(32)
        power = np.full(n + 1, _BASE, _U)
        power[0] = 1
        np.cumprod(power, out=power)
        self.inverse = np.full(n + 1, _INVERSE, _U)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(mixed * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        return h ^ h >> _U(32)


def anchors(texts: list[str], min_len: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, prefix hash, further) of each anchor of texts of at least ``min_len`` characters.

    Anchors of a repetition whose surroundings are all the same come out once; ``further`` is the distance to the last.
    """
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.r_[0, np.cumsum(lengths)]
    n, w = len(codes), min_len - k + 1
    hashes = _Hashes(codes)
    at = np.arange(n - k + 1)
    grams = hashes.of(at, at + k)
    inside = np.ones(len(at), bool)  # prefixes within one text
    for s in starts[1:-1]:
        inside[max(0, s - k + 1) : s] = False
    low = _sliding(np.where(inside, grams, ~_U(0)), w, np.minimum)
    whole = np.zeros(len(low), bool)
    for s, m in zip(starts, lengths):
        whole[s : s + m - min_len + 1] = True
    low = np.where(whole, low, _U(0))
    edge = np.zeros(w - 1, _U)
    high = _sliding(np.concatenate([edge, low, edge]), w, np.maximum)
    pos = np.flatnonzero(inside & (high[: len(grams)] == grams))
    text = np.searchsorted(starts, pos, side="right") - 1
    left, right = np.maximum(starts[text], pos - (min_len - k)), np.minimum(starts[text + 1], pos + min_len)
    around = hashes.of(left, right)
    same = np.r_[False, (around[1:] == around[:-1]) & (text[1:] == text[:-1]) & (np.diff(pos) <= min_len) & (pos[1:] - left[1:] == pos[:-1] - left[:-1]) & (right[1:] - pos[1:] == right[:-1] - pos[:-1])] if len(pos) else np.empty(0, bool)
    first = np.flatnonzero(~same)
    last = np.r_[first[1:] - 1, len(pos) - 1] if len(pos) else first
    return text[first], (pos - starts[text])[first], grams[pos[first]].view(np.int64), pos[last] - pos[first]


def _chunks(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS or i == len(texts) - 1:
            yield keys[a : i + 1], texts[a : i + 1]
            a, size = i + 1, 0


def _anchored(batches: Iterator[pa.RecordBatch], min_len: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, texts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text, pos, gram, further = anchors(texts, min_len, k)
            doc = np.array(keys, np.int64)[text]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(gram), pa.array(further.astype(np.int32))], ["doc", "pos", "gram", "further"])


def _in_two_records(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose ``key`` occurs in two records (``doc``, or from ``doc`` to ``last``), with the number ``n`` of rows of that key.

    Frequent keys are joined by broadcast (at most HOT_SHARE), so their rows stay where they are.
    """
    key, total = list(key), rows.count()
    last = "last" if "last" in rows.columns else "doc"
    counts = rows.groupBy(*key).agg(F.min("doc").alias("a"), F.max(last).alias("b"), F.count("*").alias("n")).filter(F.col("a") < F.col("b"))
    counts = staged(counts.select(*key, "n"), "span-keys")
    least = max(MAX_GROUP, -(-total // HOT_SHARE))
    hot = counts.filter(F.col("n") >= least)
    if not hot.limit(1).count():
        return rows.join(counts, key)
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(counts.filter(F.col("n") < least), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def _surroundings(batches: Iterator[pa.RecordBatch], min_len: int, k: int) -> Iterator[pa.RecordBatch]:
    names = ["gram", "n", "doc", "pos", "further", "left", "right"]
    for batch in batches:
        docs, texts, at = batch.column("doc"), batch.column("text").to_pylist(), batch.column("at")
        lists = at.flatten()
        sizes = at.value_lengths().to_numpy()
        pos = lists.field("pos").to_pylist()
        left, right, i = [], [], 0
        for text, m in zip(texts, sizes.tolist()):
            for p in pos[i : i + m]:
                left.append(text[max(0, p - (min_len - k)) : p][::-1])
                right.append(text[p : p + min_len])
            i += m
        own = docs.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        out = pa.RecordBatch.from_arrays([lists.field("gram"), lists.field("n"), own, lists.field("pos"), lists.field("further"), pa.array(left, pa.string()), pa.array(right, pa.string())], names)
        for a in range(0, out.num_rows, 10_000):
            yield out.slice(a, 10_000)


def _sorted_common(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The order of texts, and of each in that order the length it has in common with the one before (-1 for the first)."""
    lengths = np.array([len(t) for t in texts])
    wide = np.array(texts, dtype=f"<U{max(1, int(lengths.max()))}")
    order = np.argsort(wide, kind="stable")
    codes = wide.view(np.uint32).reshape(len(texts), -1)
    common = np.full(len(texts), -1, np.int64)
    for a in range(1, len(order), 8192):
        one, two = order[a - 1 : min(len(order), a + 8192) - 1], order[a : a + 8192]
        differ = codes[one] != codes[two]
        first = np.where(differ.any(1), differ.argmax(1), codes.shape[1])
        common[a : a + 8192] = np.minimum(first, np.minimum(lengths[one], lengths[two]))
    return order, common


def shared_offsets(doc: np.ndarray, last: np.ndarray, left: list[str], right: list[str], min_len: int, offsets: range) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the least and greatest ``o`` of ``offsets`` for which the window that starts ``o`` before it is shared; -1 for none.

    ``left`` has the reversed text before each suffix, ``right`` the suffix, each as far as windows reach; a suffix
    stands in the records from ``doc`` to ``last``.
    """
    n = len(doc)
    least, most = np.full(n, -1), np.full(n, -1)
    if not n:
        return least, most
    (r_order, r_common), (l_order, l_common) = _sorted_common(right), _sorted_common(left)
    sizes = np.array([[len(t) for t in side] for side in (left, right)])

    def nodes(order: np.ndarray, common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The node of each suffix at a depth, and whether it holds others."""
        joined = common >= depth
        out, many = np.empty(n, np.int64), np.empty(n, bool)
        out[order] = np.cumsum(~joined)
        many[order] = joined | np.r_[joined[1:], False]
        return out, many | alone

    alone = doc < last
    for o in offsets:
        r_node, r_many = nodes(r_order, r_common, min_len - o)
        l_node, l_many = nodes(l_order, l_common, o) if o else (np.zeros(n, np.int64), np.ones(n, bool))
        rows = np.flatnonzero(r_many & l_many & (sizes[0] >= o) & (sizes[1] >= min_len - o))
        if not len(rows):
            continue
        node = r_node[rows] * (n + 1) + l_node[rows]
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        two = np.minimum.reduceat(doc[rows], starts) < np.maximum.reduceat(last[rows], starts)
        hit = rows[np.repeat(two, np.diff(np.r_[starts, len(rows)]))]
        most[hit] = o
        least[hit] = np.where(least[hit] < 0, o, least[hit])
    return least, most


def _by_trees(batches: Iterator[pa.RecordBatch], min_len: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """(``keep``, least, most) of the suffixes that share a window of their range ``lo`` to ``hi``; groups have one ``gram``, ``lo`` and ``hi``."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).sort_by([("lo", "ascending"), ("hi", "ascending"), ("gram", "ascending")])
    key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("lo", "hi", "gram")])
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
    cuts, size = [0], 0
    for s, e in zip(starts, np.r_[starts[1:], table.num_rows]):  # whole groups of one range, up to a bound at a time
        if size and (size + e - s > SUFFIXES_PER_TASK or (key[:2, s] != key[:2, s - 1]).any()):
            cuts.append(s)
            size = 0
        size += e - s
    for a, b in zip(cuts, [*cuts[1:], table.num_rows]):
        part = table.slice(a, b - a)
        doc, last = part["doc"].to_numpy(), part["last"].to_numpy()
        least, most = shared_offsets(doc, last, part["left"].to_pylist(), part["right"].to_pylist(), min_len, range(int(key[0, a]), int(key[1, a]) + 1))
        hit = np.flatnonzero(most >= 0)
        yield pa.RecordBatch.from_arrays([*(part[c].combine_chunks().take(pa.array(hit)) for c in keep), pa.array(least[hit]), pa.array(most[hit])], [*keep, "least", "most"])


def _treed(suffixes: DataFrame, min_len: int, keep: dict[str, str], *key: str) -> DataFrame:
    """(``keep``, least, most) of suffixes whose groups of one ``key`` fit in a task."""
    tasks = max(1, -(-suffixes.count() // SUFFIXES_PER_TASK))
    rows = suffixes.repartition(tasks, *key).select(*{**dict.fromkeys(keep), **dict.fromkeys(["doc", "last", "left", "right", "lo", "hi", "gram"])})
    return rows.mapInArrow(lambda it: _by_trees(it, min_len, list(keep)), ", ".join(f"{c} {t}" for c, t in keep.items()) + ", least bigint, most bigint")


def _of_hot(hot: DataFrame, min_len: int, k: int) -> DataFrame:
    """(doc, pos, further, least, most) of suffixes whose prefix is too frequent for one task."""
    context = ["gram", "left", "right"]
    contexts = hot.groupBy(*context).agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    contexts = staged(contexts.select("*", F.monotonically_increasing_id().alias("id")), "span-contexts")
    whole = contexts.filter(F.col("doc") < F.col("last")).select("id", F.greatest(min_len - F.length("right"), F.lit(0)).cast("bigint").alias("least"), F.least(F.length("left"), F.lit(min_len - k)).cast("bigint").alias("most")).filter("least <= most")
    found = whole
    rows = contexts.select("*", F.lit(0).alias("lo"), F.lit(min_len - k).alias("hi"))
    while True:  # each round cuts the ranges of groups that don't fit
        step = F.ceil((F.col("hi") - F.col("lo") + 1) / PIECES).cast("int")
        pieces = F.array(*[F.struct((F.col("lo") + i * step).alias("lo"), F.least(F.col("lo") + (i + 1) * step - 1, F.col("hi")).alias("hi")) for i in range(PIECES)])
        rows = rows.select("id", "doc", "last", *context, F.explode(pieces).alias("r")).select("id", "doc", "last", *context, "r.lo", "r.hi")
        rows = rows.filter((F.col("lo") <= F.col("hi")) & (F.col("lo") <= F.length("left")) & (min_len - F.col("hi") <= F.length("right")))
        core = F.concat(F.left("left", F.col("lo")), F.lit("\x00"), F.left("right", F.lit(min_len) - F.col("hi")))
        rows = staged(_in_two_records(staged(rows.select("*", core.alias("core")), "span-ranges"), "lo", "hi", "core"), "span-ranges")
        single = rows.filter(F.col("lo") == F.col("hi")).select("id", F.col("lo").cast("bigint").alias("least"), F.col("lo").cast("bigint").alias("most"))
        fit = rows.filter((F.col("lo") < F.col("hi")) & (F.col("n") < MAX_GROUP)).drop("n")
        found = found.unionByName(single).unionByName(_treed(fit, min_len, {"id": "bigint"}, "lo", "hi", "core"))
        rows = rows.filter((F.col("lo") < F.col("hi")) & (F.col("n") >= MAX_GROUP)).drop("n", "core")
        if not rows.limit(1).count():
            break
    found = staged(found.groupBy("id").agg(F.min("least").alias("least"), F.max("most").alias("most")), "span-hits")
    named = contexts.select("id", *context).join(found, "id").drop("id")
    counts = hot.groupBy(*context).count().filter(F.col("count") >= MAX_GROUP).drop("count")
    counts = staged(counts, "span-frequent")
    if counts.limit(HOT_SHARE + 1).count() > HOT_SHARE:
        return hot.join(named, context)
    often = F.broadcast(named.join(F.broadcast(counts), context))  # contexts that many suffixes have, at most HOT_SHARE
    seldom = hot.join(F.broadcast(counts), context, "left_anti").join(named, context)
    return seldom.unionByName(hot.join(often, context))


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", min_len: int = MIN_LEN) -> DataFrame:
    """(key, span_start, span_len): each longest run of characters that lie in windows shared with another record.

    Characters are code points, counted from 1. A repeat within one record is no span. Null texts, texts shorter than
    ``min_len`` and rows without a key have none; of a key that comes twice the greatest text stands.
    """
    k = max(1, 2 * min_len // 5)
    docs = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= min_len))
    if docs.groupBy("doc").count().filter("count > 1").limit(1).count():
        docs = docs.groupBy("doc").agg(F.max("text").alias("text"))
    found = staged(docs.mapInArrow(lambda it: _anchored(it, min_len, k), "doc bigint, pos int, gram bigint, further int"), "anchors")
    kept = _in_two_records(found, "gram")
    of_doc = kept.groupBy("doc").agg(F.collect_list(F.struct("pos", "further", "gram", "n")).alias("at"))
    suffixes = docs.join(of_doc, "doc").mapInArrow(lambda it: _surroundings(it, min_len, k), "gram bigint, n bigint, doc bigint, pos int, further int, left string, right string")
    suffixes = staged(suffixes, "suffixes")
    cold = suffixes.filter(F.col("n") < MAX_GROUP)
    cold = cold.select("doc", "pos", "further", F.col("doc").alias("last"), "left", "right", F.lit(0).alias("lo"), F.lit(min_len - k).alias("hi"), "gram")
    hits = _treed(cold, min_len, {"doc": "bigint", "pos": "int", "further": "int"}, "gram")
    hot = suffixes.filter(F.col("n") >= MAX_GROUP)
    if hot.limit(1).count():
        hits = hits.unionByName(_of_hot(hot, min_len, k).select("doc", "pos", "further", "least", "most"))
    intervals = hits.select("doc", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + min_len + F.col("further")).alias("stop"))
    by = Window.partitionBy("doc").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = intervals.select("doc", "start", "stop", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int").alias("fresh"))
    runs = runs.select("doc", "start", "stop", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    spans = runs.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.select(F.col("doc").alias(key), (F.col("start") + 1).alias("span_start"), (F.col("stop") - F.col("start")).alias("span_len"))


def shared_share(df: DataFrame, key: str = "doc_id", text: str = "text", min_len: int = MIN_LEN) -> DataFrame:
    """(key, n_chars, shared_chars, n_spans, share) for every row: how much of each text stands in other records.

    Null and empty texts have share 0 and 0 characters.
    """
    of_doc = shared_spans(df, key, text, min_len).groupBy(key).agg(F.sum("span_len").alias("shared_chars"), F.count("*").alias("n_spans"))
    rows = df.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.length(F.col(text)), F.lit(0)).cast("bigint").alias("n_chars")).join(of_doc, key, "left").fillna(0, ["shared_chars", "n_spans"])
    return rows.select(key, "n_chars", "shared_chars", "n_spans", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0).alias("share"))

"""Encoding with a public byte-level BPE vocabulary: two-tier lookup.

Tier one resolves whole pre-tokens that stand in the vocabulary through a minimal perfect hash (hash and displace),
checked against the token's bytes. Tier two merges the bytes of the others with a heap over a linked list, which is
n log n for any length. Resolved pre-tokens are remembered per task, up to a bounded number.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary that the queries use; the path is a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pattern that splits text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered per task, and the longest that are.
MEMO_ITEMS = 300_000
MEMO_CHARS = 64
#: Characters of text encoded at a time inside a batch.
CHUNK_CHARS = 1_000_000

_U = np.uint64
_MASK = (1 << 64) - 1


class MinimalHash:
    """Minimal perfect hash of byte strings: each key has its own slot in ``range(len(keys))``."""

    def __init__(self, keys: list[bytes], mean_bucket: int = 4) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // mean_bucket)
        h1 = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], _U)
        h2 = self._second(h1)
        bucket = (h1 % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(self.n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = order[starts[b] : starts[b + 1]]
            at, step = h1[own][:, None], h2[own][:, None]
            base = 0
            while True:
                slots = ((at + np.arange(base, base + 256, dtype=_U)[None, :] * step) % _U(self.n)).astype(np.int64)
                fits = ~taken[slots].any(0)
                if len(own) > 1 and fits.any():
                    low = np.sort(slots[:, fits], 0)
                    fits[np.flatnonzero(fits)[(np.diff(low, axis=0) == 0).any(0)]] = False
                if fits.any():
                    d = int(np.flatnonzero(fits)[0])
                    taken[slots[:, d]] = True
                    shift[b] = base + d
                    break
                base += 256
                if base > 1 << 24:
                    raise ValueError("keys must be distinct")
        free = np.flatnonzero(~taken)
        single = np.flatnonzero(sizes == 1)
        shift[single] = -1 - free[: len(single)]
        self.shift, self.few = shift, shift.tolist()

    @staticmethod
    def _second(h1: np.ndarray) -> np.ndarray:
        return (h1 >> _U(32)) * _U(0x9E3779B97F4A7C15) ^ (h1 << _U(7)) | _U(1)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; for a string outside the set, that of some key."""
        h1 = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], _U)
        d = self.shift[(h1 % _U(self.buckets)).astype(np.int64)]
        moved = ((h1 + d.astype(_U) * self._second(h1)) % _U(self.n)).astype(np.int64)
        return np.where(d < 0, -1 - d, moved)

    def slot(self, key: bytes) -> int:
        """:meth:`slots` of one key."""
        h1 = xxhash.xxh3_64_intdigest(key)
        d = self.few[h1 % self.buckets]
        if d < 0:
            return -1 - d
        h2 = ((h1 >> 32) * 0x9E3779B97F4A7C15 & _MASK) ^ (h1 << 7 & _MASK) | 1
        return ((h1 + d * h2) & _MASK) % self.n


class Vocabulary:
    """Ranks of a rank file behind a minimal perfect hash."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = list(ranks)
        self.hash = MinimalHash(tokens)
        self.tokens: list[bytes] = [b""] * len(tokens)
        self.ids: list[int] = [0] * len(tokens)
        for token, slot in zip(tokens, self.hash.slots(tokens).tolist()):
            self.tokens[slot], self.ids[slot] = token, ranks[token]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From lines of base64 and rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def find_one(self, key: bytes) -> int:
        """The id of one key, -1 outside the vocabulary."""
        slot = self.hash.slot(key)
        return self.ids[slot] if self.tokens[slot] == key else -1

    def find(self, keys: list[bytes]) -> list[int]:
        """The id of each key, -1 for those outside the vocabulary."""
        if not keys:
            return []
        return [self.ids[s] if self.tokens[s] == k else -1 for k, s in zip(keys, self.hash.slots(keys).tolist())]


class Encoder:
    """Encodes texts; one per task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[bytes, int] = {}

    def _rank(self, key: bytes) -> int:
        """Rank of a candidate merge, -1 for none; remembered."""
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MEMO_ITEMS:
                self.pairs.clear()
            found = self.pairs[key] = self.vocabulary.find_one(key)
        return found

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of bytes that are no token as a whole: repeatedly joins the neighbours of lowest rank, leftmost first."""
        n = len(data)
        after = list(range(1, n + 1))  # start of the next part; n at the last
        before = list(range(-1, n - 1))
        rank = self._rank
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) >= 0]
        heapq.heapify(heap)
        dead = bytearray(n + 1)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or after[j] != end:
                continue
            dead[j] = 1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank(data[i : after[end]])) >= 0:
                    heapq.heappush(heap, (r, i, after[end]))
            if (b := before[i]) >= 0 and (r := rank(data[b:end])) >= 0:
                heapq.heappush(heap, (r, b, end))
        parts, i = [], 0
        while i < n:
            parts.append(rank(data[i : after[i]]))
            i = after[i]
        return tuple(parts)

    def _resolve(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each piece."""
        memo = self.memo
        if len(memo) > MEMO_ITEMS:
            memo.clear()
        found: dict[str, tuple[int, ...]] = {}
        new = [p for p in set(pieces) if p not in memo]
        raw = [p.encode() for p in new]
        for p, b, i in zip(new, raw, self.vocabulary.find(raw)):
            (memo if len(p) <= MEMO_CHARS else found)[p] = (i,) if i >= 0 else self.merge(b)
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for an empty and a null text."""
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            chunk, size = [], 0
            while at < len(texts) and (not chunk or size < CHUNK_CHARS):
                chunk.append(self.split(texts[at]) if texts[at] else [])
                size += len(texts[at] or "")
                at += 1
            long = self._resolve(chain.from_iterable(chunk))
            memo = self.memo
            if long:
                get = lambda p: memo.get(p) or long[p]
            else:
                get = memo.__getitem__
            out += [list(chain.from_iterable(map(get, pieces))) for pieces in chunk]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        by_id = dict(zip(self.vocabulary.ids, self.vocabulary.tokens))
        return b"".join(by_id[i] for i in ids).decode()


def _encoded(batches: Iterator[pa.RecordBatch], shared, counts: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(shared.value)
    for batch in batches:
        ids = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        kept, names = batch.columns[:-1], batch.schema.names[:-1]
        if counts:
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lengths)], [*names, "n_tokens"])
            continue
        total = int(lengths.sum())
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(lengths, out=offsets[1:])
        flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, total))
        yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets), flat)], [*names, "ids"])


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) for every row, without a shuffle; empty and null texts give an empty list.

    The vocabulary has a fixed size and is sent to the executors once.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encoded(it, shared, False), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text`` but with ``n_tokens`` (0 for empty and null texts), without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    others = [c for c in df.columns if c not in (text, "n_tokens")]
    rows = df.select(*others, F.col(text).cast("string").alias(text))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(lambda it: _encoded(it, shared, True), f"{schema}, n_tokens bigint")

"""Languages of documents and of the segments of mixed documents, by hierarchical discrimination.

Linear support vector machines over hashed character n-grams of words: one against the rest for language families, and
one against one for the languages of each family. Their scores add up over words, so a text is cut into segments by the
best path over its words, where changing the language costs less at a clause boundary; each segment is then labelled
through the hierarchy, family first. The machines are fitted on the sentences of ``lang_samples``, a fixed table, and then
again with a bounded number of labelled records whose label the first fit confirms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.canonical import MIN_CHARS, canonical, fields

#: Family of each language; a language that isn't named here is a family of its own.
FAMILIES = {"de": "germanic", "en": "germanic", "nl": "germanic", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ru": "slavic"}
#: Labelled sentences used for fitting, at most (those with the smallest ids); the table has a fixed size of 640.
MAX_SAMPLES = 20_000
#: Labelled records per language that widen the vocabulary: those of the least hashes whose label the first model confirms.
MORE_PER_LANGUAGE = 300
DIMENSIONS = 1 << 15
LONGEST_GRAM = 4
#: Cost of a change of language between two words, inside a clause and at its boundary, and the least words of a segment.
INSIDE_COST, BOUNDARY_COST, LEAST_WORDS = 9.0, 5.0, 3
#: Weights of words that the fitted sentences don't have, of those that look like names,
#: and of single letters.
UNSEEN, NAMELIKE, SINGLE = 0.7, 0.2, 0.25
MEMO_ITEMS = 200_000
CELLS = 200_000

_NOISE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\S+|[@#]\w+|<[^<>]{1,200}>|&#?\w+;")
_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?…;:,|/\"“”„«»()\[\]\n\r>]|--|[–—]")
_U = np.uint64


def tokens(text: str) -> list[str]:
    """Words and boundary signs of a text, without links, mentions and markup; of a text of fields, its values."""
    if text.lstrip()[:1] == "{" or "\n" in text or "\r" in text:
        found = fields(text)
        if found is not None:
            text = "\n".join(v for _, v in found)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _TOKEN.findall(_NOISE.sub(" ", text))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashed features): the character n-grams of each word in boundary marks, and the word."""
    marked = [f"\x02{w}\x03" for w in words]
    lengths = np.array([len(m) for m in marked])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    ends = np.cumsum(lengths)
    n = len(codes)
    word = np.repeat(np.arange(len(words)), lengths)
    to_end = np.repeat(ends, lengths) - np.arange(n)
    owner, feature = [], []
    h = np.zeros(n, _U)
    for size in range(1, LONGEST_GRAM + 1):
        moved = np.zeros(n, _U)
        if size <= n:
            moved[: n - size + 1] = codes[size - 1 :]
        h = (h * _U(0x100000001B3) ^ moved) * _U(0x9E3779B97F4A7C15)
        ok = to_end >= size
        owner.append(word[ok])
        feature.append((h[ok] ^ _U(size)) >> _U(40))
    whole = np.zeros(len(words), _U)
    powers = (np.arange(n) - np.repeat(ends - lengths, lengths)).astype(_U)
    np.add.at(whole, word, (codes + _U(7)) * (powers * _U(2) + _U(1)) * _U(0xD6E8FEB86659FD93) ^ codes << _U(21))
    owner.append(np.arange(len(words)))
    feature.append((whole * _U(0xBF58476D1CE4E5B9)) >> _U(40))
    owner_, feature_ = np.concatenate(owner), (np.concatenate(feature) % _U(DIMENSIONS)).astype(np.int64)
    order = np.argsort(owner_, kind="stable")
    return np.searchsorted(owner_[order], np.arange(len(words) + 1)), feature_[order]


def _svm(phi: tuple, inst: tuple, y: np.ndarray, reg: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights of an L2-regularised squared-hinge machine; instances are weighted sets of words, words sets of features."""
    (p_at, p_feature, p_value), (i_row, i_word, i_value) = phi, inst
    words = len(p_at) - 1
    p_word = np.repeat(np.arange(words), np.diff(p_at))
    n = len(y)
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(DIMENSIONS)
    ahead, momentum, step = w.copy(), 0.0, 0.5
    bound = None
    for r in range(rounds):
        by_word = np.bincount(p_word, ahead[p_feature] * p_value, words)
        margin = y * np.bincount(i_row, by_word[i_word] * i_value, n)
        lack = np.maximum(0, 1 - margin)
        back = np.bincount(i_word, (-2 * balance * lack * y)[i_row] * i_value, words)
        gradient = np.bincount(p_feature, back[p_word] * p_value, DIMENSIONS) + reg * ahead
        new = ahead - step * gradient
        loss = float((balance * lack * lack).sum())
        if bound is not None and loss > 2 * bound + 1e-9:
            step *= 0.5
            ahead = w.copy()
            momentum = 0.0
            continue
        bound = loss
        t = (r + 1) / (r + 4)
        ahead = new + t * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    """Fitted weights: a column per family, then one per pair of languages of one family."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    known: frozenset[str]
    family_of: dict[str, str]

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], families: dict[str, str] | None = None, more: list[tuple[str, str]] = ()) -> LanguageModel:
        """From (language, sentence) pairs, and further texts of which fewer pieces are taken; those without a word are of no use."""
        families = FAMILIES if families is None else families
        words: dict[str, int] = {}
        labels, rows, cols, values = [], [], [], []
        for number, (lang, text) in enumerate([*samples, *more]):
            own = [t.lower() for t in tokens(text) if t[0].isalpha()]
            namelike = {t.lower() for t in tokens(text)[1:] if t[0].isupper() and not t.isupper() and lang != "de"}
            own = [t for t in own if t not in namelike] or own
            if not own:
                continue
            n = len(own)
            cuts = {(0, n), (0, (n + 1) // 2), (n // 2, n), *((a, min(n, a + 3)) for a in range(0, max(1, n - 2), 2)), *((a, a + 1) for a in range(0, n, 3))}
            if number >= len(samples):
                cuts = {(0, n), *((a, min(n, a + 6)) for a in range(0, n, 6))}
            for a, b in sorted(cuts):
                if b > a:
                    rows += [len(labels)] * (b - a)
                    cols += [words.setdefault(w, len(words)) for w in own[a:b]]
                    values += [1.0 / (b - a)] * (b - a)
                    labels.append(lang)
        langs = sorted(set(labels))
        family = {x: families.get(x, x) for x in langs}
        names = sorted(set(family.values()))
        pairs = [(a, b) for i, a in enumerate(langs) for b in langs[i + 1 :] if family[a] == family[b]]
        if not langs:
            return cls([], [], [], np.zeros((DIMENSIONS, 0), np.float32), frozenset(), {})
        at, feature = _grams(list(words))
        value = np.repeat(1.0 / np.sqrt(np.maximum(1, np.diff(at))), np.diff(at))
        phi, lab = (at, feature, value), np.array(labels)
        row, col, val = np.array(rows), np.array(cols), np.array(values)
        fam = np.array([family[x] for x in labels])
        columns = [_svm(phi, (row, col, val), np.where(fam == f, 1.0, -1.0)) for f in names]
        for a, b in pairs:
            pick = (lab == a) | (lab == b)
            number = np.cumsum(pick) - 1
            keep = pick[row]
            columns.append(_svm(phi, (number[row[keep]], col[keep], val[keep]), np.where(lab[pick] == a, 1.0, -1.0)))
        return cls(langs, names, pairs, np.stack(columns, 1).astype(np.float32), frozenset(words), family)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The machines' scores of each word."""
        at, feature = _grams(words)
        sums = np.add.reduceat(self.weights[feature], at[:-1], axis=0)
        return sums / np.sqrt(np.maximum(1, np.diff(at)))[:, None]

    def additive(self) -> np.ndarray:
        """Maps machine scores to additive scores by language: the family's, and the mean of the language's pairs."""
        out = np.zeros((self.weights.shape[1], len(self.languages)), np.float32)
        for i, x in enumerate(self.languages):
            out[self.families.index(self.family_of[x]), i] = 1.0
            own = [(j, 1.0 if a == x else -1.0) for j, (a, b) in enumerate(self.pairs, len(self.families)) if x in (a, b)]
            for j, sign in own:
                out[j, i] = sign / len(own)
        return out

    def decide(self, scores: np.ndarray) -> np.ndarray:
        """The language of each row of summed scores: the best family, then the winner of most pairs in it (ties by margin)."""
        family = np.argmax(scores[:, : len(self.families)], 1)
        index = {x: i for i, x in enumerate(self.languages)}
        votes = np.zeros((len(scores), len(self.languages)))
        for j, (a, b) in enumerate(self.pairs, len(self.families)):
            s = scores[:, j]
            small = 1e-3 * np.tanh(s / (1 + np.abs(s).max(initial=0.0)))
            votes[:, index[a]] += (s > 0) + small
            votes[:, index[b]] += (s <= 0) - small
        of = np.array([self.families.index(self.family_of[x]) for x in self.languages])
        return np.argmax(np.where(of[None, :] == family[:, None], votes, -np.inf), 1)


class Segmenter:
    """Segments of texts; one per task."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.additive = model.additive()
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}  # token -> row; 0 is a boundary sign
        self.table = np.zeros((1, self.model.weights.shape[1]), np.float32)
        self.solid = np.zeros(1, bool)

    def _look_up(self, seen: set[str]) -> None:
        if len(self.ids) > MEMO_ITEMS:
            self._clear()
        new = sorted(t for t in seen if t not in self.ids)
        words = [t for t in new if t[0].isalpha()]
        self.ids.update((t, 0) for t in new if not t[0].isalpha())
        if words:
            known = np.array([t.lower() in self.model.known for t in words])
            namelike = ~known & np.array([len(t) > 1 and t[0].isupper() and not t.isupper() for t in words])
            single = np.array([len(t) == 1 for t in words])
            weight = np.where(single, SINGLE, np.where(namelike, NAMELIKE, np.where(known, 1.0, UNSEEN))).astype(np.float32)
            self.ids.update(zip(words, range(len(self.table), len(self.table) + len(words))))
            self.table = np.concatenate([self.table, self.model.word_scores([t.lower() for t in words]) * weight[:, None]])
            self.solid = np.concatenate([self.solid, ~namelike & ~single])

    def segments(self, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
        """Per text its segments as (language, confidence, words); none for a text without words."""
        out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
        if not self.model.languages:
            return out
        cut = [tokens(t) if t else [] for t in texts]
        self._look_up(set(chain.from_iterable(cut)))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(cut)), sizes)
        word = np.flatnonzero(flat > 0)
        opens = np.r_[True, flat[:-1] == 0][: len(flat)]
        row, owner, opens = flat[word], text[word], opens[word]
        counts = np.bincount(owner, minlength=len(cut))
        starts = np.cumsum(counts) - counts
        order = np.argsort(counts, kind="stable")
        order = order[counts[order] > 0]
        runs: list[tuple[int, int, int]] = []
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * counts[order[b]] <= CELLS:
                b += 1
            runs += self._paths(order[a:b], starts, counts, row, opens)
            a = b
        if not runs:
            return out
        sums = np.zeros((len(row) + 1, self.table.shape[1]))
        np.cumsum(self.table[row], axis=0, out=sums[1:])
        for i, lang, conf, size in self._labelled(runs, sums, row):
            out[i].append((lang, conf, size))
        return out

    def _paths(self, texts: np.ndarray, starts: np.ndarray, counts: np.ndarray, row: np.ndarray, opens: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first word, end) of each stretch of one language on the best paths of some texts."""
        n, size = len(texts), counts[texts]
        longest = int(size.max())
        step = np.arange(longest)
        inside = step[None, :] < size[:, None]
        at = np.where(inside, starts[texts][:, None] + step[None, :], 0)
        emitted = np.where(inside[:, :, None], (self.table[row[at]].reshape(n * longest, -1) @ self.additive).reshape(n, longest, -1), np.float32(0))
        cost = np.where(opens[at] & inside, np.float32(BOUNDARY_COST), np.float32(INSIDE_COST))
        best = emitted[:, 0].copy()
        langs = best.shape[1]
        back = np.empty((longest, n, langs), np.int8)
        stay = np.arange(langs, dtype=np.int8)[None, :]
        every = np.arange(n)
        for t in range(1, longest):
            top = best.argmax(1)
            jump = (best[every, top] - cost[:, t])[:, None]
            moves = jump > best
            back[t] = np.where(moves, top[:, None].astype(np.int8), stay)
            best = np.where(moves, jump, best) + emitted[:, t]
        state = np.empty((n, longest), np.int8)
        state[:, -1] = best.argmax(1)
        for t in range(longest - 1, 0, -1):
            state[:, t - 1] = back[t][every, state[:, t]]
        fresh = np.concatenate([np.ones((n, 1), bool), state[:, 1:] != state[:, :-1]], 1) & inside
        r, c = np.nonzero(fresh)
        last = np.r_[r[1:] != r[:-1], True]
        end = np.where(last, size[r], np.r_[c[1:], 0])
        base = starts[texts][r]
        return list(zip(texts[r].tolist(), (base + c).tolist(), (base + end).tolist()))

    def _labelled(self, runs: list[tuple[int, int, int]], sums: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, str, float, int]]:
        """The segments of runs: labelled, without those too short for a clause, neighbours of one language joined."""
        text, a, b = (np.array(x) for x in zip(*runs))
        label = self.model.decide(sums[b] - sums[a])
        solid = np.concatenate([[0], np.cumsum(self.solid[row])])
        long = solid[b] - solid[a] >= LEAST_WORDS
        many = np.bincount(text)
        most = np.zeros(len(many), np.int64)
        np.maximum.at(most, text, b - a)
        any_long = np.zeros(len(many), bool)
        any_long[text[long]] = True
        keep = long | (~any_long[text] & (b - a == most[text]))
        text, a, b, label = text[keep], a[keep], b[keep], label[keep]
        order = np.lexsort((a, text))
        text, a, b, label = text[order], a[order], b[order], label[order]
        joined = np.r_[False, (text[1:] == text[:-1]) & (label[1:] == label[:-1])]
        first = np.flatnonzero(~joined)
        text, a, label, b = text[first], a[first], label[first], b[np.r_[first[1:] - 1, len(b) - 1]]
        total = sums[b] - sums[a]
        score = (total @ self.additive) * (2.0 / np.sqrt(b - a))[:, None]
        share = np.exp(score - score.max(1, keepdims=True))
        share = share[np.arange(len(share)), label] / share.sum(1)
        for i, x, conf, size in zip(text.tolist(), label.tolist(), share.tolist(), (b - a).tolist()):
            yield i, self.model.languages[x], conf, size


def _enough(text: str | None) -> bool:
    """Whether a text has MIN_CHARS letters and digits."""
    return bool(text) and len(canonical(text).translate({1: None, 2: None, 3: None})) >= MIN_CHARS


_SEGMENTS = "array<struct<lang: string, confidence: double, words: int>>"


def _segmented(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The columns but the last, which holds texts, with ``enough`` and the segments of each text."""
    segmenter = Segmenter(shared.value)
    for batch in batches:
        for a in range(0, batch.num_rows, 4000):
            part = batch.slice(a, 4000)
            texts = part.column(part.num_columns - 1).to_pylist()
            found = segmenter.segments(texts)
            flat = [s for f in found for s in f]
            enough = [len(f) > 0 and (sum(s[2] for s in f) >= MIN_CHARS or _enough(t)) for f, t in zip(found, texts)]
            each = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.float64()), pa.array([s[2] for s in flat], pa.int32())], ["lang", "confidence", "words"])
            offsets = pa.array(np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(enough, pa.bool_()), pa.ListArray.from_arrays(offsets, each)], [*part.schema.names[:-1], "enough", "found"])


def fit_model(samples: DataFrame, records: DataFrame | None = None) -> LanguageModel:
    """The model of a table of (sample_id, lang, text), of at most MAX_SAMPLES rows.

    If labelled ``records`` (record_id, lang, text) are given, the first model reads MORE_PER_LANGUAGE of them for each
    language, of 40 to 5,000 characters, and those whose label it confirms take part in a second fit, for a wider vocabulary.
    """
    rows = samples.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("sample_id", F.lower("lang").alias("lang"), "text")
    sure = [(r.lang, r.text) for r in rows.orderBy("sample_id", "lang", "text").limit(MAX_SAMPLES).collect()]
    model = LanguageModel.fit(sure)
    if records is None or not model.languages:
        return model
    label = F.lower(F.element_at(F.split(F.trim("lang"), "[-_]"), 1))
    labelled = records.select("record_id", label.alias("label"), "text").filter(F.col("record_id").isNotNull() & F.col("label").isin(model.languages) & F.length("text").between(40, 5_000))
    by = Window.partitionBy("label").orderBy(F.xxhash64("record_id"), "text")
    picked = sorted(labelled.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= MORE_PER_LANGUAGE).select("label", "record_id", "text").collect())
    found = Segmenter(model).segments([r.text for r in picked])
    more = [(r.label, r.text) for r, f in zip(picked, found) if len(f) == 1 and f[0][0] == r.label and f[0][1] > 0.9]
    return LanguageModel.fit(sure, more=more)


def _found(df: DataFrame, samples: DataFrame, record: str, text: str) -> DataFrame:
    """(record_id, label, enough, found): the segments of each record that has any, and its label, if the rows have one.

    Of deliveries whose texts differ, all segments are those of one delivery.
    """
    label = F.lower(F.element_at(F.split(F.trim("lang"), "[-_]"), 1)) if "lang" in df.columns else F.lit(None).cast("string")
    shared = df.sparkSession.sparkContext.broadcast(fit_model(samples, df.select(F.col(record).alias("record_id"), "lang", F.col(text).alias("text")) if "lang" in df.columns else None))
    rows = df.filter(F.col(record).isNotNull()).select(F.col(record).cast("bigint").alias("record_id"), label.alias("label"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(lambda it: _segmented(it, shared), f"record_id bigint, label string, enough boolean, found {_SEGMENTS}").filter(F.size("found") > 0)
    return found.groupBy("record_id").agg(F.max("label").alias("label"), F.max(F.struct("enough", "found")).alias("x")).select("record_id", "label", "x.*")


def _each(found: DataFrame) -> DataFrame:
    rows = found.select("*", F.posexplode("found").alias("at", "s"))
    return rows.select("record_id", "label", (F.col("at") + 1).cast("bigint").alias("seg_no"), F.size("found").cast("bigint").alias("segs"), "s.*", "enough")


def segments(df: DataFrame, samples: DataFrame, record: str = "record_id", text: str = "text") -> DataFrame:
    """(record_id, seg_no, segs, lang, confidence, words, enough) of every record, one row per segment.

    A record in one language has one segment. Records without a word (null, empty, numbers, links only) have none.
    ``enough`` tells whether the text has at least MIN_CHARS letters and digits. A record delivered again counts once.
    """
    return _each(_found(df, samples, record, text)).drop("label")


def wrong_labels(df: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_id, seg_no, lang): records in one language whose label is missing or another, and all segments of mixed ones.

    Labels compare without case and region; anything that is no known language is a missing label. Texts under
    MIN_CHARS letters and digits have no rows. Of labels that differ between deliveries the greatest counts. The table
    is read once after the fit, with its labels.
    """
    found = _each(_found(df, samples, "record_id", "text").filter("enough"))
    return found.filter((F.col("segs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("record_id", "seg_no", "lang")


def document_languages(df: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_id, lang, confidence, segs) per record: the language with most words, its best confidence, and the number of segments.

    Records without a word have the language ``und`` with confidence 0.
    """
    found = segments(df, samples).groupBy("record_id", "lang").agg(F.sum("words").alias("words"), F.max("confidence").alias("confidence"), F.max("segs").alias("segs"))
    best = found.groupBy("record_id").agg(F.max_by(F.struct("lang", "confidence", "segs"), F.struct("words", "lang")).alias("x")).select("record_id", "x.*")
    ids = df.filter(F.col("record_id").isNotNull()).select(F.col("record_id").cast("bigint").alias("record_id")).distinct()
    rows = ids.join(best, "record_id", "left")
    return rows.select("record_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"), F.coalesce("segs", F.lit(0)).alias("segs"))

"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are counted from its bytes (lengths, shares of character kinds, repeated words and lines). Each is binned at quantiles of the fitting
sample. Boosting goes round the features again and again: each round fits one shallow tree per feature to the gradient of the
logistic loss, over the feature's histogram, and adds a small step of it to that feature's lookup table. Then the pairs whose
residuals gain most are found, and their two-dimensional tables are boosted the same way. What is left of the model is tables; a text's score is the
logistic function of the sum of looked-up values, added up for whole batches at once.

The fitting sample is bounded: about `sample_docs` labelled rows, chosen by a hash of the key. Scores see whole texts of all documents.

Defined results: null and empty texts have zero features and get the model's score for them; rows with several labels count as labelled 1 if one says so;
without labelled rows the score is 0.5 for all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import blocks, distinct_per_text, hashes, runs, same_bytes, summed, words_at
from .common import released, spread

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "sign_share", "odd_sign_share", "space_share", "line_rate", "high_share",
    "repeated_sign_share", "distinct_word_share", "distinct_line_share", "log_longest_word", "stop_share", "adjacent_word_repeat",
]

_UPPER, _LOWER, _DIGIT, _SIGN, _ODD, _SPACE, _STOP = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN[33:127] = True
_SIGN &= ~(_UPPER | _LOWER | _DIGIT)
_ODD |= _SIGN
for _c in b".,;:?'\"-()":
    _ODD[_c] = False
for _c in b".?!":
    _STOP[_c] = True


def features(column: pa.Array) -> np.ndarray:
    found = [np.zeros((0, len(FEATURES)))]
    for _, n, data, offsets in blocks(column):
        share = np.zeros((n, len(FEATURES)))
        size = np.diff(offsets).astype(float)
        per = np.maximum(size, 1)

        def count(mask: np.ndarray, offsets=offsets) -> np.ndarray:
            return summed(mask.view(np.int8), offsets).astype(float)

        sign = _SIGN[data]
        upper, lower = count(_UPPER[data]), count(_LOWER[data])
        starts, ends = runs(~_SPACE[data], offsets)
        at = np.searchsorted(starts, offsets)
        n_words = np.diff(at).astype(float)
        words = np.maximum(n_words, 1)
        doc = np.repeat(np.arange(n), np.diff(at))
        eights = words_at(data)
        keys = hashes(data, starts, ends, eights)
        line_starts, line_ends = runs(data != 10, offsets)
        line_doc = np.repeat(np.arange(n), np.diff(np.searchsorted(line_starts, offsets)))
        n_lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
        same = np.zeros(len(data), bool)
        same[1:] = data[1:] == data[:-1]
        longest = np.zeros(n)
        np.maximum.at(longest, doc, (ends - starts).astype(float))
        again = np.zeros(len(keys), bool)
        after = np.flatnonzero((keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1]) & (ends[1:] - starts[1:] == ends[:-1] - starts[:-1]))
        again[after + 1] = same_bytes(eights, starts[after], eights, starts[after + 1], ends[after] - starts[after])
        share[:, 0], share[:, 1], share[:, 2] = np.log1p(size), np.log1p(n_words), summed(ends - starts, at) / words
        share[:, 3], share[:, 4], share[:, 5] = upper / np.maximum(upper + lower, 1), count(_DIGIT[data]) / per, count(sign) / per
        share[:, 6], share[:, 7], share[:, 8] = count(_ODD[data]) / per, count(_SPACE[data]) / per, count(data == 10) / words
        share[:, 9], share[:, 10] = count(data >= 0x80) / per, count(sign & same) / per
        share[:, 11] = distinct_per_text(data, starts, ends, keys, eights, doc, n) / words
        share[:, 12] = distinct_per_text(data, line_starts, line_ends, hashes(data, line_starts, line_ends, eights), eights, line_doc, n) / n_lines
        share[:, 13], share[:, 14], share[:, 15] = np.log1p(longest), count(_STOP[data]) / words, summed(again.astype(np.int64), at) / words
        found.append(share)
    return np.concatenate(found)


@dataclass
class Additive:
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.single):
            total += t[b[:, j]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """A shallow tree over the bins of one feature, as the value of each bin: Newton steps of the leaves."""
    value = np.zeros(len(g))

    def grow(lo: int, hi: int, depth: int) -> None:
        gs, hs = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if depth and hi - lo > 1:
            gl, hl = gs[:-1], hs[:-1]
            gain = gl**2 / (hl + 1) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + 1)
            gain[(hl < least) | (hs[-1] - hl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > gs[-1] ** 2 / (hs[-1] + 1) + 1e-9:
                grow(lo, lo + k + 1, depth - 1)
                grow(lo + k + 1, hi, depth - 1)
                return
        value[lo:hi] = gs[-1] / (hs[-1] + 1)

    grow(0, len(g), depth)
    return value


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """One cut of the first feature and a cut of the second on either side; the table of Newton steps and its gain."""
    best, table = -1.0, np.zeros(g.shape)
    for k in range(1, g.shape[0]):
        gain, value = 0.0, np.zeros(g.shape)
        for rows in (slice(0, k), slice(k, None)):
            one = _tree(g[rows].sum(0), h[rows].sum(0), 1, least)
            gain += float((one * g[rows].sum(0)).sum())
            value[rows] = one
        if gain > best:
            best, table = gain, value
    return table, best


def train(x: np.ndarray, y: np.ndarray, *, n_bins: int = 24, rounds: int = 150, rate: float = 0.15, n_pairs: int = 6, depth: int = 2, least: float = 1.0) -> Additive:
    model = Additive()
    if not len(y):
        return model
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1]))
        model.edges.append(cuts)
        model.single.append(np.zeros(len(cuts) + 1))
    b, total = model.bins(x), np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(model.single):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), depth, least)
            t += step
            total += step[b[:, j]]
    sizes = [len(t) for t in model.single]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, i] * sizes[j] + b[:, j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h), least)[1], i, j) for i, j in combinations(range(len(sizes)), 2)), reverse=True)
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in gains[:n_pairs]]
    for _ in range(rounds // 5):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), least)[0]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def _kernel(model, threshold: float | None, where: int, name: str):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.value.score(features(b.column(where)))
            yield b.filter(pa.array(score >= threshold)) if threshold is not None else pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["id", name])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, sample_docs: int = 20_000, label_col: str = "quality", key_col: str = "doc_id", text_col: str = "text", **kw) -> Additive:
    """Fits the model on a bounded sample of the labelled rows that `learn` (over a column named as key_col) admits."""
    rows = labels.select(F.col(key_col), F.col(label_col).alias("y")).filter(learn & F.col("y").isNotNull() & F.col(key_col).isNotNull())
    n = rows.count()
    spread = F.pmod(F.xxhash64(F.lit("sample"), F.col(key_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(spread < min(1.0, sample_docs / max(n, 1))).groupBy(F.col(key_col).alias("key")).agg(F.max("y").alias("y"))
    # about sample_docs rows of two numbers: bounded, whatever the corpus' size
    joined = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = joined.select(F.col("y").cast("double").alias("y"), "text").mapInArrow(run, "y double, x array<double>").collect()
    got.sort(key=lambda r: (r["x"], r["y"]))  # the sums of floats shall not depend on the order in which tasks end
    return train(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got]), **kw)


def score(docs: DataFrame, model: Additive, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id and score. One pass, no shuffle."""
    d = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(_kernel(sent, None, 1, "score"), f"id {d.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Additive, threshold: float = 0.3, *, text_col: str = "text") -> DataFrame:
    """The documents with a score of threshold or more, with all their columns. One pass, no shuffle, no join."""
    return spread(docs).mapInArrow(_kernel(docs.sparkSession.sparkContext.broadcast(model), threshold, docs.columns.index(text_col), ""), docs.schema)

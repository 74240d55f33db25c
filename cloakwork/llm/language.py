"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the characters of its words (lower-cased, one boundary before and after), of order 5 by default: the
highest order counts occurrences, the lower ones the distinct characters to the left, and every order gives the mass its absolute discount
takes to the order below, down to a uniform floor. The models of all languages lie side by side in arrays sorted by the
n-gram's hash: one search finds an n-gram's discounted probability in every language.

A text's cross-entropy in a language is the mean of its words' character losses. The lowest wins. `rejected` is set where a text has no letter,
or where even the lowest cross-entropy lies above what calibration texts (a tenth of the fitting sample, held back) show: the mean of that language's
and `margin` times the 99 % quantile of all texts' excess over their language's mean, more for short texts, whose mean varies. Text in a language that
was not learnt, or that is no language, lies beyond it; a learnt language with names, numbers or another learnt language in it doesn't.

The fitting sample is bounded: about `sample_docs` documents of each language, chosen by a hash of the key, whatever the corpus' size.
Everything else sees whole texts and all documents.

Defined results: `und` with score 0 for a null text or one without a letter; ties go to the language that sorts first; without a learnable
document, every text is `und`. The score is the softmax of the texts' log-likelihood per character over the languages (times `sharpness`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkStore, blocks, mixed, runs, summed
from .common import released, spread

BOUNDARY = 2
CHUNKS, SLICE = 400_000, 4096  # words that a worker remembers, and that it solves at once
SHARPNESS = 8.0
LEAST_CALIBRATION, LEAST_SPREAD = 20, 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case (ASCII and the Latin-1 letters), and starts and ends of the words."""
    lower = _LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    lower[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return (lower, *runs(_LETTER[lower], offsets))


def _characters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, a boundary before and after each, and which word each belongs to."""
    text = "".join([chr(BOUNDARY) + w.decode("utf-8", "replace") + chr(BOUNDARY) for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return points, np.cumsum(points == BOUNDARY) - 1 >> 1


def _grams(points: np.ndarray, word: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order, hash of the n-gram that ends at each place, and whether it lies in one word."""
    found, h = [], np.zeros(len(points), np.uint64)
    inside = np.ones(len(points), bool)
    for n in range(1, order + 1):
        shifted = np.zeros(len(points), np.uint64)
        shifted[n - 1 :] = points[: len(points) - n + 1]
        h = mixed(h ^ (shifted + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15))
        if n > 1:
            same = np.zeros(len(points), bool)
            same[n - 1 :] = word[n - 1 :] == word[: len(points) - n + 1]
            inside &= same
        found.append((h, inside.copy()))
    return found


@dataclass
class KneserNey:
    """Sorted hash arrays: for each order the n-grams' hashes with discounted probabilities, and the contexts' with the mass they pass down."""

    languages: list[str]
    order: int = 5
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: dict[str, tuple[float, float]] = field(default_factory=dict)  # mean and spread of calibration texts

    @classmethod
    def fit(cls, counts: dict[str, dict[bytes, int]], order: int = 5) -> KneserNey:
        """counts: word counts of each language."""
        self = cls(sorted(counts), order)
        grams: list[list] = [[] for _ in range(order)]
        contexts: list[list] = [[] for _ in range(order)]
        floor = []
        for language in self.languages:
            found = counts[language]
            points, word = _characters(list(found))
            weight = np.fromiter(found.values(), np.int64, len(found))[word]
            real = np.ones(len(points), bool)
            real[1:] = word[1:] == word[:-1]
            real[0] = False  # the boundary before a word is context only
            hs = _grams(points, word, order)
            floor.append(1.0 / (len(np.unique(points)) + 1))
            # hash of each n-gram without its last character: that of the (n-1)-gram one place before
            for n in range(order, 0, -1):
                h, inside = hs[n - 1]
                # words shorter than the order keep their longest n-grams, which begin at the boundary, as whole histories
                use = real & inside
                keys = h[use]
                history = np.zeros(len(points), np.uint64)
                if n > 1:
                    history[1:] = hs[n - 2][0][:-1]
                begins = np.zeros(len(points), bool)  # n-grams that begin at the word's boundary have nothing to their left
                if n < order:
                    _, longer = hs[n]
                    begins = use & ~longer
                    left = hs[n][0]
                    kept = use & longer
                    types, first = np.unique(left[kept], return_index=True)
                    at = np.flatnonzero(kept)[first]
                    key_types, history_types, number = h[at], history[at], np.ones(len(at), np.int64)
                    b = np.flatnonzero(begins)
                    key_all = np.concatenate([key_types, h[b]])
                    history_all = np.concatenate([history_types, history[b]])
                    number = np.concatenate([number, weight[b]])
                else:
                    key_all, history_all, number = keys, history[use], weight[use]
                k, first, inverse = np.unique(key_all, return_index=True, return_inverse=True)
                c = np.bincount(inverse, number, len(k))
                own = history_all[first]
                ones, twos = int((c == 1).sum()), int((c == 2).sum())
                discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
                hk, hi = np.unique(own, return_inverse=True)
                total, kinds = np.bincount(hi, c, len(hk)), np.bincount(hi, minlength=len(hk))
                grams[n - 1].append((k, np.maximum(c - discount, 0) / total[hi]))
                contexts[n - 1].append((hk, np.minimum(1.0, discount * kinds / total)))
        self.floor = np.array(floor)
        for n in range(order):
            for parts, empty, to in ((grams[n], 0.0, self.grams), (contexts[n], 1.0, self.contexts)):
                keys = np.unique(np.concatenate([k for k, _ in parts]))
                values = np.full((len(keys), len(parts)), empty, np.float32)
                for j, (k, v) in enumerate(parts):
                    values[np.searchsorted(keys, k), j] = v
                to.append((keys, values))
        return self

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, empty: float) -> np.ndarray:
        keys, values = table
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        found = values[at]
        found[keys[at] != h] = empty
        return found

    def losses(self, words: list[bytes]) -> np.ndarray:
        """For each word: characters (with its end) and the loss in nats in each language."""
        points, word = _characters(words)
        p = np.broadcast_to(self.floor, (len(points), len(self.languages))).copy()
        history = np.zeros(len(points), np.uint64)
        for n, (h, inside) in enumerate(_grams(points, word, self.order), 1):
            held = np.flatnonzero(inside)
            p[held] = self._find(self.grams[n - 1], h[held], 0.0) + self._find(self.contexts[n - 1], history[held], 1.0) * p[held]
            history = np.zeros(len(points), np.uint64)
            history[1:] = h[:-1]
        real = np.ones(len(points), bool)
        real[1:] = word[1:] == word[:-1]
        real[0] = False
        loss = -np.log(p) * real[:, None]
        first = np.flatnonzero(~real)
        return np.concatenate([np.add.reduceat(real.astype(float), first)[:, None], np.add.reduceat(loss, first)], 1)


class Scorer:
    def __init__(self, model: KneserNey, margin: float):
        self.model, self.margin, self.width = model, margin, len(model.languages) + 1
        self.store = ChunkStore(lambda w: [x for lo in range(0, len(w), SLICE) for x in model.losses(w[lo : lo + SLICE]).astype(np.float32)], np.float32, CHUNKS)

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy (nan: no letter) and whether it is rejected, of each text."""
        names, scores, entropies, rejects = [], [], [], []
        languages = [*self.model.languages, "und"]
        for lo, n, data, offsets in blocks(column):
            lower, starts, ends = letters(data, offsets)
            best, score, entropy = np.full(n, len(languages) - 1), np.zeros(n), np.full(n, np.nan)
            if len(languages) > 1 and len(starts):
                values = self.store.gather(self.store.codes(lower, starts, ends))[0].reshape(-1, self.width)
                at = np.searchsorted(starts, offsets)
                total = np.stack([summed(values[:, j].astype(np.float64), at) for j in range(self.width)], 1)
                ascii_letter = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
                some = np.flatnonzero(total[:, 0] > 0)
                sure = ascii_letter[offsets[some + 1]] > ascii_letter[offsets[some]]
                for i in np.flatnonzero(~sure):  # only bytes outside ASCII: they may be signs
                    sure[i] = any(map(str.isalpha, column[lo + int(some[i])].as_py()))
                some = some[sure]
                mean = total[some, 1:] / total[some, :1]
                best[some] = mean.argmin(1)
                entropy[some] = mean.min(1)
                score[some] = 1 / np.exp(SHARPNESS * (entropy[some, None] - mean)).sum(1)
                bound = np.array([self.model.limit.get(x, (math.inf, 0.0)) for x in self.model.languages])
                reject = np.ones(n, bool)
                mid, spread = bound[best[some]].T
                reject[some] = entropy[some] > mid + self.margin * spread * (1 + 8 / np.sqrt(total[some, 0]))
            else:
                reject = np.ones(n, bool)
            names += [languages[i] for i in best.tolist()]
            scores.append(score)
            entropies.append(entropy)
            rejects.append(reject)
        flat = [np.concatenate([*x, np.zeros(0)]) for x in (scores, entropies)]
        return names, *flat, np.concatenate([*rejects, np.zeros(0, bool)])


def sampled(docs: DataFrame, learn: Column, per_class: int, total: int) -> DataFrame:
    """About per_class of the rows (k, lang, text) of each language, `total` in all at most, chosen by a hash of the key: the counts of the languages set their shares."""
    rows = docs.filter(learn & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one number per language
    if not counts:
        return rows.limit(0)
    wanted = min(per_class, max(1, total // len(counts)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, wanted / n)))])
    spread = F.pmod(F.xxhash64(F.lit("sample"), F.col("k")), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(spread < share[F.col("lang")])


def fit(docs: DataFrame, learn: Column, *, order: int = 5, sample_docs: int = 600, sample_total: int = 6000, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id") -> KneserNey:
    """Fits the models on a bounded sample of the labelled documents that `learn` (over a column k, the key) admits."""
    rows = sampled(docs.select(F.col(key_col).alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), learn, sample_docs, sample_total)
    place = F.xxhash64(F.lit("place"), "k", "text")
    counts: dict[str, dict[bytes, int]] = {}
    held: dict[str, list[str]] = {}
    # the sample is bounded; its order doesn't depend on how Spark cuts the table
    for r in sorted(rows.filter("length(text) > 0").select("lang", place.alias("place"), "text").collect()):
        language = r["lang"]
        if r["place"] % 10 == 9:
            held.setdefault(language, []).append(r["text"])
            continue
        own = counts.setdefault(language, {})
        for _, _, data, offsets in blocks(pa.array([r["text"]])):
            lower, starts, ends = letters(data, offsets)
            raw = lower.tobytes()
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                w = raw[a:b]
                own[w] = own.get(w, 0) + 1
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return KneserNey([], order)
    model = KneserNey.fit(counts, order)
    scorer, mids, excess = Scorer(model, 0.0), {}, [np.zeros(0)]
    for language in model.languages:
        own = scorer.score(pa.array(held.get(language, []), pa.string()))[2]
        own = own[~np.isnan(own)]
        if len(own):
            mids[language] = float(own.mean())
            excess.append(own - mids[language])
    pooled = np.concatenate(excess)
    if len(pooled) >= LEAST_CALIBRATION:  # one spread for all: a single language has too few texts for its tail
        spread = max(LEAST_SPREAD, float(np.quantile(pooled, 0.99)))
        model.limit = {x: (mids.get(x, max(mids.values())), spread) for x in model.languages}
    return model


def identify(docs: DataFrame, model: KneserNey, *, margin: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, lang_pred, score, cross_entropy and rejected. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, margin)
        for b in batches:
            names, score, entropy, reject = scorer.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(reject)], ["id", "lang_pred", "score", "cross_entropy", "rejected"])

    d = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: KneserNey, *, margin: float = 3.0, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns. One pass, no shuffle, no join."""
    sent, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, margin)
        for b in batches:
            yield b.filter(pa.array(~scorer.score(b.column(where))[3]))

    return spread(docs).mapInArrow(run, docs.schema)

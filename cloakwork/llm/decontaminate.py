"""Benchmark decontamination over suffix arrays of the training texts.

Training texts are dealt with in shards, slices of the Arrow batches that a task reads, so nothing is shuffled. In each shard:

1. Words become numbers of the benchmark's vocabulary, all others -1.
2. Places where the next `anchor` words are no run of words of any test item can begin no match that counts, and are left
   out by a lookup that never misses one and may let a few more through. What is left, runs of words with a mark between them, is the
   shard's training string. Words are compared byte by byte, not by a hash alone.
3. Its suffix array is built by prefix doubling, to the depth of the longest test item.
4. Every suffix of every test item is searched in it by binary search, word by word, for all suffixes at once. That gives
   the interval of places that hold its window, and its longest verbatim match with the places.

Occurrences of windows mark words as hit; documents with a hit word are affected.

The test items are the stated query set. They come to the executors in blocks of about `block_words` words, one broadcast at a time: with several blocks
there is a pass over the texts for each, and between passes a table in the shared folder holds the rows with the words hit so far, a bit each, and
the items found. One item is in one block whole, so an item's length bounds a block from below.

Defined results: null texts and items have no words, thus no window; an item without an id takes no part; equal items
count each under its own id; equal rows of documents each get a row; no items: nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ByteIndex, HashIndex, blocks, gathered, hashes, mixed, per_text, runs, summed, words_at
from .common import WORD_TABLE, released, spread, stored, words

TABLE = np.frombuffer(WORD_TABLE, np.uint8)
SHARD_BYTES = 8 << 20


class TestItems:
    """The windows of a block of test items, and all their words as one string for the search."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = 10):
        found = [(str(i), w) for i, t in items if i is not None and (w := words(t))]
        vocabulary = sorted({x for _, w in found for x in w})
        number = {x: k for k, x in enumerate(vocabulary)}
        self.ids = [i for i, _ in found]
        self.names = np.array(self.ids, object)
        raw = b"".join(vocabulary)
        self.vocabulary = np.frombuffer(raw, np.uint8), np.cumsum([len(x) for x in vocabulary], dtype=np.int64)
        sizes = np.array([len(w) for _, w in found], np.int64)
        self.words = np.array([number[x] for _, w in found for x in w], np.int32)
        self.item = np.repeat(np.arange(len(found)), sizes)
        self.left = np.concatenate([np.arange(n, 0, -1) for n in sizes]) if found else np.zeros(0, np.int64)  # words up to the item's end
        self.window = np.minimum(window, sizes)[self.item] if found else np.zeros(0, np.int64)
        self.is_window = self.left >= self.window
        self.longest = int(sizes.max(initial=0))
        self.anchor = int(min(3, self.window.min(initial=3)))
        self.index: tuple[ByteIndex, HashIndex] | None = None

    def ready(self) -> tuple[ByteIndex, HashIndex]:
        """Numbers of the items' words, and their runs of `anchor` words."""
        if self.index is None:
            data, ends = self.vocabulary
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            vocabulary = ByteIndex(max(16, len(ends)))
            vocabulary.add(data, starts, ends, hashes(data, starts, ends))
            grams = np.unique(_grams(self.words, self.anchor)[self.left[: max(0, len(self.words) - self.anchor + 1)] >= self.anchor])
            anchors = HashIndex(max(16, len(grams)))
            anchors.add(grams, np.arange(len(grams), dtype=np.int32))
            self.index = vocabulary, anchors
        return self.index


def _grams(numbers: np.ndarray, k: int) -> np.ndarray:
    """A key for each k consecutive numbers."""
    n = max(0, len(numbers) - k + 1)
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key = mixed(key * np.uint64(0x100000001B3) + numbers[j : j + n].astype(np.int64).astype(np.uint64) + np.uint64(7))
    return key | np.uint64(1)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of what follows them, compared to `depth` words at least, by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, h = rank.astype(np.int64), 1
    while h < depth:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        new = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        h *= 2
    return np.argsort(rank, kind="stable")


def _bound(text, array, low, high, depth, want, upper):
    """Binary search in each [low, high): the first place whose word at `depth` is not below (upper: is above) the one wanted."""
    low, high = low.copy(), high.copy()
    n = len(text)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        at = array[np.minimum(mid, n - 1)] + depth
        word = np.where(at < n, text[np.minimum(at, n - 1)], -2)
        right = open_ & ((word <= want) if upper else (word < want))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)


def search(text: np.ndarray, array: np.ndarray, items: TestItems) -> dict[str, np.ndarray]:
    """For every test suffix: the interval of its window (if it has one), and length and first place of its longest match."""
    n = len(items.words)
    low, high = np.zeros(n, np.int64), np.full(n, len(text), np.int64)
    window_low, window_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    length, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    active, depth = np.arange(n), 0
    while len(active) and depth < items.longest:
        active = active[items.left[active] > depth]
        want = items.words[active + depth]
        lo = _bound(text, array, low[active], high[active], depth, want, False)
        hi = _bound(text, array, lo, high[active], depth, want, True)
        active, lo, hi = (x[hi > lo] for x in (active, lo, hi))
        depth += 1
        low[active], high[active] = lo, hi
        length[active], place[active] = depth, array[lo]
        full = active[(items.window[active] == depth) & items.is_window[active]]
        window_low[full], window_high[full] = low[full], high[full]
    return {"low": window_low, "high": window_high, "length": length, "place": place}


class Shard:
    """The words of a slice of training texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = TABLE[data]
        self.starts, self.ends = runs(lower != 32, offsets)
        self.lower, self.eights = lower, words_at(lower)
        self.hashes = hashes(lower, self.starts, self.ends, self.eights)
        self.n_words = per_text(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.hit = np.zeros(len(self.starts), bool)

    def find(self, items: TestItems) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """The search's result, the suffix array, and the word that each place of the training string is (-1: a mark)."""
        vocabulary, anchors = items.ready()
        number = vocabulary.find(self.lower, self.starts, self.ends, self.hashes, self.eights)
        k, n = items.anchor, len(number)
        m = max(0, n - k + 1)
        good = np.ones(m, bool)
        for j in range(k):
            good &= number[j : j + m] >= 0
        good &= self.doc[:m] == self.doc[k - 1 : k - 1 + m]
        maybe = np.flatnonzero(good)
        if len(maybe):
            key = np.zeros(len(maybe), np.uint64)
            for j in range(k):
                key = mixed(key * np.uint64(0x100000001B3) + number[maybe + j].astype(np.int64).astype(np.uint64) + np.uint64(7))
            maybe = maybe[anchors.find(key | np.uint64(1)) >= 0]
        if not len(maybe):
            none = np.zeros(len(items.words), np.int64)
            return {"low": none, "high": none, "length": none, "place": none}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, maybe, 1)
        np.add.at(step, maybe + k, -1)
        kept = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        new = np.ones(len(kept), np.int64)  # a mark before each run of words
        new[1:] = (kept[1:] != kept[:-1] + 1) | (self.doc[kept[1:]] != self.doc[kept[:-1]])
        at = np.arange(len(kept)) + np.cumsum(new)
        text, source = np.full(len(kept) + int(new.sum()), -1, np.int32), np.full(len(kept) + int(new.sum()), -1, np.int64)
        text[at], source[at] = number[kept], kept
        array = suffix_array(text, items.longest)
        return search(text, array, items), array, source

    def mark(self, items: TestItems) -> tuple[np.ndarray, np.ndarray]:
        """Marks the words in occurrences of windows. Returns pairs (text, item) without repetition."""
        found, array, source = self.find(items)
        some = np.flatnonzero(found["high"] > found["low"])
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = items.window[some]
        # equal windows have equal intervals: each is expanded once
        own = np.stack([found["low"][some], found["high"][some], size], 1)
        own, which = np.unique(own, axis=0, return_inverse=True)
        which = which.reshape(-1)
        count = own[:, 1] - own[:, 0]
        place = gathered(array, own[:, 0], count)
        step = np.zeros(len(source) + 1, np.int32)
        np.add.at(step, place, 1)
        np.add.at(step, place + np.repeat(own[:, 2], count), -1)
        self.hit[source[np.cumsum(step[:-1]) > 0]] = True
        docs = self.doc[source[place]]
        pair = np.unique(docs * len(own) + np.repeat(np.arange(len(own)), count))
        docs, windows = pair // len(own), pair % len(own)
        order = np.argsort(which, kind="stable")  # items of each window
        of_window = np.searchsorted(which[order], np.arange(len(own) + 1))
        n_items = np.diff(of_window)
        chosen = gathered(items.item[some][order], of_window[windows], n_items[windows])
        pair = np.unique(np.repeat(docs, n_items[windows]) * len(items.ids) + chosen)
        return pair // len(items.ids), pair % len(items.ids)


def item_blocks(items: DataFrame, window: int, block_words: int, id_col: str, text_col: str) -> Iterator[TestItems]:
    """The test items in blocks of a bounded size, at least one; the driver holds one block, and one partition of its texts, at a time."""
    chosen = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = 6 * block_words  # bytes
    held, total = [], 0
    for r in chosen.repartition(int(1 + size // most), "id").toLocalIterator() if size > most else chosen.collect():
        more = len(r["text"] or "")
        if held and total + more > most:
            yield TestItems(held, window)
            held, total = [], 0
        held.append((r["id"], r["text"]))
        total += more
    yield TestItems(held, window)


Finish = Callable[[list[pa.Array], Shard, list[list[str]]], pa.RecordBatch]


def _over_blocks(source: DataFrame, where: int, tests: Iterator[TestItems], finish: Finish, schema) -> DataFrame:
    """The rows of source, whose column `where` is the text, with all items marked: `finish` makes the result's rows of each shard's."""
    spark, n_columns = source.sparkSession, len(source.columns)
    between = T.StructType([*source.schema.fields, T.StructField("__hit", T.BinaryType()), T.StructField("__items", T.ArrayType(T.StringType()))])
    held, test = source, next(tests)
    while True:
        following = next(tests, None)
        sent = spark.sparkContext.broadcast(test)

        @released
        def run(batches: Iterator[pa.RecordBatch], sent=sent, goes_on=held is not source, last=following is None) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, n, data, offsets in blocks(b.column(where), SHARD_BYTES):
                    part, shard = b.slice(lo, n), Shard(data, offsets)
                    first = np.concatenate([[0], np.cumsum(shard.n_words)])
                    names: list[list[str]] = part.column(n_columns + 1).to_pylist() if goes_on else [[] for _ in range(n)]
                    if goes_on:
                        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(m)) for x, m in zip(part.column(n_columns).to_pylist(), shard.n_words, strict=True)]
                        shard.hit |= np.concatenate(bits).astype(bool)
                    for d, i in zip(*(x.tolist() for x in shard.mark(sent.value)), strict=True):
                        names[d].append(sent.value.ids[i])
                    columns = part.columns[:n_columns]
                    if last:
                        yield finish(columns, shard, names)
                    else:
                        bits = [np.packbits(shard.hit[i:j]).tobytes() for i, j in zip(first.tolist(), first.tolist()[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))], between.names)

        if following is None:
            return held.mapInArrow(run, schema)
        held, test = stored(held.mapInArrow(run, between), "marked"), following
        sent.destroy()


def _n_hit(shard: Shard) -> np.ndarray:
    return summed(shard.hit.astype(np.int64), np.concatenate([[0], np.cumsum(shard.n_words)]))


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, block_words: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: its id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated."""

    def finish(columns: list[pa.Array], shard: Shard, names: list[list[str]]) -> pa.RecordBatch:
        n_hit = _n_hit(shard)
        out = [columns[0], pa.array(shard.n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(n_hit > 0)]
        return pa.RecordBatch.from_arrays(out, ["id", "n_words", "n_hit", "n_items", "items", "contaminated"])

    d = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    schema = f"id {d.schema['id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean"
    return _over_blocks(d, 1, item_blocks(items, window, block_words, item_col, item_text), finish, schema).withColumnRenamed("id", id_col)


def longest_matches(docs: DataFrame, items: DataFrame, *, least: int = 10, block_words: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For every test suffix (item, word it begins at) with a match of `least` words or more: the longest one's length, and the document and word where it stands (the smallest)."""
    sc = docs.sparkSession.sparkContext
    d = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    found = None
    for test in item_blocks(items, least, block_words, item_col, item_text):
        sent = sc.broadcast(test)

        @released
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, _, data, offsets in blocks(b.column(1), SHARD_BYTES):
                    shard, it = Shard(data, offsets), sent.value
                    first = np.concatenate([[0], np.cumsum(shard.n_words)])
                    found, _, source = shard.find(it)
                    some = np.flatnonzero(found["length"] >= np.minimum(least, it.window))
                    some = some[found["length"][some] > 0]
                    word = source[found["place"][some]]
                    doc = shard.doc[word]
                    begin = np.searchsorted(it.item, it.item[some])
                    out = [pa.array(it.names[it.item[some]].tolist(), pa.string()), pa.array(some - begin, pa.int64()), pa.array(found["length"][some], pa.int64()), b.column(0).slice(lo).take(pa.array(doc)), pa.array(word - first[doc], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, ["item", "item_word", "length", "id", "word"])

        each = d.mapInArrow(run, f"item string, item_word long, length long, id {d.schema['id'].dataType.simpleString()}, word long")
        best = each.groupBy("item", "item_word").agg(F.min(F.struct((-F.col("length")).alias("l"), "id", "word")).alias("b"))
        best = stored(best.select(F.col("item").alias(item_col), "item_word", (-F.col("b.l")).alias("length"), F.col("b.id").alias(id_col), F.col("b.word").alias("word")), "matches")
        found = best if found is None else found.union(best)
        sent.destroy()
    return found


def remove_contaminated(docs: DataFrame, items: DataFrame, *, max_hit_share: float = 0.0, window: int = 10, block_words: int = 4_000_000, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a hit word, or with at most this share of their words hit, with all their columns. One pass for each block of items, no join."""

    kept = docs.columns

    def finish(columns: list[pa.Array], shard: Shard, names: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, kept).filter(pa.array(_n_hit(shard) <= max_hit_share * shard.n_words))

    return _over_blocks(spread(docs), docs.columns.index(text_col), item_blocks(items, window, block_words, item_col, item_text), finish, docs.schema)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()

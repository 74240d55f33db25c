"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. A document becomes its words (ASCII letters lower-cased) with one space between them. Documents of equal words are one node, known by a 128-bit
   digest of them; only nodes go on, so copies never meet in pairs. A node's signature is the low 8 bits of 160 MinHash values of its word n-grams (five words).
2. Nodes that share five signature values in one of 32 bands meet in that band's bucket. Two sets of similarity 0.8 miss all bands with
   a probability of 3e-6; other thresholds get the widest bands with at most that.
3. Buckets of more than `block` nodes, or of more than `block_bytes` of text, are dealt into pairs of blocks, so a hot bucket is many tasks of bounded
   size. A pair that meets in several bands is looked at in the first only. Its signatures are compared eight bands at a time, and it is dropped as soon as the
   posterior probability that its similarity reaches the threshold, given the matches so far and a uniform prior, is below `tolerance`.
4. The texts of the nodes that are left are read again; their pairs are verified exactly: n-grams are equal if their words are, byte by byte, and
   no hash decides. A task keeps, of the verified links, each node's number of linked documents and a spanning forest: rows grow with the nodes, not
   with the pairs.
5. Components of the forest edges are the classes. Each document gets its class (the smallest id in it) and the number
   of other documents that it is linked with (copies of its own text included).

Defined results: a text of one to four words has one n-gram, all its words, so it links with texts of the same words only; null texts and texts without a word are
alone in their class, with the class id that is their own id, and link with nothing; rows of equal ids and texts each get a row; a null id never becomes a
class id unless the class has no other. Similarity at the threshold counts as a link. An empty table gives no row. All columns but id and text are left out
of `similar_documents` and kept by `one_of_each`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import blocks, distinct, hashes, mixed, runs
from .common import WORD_TABLE, released, spread, stored, whole_groups, words
from .components import components

HASHES, CHUNK = 160, 40
MISS = 4e-6
_rng = np.random.default_rng(7)
_FACTOR = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)
_TABLE = np.frombuffer(WORD_TABLE, np.uint8)


def rows_per_band(threshold: float) -> int:
    """The widest bands by which pairs at the threshold meet but for a probability of MISS."""
    return max([1, *(r for r in (2, 4, 5, 8, 10) if (1 - threshold**r) ** (HASHES // r) <= MISS)])


@lru_cache(16)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For CHUNK, 2 * CHUNK, ... compared values: fewer matches than this, and the posterior is below the tolerance.

    Two values match with probability q = s + (1 - s) / 256; with a uniform prior, P(q >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    t, found = threshold + (1 - threshold) / 256, []
    for n in range(CHUNK, HASHES + 1, CHUNK):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                found.append(m)
                break
    return tuple(found)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, for signatures; none for a text of fewer words."""
    for _, rows, data, offsets in blocks(column):
        lower = _TABLE[data]
        starts, ends = runs(lower != 32, offsets)
        word = hashes(lower, starts, ends)
        grams = np.zeros(len(word), np.uint64)
        for j in range(n):
            shifted = np.zeros(len(word), np.uint64)
            shifted[: max(0, len(word) - j)] = word[j:]
            grams = mixed(grams * np.uint64(0x100000001B3) + shifted)
        at = np.searchsorted(starts, offsets).tolist()
        for i in range(rows):
            yield np.unique(grams[at[i] : max(at[i], at[i + 1] - n + 1)])


def exact_sets(bodies: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct n-grams of each body, words with a space between them, as numbers: equal ones stand for equal words. A body of fewer words has one of its own."""
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    starts, ends = runs(data != 32, offsets)
    word, first = distinct(data, starts, ends)
    word, many = word.astype(np.int64), max(1, len(first))
    gram = word
    for j in range(1, n):  # a gram and the word after it make the next longer gram
        gram = np.unique(gram[: max(0, len(word) - j)] * many + word[j:], return_inverse=True)[1]
    at = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(bodies)), np.diff(at))[: len(gram)]
    whole = np.arange(len(gram)) + n <= at[1:][row]
    size = int(gram.max(initial=0)) + 1
    pair = np.unique(row[whole] * size + gram[whole])
    found = np.split(pair % size, np.searchsorted(pair // size, np.arange(1, len(bodies))))
    return [x if len(x) else np.array([-1 - i]) for i, x in enumerate(found)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The low bytes of the MinHash values of non-empty sets, a row each."""
    sizes = np.array([len(s) for s in sets])
    first, flat = np.cumsum(sizes) - sizes, np.concatenate(sets)
    out = np.empty((len(sets), HASHES), np.uint8)
    for i in range(HASHES):
        out[:, i] = (np.minimum.reduceat(flat * _FACTOR[i] + _SHIFT[i], first) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(56)
    return out


def _body(text: str | None) -> bytes:
    return b" ".join(words(text))


def _digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def sketches(docs: DataFrame, n: int, band: int, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, size, sig, bands): digest is null where a text has no word, sig and bands also where it has fewer than n. A band's key holds its number and its values."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                bodies = [_body(t.as_py()) for t in part.column(1)]
                sets = list(shingle_sets(part.column(1), n))
                some = [s for s in sets if len(s)]
                sig = signatures(some) if some else np.zeros((0, HASHES), np.uint8)
                rows = iter(zip(sig, band_keys(sig, band).tolist(), strict=True))
                found = [next(rows) if len(s) else None for s in sets]
                columns = [
                    part.column(0), pa.array([_digest(x) if x else None for x in bodies], pa.binary()), pa.array([len(x) for x in bodies], pa.int64()),
                    pa.array([x and x[0].tobytes() for x in found], pa.binary()), pa.array([x and x[1] for x in found], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "size", "sig", "bands"])

    d = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, digest binary, size long, sig binary, bands array<long>")


def band_keys(sig: np.ndarray, band: int) -> np.ndarray:
    """A key per band: for bands of up to five values the values themselves, for wider ones a hash of them; the band's number on top."""
    parts = sig.reshape(len(sig), HASHES // band, band).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for j in range(band):
        key = key << np.uint64(8) | parts[:, :, j] if band <= 5 else mixed(key * np.uint64(257) + parts[:, :, j])
    return (key & np.uint64((1 << 48) - 1) | (np.arange(HASHES // band, dtype=np.uint64) << np.uint64(48))[None]).astype(np.int64)


def _group_numbers(t: pa.Table) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    for c in ("bucket", "i", "j"):
        x = np.asarray(t.column(c))
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _pairs(t: pa.Table, sig: np.ndarray, band: int, least: tuple[int, ...], most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs that meet first in the bucket they stand in and outlive the pruning."""
    bucket, i, j, side = (np.asarray(t.column(c)) for c in ("bucket", "i", "j", "side"))
    group = _group_numbers(t)
    own, crossing = bucket >> 48, i != j
    d, alive = 1, np.arange(len(bucket) - 1)
    waiting: list[np.ndarray] = []

    def checked() -> tuple[np.ndarray, np.ndarray]:
        pair = np.concatenate(waiting)
        waiting.clear()
        a, b = pair[:, 0], pair[:, 1]
        matches = np.zeros(len(a), np.int64)
        for k, need in enumerate(least):
            lo = k * CHUNK
            same = sig[a, lo : lo + CHUNK] == sig[b, lo : lo + CHUNK]
            agree = same.reshape(len(a), CHUNK // band, band).all(2) & (np.arange(lo // band, (lo + CHUNK) // band)[None] < own[a][:, None])
            matches += same.sum(1)
            on = (matches >= need) & ~agree.any(1)
            a, b, matches = a[on], b[on], matches[on]
        return a, b

    while len(alive):
        alive = alive[alive + d < len(group)]
        alive = alive[group[alive] == group[alive + d]]
        some = alive[~crossing[alive] | (side[alive] != side[alive + d])]
        if len(some):
            waiting.append(np.stack([some, some + d], 1))
            if sum(map(len, waiting)) > most:
                yield checked()
        d += 1
    if waiting:
        yield checked()


def _binary(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members each pair of sets has in common, exactly."""
    if len(a) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    sizes = [len(s) for s in sets]
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(member, kind="stable")
    member, row = member[order], row[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for lo in range(0, int(member[-1]) + 1, width):
        x, y = np.searchsorted(member, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[x:y], member[x:y] - lo] = 1
        total += part @ part.T  # counts below 2**24 are exact
    return total[a, b].astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row of each row's tree."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def similar_documents(
    docs: DataFrame, *, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, block: int = 2048, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per document: its id, class_id (the smallest id of its class) and n_links."""
    band = rows_per_band(threshold)
    least = least_matches(threshold, tolerance)
    all_docs = stored(sketches(docs, n, band, id_col, text_col), "sketches")
    same = all_docs.filter("digest is not null").groupBy("digest")
    nodes = stored(same.agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")

    exploded = nodes.select("digest", "size", F.explode("bands").alias("bucket"))
    full = exploded.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")).filter("m > 1")
    full = full.select(F.col("bucket").alias("full"), F.ceil(F.greatest(F.col("m") / block, F.least(F.col("m"), F.col("bytes") / block_bytes))).cast("int").alias("nb"))
    members = exploded.join(full, exploded["bucket"] == full["full"]).select("bucket", "digest", "nb")
    members = members.withColumn("side", F.pmod(F.xxhash64("digest", "bucket"), F.col("nb").cast("long")).cast("int"))
    dealt = members.select("bucket", "digest", "side", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("t"))
    dealt = dealt.select("bucket", F.least("side", "t").alias("i"), F.greatest("side", "t").alias("j"), "side", F.col("digest").alias("d"))
    placed = dealt.join(nodes.select("digest", "sig"), dealt["d"] == nodes["digest"]).select("bucket", "i", "j", "side", "digest", "sig")

    @released
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 3):
            sig, kept = _binary(t.column("sig"), HASHES), np.zeros(t.num_rows, bool)
            for a, b in _pairs(t, sig, band, least):
                kept[a] = kept[b] = True
            yield from t.select(["bucket", "i", "j", "side", "digest"]).filter(pa.array(kept)).combine_chunks().to_batches()

    key = ["bucket", "i", "j"]
    near = stored(placed.repartition(*key).sortWithinPartitions(*key, "digest").mapInArrow(prune, "bucket long, i int, j int, side int, digest binary"), "near")

    wanted = near.select("digest").distinct().join(nodes.select("digest", "rep", "copies", "sig"), "digest")
    text = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    # the list of ids grows with the documents: a sort-merge join at every size, never a broadcast
    read = text.join(wanted.hint("merge"), text["id"].eqNullSafe(wanted["rep"])).select("digest", "copies", "sig", "text")

    @released
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [_body(t.as_py()) for t in b.column(3)]
            own = pa.array([_digest(x) == d for x, d in zip(bodies, b.column(0).to_pylist(), strict=True)], pa.bool_())  # an id may stand on other texts too
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bodies, pa.binary())], ["digest", "copies", "sig", "body"]).filter(own)

    texts = read.mapInArrow(resolve, "digest binary, copies long, sig binary, body binary").dropDuplicates(["digest"]).withColumnRenamed("digest", "own")
    bodies = near.join(texts, near["digest"] == texts["own"]).select("bucket", "i", "j", "side", "digest", "copies", "sig", "body")

    @released
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 3):
            all_sets = exact_sets(t.column("body").to_pylist(), n)
            size, copies = np.array([len(s) for s in all_sets], np.int64), np.asarray(t.column("copies"))
            links, ends, group = np.zeros(t.num_rows, np.int64), [], _group_numbers(t)
            for a, b in _pairs(t, _binary(t.column("sig"), HASHES), band, least, 20_000):
                if not len(a):
                    continue
                order = np.argsort(group[a], kind="stable")  # sets are compared group by group
                a, b = a[order], b[order]
                edge = np.flatnonzero(np.concatenate([[True], group[a][1:] != group[a][:-1], [True]]))
                both = np.empty(len(a), np.int64)
                for lo, hi in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                    rows, at = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_inverse=True)
                    both[lo:hi] = _shared([all_sets[r] for r in rows], at[: hi - lo], at[hi - lo :])
                linked = both >= threshold * (size[a] + size[b] - both) - 1e-9
                a, b = a[linked], b[linked]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                root = _forest(np.concatenate([*(x for x, _ in ends), a]), np.concatenate([*(x for _, x in ends), b]), t.num_rows)
                some = np.flatnonzero(root != np.arange(t.num_rows))
                ends = [(some, root[some])]  # of the links so far, a forest is enough
            digest = t.column("digest").to_pylist()
            root = np.arange(t.num_rows)
            for x, y in ends:
                root[x] = y
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([digest[k] for k in some], pa.binary()), pa.array(links[some], pa.int64()), pa.array([digest[root[k]] for k in some], pa.binary())], ["digest", "links", "root"])

    linked = stored(bodies.repartition(*key).sortWithinPartitions(*key, "digest").mapInArrow(verify, "digest binary, links long, root binary"), "links")

    roots = components(linked, "digest", "root")
    counts = linked.groupBy("digest").agg(F.sum("links").alias("links")).select(F.col("digest").alias("linked"), "links")
    classes = nodes.select("digest", "rep", "copies").join(roots, F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("root", "digest"))
    least_id = classes.groupBy("root").agg(F.min("rep").alias("class_id")).select(F.col("root").alias("of"), "class_id")
    classes = classes.join(least_id, F.col("root") == F.col("of")).join(counts, F.col("digest") == F.col("linked"), "left")
    classes = classes.select(F.col("digest").alias("own"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # from tables on both sides, so that Spark can split the digest that most copies share
    out = all_docs.select("id", "digest").join(stored(classes, "classes"), F.col("digest") == F.col("own"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """The documents whose id is their class' smallest, with all their columns; rows of equal ids stay together if one of them does."""
    found = similar_documents(docs, id_col=id_col, **kw)
    stays = found.groupBy(F.col(id_col).alias("__gone")).agg(F.bool_or(F.col("class_id").eqNullSafe(F.col(id_col))).alias("__stays"))
    gone = stored(stays.filter("not __stays").select("__gone"), "gone")
    return docs.join(gone.hint("merge"), docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")

"""Approximate nearest neighbours by several shifted Hilbert curves.

1. Equal vectors are one point, with its `k + 1` smallest ids; more could not be asked for.
2. Each curve has a random rotation to `dims` axes and a random shift of its grid; a point's key is its place on that Hilbert curve, and within its grid
   cell its place on a finer one.
3. Keys are cut into small ranges of about a window each by quantiles of a bounded sample (`sample_points`); RANGE of them in a row are a group of a Spark shuffle,
   together with the one before and the one after, so that a window never ends at a group's edge. A group that holds far more points than the cuts
   should have let it, as where very many lie in one grid cell, is dealt out in parts.
4. A query goes to its own group on each curve, and there looks at the `window` points on either side of its own place, by their differences in single
   precision from vectors that are centred first. Every group returns the query's best candidates.
5. What the windows found is merged, and distances are computed anew in double precision on the original vectors.

The window is a number of rows that grows more slowly than the table: window_scale * n ** window_power, and a few more than k at least, as so many must be
returned. The power is measured on vectors without structure, nearly independent directions, the worst case: there a fixed recall asks for windows
that grow so. One formula holds for all sizes; recall and work are measured in the README.

Defined results: vectors that are null, of another length than most, zero, or hold a null or non-finite component take no part, nor do rows with a null
id; of rows of equal ids the smallest vector counts (by its first component, then the next); of equal distances the smaller id is nearer; fewer than k other
points: all of them; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, small_batches, stored, whole_groups
from .hilbert import hilbert_keys

SPARE = 4  # candidates beyond k that single precision may need
RANGE = 16


class Curves:
    """Rotations and shifted grids; the grid's step is a share of the spread of the vectors around their mean, which is measured."""

    def __init__(self, length: int, spread: float, n: int, dims: int = 10, bits: int = 6, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dims, self.bits = min(dims, length), bits
        self.rotation = [np.linalg.qr(rng.normal(size=(length, self.dims)))[0] for _ in range(n)]
        self.shift = [rng.random(self.dims) for _ in range(n)]
        self.step = max(8 * spread / (1 << bits), 1e-300)

    def keys(self, x: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Place on curve c, and on the finer curve within the cell, of centred vectors."""
        n = 1 << self.bits
        y = x @ self.rotation[c] / self.step + self.shift[c] + n // 2
        cell = np.clip(np.floor(y), 0, n - 1)
        return hilbert_keys(cell, self.bits), hilbert_keys(np.clip(np.floor((y - cell) * n), 0, n - 1), self.bits)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, length)


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the rows that take part, once per id."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.filter("id is not null and v is not null and size(v) > 0").filter(fine & F.exists("v", lambda c: c != 0))
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("v") == (common["n"] if common else -1))


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _windows(query: tuple[np.ndarray, np.ndarray], point: tuple[np.ndarray, np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points in the curve's order, and for each query where its window begins and how long it is."""
    order = np.lexsort(point[::-1])
    n, q = len(order), len(query[0])
    both = np.lexsort((np.r_[point[1][order], query[1]], np.r_[point[0][order], query[0]]))
    place = np.empty(n + q, np.int64)
    place[both] = np.cumsum(both < n)
    begin = np.clip(place[n:] - window, 0, max(0, n - 2 * window - 1))  # at an end of the curve the window lies to one side
    return order, begin, np.minimum(2 * window + 1, n - begin)


def nearest(
    vectors: DataFrame, is_query: Column, *, k: int = 10, curves: int = 32, window_scale: float = 0.085, window_power: float = 0.79, sample_points: int = 200_000, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row where is_query (a condition on a column `id`) holds."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stored(clean(vectors, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    # a rank over equal vectors: Spark limits it before the shuffle too, so a vector that many rows share is cheap
    of_equal = Window.partitionBy("v").orderBy("id")
    ranked = rows.withColumn("r", F.row_number().over(of_equal)).filter(F.col("r") <= k + 1)
    points = stored(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("point"), "ids", "v"), "points")
    queries = rows.filter(is_query).select(F.col("id").alias("query_id"), "v")
    n, length = points.agg(F.count("*"), F.first(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    mean, spread = _moments(points, length)
    maker, window = Curves(length, spread, curves), max(k + 1, int(np.ceil(window_scale * n**window_power)))
    n_small = max(1, n // max(window, 256))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), length) - mean
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(maker.keys(x, c)[0])], ["curve", "key"])

    chance = F.pmod(F.xxhash64(F.lit("cuts"), "point"), F.lit(1 << 30)) / float(1 << 30)
    sample = points.filter(chance < min(1.0, sample_points / n)).select("v").mapInArrow(keyed, "curve int, key long")
    share = [j / n_small for j in range(1, n_small)]
    found = sample.groupBy("curve").agg(F.percentile_approx("key", share, F.lit(max(10_000, 20 * n_small))).alias("cuts")).collect() if share else []
    cuts = {c: np.zeros(0, np.int64) for c in range(curves)} | {r["curve"]: np.array(r["cuts"], np.int64) for r in found}

    def ranged(is_query: bool):
        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, ids = _matrix(b.column(1), length) - mean, np.asarray(b.column(0))
                single = x.astype("<f4")
                for c in range(curves):
                    key, fine = maker.keys(x, c)
                    small = np.searchsorted(cuts[c], key, "right")
                    own, at = small // RANGE, np.arange(len(ids))
                    if not is_query:  # the small ranges at a group's edges stand in the next group too
                        low, high = np.flatnonzero((small % RANGE == 0) & (small > 0)), np.flatnonzero((small % RANGE == RANGE - 1) & (small < n_small - 1))
                        own, at = np.concatenate([own, own[low] - 1, own[high] + 1]), np.concatenate([at, low, high])
                    out = [np.full(len(at), c, np.int32), own.astype(np.int32), ids[at], key[at], fine[at]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array([single[r].tobytes() for r in at], pa.binary())], ["curve", "range", "id", "key", "fine", "v"])

        return run

    kind = "curve int, range int, id long, key long, fine long, v binary"
    placed = stored(points.select("point", "v").mapInArrow(ranged(False), kind), "placed")
    asked = queries.mapInArrow(ranged(True), kind)
    most = 4 * RANGE * max(window, 256)
    hot = stored(placed.groupBy("curve", "range").count().filter(F.col("count") > most).select("curve", "range", F.ceil(F.col("count") / most).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        data, ask = placed.withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))
    else:  # a row of this table stands for over `most` points, so it is many thousand times smaller than they are
        n_parts = F.coalesce("parts", F.lit(1))
        data = placed.join(F.broadcast(hot), ["curve", "range"], "left").withColumn("part", F.pmod(F.xxhash64("id"), n_parts.cast("long")).cast("int")).drop("parts")
        ask = asked.join(F.broadcast(hot), ["curve", "range"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1))).drop("parts")

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def searched(t: pa.Table) -> pa.RecordBatch | None:
            own = np.asarray(t.column("query"))
            if own.all() or not own.any():
                return None
            ids, key, fine = (np.asarray(t.column(c)) for c in ("id", "key", "fine"))
            x = np.frombuffer(b"".join(t.column("v").to_pylist()), "<f4").reshape(-1, length)
            y, y_ids = x[~own], ids[~own]
            order, begin, size = _windows((key[own], fine[own]), (key[~own], fine[~own]), window)
            y, y_ids = y[order], y_ids[order]
            out = []
            for q, q_id, lo, m in zip(x[own], ids[own], begin.tolist(), size.tolist(), strict=True):
                apart = y[lo : lo + m] - q
                d = np.einsum("ij,ij->i", apart, apart)
                best = np.argpartition(d, k + SPARE)[: k + 1 + SPARE] if m > k + 1 + SPARE else np.arange(m)
                out.append((np.full(len(best), q_id), y_ids[lo + best]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], ["query_id", "point"])

        for t in whole_groups(batches, 3):
            group = np.stack([np.asarray(t.column(c)) for c in range(3)], 1)
            edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1), [True]]))
            for lo, hi in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                if (b := searched(t.slice(lo, hi - lo))) is not None:
                    yield b

    key = ["curve", "range", "part"]
    columns = [*key, "query", "id", "key", "fine", "v"]
    both = ask.withColumn("query", F.lit(True)).select(columns).union(data.withColumn("query", F.lit(False)).select(columns))
    found = both.repartition(*key).sortWithinPartitions(*key).mapInArrow(scan, "query_id long, point long").distinct()
    pairs = found.join(points, "point").join(queries.select("query_id", F.col("v").alias("q")), "query_id")
    scored = pairs.select("query_id", F.explode("ids").alias("vec_id"), _distance("q", "v").alias("score")).filter("vec_id != query_id")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _moments(points: DataFrame, length: int) -> tuple[np.ndarray, float]:
    """The points' mean, and the root of the mean variance of a component around it: two numbers per component come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, apart = 0, np.zeros(length), np.zeros(length)
        for b in batches:
            x = _matrix(b.column(0), length)
            own, m = x.mean(0), len(x)
            apart += ((x - own) ** 2).sum(0) + (own - mean) ** 2 * n * m / (n + m)
            mean, n = mean + (own - mean) * m / (n + m), n + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([mean.tolist()]), pa.array([apart.tolist()])], ["n", "mean", "apart"])

    n, mean, apart = 0.0, np.zeros(length), np.zeros(length)
    # a row of each task, in a fixed order: the sums shall not depend on which task ends first
    for r in sorted(points.select("v").mapInArrow(run, "n double, mean array<double>, apart array<double>").collect()):
        own, m = np.array(r["mean"]), r["n"]
        apart += np.array(r["apart"]) + (own - mean) ** 2 * n * m / (n + m)
        mean, n = mean + (own - mean) * m / (n + m), n + m
    return mean, float(np.sqrt(apart.sum() / (n * length)))

"""Centroid clustering of integer vectors by Shallot search.

Each vector keeps its nearest and second-nearest centroid with an upper bound of
the first distance and a lower bound of all others. After a round of moves the
bounds are shifted; a vector whose upper bound still lies below the lower one, or
below half the way to the next centroid, keeps its cluster unseen. The others
start from the closer of the two remembered centroids and go through its
neighbours, nearest first, while they lie within the distance to the start plus
the second-best distance found so far: a ball that shrinks on the way. Bounds are
doubles with a margin; whatever survives them is compared in whole numbers.

A round reads the last round's table and writes the next one. Centroids are sums
of whole numbers, kept up to date by the vectors that changed cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.frames import drop_scratch, scratch, written
from rowsmith.llm.nra import integers

SLACK = 1 + 1e-9  # more than the rounding of any bound
AHEAD = 4  # neighbours measured in one product
LONG = 2**63 - 1
STATE = "vec_id long, x array<long>, previous int, cluster int, second int, upper double, lower double"


def _whole(values: np.ndarray) -> np.ndarray:
    """As int64, or as Python integers where products could leave 64 bits."""
    top = max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))
    return values.astype(np.int64) if top < 2**26 else values.astype(object)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows of ``x`` by rows of ``c``."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
        return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1) if len(c) else np.zeros((len(x), 0), object)
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if x.shape[1] * 4 * float(top) ** 2 < 2**52:  # doubles hold every term
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def _root(values: np.ndarray) -> np.ndarray:
    return np.sqrt(values.astype(float))


class Search:
    """Nearest and second-nearest centroids; ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None = None):
        self.c = _whole(centroids)
        self.k = len(centroids)
        apart = squares(self.c, self.c)
        self.apart = _root(apart)
        others = self.apart + np.where(np.eye(self.k, dtype=bool), np.inf, 0)
        self.half = others.min(axis=1, initial=np.inf) / 2
        self.order = np.argsort(others, axis=1, kind="stable")[:, : self.k - 1]
        self.moved = np.zeros(self.k) if moved is None else moved
        most = np.argsort(-self.moved, kind="stable")
        # the largest move of a centroid other than one's own
        self.others_moved = np.array([self.moved[most[1] if most[0] == j else most[0]] if self.k > 1 else 0.0 for j in range(self.k)])

    def all(self, x: np.ndarray):
        """Without bounds: every centroid is measured."""
        d = squares(x, self.c)
        at = np.arange(len(x))
        first = d.argmin(axis=1) if d.dtype != object else np.array([min(range(self.k), key=row.__getitem__) for row in d], int)
        best = d[at, first]
        if self.k == 1:
            return first, first, _root(best), np.full(len(x), np.inf)
        rest = d.copy()
        rest[at, first] = LONG if d.dtype != object else 1 << 200
        second = rest.argmin(axis=1) if d.dtype != object else np.array([min(range(self.k), key=row.__getitem__) for row in rest], int)
        return first, second, _root(best), _root(rest[at, second])

    def bounded(self, x: np.ndarray, first, second, upper, lower):
        """The state after the centroids moved; also how many distances were measured."""
        first, second = first.copy(), second.copy()
        upper = (upper + self.moved[first]) * SLACK
        lower = lower - self.others_moved[first] * SLACK
        limit = np.maximum(lower, self.half[first])
        open_ = np.flatnonzero(upper * SLACK >= limit)
        measured = 0
        if len(open_):
            measured += len(open_)
            upper[open_] = _root(self._own(x[open_], first[open_]))
            open_ = open_[upper[open_] * SLACK >= limit[open_]]
        if not len(open_) or self.k == 1:
            return first, second, upper, lower, measured
        measured += len(open_)
        da, db = self._own(x[open_], first[open_]), self._own(x[open_], second[open_])
        swap = (db < da) | ((db == da) & (second[open_] < first[open_]))
        a, b = np.where(swap, second[open_], first[open_]), np.where(swap, first[open_], second[open_])
        da, db = np.where(swap, db, da), np.where(swap, da, db)
        for start in np.unique(a):
            at = np.flatnonzero(a == start)
            measured += self._scan(x[open_[at]], int(start), at, a, b, da, db)
        first[open_], second[open_], upper[open_], lower[open_] = a, b, _root(da), _root(db)
        return first, second, upper, lower, measured

    def _own(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        c = self.c[which]
        if x.dtype == object or c.dtype == object:
            x, c = x.astype(object), c.astype(object)
        return ((x - c) ** 2).sum(axis=1)

    def _scan(self, x: np.ndarray, start: int, at: np.ndarray, a, b, da, db) -> int:
        """Improves ``a, b, da, db`` at the places ``at``, all of which start from one centroid."""
        reach = _root(da[at])
        measured = 0
        active = np.arange(len(at))
        for t in range(0, self.k - 1, AHEAD):
            near = self.order[start, t : t + AHEAD]
            ball = (reach[active] + _root(db[at[active]])) * SLACK
            active = active[self.apart[start, near[0]] <= ball]
            if not len(active):
                break
            d = squares(x[active], self.c[near])
            measured += d.size
            here = at[active]
            for col, j in enumerate(near):
                one = d[:, col]
                known = (b[here] == j) | (a[here] == j)
                closer = ~known & ((one < da[here]) | ((one == da[here]) & (j < a[here])))
                middle = ~known & ~closer & ((one < db[here]) | ((one == db[here]) & (j < b[here])))
                i = here[closer]
                b[i], db[i], a[i], da[i] = a[i], da[i], j, one[closer]
                i = here[middle]
                b[i], db[i] = j, one[middle]
        return measured


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return _whole(col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), width))


def _assign(search: Search, width: int, bounded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if bounded:
                old = [batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower")]
                new = search.bounded(x, *old)[:4]
                before = old[0]
            else:
                new, before = search.all(x), np.full(len(x), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(before, pa.int32()), pa.array(new[0], pa.int32()), pa.array(new[1], pa.int32()),
                 pa.array(new[2], pa.float64()), pa.array(new[3], pa.float64())],
                names=["vec_id", "x", "previous", "cluster", "second", "upper", "lower"])

    return run


def _changes(k: int, width: int):
    """Per task and cluster: members and sums gained, those lost taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), object)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            for name, sign in (("cluster", 1), ("previous", -1)):
                which = batch.column(name).to_numpy()
                for j in np.unique(which[which >= 0]):
                    mine = x[which == j]
                    total[j, :width] += sign * mine.sum(axis=0).astype(object)
                    total[j, width] += sign * len(mine)
        i, j = np.nonzero(total)
        values = [Decimal(int(v)) for v in total[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["i", "j", "total"])

    return run


def _distances(centroids: np.ndarray, width: int):
    c = _whole(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            own = c[batch.column("cluster").to_numpy()]
            if x.dtype == object or own.dtype == object:
                x, own = x.astype(object), own.astype(object)
            d = np.minimum(((x - own) ** 2).sum(axis=1), LONG)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: float = 256.0, seed: str = "2", id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector of ``width`` finite components.

    Components count as floor(scale * x). The first centroids are the ``k`` vectors
    with the smallest sha256 of ``seed:id``, in that order; each of ``rounds``
    rounds assigns all vectors to the nearest centroid (ties: smaller number) and
    moves non-empty centroids to floor(sum / count); then vectors are assigned
    once more. ``distance`` is squared; sums and distances beyond a long count as
    the largest long.

    Other vectors (null, of another length, with null or non-finite components)
    are left out. Rows that repeat an id are vectors of their own; among equal
    hashes the smaller vector comes first, and rows without id come last. Fewer
    than ``k`` vectors make as many clusters; none give no rows. Other columns
    are ignored. The driver holds ``k`` centroids, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    whole = integers(F.col(vector_col), scale)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x")).filter(F.size(F.coalesce("x", F.array())) == width)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("x", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in first], object)
    k = len(centroids)
    totals = np.zeros((k, width + 1), object)
    state, path, search = kept, None, Search(centroids)
    for turn in range(rounds + 1):
        after = scratch(spark, "shallot")
        state.mapInArrow(_assign(search, width, bounded=turn > 0), STATE).write.parquet(after)
        if path:
            drop_scratch(spark, path)
        state, path = spark.read.schema(STATE).parquet(after), after
        if turn == rounds:
            break
        changed = state.filter("cluster <> previous").select("x", "cluster", "previous").mapInArrow(_changes(k, width), "i int, j int, total decimal(38,0)")
        for r in changed.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
            totals[r["i"], r["j"]] += int(r["total"])
        moved = centroids.copy()
        for j in range(k):
            if totals[j, width]:
                moved[j] = totals[j, :width] // totals[j, width]
        steps = _root(((moved - centroids) ** 2).sum(axis=1)) * SLACK
        centroids, search = moved, Search(moved, steps)
    placed = written(state.select("x", "vec_id", "cluster").mapInArrow(_distances(centroids, width), "vec_id long, cluster int, distance long"), "shallot-placed")
    drop_scratch(spark, path)
    sums = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia = min(sum(sums.values()), LONG)
    facts = F.array(*[
        F.struct(F.lit(min(sums.get(j, 0), LONG)).cast("long").alias("inertia"), F.lit(hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()).alias("sha"))
        for j in range(k)])
    own = F.element_at(facts, F.col("cluster") + 1)
    return placed.select(
        "vec_id", "cluster", "distance", own["inertia"].alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), own["sha"].alias("centroid_sha256"))

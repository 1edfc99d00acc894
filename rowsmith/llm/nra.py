"""Exact top-k inner products by no-random-access aggregation.

Every dimension of a candidate block is a list sorted by value; a query reads
it from the top where its weight is positive, from the bottom where negative.
After each stretch of reading, a candidate's score lies between the sum read so
far plus the worst, and plus the best, its unread entries can add (the best is
the list's frontier). Candidates whose upper bound is below the k-th lower bound
are outsiders; reading stops for a query when few others are left, and their
final scores are resolved from the block's rows. The work for a block of
candidates and a block of queries is done in matrix products over the entries
read, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.frames import shard_of, written

BLOCK = 8192
QUERY_BLOCK = 1024
DEPTHS = (0.5, 0.75, 0.9, 1.0)  # share of each list read when bounds are compared
FEW = 8  # times k: so many possible candidates are resolved


def integers(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = col.combine_chunks()
    out = np.zeros((len(rows), width), np.int64)
    ends = np.cumsum(sizes := rows.value_lengths().to_numpy())
    at = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
    out[np.repeat(np.arange(len(rows)), sizes), at] = rows.flatten().to_numpy()
    return out


def top_of_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int,
                 copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, candidate numbers and scores of the k best per query, ties to the smaller id; a row with the query's id is left out.

    With ``copies``, rows per candidate, only a query's own vector under its id is left out, and only if there is no second one.
    """
    n, d = vectors.shape
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(d, 1)
    kind = np.float32 if bound < 2**24 else np.float64
    slack = 0.0 if bound < 2**53 else bound * 1e-12
    order = np.argsort(vectors, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(vectors, order, axis=0).astype(kind)
    v = vectors.astype(kind)
    least, most = (ordered[0], ordered[-1]) if n else (np.zeros(d, kind),) * 2
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left = np.arange(len(queries))
    up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    read = np.zeros((n, len(queries)), kind)
    done = 0
    for share in DEPTHS:
        depth = n if share >= 1 else int(n * share)
        top_new = (place < n - done) & (place >= n - depth)
        bottom_new = (place >= done) & (place < depth)
        read += (v * top_new) @ up.T + (v * bottom_new) @ down.T
        done = depth
        if depth < n:
            under, above = (place < n - depth).astype(kind), (place >= depth).astype(kind)
            best = under @ (up * ordered[n - depth - 1]).T + above @ (down * ordered[depth]).T + read
            worst = under @ (up * least).T + above @ (down * most).T + read
        else:
            best = worst = read.copy()
        own = ids[:, None] == query_ids[left][None, :]
        if copies is not None:
            i, j = np.nonzero(own)
            own[i, j] = (copies[i] == 1) & (vectors[i] == queries[left[j]]).all(axis=1)
        best[own] = -np.inf
        if worst is not best:
            worst[own] = -np.inf
        if n > k:
            kth = np.partition(worst, n - k, axis=0)[n - k]
            may = best >= kth - slack
        else:
            may = best > -np.inf
        may &= best > -np.inf
        ready = (may.sum(axis=0) <= FEW * k) | (depth == n)
        for col in np.flatnonzero(ready):
            c = np.flatnonzero(may[:, col])
            scores = vectors[c] @ queries[left[col]]
            pick = np.lexsort((ids[c], -scores))[:k]
            out.append((np.full(len(pick), left[col]), c[pick], scores[pick]))
        left, up, down, read = left[~ready], up[~ready], down[~ready], read[:, ~ready]
        if not len(left):
            break
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))  # type: ignore[return-value]


def _pair(k: int):
    def run(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score", "n"]
        if not candidates.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        width = max(t.column("vec").combine_chunks().value_lengths().to_numpy().max() for t in (candidates, queries))
        ids, query_ids, copies = candidates.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy(), candidates.column("copies").to_numpy()
        v, x = _matrix(candidates.column("vec"), width), _matrix(queries.column("vec"), width)
        q, c, s = top_of_block(v, ids, x, query_ids, k, copies)
        own = (ids[c] == query_ids[q]) & (v[c] == x[q]).all(axis=1)
        return pa.table(dict(zip(names, (queries.column("query").to_numpy()[q], query_ids[q], ids[c], s, copies[c] - own))))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding",
          block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the k rows of ``vectors`` with the highest integer inner product.

    Components count as floor(scale * x). Vectors null, or with a null or
    non-finite component, take no part, nor do null ids. Rows that repeat an id,
    with the same vector or another, are rows of their own, as queries and as
    candidates; a query row leaves out one row of its id and vector, itself. Equal
    rows travel once, with their number. Ties go to the smaller id. Shorter vectors
    count as filled with zeros. Every query gets min(k, candidates) rows; empty
    tables give none. Scores must fit a long.
    """

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("vec")).dropna()
        return rows.groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("copies"))

    rows = written(clean(vectors), "vectors")
    asked = written(clean(queries).withColumn("query", F.monotonically_increasing_id()), "queries")
    n_blocks = max(1, -(-rows.count() // block))
    n_queries = max(1, -(-asked.count() // query_block))
    left = rows.withColumns({"block": shard_of(n_blocks, "vec_id", "vec"), "part": F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))})
    right = asked.drop("copies").withColumns({"part": shard_of(n_queries, "vec_id", "vec"), "block": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))})
    best = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_pair(k), "query long, query_id long, vec_id long, score long, n long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    best = best.withColumn("before", before).filter(F.col("before") < k)
    best = best.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k))))).join(
        asked.filter("copies > 1").select("query", "copies"), "query", "left")
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1)))))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

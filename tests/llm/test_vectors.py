"""Whitening and centroid clustering against plain numpy and Python."""

import hashlib
import math

import numpy as np
import pytest
from llm_cases import CLASHING
from pyspark.sql import functions as F

from rowsmith.llm import queries, shallot, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"
BAD = [(900, None), (901, [None] + [0.5] * 5), (902, [float("nan")] + [0.5] * 5), (903, [float("inf")] + [0.5] * 5)]


def frame(spark, rows, schema=SCHEMA):
    names = [*CLASHING, "x", "cluster", "i", "total", "a.b"]
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in names})


def whole(v, scale=256):
    return tuple(math.floor(scale * float(np.float32(c))) for c in v)


# --- whitening ---------------------------------------------------------------------


def brute_white(rows, k):
    xs = [whole(v) for _, v in rows]
    fit = sorted(set(xs))
    n, S = len(fit), [sum(col) for col in zip(*fit)]
    x = np.array(fit, float)
    cov = np.cov(x.T, bias=True).reshape(len(S), len(S))
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for (i, _), v in zip(rows, xs):
        dev = sum((n * a - s) ** 2 for a, s in zip(v, S))
        w = (np.array(v) - np.array(S) / n) @ vectors / np.sqrt(values)
        out.append((i, n, dev, w))
    return out, values / np.trace(cov)


def same_white(got, want, share, k, tol=1e-9):
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    sign = np.zeros(k)
    for i, n, dev, w in want:
        rows = by[i, dev]
        assert sorted(rows) == list(range(1, k + 1)) and all(r["n"] == n for r in rows.values())
        mine = np.array([rows[c]["whitened"] for c in range(1, k + 1)])
        sign = np.where((sign == 0) & (np.abs(w) > 1e-6), np.sign(w * mine), sign)
        assert np.allclose(mine, w * np.where(sign == 0, 1, sign), rtol=tol, atol=tol)
    assert np.allclose([by[want[0][0], want[0][2]][c]["explained"] for c in range(1, k + 1)], share, rtol=1e-9)


def test_query_whitens_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op11_embedding_whitening(spark, SF).collect()
    assert len(got) == 4 * len(rows)
    want, share = brute_white(rows, 4)
    same_white(got, want, share, 4)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_of_repeated_rows_bad_vectors_and_clashing_columns(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in r.normal(0.3, [3, 2, 1, 0.5, 0.1, 0.1])]) for i in range(60)]
    rows += [(7, rows[7][1]), (700, rows[7][1]), (None, rows[3][1])]
    got = whitening.whiten(frame(spark, rows + BAD).repartition(5), components=3).collect()
    assert len(got) == 3 * len(rows) and not {900, 901, 902, 903} & {g["vec_id"] for g in got}
    want, share = brute_white(rows, 3)
    same_white(got, want, share, 3)


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.25])]).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, BAD)).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["n"] == 1 and r["explained"] is None and r["identity_error"] is None for r in one)
    line = whitening.whiten(frame(spark, [(i, [0.5 * i, 0.0, 1.0]) for i in range(5)])).collect()
    assert len(line) == 15 and all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    assert line[0]["identity_error"] < 1e-9
    ragged = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 0.0]), (4, [])])).collect()
    assert {(r["vec_id"], r["n"]) for r in ragged} == {(1, 3), (2, 3), (3, 3), (4, 3)} and len(ragged) == 8


def test_whitening_of_huge_entries(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [2e15, 3.0]), (4, [1e30, 3.0])]
    got = whitening.whiten(frame(spark, rows, "vec_id long, embedding array<double>"), components=1).collect()
    assert len(got) == 4 and all(r["deviation"] is None for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_leading_eigenvectors(seed):
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.normal(size=(24, 24)))
    values = np.sort(r.uniform(0, 5, 24))[::-1].copy()
    if seed == 1:
        values[:3] = 7.0  # a threefold eigenvalue
    if seed == 2:
        values[1] = values[0] * (1 - 1e-12)
    if seed == 3:
        values[2:] = 0
    m = q @ np.diag(values) @ q.T
    m = np.diag(values) if seed == 4 else (m + m.T) / 2
    got, vectors = whitening.principal(m, 4)
    assert np.allclose(got, values[:4], rtol=1e-13, atol=1e-13 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13
    assert np.abs(m @ vectors - vectors * got).max() < 1e-12 * values[0]


# --- clustering --------------------------------------------------------------------


def brute_clusters(rows, k, rounds, width):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    x = np.array([v for _, v in kept], object)

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        own = np.array([j for _, j in nearest()])
        for j in range(len(cents)):
            if (own == j).any():
                cents[j] = tuple(s // int((own == j).sum()) for s in x[own == j].sum(axis=0))
    last = nearest()
    inertia = [sum(d for d, j in last if j == c) for c in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    most = 2**63 - 1
    return sorted(((i, j, min(d, most), min(inertia[j], most), min(sum(inertia), most), sha[j]) for (i, _), (d, j) in zip(kept, last)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_clusters_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(queries.op13_centroid_clustering(spark, SF)) == brute_clusters(rows, 40, 5, 64)


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_clusters_with_ties_repeats_and_bad_vectors(spark, spread):
    r = np.random.default_rng(8)
    middle = r.normal(size=(6, 4))
    rows = [(i, [float(np.float32(c)) for c in middle[i % 6] + r.normal(0, spread, 4)]) for i in range(240)]
    rows += [(1000 + i, [float(a), float(b), 0.0, 0.0]) for i, (a, b) in enumerate([(x, y) for x in range(6) for y in range(6)] * 2)]
    rows += [(3, rows[3][1]), (3, rows[9][1]), (None, rows[5][1]), (500, [1.0]), (501, []), *BAD]
    got = shallot.cluster(frame(spark, rows).repartition(5), k=9, rounds=5, width=4)
    assert rows_of(got) == brute_clusters(rows, 9, 5, 4)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.25, 1.0]), (4, [0.5, 0.5])]
    assert rows_of(shallot.cluster(frame(spark, rows), width=2)) == brute_clusters(rows, 40, 5, 2)
    assert rows_of(shallot.cluster(frame(spark, rows[:1]), width=2)) == brute_clusters(rows[:1], 40, 5, 2)
    assert shallot.cluster(frame(spark, rows), width=3).count() == 0
    assert shallot.cluster(frame(spark, rows).limit(0), width=2).count() == 0


def test_huge_components(spark):
    rows = [(i, [1e6 * i, -1e7 * (i % 7)]) for i in range(50)]
    got = shallot.cluster(frame(spark, rows, "vec_id long, embedding array<double>"), k=5, width=2)
    assert rows_of(got) == brute_clusters_double(rows)


def brute_clusters_double(rows):
    global whole
    single, whole = whole, lambda v: tuple(math.floor(256 * c) for c in v)
    try:
        return brute_clusters(rows, 5, 5, 2)
    finally:
        whole = single


def test_the_search_measures_fewer_distances_than_all():
    r = np.random.default_rng(0)
    middle = r.integers(-2000, 2000, (40, 8))
    x = (middle[r.integers(0, 40, 5000)] + r.integers(-60, 60, (5000, 8))).astype(np.int64)
    start = shallot.Search(middle.astype(object))
    state = start.all(x)
    moved = middle + r.integers(-3, 4, middle.shape)
    search = shallot.Search(moved.astype(object), np.sqrt(((moved - middle) ** 2).sum(axis=1)))
    first, second, upper, lower, measured = search.bounded(x, *state)
    assert (first == search.all(x)[0]).all() and measured < 5000
    search = shallot.Search(moved.astype(object), np.full(40, 1e9))  # bounds that tell nothing
    first, second, upper, lower, measured = search.bounded(x, *state)
    want = search.all(x)
    assert (first == want[0]).all() and measured < 5000 * 40 / 2

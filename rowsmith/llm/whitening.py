"""Embedding whitening onto the leading principal components.

The covariance is gathered in two passes over the distinct integer vectors: first
their number and sums, then products of entries centred at the rounded mean.
Those products are integers, so partial sums from any task, in any order, add up
to the same total; the remainder of the mean is taken off exactly at the end.

The matrix has as many rows as a vector has entries. Householder reflections make
it tridiagonal on the driver, Sturm counts bisect its leading eigenvalues to the
last bit, and inverse iteration finds their vectors, orthogonalised again within
clusters of close eigenvalues. The small projection goes to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.frames import written
from rowsmith.llm.nra import integers

CLUSTER = 1e-3  # eigenvalues closer than this share of the norm are orthogonalised against each other
NULL_SHARE = 1e-13  # eigenvalues below this share of the largest one, per row of the matrix, count as zero
SUM = "decimal(38,0)"


# --- the symmetric eigenproblem -------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, subdiagonal and the Householder vectors (first row touched, unit vector) of a symmetric matrix."""
    a = np.array(matrix, float)
    n = len(a)
    mirrors: list[tuple[int, np.ndarray]] = []
    for k in range(n - 2):
        column = a[k + 1 :, k]
        rest = np.abs(column[1:]).max()
        if rest == 0:
            continue
        scale = np.abs(column).max()
        v = column / scale
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        # A <- H A H with H = I - 2 v v', as a rank-two update of the trailing block
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = 2 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        head = column - 2 * v * (v @ column)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = head[0]
        mirrors.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, x: float) -> int:
    """Sturm count: eigenvalues of the tridiagonal matrix below ``x``."""
    tiny = np.finfo(float).tiny
    count, q = 0, 1.0
    for i, d in enumerate(diagonal.tolist()):
        q = d - x - (float(off[i - 1]) ** 2 / q if i else 0.0)
        if q == 0:
            q = -tiny
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The ``k`` largest eigenvalues, largest first, bisected until no double lies between the ends."""
    n = len(diagonal)
    around = np.zeros(n)
    around[1:] += np.abs(off)
    around[:-1] += np.abs(off)
    low, high = float((diagonal - around).min()), float((diagonal + around).max())
    pad = max(abs(low), abs(high), np.finfo(float).tiny) * 1e-12
    out = []
    for j in range(1, k + 1):
        lo, hi = low - pad, high + pad
        while True:
            mid = lo + (hi - lo) / 2
            if not lo < mid < hi:
                break
            if below(diagonal, off, mid) > n - j:
                hi = mid
            else:
                lo = mid
        out.append(hi if abs(hi) < abs(lo) else lo)
    return out


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, floor: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; a zero pivot becomes ``floor``."""
    n = len(diagonal)
    d, up, up2 = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    low, b = np.append(off, 0.0), right.astype(float)
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low_i = low[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
        else:
            low_i = low[i]
        if abs(d[i]) < floor:
            d[i] = floor
        f = low_i / d[i]
        d[i + 1] -= f * up[i]
        up[i + 1] -= f * up2[i]
        b[i + 1] -= f * b[i]
    if abs(d[n - 1]) < floor:
        d[n - 1] = floor
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        rest = b[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / d[i]
        if abs(x[i]) > 1e150:  # the direction alone matters
            x, b = x / 1e150, b / 1e150
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors as columns, by inverse iteration."""
    n = len(diagonal)
    norm = float(np.abs(diagonal).max(initial=0) + 2 * np.abs(off).max(initial=0)) or 1.0
    eps = np.finfo(float).eps
    found: list[np.ndarray] = []
    for j, value in enumerate(values):
        near = [found[i] for i in range(j) if abs(values[i] - value) <= CLUSTER * norm]
        x = np.random.default_rng(j).uniform(-1, 1, n)
        shift = value + eps * norm * sum(abs(values[i] - value) <= 10 * eps * norm for i in range(j))
        for _ in range(6):
            x = solve_shifted(diagonal, off, shift, x / np.linalg.norm(x), eps * norm)
            for _ in range(2):
                for other in near:
                    x = x - (other @ x) * other
            if not np.linalg.norm(x):
                x = np.random.default_rng(1000 + j).uniform(-1, 1, n)
        found.append(x / np.linalg.norm(x))
    return np.stack(found, axis=1)


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix and their unit vectors as columns, the largest entry positive."""
    size = float(np.abs(matrix).max(initial=0))
    if not size:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, mirrors = tridiagonal(matrix / size)
    values = leading(diagonal, off, k)
    found = vectors_of(diagonal, off, values)
    for at, v in reversed(mirrors):
        found[at:] -= 2 * np.outer(v, v @ found[at:])
    top = np.abs(found).argmax(axis=0)
    return np.array(values) * size, found * np.where(found[top, np.arange(k)] < 0, -1.0, 1.0)


# --- sums over the vectors --------------------------------------------------------


def _rows(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), width)


def _total(batches, schema: str, add) -> Iterator[pa.RecordBatch]:
    """One set of rows per task: index columns and an exact integer total."""
    total = None
    for batch in batches:
        part = add(batch)
        total = part if total is None else total + part
    if total is not None:
        at = np.indices(total.shape).reshape(total.ndim, -1)
        values = [Decimal(int(v)) for v in total.ravel()]
        yield pa.RecordBatch.from_arrays([*[pa.array(i, pa.int32()) for i in at], pa.array(values, pa.decimal128(38, 0))], names=schema.split())


def _sums(width: int):
    def add(batch: pa.RecordBatch) -> np.ndarray:
        x = _rows(batch.column("x"), width)
        big = np.abs(x.astype(float)).max(initial=0) >= 2**31
        return np.append((x.astype(object) if big else x).sum(axis=0).astype(object), len(x))

    return lambda batches: _total(batches, "i total", add)


def _products(width: int, middle: list[int]):
    def add(batch: pa.RecordBatch) -> np.ndarray:
        x = _rows(batch.column("x"), width)
        out = np.zeros((width + 1, width), object)
        top = int(np.abs(x.astype(float)).max(initial=0)) + max((abs(m) for m in middle), default=0) + 1
        step = int(2**53 // top**2)  # so many products add up exactly in doubles
        if step < 64:
            y = x.astype(object) - np.array(middle, object)
            out[:width], out[width] = y.T @ y, y.sum(axis=0)
            return out
        y = (x - np.array(middle)).astype(float)
        for lo in range(0, len(y), step):
            part = y[lo : lo + step]
            out[:width] += (part.T @ part).astype(np.int64)
            out[width] += part.sum(axis=0).astype(np.int64)
        return out

    return lambda batches: _total(batches, "i j total", add)


@dataclass(frozen=True)
class Whitening:
    """Number and sums of the fit list, its leading components and what each explains."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def good(self) -> np.ndarray:
        """Components with a variance above rounding."""
        return self.values > NULL_SHARE * len(self.sums) * self.values.max(initial=0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; centred entries are exact before the one rounding of the product."""
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((x - whole).astype(float) - rest) @ self.vectors / np.sqrt(np.where(self.good(), self.values, np.nan))


def fit(rows: DataFrame, components: int, width: int) -> Whitening | None:
    """``rows``: distinct vectors ``x`` of ``width`` entries, read twice. None without any."""
    got = rows.mapInArrow(_sums(width), f"i int, total {SUM}").groupBy("i").agg(F.sum("total").alias("total")).collect()
    sums = {r["i"]: int(r["total"]) for r in got}
    n = sums.pop(width, 0)
    if not n:
        return None
    total = [sums[i] for i in range(width)]
    middle = [(2 * s + n) // (2 * n) for s in total]
    parts = rows.mapInArrow(_products(width, middle), f"i int, j int, total {SUM}")
    got = parts.filter("i <= j OR i = %d" % width).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    cell = {(r["i"], r["j"]): int(r["total"]) for r in got}
    off = [cell[width, j] for j in range(width)]  # sums of the centred entries: less than n each
    cov = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            cov[i, j] = cov[j, i] = (n * cell[i, j] - off[i] * off[j]) / (n * n)
    values, vectors = principal(cov, min(components, width))
    return Whitening(n, tuple(total), values, vectors, float(np.trace(cov)))


def identity_error(rows: DataFrame, model: Whitening, width: int) -> float | None:
    """Largest entry of the whitened covariance minus the identity, measured on the fit list; null without a component of positive variance."""
    good = np.flatnonzero(model.good())
    if not len(good):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(good) + 1, len(good)))
        for batch in batches:
            w = model.project(_rows(batch.column("x"), width))[:, good]
            total[:-1] += w.T @ w
            total[-1] += w.sum(axis=0)
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "total"])

    got = rows.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    cov = np.zeros((len(good) + 1, len(good)))
    for r in got:
        cov[r["i"], r["j"]] = r["total"] / model.n
    return float(np.abs(cov[:-1] - np.outer(cov[-1], cov[-1]) - np.eye(len(good))).max())


def _whitened(model: Whitening, error: float | None, width: int):
    k = len(model.values)
    share = [float(v / model.trace) if model.trace else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _rows(batch.column("x"), width), batch.num_rows
            w = model.project(x)
            rough = ((model.n * x.astype(float) - np.array(model.sums, float)) ** 2).sum(axis=1)
            if rough.max(initial=0) < 2**62:
                far = pa.array(((model.n * x - np.array(model.sums)) ** 2).sum(axis=1))
            else:
                exact = ((model.n * x.astype(object) - np.array(model.sums, object)) ** 2).sum(axis=1)
                far = pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())
            at = np.repeat(np.arange(m), k)
            flat = w.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                 far.take(pa.array(at)), pa.array(flat, pa.float64(), mask=np.isnan(flat)), pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and leading component.

    An entry c counts as the integer x = floor(scale * c). Vectors that are null
    or hold a null or non-finite entry are left out. The model is fitted on each
    distinct integer vector once: ``n`` of them, sums S, covariance with divisor n.
    ``deviation`` is the sum of (n * x - S)**2, null where a long cannot hold it.

    Vectors shorter than the longest, empty ones too, count as filled with zeros.
    Repeated rows and rows without id are all returned. A component without
    variance (fewer independent vectors than components) has ``whitened`` null and
    is left out of ``identity_error``, which is null if none is left; ``explained``
    is null if all vectors are equal. There are no more components than entries.
    No vectors give no rows; other columns are ignored. On the driver: the matrix,
    width by width, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("x")).filter("x IS NOT NULL")
    low, width = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    none = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not width:
        return none
    if low != width:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    fitted = written(rows.select("x").distinct(), "whitening-fit")
    model = fit(fitted, components, width)
    if model is None:
        return none
    return rows.mapInArrow(_whitened(model, identity_error(fitted, model, width), width), none.schema)

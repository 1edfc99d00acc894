"""Labelled samples of bounded size, and logistic regression on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, per_class: int, max_chars: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[pd.DataFrame, dict[int, int]]:
    """At most ``per_class`` whole texts of each label, of up to ``max_chars`` characters and not held out, in hashed order; and how many rows have each label.

    Of several texts of an id the smallest counts, so reruns learn from the same ones. The sample is what a model may be fitted on; it does not grow with the input.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL")
    known = known.filter(~held_out(F.col("id"), folds, fold)).groupBy("id").agg(F.max("label").alias("label"))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") <= max_chars)
    # twice the ids, as some texts may be missing or too long
    ids = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(2 * per_class) for k in (0, 1)]
    rows = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    parts = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    sample = parts[0].unionByName(parts[1]).toPandas()
    return sample.sort_values("id", ignore_index=True), totals


class Logistic:
    """Weighted ridge logistic regression by Newton steps; constant features are harmless."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = x.std(axis=0) + 1e-6 if len(x) else np.ones(x.shape[1])
        self.w = np.zeros(x.shape[1] + 1)
        if not len(y) or y.min() == y.max():  # nothing to tell apart: the share of label 1, kept off 0 and 1
            self.w[-1] = np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5)) if len(y) else 0.0
            return
        z = self._design(x)
        pull = np.full(z.shape[1], ridge * weight.sum())
        pull[-1] = 1e-9
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            gradient = z.T @ (weight * (p - y)) + pull * self.w
            curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(pull)
            step = np.linalg.solve(curve, gradient)
            self.w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -30, 30)))

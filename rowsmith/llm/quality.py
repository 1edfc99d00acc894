"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded
from its bytes and words; gated attention, learned from document labels alone,
weighs the encodings, and the weighted mean is scored:

    z_i = tanh(W x_i + b),  a = softmax_i(w . (tanh(V z_i) * sigmoid(U z_i))),
    score = sigmoid(c . sum_i a_i z_i + d)

The model is fitted with numpy on a bounded sample (``PER_CLASS`` whole texts
per label, of up to ``MAX_CHARS`` characters); every passage of every text is
scored on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rowsmith.llm.fitting import Logistic, held_out, labelled_sample
from rowsmith.llm.frames import whole_row
from rowsmith.llm.words import Words, blocks

PER_CLASS = 1500
MAX_CHARS = 20_000
PASSAGE = 64
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 25, 64, 0.01

# Byte classes: lower, upper, digit, blank, line end, each ASCII mark, lead and following bytes of non-ASCII characters.
_MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate([range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), (0x20, 0x09), (0x0A, 0x0D), range(0xC0, 0x100), range(0x80, 0xC0)]):
    CLASS[list(_bytes)] = _k
CLASS[_MARKS] = 7 + np.arange(len(_MARKS))
N_CLASSES = 8 + len(_MARKS)  # the last: control bytes
CLASS[[c for c in range(0x20) if c not in (0x09, 0x0A, 0x0D)] + [0x7F]] = N_CLASSES - 1
N_FEATURES = N_CLASSES + 7


def encode(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per block: passage features and the first passage of each text; a text without words has one passage of zeros."""
    for lo, hi in blocks(texts, 4 << 20):
        words = Words(texts.slice(lo, hi - lo))
        n_pass = np.maximum(1, -(-words.counts // PASSAGE))
        first = np.concatenate([[0], np.cumsum(n_pass)])
        doc = words.text_of()
        within = np.arange(len(words)) - words.first[doc]
        passage = first[doc] + within // PASSAGE
        x = np.zeros((first[-1], N_FEATURES))
        n = np.bincount(passage, minlength=first[-1])
        full = np.flatnonzero(n)
        heads = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(words) else np.zeros(0, np.int64)
        begin, end = words.starts[heads], np.append(words.starts[heads[1:]], 0)
        tails = np.append(heads[1:], len(words)) - 1 if len(words) else heads
        end = words.ends[tails] if len(words) else end[:0]
        # bytes from a passage's first word to its last
        length = end - begin
        of = np.repeat(full, length)
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
        marks = np.bincount(of * N_CLASSES + CLASS[words.raw[at]], minlength=first[-1] * N_CLASSES).reshape(-1, N_CLASSES)
        x[:, :N_CLASSES] = np.sqrt(marks / np.maximum(marks.sum(axis=1, keepdims=True), 1))
        h = words.hashes()
        size = words.ends - words.starts
        total = np.maximum(n, 1)
        order = np.lexsort((h, passage))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
        upper = (words.raw[words.starts] >= 0x41) & (words.raw[words.starts] <= 0x5A) if len(words) else again
        stats = [np.bincount(passage, v, minlength=first[-1]) / total for v in (size, size**2, size >= 15, size <= 2, upper, again)]
        x[:, N_CLASSES:] = np.stack([np.bincount(passage[order], new, minlength=first[-1]) / total, np.sqrt(stats[0]), np.sqrt(stats[1]), *stats[2:]], axis=1)
        yield x, first


def _sums(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(v, first[:-1], axis=0)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class AttentionModel:
    def __init__(self, sample: pd.DataFrame, totals: dict[int, int]):
        y = sample["label"].to_numpy().astype(float)
        parts = list(encode(pa.array(sample["text"], pa.string())))
        x = np.concatenate([p for p, _ in parts]) if parts else np.zeros((0, N_FEATURES))
        counts = np.concatenate([np.diff(f) for _, f in parts]) if parts else np.zeros(0, int)
        first = np.concatenate([[0], np.cumsum(counts)]).astype(int)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 0.02) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
        rng = np.random.default_rng(3)
        self.p = {
            "W": rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE),
            "c": np.zeros(HIDDEN), "d": np.zeros(1),
        }
        share = np.where(y == 1, totals.get(1, 0) / max(1, (y == 1).sum()), totals.get(0, 0) / max(1, (y == 0).sum()))
        share = share / max(share.sum(), 1e-9) * len(y)
        if len(y) and y.min() < y.max():
            self._train(self._scaled(x), first, y, rng)
        # the sample has other class shares than the labels: a last logistic step on the document's logit
        logit = np.concatenate([self._logit(self._scaled(p), f) for p, f in parts]) if parts else np.zeros(0)
        self.calibration = Logistic(logit[:, None], y, share)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        z = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(z @ p["V"]), _sigmoid(z @ p["U"])
        s = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(s - np.maximum.reduceat(s, first[:-1])[bag])
        a = e / _sums(e, first)[bag]
        m = _sums(a[:, None] * z, first)
        return z, t, g, bag, a, m, m @ p["c"] + p["d"][0]

    def _logit(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(x, first)[-1]

    def _train(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        p = self.p
        moment = {k: np.zeros_like(v) for k, v in p.items()}
        square = {k: np.zeros_like(v) for k, v in p.items()}
        class_weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), BATCH):
                docs = order[lo : lo + BATCH]
                size = np.diff(first)[docs]
                f = np.concatenate([[0], np.cumsum(size)])
                rows = np.arange(f[-1]) - np.repeat(f[:-1], size) + np.repeat(first[docs], size)
                xb = x[rows]
                z, t, g, bag, a, m, o = self._forward(xb, f)
                do = (_sigmoid(o) - y[docs]) * class_weight[docs] / len(docs)
                grad = {"c": m.T @ do, "d": np.array([do.sum()])}
                dm = do[:, None] * p["c"]
                da = (z * dm[bag]).sum(axis=1)
                ds = a * (da - _sums(a * da, f)[bag])
                grad["w"] = (t * g).T @ ds
                dt, dg = ds[:, None] * p["w"] * g * (1 - t**2), ds[:, None] * p["w"] * t * g * (1 - g)
                grad["V"], grad["U"] = z.T @ dt, z.T @ dg
                dz = (a[:, None] * dm[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - z**2)
                grad["W"], grad["b"] = xb.T @ dz, dz.sum(axis=0)
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k in p:
                    d = grad[k] + 1e-4 * p[k]
                    moment[k] = 0.9 * moment[k] + 0.1 * d
                    square[k] = 0.999 * square[k] + 0.001 * d**2
                    p[k] = p[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)

    def predict(self, texts: pa.Array) -> np.ndarray:
        out = [self._logit(self._scaled(x), first) for x, first in encode(texts)]
        return self.calibration.predict(np.concatenate(out)[:, None]) if out else np.zeros(0)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(m.predict(batch.column("text")), pa.float64())], schema=pa.schema([batch.schema.field("row"), ("score", pa.float64())]))

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, label_col: str = "quality") -> AttentionModel:
    return AttentionModel(*labelled_sample(docs, labels, label_col, folds, fold, PER_CLASS, MAX_CHARS))


def score(docs: DataFrame, model: AttentionModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``score`` for every row: ``row`` is a struct of the columns ``carry`` (all by default).

    The score, from 0 to 1, rises with the likelihood of label 1. A null or empty
    text counts as one passage without words. Repeated rows score alike; an empty
    table gives none.
    """
    cols = carry or docs.columns
    src = docs.select(whole_row(docs, cols).alias("row"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return src.mapInArrow(_score(shared), StructType([src.schema["row"], StructField("score", DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score``; labels with null or other values than 0 and 1 are not learned from."""
    out = score(docs, fit(docs, labels), carry=["doc_id"])
    return out.select("row.doc_id", held_out(F.col("row.doc_id"), 5, 0).alias("held_out"), "score")

"""Toxicity by compression distance with two zstandard dictionaries.

One dictionary is trained on ordinary text, one on the passages that set toxic
texts apart: the byte sequences whose distinct contexts are many times as
frequent there (contexts, not occurrences, so copies of a text count once),
picked until they cover the words concerned. A window, one word with its leading
blank, is compressed with the ordinary dictionary and with both; the bytes saved
are its toxicity. Per document, the numbers of windows over each threshold give
a logistic score, calibrated on labelled texts. The filler beside the ordinary
dictionary keeps distances alike, and the blanks after a window let the
compressor look at its last bytes.

Models are fitted on a bounded sample (``PER_CLASS`` whole texts per label, of up
to ``MAX_CHARS`` characters); scoring reads every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rowsmith.llm.fitting import Logistic, held_out, labelled_sample
from rowsmith.llm.frames import whole_row
from rowsmith.llm.words import Words, blocks, mix

PER_CLASS = 1000
MAX_CHARS = 20_000
DICT_BYTES = 1024
GRAMS = range(4, 13)
RATIO = 15
LEVELS = (2, 3, 4, 5, 6, 7)
TAIL = b" " * 16


def _contexts(texts: list[bytes]) -> dict[bytes, int]:
    """How many distinct words each word follows."""
    words = Words(pa.array(texts, pa.binary()).cast(pa.string()))
    h = words.hashes()
    before = np.zeros(len(h), np.uint64)
    before[1:] = h[:-1]
    before[words.first[:-1][words.counts > 0]] = 0
    _, once = np.unique(mix(before) + h, return_index=True)
    _, at, counts = np.unique(h[once], return_index=True, return_counts=True)
    at = once[at]
    raw = words.raw.tobytes()
    return {raw[x:y]: n for x, y, n in zip(words.starts[at].tolist(), words.ends[at].tolist(), counts.tolist())}


def _grams(word: bytes) -> set[bytes]:
    x = b" " + word
    return {x[i : i + n] for n in GRAMS for i in range(len(x) - n + 1)}


def telling_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[tuple[bytes, int]]:
    """Byte sequences with ``RATIO`` times the contexts in toxic texts, each with the number it adds to the cover."""
    t, o = _contexts(toxic), _contexts(ordinary)
    least = max(3, min(8, len(toxic) // 20))
    count: Counter = Counter()
    for w, n in t.items():
        for g in _grams(w):
            count[g] += n
    count = Counter({g: n for g, n in count.items() if n >= least})
    other: Counter = Counter()
    for w, n in o.items():
        for g in _grams(w):
            if g in count:
                other[g] += n
    n_t, n_o = max(1, sum(t.values())), max(1, sum(o.values()))
    telling = {g for g, n in count.items() if n / n_t >= RATIO * (other[g] + 1) / n_o}
    if not telling and count:  # few ordinary texts: the ratio cannot be reached
        telling = {g for g in count if not other[g]}
    holds = {w: h for w in t if (h := _grams(w) & telling)}
    out: list[tuple[bytes, int]] = []
    while holds:
        c: Counter = Counter()
        for w, h in holds.items():
            for g in h:
                c[g] += t[w]
        top = max(c.values())
        if top < least:
            break
        g = max((g for g in c if c[g] >= 0.9 * top), key=lambda g: (len(g), c[g], g))
        out.append((g, c[g]))
        holds = {w: h for w, h in holds.items() if g not in h}
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    total = b"".join(samples)
    try:
        return zstandard.train_dictionary(min(size, max(256, len(total) // 4)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return total[-size:]


class Model:
    def __init__(self, sample: pd.DataFrame, totals: dict[int, int]):
        texts = [s.lower().encode() for s in sample["text"]]
        y = sample["label"].to_numpy()
        number = np.zeros(len(y), int)
        for k in (0, 1):
            number[y == k] = np.arange((y == k).sum())
        apart = (y == 1).sum() >= 60  # enough to calibrate on texts the dictionaries have not seen
        trains = (number % 3 != 2) if apart else np.ones(len(y), bool)
        toxic, ordinary = ([t for t, k, use in zip(texts, y, trains) if k == label and use] for label in (1, 0))
        self.passages = telling_passages(toxic, ordinary)
        rng = np.random.default_rng(0)
        drawn = [g for g, n in self.passages for _ in range(min(n, 400))]
        drawn = [drawn[i] for i in rng.permutation(len(drawn))]
        self.toxic = _dictionary([b"".join(drawn[i : i + 8]) for i in range(0, len(drawn), 8)], DICT_BYTES)
        pieces = [b" ".join(p) for t in ordinary[:1500] for p in _chunks(t.split(), 10)]
        self.ordinary = _dictionary(pieces, DICT_BYTES)
        self.filler = rng.integers(0, 9, len(self.toxic), dtype=np.uint8).tobytes()
        check = ~trains if apart else trains
        x = self.features(pa.array(sample["text"][check], pa.string()))
        yc = y[check].astype(float)
        weight = np.where(yc == 1, totals.get(1, 0) / max(1, (yc == 1).sum()), totals.get(0, 0) / max(1, (yc == 0).sum()))
        self.logistic = Logistic(x, yc, weight / max(weight.sum(), 1e-9) * len(yc))
        if not (y == 1).any():  # no toxic text to learn from: nothing counts as toxic
            self.logistic.w[:] = 0
            self.logistic.w[-1] = -5.0

    def compressors(self):
        options = zstandard.ZstdCompressionParameters(
            window_log=12, hash_log=12, chain_log=12, search_log=4, min_match=4, target_length=8, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        for extra in (self.filler, self.toxic):
            d = zstandard.ZstdCompressionDict(self.ordinary + extra, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=options)
            yield zstandard.ZstdCompressor(dict_data=d, compression_params=options).compress

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: log counts and shares of windows that save each number of bytes, and log windows."""
        plain, both = self.compressors()
        out = []
        for lo, hi in blocks(texts, 8 << 20):
            words = Words(texts.slice(lo, hi - lo), lower=True)
            coded = pa.array(words.hashes()).dictionary_encode()
            which = coded.indices.to_numpy()
            first = np.zeros(len(coded.dictionary), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            raw = words.bytes.tobytes()
            windows = (b" " + raw[a:b] + TAIL for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist()))
            saved = np.array([len(plain(w)) - len(both(w)) for w in windows], np.int64)
            saved = np.clip(saved, 0, LEVELS[-1])[which] if len(which) else np.zeros(0, np.int64)
            table = np.bincount(words.text_of() * 8 + saved, minlength=8 * (hi - lo)).reshape(-1, 8)
            over = np.stack([table[:, k:].sum(axis=1) for k in LEVELS], axis=1)
            n = words.counts[:, None]
            out.append(np.concatenate([np.log1p(over), np.sqrt(over / np.maximum(n, 1)), np.log1p(n)], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2 * len(LEVELS) + 1))


def _chunks(words: list[bytes], n: int) -> list[list[bytes]]:
    return [words[i : i + n] for i in range(0, len(words), n)]


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            p = m.logistic.predict(m.features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p)], schema=pa.schema([batch.schema.field("row"), ("score", pa.float64())]))

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, label_col: str = "toxic") -> Model:
    return Model(*labelled_sample(docs, labels, label_col, folds, fold, PER_CLASS, MAX_CHARS))


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``score`` for every row: ``row`` is a struct of the columns ``carry`` (all by default).

    The score, from 0 to 1, rises with the likelihood of label 1. A null text
    scores as an empty one. Repeated rows score alike; an empty table gives none.
    A model fitted without any toxic text scores everything near 0.
    """
    cols = carry or docs.columns
    src = docs.select(whole_row(docs, cols).alias("row"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return src.mapInArrow(_score(shared), StructType([src.schema["row"], StructField("score", DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score``; labels with null or other values than 0 and 1 are not learned from."""
    out = score(docs, fit(docs, labels), carry=["doc_id"])
    return out.select("row.doc_id", held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "score")

"""Benchmark decontamination with an FM-index per training shard.

A task cuts its documents into shards of a few MB, indexes the word sequence of
each (suffix array by prefix tripling, Burrows-Wheeler transform in a wavelet
matrix, every 16th text position sampled), searches all benchmark windows
backwards at once, and locates what occurs by walking to the next sample.
Separators keep matches inside a document. Nothing is shuffled.

The benchmark reaches the tasks in pieces of at most ``PIECE_BYTES`` of text;
a larger benchmark makes further passes over the documents, each adding to the
spans and items found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.frames import drop_scratch, held, text_bytes, whole_row
from rowsmith.llm.words import ALNUM, Words, blocks

SHARD_BYTES = 6 << 20
PIECE_BYTES = 8 << 20
SAMPLE = 16


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Order of all suffixes; ``codes`` are from 1, the end sorts first."""
    n = len(codes)
    width = max(int(codes.max(initial=1)), n).bit_length()
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = codes
    per = 3 if width <= 21 else 2

    def key(at: np.ndarray, step: int) -> np.ndarray:
        k = rank[at]
        for p in range(1, per):
            k = (k << width) | rank[np.minimum(at + p * step, n)]
        return k

    k = key(np.arange(n), 1)
    sa = np.argsort(k)
    slots, k, step = np.arange(n), k[sa], 1
    while len(slots):
        new = np.ones(len(slots), bool)
        new[1:] = k[1:] != k[:-1]
        heads = np.flatnonzero(new)
        rank[sa[slots]] = slots[np.repeat(heads, np.diff(np.append(heads, len(new))))] + 1
        single = new & np.append(new[1:], True)
        slots = slots[~single]
        step *= per
        k = key(sa[slots], step)
        order = np.argsort(k)
        sa[slots], k = sa[slots][order], k[order]
    return sa


class BitVector:
    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            one = (seq >> shift & 1).astype(bool)
            zeros = seq[~one]
            self.levels.append((shift, BitVector(one), len(zeros)))
            seq = np.concatenate([zeros, seq[one]])

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each code before each position."""
        start = np.zeros(len(code), np.int64)
        both = np.concatenate([start, at])
        n = len(code)
        for shift, bits, zeros in self.levels:
            ones = bits.rank(both)
            up = np.tile((code >> shift & 1).astype(bool), 2)
            both = np.where(up, zeros + ones, both - ones)
        return both[n:] - both[:n]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code at each position, and its occurrences before."""
        code, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            up = bits.get(at)
            code |= up.astype(np.int64) << shift
            a, s = bits.rank(at), bits.rank(start)
            at, start = np.where(up, zeros + a, at - a), np.where(up, zeros + s, start - s)
        return code, at - start


class FMIndex:
    """Over codes 1..; 0 is the end mark added here."""

    def __init__(self, codes: np.ndarray):
        n = len(codes) + 1
        text = np.append(codes, 0).astype(np.int64)
        sa = np.concatenate([[n - 1], suffix_array(codes)])
        bits = max(1, int(text.max()).bit_length())
        self.wavelet = WaveletMatrix(text[sa - 1].astype(np.int32), bits)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        self.marked = BitVector(sa % SAMPLE == 0)
        self.sampled = sa[sa % SAMPLE == 0]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern (left-aligned rows; codes below 1 occur nowhere)."""
        lo, hi = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            at = at[(patterns[at, :size] > 0).all(axis=1)]
            c = patterns[at, size - 1]
            a, b = self.begin[c], self.begin[c + 1]
            for k in range(size - 2, -1, -1):
                live = a < b
                at, a, b = at[live], a[live], b[live]
                if not len(at):
                    break
                c = patterns[at, k]
                ends = self.begin[np.tile(c, 2)] + self.wavelet.rank(np.tile(c, 2), np.concatenate([a, b]))
                a, b = ends[: len(at)], ends[len(at) :]
            lo[at], hi[at] = a, np.maximum(a, b)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        found, left = np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        for walked in range(SAMPLE):
            at = rows[left]
            here = self.marked.get(at)
            found[left[here]] = self.sampled[self.marked.rank(at[here])] + walked
            left = left[~here]
            if not len(left):
                break
            code, before = self.wavelet.access(rows[left])
            rows[left] = self.begin[code] + before
        return found


class Windows:
    """The distinct windows of a piece of the benchmark, as word hashes, and the items each comes from."""

    def __init__(self, items: list, texts: list, size: int):
        words = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        codes = words.hashes()
        starts = words.windows(size)
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        rows = np.zeros((len(starts) + len(short), size), np.uint64)
        rows[: len(starts)] = codes[starts[:, None] + np.arange(size)] if len(starts) else 0
        for k, t in enumerate(short, len(starts)):
            rows[k, : words.counts[t]] = codes[words.first[t] : words.first[t + 1]]
        lens = np.concatenate([np.full(len(starts), size), words.counts[short]]).astype(np.int64)
        owner = np.concatenate([words.text_of()[starts], short]).astype(np.int64)
        both = np.concatenate([rows, lens[:, None].astype(np.uint64)], axis=1)
        distinct, which = np.unique(both, axis=0, return_inverse=True) if len(both) else (both, owner)
        self.items = np.array(items, dtype=object)  # null for an item without id
        self.hashes, self.sizes = distinct[:, :size], distinct[:, size].astype(np.int64)
        pairs = np.unique(np.stack([which.ravel(), owner], axis=1), axis=0) if len(both) else np.zeros((0, 2), np.int64)
        self.item = pairs[:, 1]
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Window number and first word of every occurrence in a shard."""
        empty = np.zeros(0, np.int64)
        if not len(words) or not len(self.sizes):
            return empty, empty
        coded = pa.array(words.hashes()).dictionary_encode()
        vocabulary = coded.dictionary.to_numpy()
        codes = coded.indices.to_numpy().astype(np.int64) + 2  # 1 separates documents
        at = np.arange(len(words)) + words.text_of()
        text = np.ones(len(words) + len(words.counts), np.int64)
        text[at] = codes
        order = np.argsort(vocabulary)
        place = np.searchsorted(vocabulary, self.hashes, sorter=order)
        place[place == len(order)] = 0
        known = order[place]
        patterns = np.where(vocabulary[known] == self.hashes, known + 2, 0)
        index = FMIndex(text)
        lo, hi = index.search(patterns, self.sizes)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return which, np.searchsorted(at, index.locate(rows))


def _search(windows, limit: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for batch in batches:
            names = batch.schema.names
            texts = batch.column("text")
            n_words, n_hit, spans, items, clean = [], [], [], [], []
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for lo, hi in blocks(texts, limit):
                words = Words(texts.slice(lo, hi - lo), ALNUM, lower=True)
                which, first = w.find(words)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + w.sizes[which], -1)
                doc = words.text_of()[first]
                for k in range(hi - lo):
                    for s in old_spans[lo + k] or ():
                        cover[words.first[k] + s["first"]] += 1
                        cover[words.first[k] + s["last"]] -= 1
                hit = np.cumsum(cover[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                got = np.unique(np.stack([doc, which], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
                got_from = np.searchsorted(got[:, 0], np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    a, b = words.first[k], words.first[k + 1]
                    cut = int(total[b] - total[a])
                    n_words.append(int(b - a))
                    n_hit.append(cut)
                    own = set(old_items[lo + k] or ())
                    for p in got[got_from[k] : got_from[k + 1], 1]:
                        own.update(i for i in w.items[w.item[w.item_from[p] : w.item_from[p + 1]]] if i is not None)
                    items.append(sorted(own))
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8))) if cut else ()
                    spans.append([{"first": int(x), "last": int(y)} for x, y in zip(turn[::2], turn[1::2])])
                    if with_text:
                        clean.append(_without(words, k, spans[-1]) if cut else texts[lo + k].as_py())
            new = {"n_words": n_words, "n_hit": n_hit, "spans": spans, "items": items} | ({"clean": clean} if with_text else {})
            yield pa.RecordBatch.from_arrays([pa.array(new[c], batch.schema.field(c).type) if c in new else batch.column(c) for c in names], names=names)

    return run


def _without(words: Words, k: int, spans: list) -> str:
    lo, hi = words.offsets[k], words.offsets[k + 1]
    parts, at = [], lo
    for s in spans:
        parts.append(words.raw[at : words.starts[words.first[k] + s["first"]]].tobytes())
        at = words.ends[words.first[k] + s["last"] - 1]
    return b"".join([*parts, words.raw[at:hi].tobytes()]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", with_text: bool = True, shard_bytes: int = SHARD_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Words of documents inside an occurrence of a benchmark window.

    A window is ``size`` consecutive words of an item; a shorter item, if it has
    words, is one window. Words are runs of 0-9, a-z (A-Z lowered) and non-ASCII
    characters. Returns ``doc_id, n_words, n_hit, spans, items, clean, row``:
    merged spans in word numbers (``last`` exclusive), item ids as sorted text,
    the text without the spans (``with_text``), and the input row as a struct, so
    no column name can clash.

    A null or empty text has no words; null texts stay null. The words of an item
    without id count as hit like any others, but it has no place among ``items``;
    items without text have no windows. Repeated rows are ordinary rows, repeated items count
    once. An empty benchmark hits nothing, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    fields = "array<struct<first:bigint,last:bigint>>"
    found = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"), F.array().cast(fields).alias("spans"), F.array().cast("array<string>").alias("items"),
        F.lit(None).cast("string").alias("clean"), whole_row(docs).alias("row"))
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).dropna(subset=["text"])
    pieces = max(1, -(-text_bytes(bench) // piece_bytes))
    last_path = None
    for k in range(pieces):
        rows = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(pieces)) == k).collect()
        shared = spark.sparkContext.broadcast(Windows([r.item for r in rows], [r.text for r in rows], size))
        found = found.mapInArrow(_search(shared, shard_bytes, with_text and k == pieces - 1), found.schema)
        if k < pieces - 1:
            # one piece at a time is held anywhere
            found, path = held(found, "windows")
            shared.unpersist()
            if last_path:
                drop_scratch(spark, last_path)
            last_path = path
    return found.drop("text")

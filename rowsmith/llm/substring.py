"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted over the corpus.

Spark groups the rows three times, always by a key whose groups are bounded:

1. documents by shard (hash of id and text). A shard hashes all its windows and
   sends each distinct hash once, packed by hash range, so a window that a third
   of the corpus repeats arrives as often as there are shards, not as often as
   it occurs.
2. hash ranges: a hash that two shards sent occurs more than once. The answer is
   one bit per hash sent.
3. documents and answers by shard again (the first shuffle is reused): windows
   repeated over shards or inside the shard merge into maximal removal intervals.

Hashes have 64 bits: with n windows, n**2 / 2**65 pairs of different windows are
expected to be taken as equal (5e-4 for 1.4e8 windows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.frames import power_of_two, shard_of, text_bytes
from rowsmith.llm.words import Words, blocks, mix, sliding

SHARD_BYTES = 4 << 20
RANGE_WINDOWS = 8 << 20
HASH_BYTES = 7  # the range number holds the eighth byte


def _window_hashes(texts: pa.Array, size: int):
    """Per block of texts: row range, words, window starts, window hashes."""
    for lo, hi in blocks(texts, 2 << 20):
        words = Words(texts.slice(lo, hi - lo))
        at = words.windows(size)
        yield lo, hi, words, at, mix(sliding(words.hashes(), at, at + size))


def _ranges(hashes: np.ndarray, bits: int):
    """Distinct hashes in ascending order, and where each range of the top ``bits`` begins."""
    distinct = np.unique(hashes)
    edges = np.searchsorted(distinct, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return distinct, np.append(edges, len(distinct))


def _all_hashes(texts: pa.Array, size: int) -> np.ndarray:
    parts = [h for *_, h in _window_hashes(texts, size)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _send(size: int, bits: int):
    def shard(key: tuple, rows: pa.Table) -> pa.Table:
        distinct, edges = _ranges(_all_hashes(rows.column("text").combine_chunks(), size), bits)
        packed = distinct.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
        full = np.flatnonzero(np.diff(edges))
        return pa.table(
            {
                "range": pa.array(full, pa.int32()),
                "shard": pa.array(np.full(len(full), key[0].as_py()), pa.int32()),
                "hashes": pa.array([packed[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary()),
            }
        )

    return shard


def _count(key: tuple, rows: pa.Table) -> pa.Table:
    sent = rows.column("hashes").to_pylist()
    wide = np.zeros((sum(map(len, sent)) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, HASH_BYTES)
    hashes = wide.view(np.uint64).ravel()
    order = np.sort(hashes)
    repeated = np.unique(order[1:][order[1:] == order[:-1]])
    at = np.searchsorted(repeated, hashes)
    hit = np.zeros(len(hashes), bool)
    if len(repeated):
        at[at == len(repeated)] = 0
        hit = repeated[at] == hashes
    ends = np.cumsum([len(x) // HASH_BYTES for x in sent])
    bits = [np.packbits(hit[e - len(x) // HASH_BYTES : e]).tobytes() for x, e in zip(sent, ends)]
    return pa.table({"range": rows.column("range"), "shard": rows.column("shard"), "bits": pa.array(bits, pa.binary())})


_OUT = "doc_id {id}, n_words bigint, n_removed bigint, removed array<struct<first:bigint,last:bigint>>, kept string"


def _cut(size: int, bits: int, schema: pa.Schema):
    def shard(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string())
        hashes = _all_hashes(texts, size)
        distinct, edges = _ranges(hashes, bits)
        repeated = np.zeros(len(distinct), bool)
        for k, b in zip(answers.column("range").to_pylist(), answers.column("bits").to_pylist()):
            n = edges[k + 1] - edges[k]
            repeated[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=n)
        place = np.searchsorted(distinct, hashes)
        repeated |= np.bincount(place, minlength=len(distinct)) > 1
        hit = repeated[place]
        raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        n_words, n_removed, removed, kept = [], [], [], []
        done = 0
        for lo, hi, words, at, h in _window_hashes(texts, size):
            starts = at[hit[done : done + len(h)]]
            done += len(h)
            cover = np.zeros(len(words) + 1, np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + size, -1)
            gone = np.cumsum(cover[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            for k, body in enumerate(raw.slice(lo, hi - lo).to_pylist()):
                a, b = words.first[k], words.first[k + 1]
                cut = int(total[b] - total[a])
                n_words.append(b - a)
                n_removed.append(cut)
                parts = (body or b"").split()
                spans = []
                if cut:
                    g = np.concatenate([[False], gone[a:b], [False]])
                    turn = np.flatnonzero(g[1:] != g[:-1])
                    spans = [{"first": int(x), "last": int(y)} for x, y in zip(turn[::2], turn[1::2])]
                    keep, last = [], 0
                    for s in spans:
                        keep += parts[last : s["first"]]
                        last = s["last"]
                    parts = keep + parts[last:]
                removed.append(spans)
                kept.append(b" ".join(parts).decode())
        cols = [docs.column("doc_id") if docs.num_rows else [], n_words, n_removed, removed, kept]
        return pa.table([pa.chunked_array([pa.array(c, f.type)]) if isinstance(c, list) else c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return shard


def remove_repeats(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text",
                   shard_bytes: int = SHARD_BYTES, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """Cut every word that a window of ``size`` words, occurring again anywhere in the input, covers.

    Returns ``doc_id, n_words, n_removed, removed, kept``: ``removed`` lists the
    maximal intervals in word numbers (``last`` exclusive), ``kept`` joins the
    rest with blanks. Words are runs of bytes other than blank and \\t..\\r;
    windows are judged on the input, so all occurrences go.

    A null or empty text, and one shorter than a window, loses nothing; null ids
    and repeated rows are ordinary rows (a repeated row repeats its windows).
    Other columns are ignored. An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = text_bytes(src)
    n_shards = max(1, -(-total // shard_bytes))
    bits = max(8, power_of_two(total / 4 / range_windows).bit_length() - 1)
    rows = src.withColumn("shard", shard_of(n_shards, "doc_id", "text"))
    sent = rows.groupBy("shard").applyInArrow(_send(size, bits), "range int, shard int, hashes binary")
    answers = sent.groupBy("range").applyInArrow(_count, "range int, shard int, bits binary")
    id_type = src.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = _OUT.format(id=id_type)
    schema = to_arrow_schema(StructType.fromDDL(out))
    return rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_cut(size, bits, schema), out)

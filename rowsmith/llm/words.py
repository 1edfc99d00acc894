"""Words of Arrow text columns as numpy arrays.

All word classes used by the operators are delimited by ASCII bytes, so words
are found on the UTF-8 buffer of a column without making Python strings.
Hashes are polynomial (Rabin-Karp) modulo 2**64: a prefix sum of byte codes
times powers of an odd base, shifted back by the inverse power.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 19
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

# Byte classes. SPACED: anything but blank and \t..\r.  ALNUM: digits, a-z, non-ASCII.
_b = np.arange(256)
SPACED = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))
ALNUM = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)
LOWER = np.where((_b >= 0x41) & (_b <= 0x5A), _b + 32, _b).astype(np.uint8)
del _b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * BASE)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def sliding(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``codes[start:end]`` for each pair."""
    pw, inv = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * pw[: len(codes)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inv[starts]


class Words:
    """Words of a block of texts: byte spans, hashes and the text each belongs to.

    A null text has no words.  ``first[i]:first[i+1]`` are the words of text i.
    """

    def __init__(self, texts: pa.Array, word: np.ndarray = SPACED, lower: bool = False):
        texts = pa.array(texts) if not isinstance(texts, (pa.Array, pa.ChunkedArray)) else texts
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()) if len(texts) else pa.array([], pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.raw = raw
        self.bytes = LOWER[raw] if lower else raw
        inside = word[self.bytes]
        before = np.zeros(len(raw), bool)
        before[1:] = inside[:-1]
        at = self.offsets[:-1]
        before[at[at < len(raw)]] = False
        after = np.zeros(len(raw), bool)
        after[:-1] = inside[1:]
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A hash of each word, computed over pieces of about ``PIECE`` bytes: the working memory does not follow the block."""
        out = np.empty(len(self), np.uint64)
        lo = 0
        while lo < len(out):
            base = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + PIECE, side="right")))
            codes = BYTE_CODES[self.bytes[base : self.ends[hi - 1]]]
            out[lo:hi] = mix(sliding(codes, self.starts[lo:hi] - base, self.ends[lo:hi] - base))
            lo = hi
        return out

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """Start words of all runs of ``size`` words that lie in one text."""
        n = len(self)
        if n < size:
            return np.zeros(0, np.int64)
        ends = np.repeat(self.first[1:], self.counts)
        at = np.arange(n)
        return at[at + size <= ends]


def blocks(texts: pa.Array, limit: int):
    """Row ranges of ``texts`` with at most ``limit`` bytes each (one longer text is a range of its own)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    lo, n = 0, len(sizes)
    while lo < n:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield lo, hi
        lo = hi

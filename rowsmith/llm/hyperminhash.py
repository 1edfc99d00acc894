"""Near-duplicate classes by HyperMinHash sketches of word shingles.

A document's distinct shingles fall into 256 buckets by hash; each bucket stores
one byte, the leading-zero count and the mantissa bits of its minimum. Bands of
five registers, empty ones filled from the bucket's fixed probe order, find
candidates: 40 bands miss a pair of similarity 0.8 with probability 1e-7.

Texts with equal shingle sets collapse first (a plain aggregation). In every
band bucket each member is compared with the bucket's smallest number only; then
buckets whose members still lie in several classes are searched for pairs over
class borders, in blocks of bounded size. The estimate
(C/N - g)/(1 - g), with g the collision chance of registers at the two set
sizes, drops candidates more than ``MARGIN`` standard deviations below the
threshold; what remains is confirmed on the full sets. So no step makes all
pairs of a group, and none holds a group in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowsmith.llm.frames import whole_row, written
from rowsmith.llm.words import BASE, Words, blocks, mix, sliding
from rowsmith.operators.components import connected_components

BUCKETS = 256
BUCKET_BITS = 8
MANTISSA = 4  # bits after the leading one; four more bits hold leading zeros + 1
BAND_ROWS = 5
N_BANDS = 40
MARGIN = 4.5
BLOCK = 1024  # members of a band bucket compared in one piece
_U = np.uint64


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block: row range, row numbers (from 0) and hashes of distinct shingles, both in (row, hash) order.

    A-Z count as a-z. A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    for lo, hi in blocks(texts, 2 << 20):
        words = Words(texts.slice(lo, hi - lo), lower=True)
        codes = words.hashes()
        starts = words.windows(size)
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        s = np.concatenate([starts, words.first[short]])
        e = np.concatenate([starts + size, words.first[short + 1]])
        h = mix(sliding(codes, s, e) + (e - s).astype(_U) * BASE)
        row = words.text_of()[s]
        order = np.argsort(h)
        order = order[np.argsort(row[order], kind="stable")]
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield lo, hi, row[new], h[new]


def registers(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x BUCKETS registers of sorted shingle hashes: 0 if empty, else the code of the bucket's minimum."""
    out = np.zeros((n, BUCKETS), np.uint8)
    cell = row * BUCKETS + (h >> _U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = cell[1:] != cell[:-1]
    v = (h[first] << _U(BUCKET_BITS)) | _U(1 << (BUCKET_BITS - 1))  # never zero
    zeros = np.zeros(len(v), _U)
    for step in (32, 16, 8, 4, 2, 1):
        small = v < (_U(1) << _U(64 - step))
        zeros[small] += _U(step)
        v[small] <<= _U(step)
    mantissa = (v << _U(1)) >> _U(64 - MANTISSA)
    out.reshape(-1)[cell[first]] = ((np.minimum(zeros, _U(14)) + _U(1)) << _U(MANTISSA) | mantissa).astype(np.uint8)
    return out


_PROBES = np.argsort(mix(np.arange(BUCKETS * BUCKETS, dtype=_U) + _U(99)).reshape(BUCKETS, BUCKETS), axis=1)


def densified(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first full one in their own fixed probe order."""
    out = regs.copy()
    row, at = np.nonzero(regs == 0)
    alive = regs.any(axis=1)[row]
    row, at = row[alive], at[alive]
    for t in range(BUCKETS):
        if not len(row):
            break
        value = regs[row, _PROBES[at, t]]
        full = value > 0
        out[row[full], at[full]] = value[full]
        row, at = row[~full], at[~full]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """n x N_BANDS hashes of BAND_ROWS densified registers each."""
    d = densified(regs)[:, : N_BANDS * BAND_ROWS].reshape(len(regs), N_BANDS, BAND_ROWS).astype(_U)
    key = np.tile(np.arange(1, N_BANDS + 1, dtype=_U)[None, :] * BASE, (len(regs), 1))
    for k in range(BAND_ROWS):
        key = mix(key + d[:, :, k] + _U(1))
    return key


# Range of a bucket's minimum, as a share of the bucket, for each register code.
_code = np.arange(1 << MANTISSA, 256)
_z, _m = (_code >> MANTISSA) - 1.0, _code & ((1 << MANTISSA) - 1)
_low = (1 + _m / (1 << MANTISSA)) * 2.0 ** (-_z - 1)
_high = (1 + (_m + 1) / (1 << MANTISSA)) * 2.0 ** (-_z - 1)
_last = _z == 14  # all smaller minima share these codes; their mantissa is uniform
_low[_last], _high[_last] = (_m[_last]) / 16 * 2.0**-14, (_m[_last] + 1) / 16 * 2.0**-14


def collision_rate(sizes: np.ndarray) -> np.ndarray:
    """rows x codes: chance of each register code for a set of the given size; the dot product of two rows is the collision chance."""
    rate = sizes[:, None] / BUCKETS
    return np.exp(-rate * _low) - np.exp(-rate * _high)


def estimates(regs: np.ndarray, chance: np.ndarray, one: np.ndarray, one_chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of each row of ``regs`` with ``one`` (or row by row), and its standard deviation at 0.8."""
    full = (regs > 0) | (one > 0)
    n = np.maximum(full.sum(axis=1), 1)
    same = ((regs == one) & full).sum(axis=1)
    g = np.minimum((chance * one_chance).sum(axis=1) * BUCKETS / n, 0.9)
    return (same / n - g) / (1 - g), np.sqrt(0.16 / n) / (1 - g)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, row, h in shingle_sets(texts, size):
                n = hi - lo
                regs = registers(row, h, n)
                edges = np.searchsorted(row, np.arange(n + 1))
                sums = [np.concatenate([np.zeros(1, _U), np.cumsum(x)]) for x in (h, mix(h + BASE))]
                a, b = (s[edges[1:]] - s[edges[:-1]] for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, n), batch.column("doc_id").slice(lo, n), texts.slice(lo, n), pa.array(np.diff(edges), pa.int64()),
                     pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary())],
                    schema=pa.schema([batch.schema.field("row"), ("doc_id", pa.int64()), batch.schema.field("text"), ("n_shingles", pa.int64()),
                                      ("a", pa.int64()), ("b", pa.int64()), ("regs", pa.binary())]),
                )

    return run


def _unpack(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            keys = band_keys(_unpack(part.column("regs"))).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, N_BANDS, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([part.column("rep"), lists], names=["rep", "keys"])


def _row_sets(texts: pa.Array, size: int):
    sets, regs = [], []
    for lo, hi, row, h in shingle_sets(texts, size):
        regs.append(registers(row, h, hi - lo))
        edges = np.searchsorted(row, np.arange(hi - lo + 1))
        sets += [h[x:y] for x, y in zip(edges[:-1], edges[1:])]
    return sets, np.concatenate(regs) if regs else np.zeros((0, BUCKETS), np.uint8)


def _confirm(size: int, percent: int):
    """Pairs with both texts -> links: estimate first, then the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_u, regs_u = _row_sets(batch.column("text_u"), size)
            sets_v, regs_v = _row_sets(batch.column("text_v"), size)
            near = []
            if sets_u:
                nu, nv = (np.array([len(x) for x in s], float) for s in (sets_u, sets_v))
                est, sd = estimates(regs_u, collision_rate(nu), regs_v, collision_rate(nv))
                for k in np.flatnonzero(est >= percent / 100 - MARGIN * sd):
                    both = len(np.intersect1d(sets_u[k], sets_v[k], assume_unique=True))
                    if both and 100 * both >= percent * (len(sets_u[k]) + len(sets_v[k]) - both):
                        near.append(k)
            at = pa.array(near, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("u").take(at), batch.column("v").take(at)], names=["u", "v"])

    return run


def _across(percent: int):
    """Members of band buckets, in blocks -> per piece, each document of a candidate pair of different classes, with its partners.

    A pair comes up once, in the first band it shares.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rep, comp, bucket = (rows.column(c).to_numpy() for c in ("rep", "comp", "key"))
        part = np.stack([rows.column("i").to_numpy(), rows.column("j").to_numpy(), rows.column("own").to_numpy()], axis=1)
        regs = _unpack(rows.column("regs").combine_chunks())
        keys = np.concatenate([band_keys(regs[x : x + 4096]).view(np.int64) for x in range(0, len(regs), 4096)])
        chance = collision_rate(rows.column("n_shingles").to_numpy().astype(float))
        order = np.lexsort((part[:, 1], part[:, 0], bucket))
        b, p = bucket[order], part[order]
        turn = np.flatnonzero((b[1:] != b[:-1]) | (p[1:, :2] != p[:-1, :2]).any(axis=1)) + 1
        partners: dict[int, list[np.ndarray]] = {}
        for piece in np.split(order, turn):
            i, j = part[piece[0], 0], part[piece[0], 1]
            own = part[piece, 2]
            for n, x in enumerate(piece):
                other = piece[n + 1 :] if i == j else (piece[own == j] if own[n] == i else piece[:0])
                other = other[comp[other] != comp[x]]
                if not len(other):
                    continue
                est, sd = estimates(regs[other], chance[other], regs[x], chance[x])
                other = other[est >= percent / 100 - MARGIN * sd]
                if len(other):
                    shared = keys[other] == keys[x]
                    other = other[keys[x][shared.argmax(axis=1)] == bucket[x]]
                    if len(other):
                        partners.setdefault(int(rep[x]), []).append(rep[other])
        lists = {u: np.unique(np.concatenate(v)) for u, v in partners.items()}
        needed = set(lists).union(*[v.tolist() for v in lists.values()]) if lists else set()
        reps = sorted(needed)
        none = np.zeros(0, np.int64)
        return pa.table({
            "piece": pa.array([key[0].as_py()] * len(reps), pa.int64()), "rep": pa.array(reps, pa.int64()),
            "others": pa.array([lists.get(r, none) for r in reps], pa.list_(pa.int64()))})

    return run


def _confirm_lists(size: int, percent: int):
    """Documents of a piece with their partners -> links between different classes, as a forest: a pair already connected adds none."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sets, _ = _row_sets(rows.column("text").combine_chunks(), size)
        at = {r: k for k, r in enumerate(rows.column("rep").to_pylist())}
        root = list(range(len(sets)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        links: list[tuple[int, int]] = []
        for u, others in zip(rows.column("rep").to_pylist(), rows.column("others").to_pylist()):
            a = sets[at[u]]
            for v in others:
                b = sets[at[v]]
                if top(at[u]) == top(at[v]) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both and 100 * both >= percent * (len(a) + len(b) - both):
                    links.append((max(u, v), min(u, v)))
                    root[top(at[u])] = top(at[v])
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by 100 * |A & B| >= percent * |A | B| over their shingle sets.

    Returns ``doc_id, n_shingles, component_id, kept`` for every row: the class is
    named by its smallest id, and ``kept`` marks that document. Words are runs of
    bytes other than blank and \\t..\\r, A-Z lowered; a set has the distinct runs
    of ``size`` words, or a shorter text's whole sequence.

    A null text or one without words has an empty set and a class of its own. A
    row without id is in the class of its text, and kept if the class has no id
    and the row is its first. Rows repeating an id belong to the classes of their
    texts, and are kept where that is the class's name: ``row_classes`` marks one
    row of each class. Other columns are ignored; an empty table gives an empty
    result.
    """
    out = row_classes(docs, size, percent, id_col, text_col, carry=[])
    kept = F.when(F.col("doc_id").isNull(), F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def row_classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The classes of ``near_duplicates`` row by row: ``row, doc_id, text, n_shingles, component_id, first``.

    ``row`` is a struct of the columns ``carry`` (by default all but the text).
    ``first`` marks exactly one row of each class, one with the smallest id (null
    last), and every row without words. Rows are numbered when their sketches are
    written, distinct sets in the order of their smallest id; sets are linked by
    number, so neither repeated nor missing ids mix or separate classes.
    """
    cols = [c for c in docs.columns if c != text_col] if carry is None else carry
    row = (whole_row(docs, cols) if cols else F.struct(F.lit(None).cast("boolean").alias("none"))).alias("row")
    src = docs.select(row, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rest = StructType.fromDDL("doc_id long, text string, n_shingles long, a long, b long, regs binary")
    schema = StructType([src.schema["row"], *rest.fields])
    sketches = written(src.mapInArrow(_sketch(size), schema).withColumn("no", F.monotonically_increasing_id()), "sketch")
    own = sketches.filter("n_shingles > 0")
    reps = own.groupBy("a", "b", "n_shingles").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "no")).alias("m"))
    # numbers rise over the partitions of the sort: the smallest number of a class has its smallest id
    reps = reps.select("a", "b", "n_shingles", "m.*").orderBy("no_id", "doc_id", "no").withColumn("rep", F.monotonically_increasing_id())
    reps = written(reps.drop("no_id"), "sets")
    sketch_of = written(reps.select("rep", "n_shingles", "no").join(own.select("no", "regs"), "no").drop("no"), "set-sketches")
    keyed = sketch_of.select("rep", "regs").mapInArrow(_bands, "rep long, keys array<long>")
    banded = keyed.select("rep", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("center")).filter("size > 1")
    members = written(banded.join(buckets, "key"), "bands")

    active = reps.select("rep", "no").join(members.select("rep").distinct(), "rep")
    texts = written(own.select("no", "text").join(active, "no").select("rep", "text"), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        one = pairs.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("text_u")), "u")
        both = one.join(texts.select(F.col("rep").alias("v"), F.col("text").alias("text_v")), "v")
        return both.select("u", "v", "text_u", "text_v").mapInArrow(_confirm(size, percent), "u long, v long")

    star = written(links(members.filter("rep <> center").select(F.col("rep").alias("u"), F.col("center").alias("v")).distinct()), "star")
    classes = connected_components(star)
    placed = members.select("key", "size", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    placed = written(placed.select("key", "size", "rep", F.coalesce("component", "rep").alias("comp")), "placed")
    split = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own_block = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")
    across = (
        placed.join(split, "key")
        .withColumn("blocks", n_blocks)
        .withColumn("own", own_block)
        .join(sketch_of, "rep")
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "with"))
        .withColumn("j", F.greatest("own", "with"))
        .withColumn("piece", F.pmod(F.xxhash64("key", "i", "j"), F.lit(_pieces(placed))))
        .select("piece", "key", "i", "j", "own", "rep", "comp", "n_shingles", "regs")
    )
    candidates = across.groupBy("piece").applyInArrow(_across(percent), "piece long, rep long, others array<long>")
    more = candidates.join(texts, "rep").select("piece", "rep", "others", "text").groupBy("piece").applyInArrow(_confirm_lists(size, percent), "u long, v long")
    final = connected_components(star.unionByName(more))

    number = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("a", "b", "n_shingles", "doc_id", "no", "component")
    # only classes of several sets need the name of another
    names = final.select("component").distinct().join(
        reps.select(F.col("rep").alias("component"), F.col("doc_id").alias("class_id"), F.col("no").alias("class_no")), "component")
    named = number.filter("component IS NOT NULL").join(names, "component").select("a", "b", "n_shingles", "class_id", "class_no")
    alone = number.filter("component IS NULL").select("a", "b", "n_shingles", F.col("doc_id").alias("class_id"), F.col("no").alias("class_no"))
    out = sketches.drop("regs").join(named.unionByName(alone), ["a", "b", "n_shingles"], "left")
    words = F.col("n_shingles") > 0
    return out.select(
        "row", "doc_id", "text", "n_shingles", F.when(words, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(words, F.col("no") == F.col("class_no")).otherwise(F.lit(True)).alias("first"))


def _pieces(members: DataFrame) -> int:
    """Groups for the block comparison, about 8,000 rows each."""
    return max(1, members.agg(F.count(F.lit(1)).cast("long")).first()[0] // 8000)

"""Jaccard join of word n-gram sets with adaptive multi-match prefixes.

All shingles have one global order, rare ones first. Two sets of n and m shingles
that are similar enough share at least k tokens within the first
``n - overlap + k`` tokens of the one and ``m - overlap + k`` of the other, for
any k up to the overlap. Each document picks its own k: it lengthens its prefix
while the estimated cost, list entries read plus candidates to verify, falls; in
return a partner has to share as many prefix tokens, the smaller k of the two.

The order comes from counts over all documents: every task counts its shingles in
stretches of ``STRETCH`` and reports those seen twice, so every shingle seen more
often than once per stretch of the corpus is known, and at most ``COMMON`` of
the most frequent ones travel to the tasks. The order decides the work only.

Equal sets are one member. Members meet in the lists of prefix tokens that two
of them share, in two steps, so that no group of copies is compared pair by pair:
each member is verified against the member that most of its lists start with,
then pairs that lie in different classes still are searched for by an equi-join on
(token, size class), where only members outside a list's largest class look for
partners in it. As similar sets share a token in their shortest prefixes too, the
join meets on those; the tokens shared in the longer ones are counted for the pairs
it finds. Verification counts common shingles of the full sets, which are made
for members of candidate pairs only: a bitmap of fixed size keeps most other texts
out of that shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.frames import drop_scratch, held, scratch, written
from rowsmith.llm.hyperminhash import shingle_sets
from rowsmith.llm.words import BASE, mix
from rowsmith.operators.components import connected_components

STRETCH = 1 << 19  # shingles counted at a time in a task: some 20 MB while they are sorted
COMMON = 1 << 20  # shingles whose counts travel to the tasks: at most 12 MB
MOST = 8  # longest extension of a prefix
FEW = 1 << 20  # wanted texts whose marks (24 MB) are broadcast; more are joined by a shuffle
MARKS = 1 << 21  # words of 64 bits in the bitmap of wanted texts: 16 MB
VERIFY = (16, 0.25)  # cost of a candidate in list entries: fixed, and per shingle
_U = np.uint64
ROWS = "doc_id long, t1 long, t2 long, n long, a long, b long, token long, seen long"


def _signatures(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row edges and two 64-bit sums that name each row's set."""
    edges = np.searchsorted(row, np.arange(n + 1))
    sums = [np.concatenate([np.zeros(1, _U), np.cumsum(x)]) for x in (h, mix(h + BASE))]
    a, b = ((s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums)
    return edges, a, b


def _rows_and_counts(size: int):
    """Documents with set sizes and signatures; then, from the same pass, shingles seen twice or more in a stretch."""

    def counted(pile: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, seen = np.unique(np.concatenate(pile), return_counts=True)
        tokens, seen = tokens[seen > 1].view(np.int64), seen[seen > 1]
        for lo in range(0, len(tokens), 1 << 16):
            part = pa.array(tokens[lo : lo + (1 << 16)])
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 6 + [part, pa.array(seen[lo : lo + (1 << 16)])], names=[c.split()[0] for c in ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile, held = [], 0
        for batch in batches:
            for lo, hi, row, h in shingle_sets(batch.column("text"), size):
                edges, a, b = _signatures(row, h, hi - lo)
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "t1", "t2")], pa.array(np.diff(edges)), pa.array(a), pa.array(b), none, none],
                    names=[c.split()[0] for c in ROWS.split(", ")])
                for start in range(0, len(h), STRETCH):
                    pile.append(h[start : start + STRETCH])
                    held += len(pile[-1])
                    if held >= STRETCH:
                        yield from counted(pile)
                        pile, held = [], 0
        if held:
            yield from counted(pile)

    return run


def common_tokens(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``COMMON`` most frequent tokens (as unsigned, sorted) and their counts: whole classes of counts, two to a power of two."""
    total = counts.groupBy("token").agg(F.sum("seen").alias("seen"))
    level = F.floor(F.log2("seen") * 2).cast("int")
    room, least = COMMON, None
    for r in sorted(total.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    got = total.filter(level >= least).toArrow()
    tokens, seen = got.column("token").to_numpy().view(_U), got.column("seen").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], seen[order]


def overlap(n, m, percent: int):
    """Fewest common members of sets of ``n`` and ``m`` members that are similar enough; Python numbers or SQL text."""
    if isinstance(n, str):
        return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def extensions(n: np.ndarray, cost: np.ndarray, edges: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: prefix length without extension, less one, and the number of shared tokens it asks for.

    ``cost`` holds the list lengths of all its tokens in global order.
    """
    least = (percent * n + 99) // 100
    base = n - least
    total = np.concatenate([np.zeros(1), np.cumsum(cost)])
    options = []
    for k in range(1, MOST + 1):
        reads = total[np.minimum(edges[:-1] + base + k, edges[1:])] - total[edges[:-1]]
        options.append(np.where(k <= np.maximum(least, 1), reads * (1 + (VERIFY[0] + VERIFY[1] * n) / k), np.inf))
    return base, np.argmin(np.stack(options), axis=0) + 1


def _prefixes(size: int, percent: int, tokens: np.ndarray, seen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, h in shingle_sets(batch.column("text"), size):
                if not len(h):
                    continue
                edges, a, _ = _signatures(row, h, hi - lo)
                n = np.diff(edges)
                cost = np.ones(len(h), np.int64)  # a token that is not known as frequent
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                    cost = np.where(tokens[at] == h, seen[at], 1)
                order = np.argsort(row * (int(cost.max()) + 1) + cost, kind="stable")  # by row, then count, then hash
                h, cost = h[order], cost[order]
                base, k = extensions(n, cost.astype(float), edges, percent)
                pos = np.arange(len(h)) - edges[row] + 1
                keep = np.flatnonzero(pos <= (base + k)[row])
                r = row[keep]
                info = n[r] << 32 | pos[keep] << 4 | k[r]
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(a[r]), pa.array(info)], names=["token", "a", "info"])

    return run


def _wanted_sets(words: np.ndarray, size: int):
    """The sets of texts whose mark is set, equal texts once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            hit = np.flatnonzero(words[(t1 >> 6) & (MARKS - 1)] >> (t1 & 63) & 1)
            _, first = np.unique(np.stack([t1[hit], t2[hit]], axis=1), axis=0, return_index=True)
            found = batch.take(pa.array(hit[np.sort(first)]))
            for lo, hi, row, h in shingle_sets(found.column("text"), size):
                edges = np.searchsorted(row, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[found.column(c).slice(lo, hi - lo) for c in ("t1", "t2")], lists], names=["t1", "t2", "members"])

    return run


def sets_of(wanted: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """``rep, members`` with the full set of each ``rep, t1, t2``, from the one text that has these hashes."""
    bit = F.expr("shiftleft(1L, cast(t1 & 63 as int))")
    rows = wanted.groupBy(F.shiftright("t1", 6).bitwiseAND(F.lit(MARKS - 1)).alias("i")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("m")).toArrow()
    words = np.zeros(MARKS, np.int64)
    words[rows.column("i").to_numpy()] = rows.column("bits").to_numpy()
    few = rows.column("m").to_numpy().sum() <= FEW
    found = source.select("t1", "t2", "text").mapInArrow(_wanted_sets(words, size), "t1 long, t2 long, members array<long>")
    return found.join(F.broadcast(wanted) if few else wanted, ["t1", "t2"]).groupBy("rep").agg(F.first("members").alias("members"))


def verified(pairs: DataFrame, sets: DataFrame, source: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` whose members ``u, v`` have sets similar enough; ``sets`` says which text each member has."""
    spark = pairs.sparkSession
    pairs, pairs_path = held(pairs, "ngram-pairs")
    members = pairs.select(F.col("u").alias("rep")).union(pairs.select("v")).distinct()
    wanted, wanted_path = held(sets.select("rep", "t1", "t2").join(members, "rep"), "ngram-wanted")
    full, full_path = held(sets_of(wanted, source, size), "ngram-members")
    one = pairs.join(full.select(F.col("rep").alias("u"), F.col("members").alias("left")), "u")
    both = one.join(full.select(F.col("rep").alias("v"), F.col("members").alias("right")), "v")
    common = F.size(F.array_intersect("left", "right"))  # row by row in the JVM: no batch of sets is held
    near = (100 + percent) * common >= percent * (F.size("left") + F.size("right"))
    links = written(both.filter(near).select(pairs.columns), "ngram-links")
    for path in (pairs_path, wanted_path, full_path):
        drop_scratch(spark, path)
    return links


def _within(x: str, y: str, k: str, percent: int) -> str:
    """Both entries stand in the prefixes that ask for ``k`` shared tokens."""
    least = overlap(f"{x}n", f"{y}n", percent)
    return f"({x}pos <= {x}n - {least} + {k} AND {y}pos <= {y}n - {least} + {k})"


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Per member the one that most of its lists have as their first, that is where the token stands earliest."""
    first = entries.groupBy("token").agg(F.min(F.struct("pos", "rep", "n", "k")).alias("c"))
    near = entries.join(first, "token").filter("rep <> c.rep").filter(f"100 * least(n, c.n) >= {percent} * greatest(n, c.n)")
    met = near.filter(_within("", "c.", "least(k, c.k)", percent)).select("rep", F.col("c.rep").alias("center"), F.expr("least(k, c.k)").alias("k"))
    # a member has one row per token of its prefix at most: dealt by member, both groupings need no other shuffle
    counts = met.repartition("rep").groupBy("rep", "center", "k").count().filter("count >= k")
    best = counts.groupBy("rep").agg(F.min(F.struct((-F.col("count")).alias("m"), "center")).alias("c"))
    return best.select(F.col("rep").alias("u"), F.col("c.center").alias("v"))


def cross_pairs(entries: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different classes that share as many prefix tokens as both ask for, each once: the smaller set in ``u``, the classes in ``of_u, of_v``."""
    placed = entries.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    by_class = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
    lists = by_class.groupBy("token").agg(F.count(F.lit(1)).alias("n_classes"), F.max(F.struct("m", "comp")).alias("top"))
    open_ = placed.join(lists.filter("n_classes > 1").select("token", F.col("top.comp").alias("major")), "token")
    width = max(math.log(100 / percent), 0.01) * 1.0001  # a partner's size class is the same or the next
    open_ = open_.withColumn("bucket", F.floor(F.log("n") / width).cast("int"))
    open_ = written(open_.select("token", "rep", "n", "pos", "k", "comp", "bucket", (F.col("comp") != F.col("major")).alias("minor")), "ngram-open")
    large = open_.filter(f"pos <= n - ({percent} * n + 99) div 100 + 1")
    small = open_.filter(f"pos <= n - {overlap('n', 'n', percent)} + 1").withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1)))
    met = f"""x.token = y.token AND x.bucket = y.bucket AND x.comp <> y.comp AND struct(x.n, x.rep) < struct(y.n, y.rep)
        AND 100 * x.n >= {percent} * y.n AND {_within("x.", "y.", "1", percent)}"""

    def join(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.alias("x").join(y.alias("y"), F.expr(met)).selectExpr(
            "x.rep AS u", "y.rep AS v", "x.comp AS of_u", "y.comp AS of_v", "least(x.k, y.k) AS k", f"{overlap('x.n', 'y.n', percent)} AS least_common", "x.n AS n", "y.n AS m")

    pairs = written(join(small.filter("minor"), large).unionByName(join(small.filter("NOT minor"), large.filter("minor"))).distinct(), "ngram-met")
    several = pairs.filter("k > 1")
    # one row per document before anything meets it: both sides of a pair with k > 1 ask for more than one token
    prefixes = written(entries.filter("k > 1").groupBy("rep").agg(F.collect_list(F.struct("token", "pos")).alias("tokens")), "ngram-prefixes")
    counted = several.join(prefixes.select(F.col("rep").alias("u"), F.col("tokens").alias("x")), "u").join(
        prefixes.select(F.col("rep").alias("v"), F.col("tokens").alias("y")), "v")
    common = "array_intersect(filter(x, e -> e.pos <= n - least_common + k).token, filter(y, e -> e.pos <= m - least_common + k).token)"
    named = ["u", "v", "of_u", "of_v"]
    return pairs.filter("k = 1").select(named).unionByName(counted.filter(f"size({common}) >= k").select(named))


def similar_classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Rows are linked when 100 * |A & B| >= percent * |A | B| over their sets of
    distinct runs of ``size`` words; the class is named by its smallest id. Words
    are runs of bytes other than blank and \\t..\\r, A-Z lowered. A text of fewer
    words, but not none, has its whole sequence as its one shingle.

    A null text, or one without words, has an empty set and a class of its own,
    named by its own id. Rows that repeat an id belong to the classes of their
    texts; a row without id belongs to its class too, which is null only if no row
    of the class has an id. Other columns are ignored; an empty table gives no
    rows. ``percent`` is 50 to 100.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    marks = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *marks, text.alias("text"))
    path = scratch(spark, "ngram-rows")
    source.mapInArrow(_rows_and_counts(size), ROWS).write.parquet(path)
    both = spark.read.schema(ROWS).parquet(path)
    rows = both.filter("token IS NULL").select("doc_id", "t1", "t2", "n", "a", "b")
    tokens, seen = common_tokens(both.filter("token IS NOT NULL").select("token", "seen"))

    # numbers rise over the partitions of the sort: the smallest number of a class has its smallest id
    sets = rows.filter("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")).alias("m"))
    sets = sets.select("a", "b", "n", "m.*").orderBy("no_id", "doc_id", "a", "b").withColumn("rep", F.monotonically_increasing_id()).drop("no_id")
    sets = written(sets, "ngram-sets")

    prefix = source.select("text").mapInArrow(_prefixes(size, percent, tokens, seen), "token long, a long, info long")
    shared = prefix.groupBy("token").agg(F.min("a").alias("x"), F.max("a").alias("y")).filter("x <> y").select("token")
    kept = prefix.join(shared, "token", "left_semi").distinct()
    kept = kept.select("token", "a", F.shiftright("info", 32).alias("n"), F.shiftright("info", 4).bitwiseAND(F.lit((1 << 28) - 1)).alias("pos"), F.col("info").bitwiseAND(F.lit(15)).alias("k"))
    entries = written(kept.join(sets.select("a", "n", "rep"), ["a", "n"]).select("token", "rep", "n", "pos", "k"), "ngram-entries")

    def check(pairs: DataFrame) -> DataFrame:
        return verified(pairs, sets, source, size, percent)

    classes = connected_components(check(star_pairs(entries, percent)))
    more = check(cross_pairs(entries, classes, percent))
    # the links found last join whole classes: their names are the nodes
    merged = connected_components(more.select(F.col("of_u").alias("u"), F.col("of_v").alias("v")))

    named = sets.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("a", "b", "n", F.coalesce("component", "rep").alias("class"))
    named = named.join(merged.withColumnRenamed("node", "class"), "class", "left").select("a", "b", "n", F.coalesce("component", "class").alias("component"))
    names = sets.select(F.col("rep").alias("component"), F.col("doc_id").alias("class_id"))
    named = named.join(names, "component").select("a", "b", "n", "class_id")
    out = rows.join(named, ["a", "b", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id"))

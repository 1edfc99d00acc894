"""Mixing sources to target weights, in DataFrame functions only.

Each source's documents, in a hashed order, form one stream of tokens cut into
blocks of ``BLOCK`` tokens. Targets follow the weights, capped at a multiple of
the source's size. The output has shards of ``SHARD_SLOTS`` slots. Each shard
draws the sources of its slots by chance in proportion to the targets: its counts
are multinomial. What a source got too often over all shards, at places given by
a permutation of its draws, goes to sources that got too few, so every source
fills exactly the slots its target asks for. Slot k of a source takes block p(k),
p a pseudorandom permutation of its block numbers, begun again for each pass
through the source; the last block of the last pass is cut at the target. Blocks
and document pieces meet by equi-join on the index, and the pieces are written.

Stream positions come from sums per (source, chunk) and windows inside a chunk,
so a source that holds a third of all rows is spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.frames import written

BLOCK = 64
CHUNK_ROWS = 20_000
SHARD_SLOTS = 8192
RANGES = 1024  # stretches of the slots by which a draw finds its source
EXPAND = 256  # shards whose slots one task makes
GROUP = 4096  # shards whose draws are summed in one window
FEW_SOURCES = 1 << 20  # tables of up to so many sources (some 60 MB) are broadcast
_PRIMES = (16_777_213, 16_777_199, 16_777_183, 16_777_153)  # multipliers of a permutation: below 2^48 numbers at most one of them divides their count
WORD = "[^\\x20\\x09-\\x0D]+"


def capped_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order, null last, weigh ``weights`` in turn. A target
    is min(cap * size, level * weight) at the level where targets sum to all
    sizes: resharing the excess by weight until none is above ends there. The
    windows run over one row per source, in one task; nothing else does.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("weight", w).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    done, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(done), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level)
    first = F.first(F.when(F.col("level") <= F.col("top") / F.col("weight"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least("top", first * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _permuted(index: Column, n: Column, key: Column) -> Column:
    """A permutation of 0 to n - 1, another one for each key. Up to 2^38 numbers, no product leaves a long."""
    at = F.pmod(key, F.lit(len(_PRIMES))).cast("int")
    one, other = (F.element_at(F.array(*[F.lit(p).cast("long") for p in _PRIMES[i:] + _PRIMES[:i]]), at + 1) for i in (0, 1))
    return F.pmod(index * F.when(F.pmod(n, one) == 0, other).otherwise(one) + F.pmod(key, n), n)


def _ranges(sources: DataFrame, total: int, n: str) -> DataFrame:
    """Per stretch of the numbers 0 to ``total`` - 1 the sources that lie in it, each with its own ``n`` numbers ``lo`` to ``hi``."""
    before = F.sum(n).over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    step = -(-total // RANGES)
    placed = sources.filter(F.col(n) > 0).withColumn("hi", before).withColumn("lo", F.col("hi") - F.col(n))
    return placed.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))))


def draws(plan: DataFrame, block: int, seed: int) -> DataFrame:
    """``shard, slot, key, block, words``: the slots of all shards, each with the block it takes and how many of its words.

    ``plan`` has one row per source. Every slot of a shard draws a source by hash;
    the counts per shard and source are kept, not the draws. Sums of the counts
    over earlier shards number the draws of a source.
    """
    spark = plan.sparkSession
    n_sources, total = plan.filter("slots > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("slots"), F.lit(0)).cast("long")).first()
    shards, step = -(-total // SHARD_SLOTS), max(1, -(-total // RANGES))
    few = F.broadcast if n_sources <= FEW_SOURCES else (lambda df: df)

    length = F.least(F.lit(SHARD_SLOTS).cast("long"), F.lit(total) - F.col("shard") * SHARD_SLOTS)
    tasks = min(max(shards, 1), 1 << 16)
    tried = spark.range(0, shards, 1, tasks if tasks < 64 else max(64, tasks // 16)).select(F.col("id").alias("shard"))
    tried = tried.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), length - 1)).alias("i"))
    tried = tried.select("shard", F.pmod(F.xxhash64("shard", "i", F.lit(seed + 1)), F.lit(max(total, 1))).alias("at"))
    tried = tried.withColumn("stretch", F.floor(F.col("at") / step))
    known = few(_ranges(plan.select("key", "slots"), max(total, 1), "slots").select("key", "lo", "hi", "stretch"))
    counts = tried.join(known, "stretch").filter("at >= lo AND at < hi").groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.withColumn("group", F.floor(F.col("shard") / GROUP)), "mix-counts")

    # the number of a source's first draw in a shard, and of the shard's first draw of it
    per_group = counts.groupBy("key", "group").agg(F.sum("n").alias("in_group"))
    earlier = F.sum("in_group").over(Window.partitionBy("key").orderBy("group")) - F.col("in_group")
    inside = F.sum("n").over(Window.partitionBy("key", "group").orderBy("shard")) - F.col("n")
    numbered = counts.withColumn("inside", inside).join(per_group.select("key", "group", earlier.alias("earlier")), ["key", "group"])
    # a fixed number of tasks: the counts are few bytes, the slots they stand for are not
    numbered = numbered.repartition(max(spark.sparkContext.defaultParallelism, shards // EXPAND), "shard")
    in_shard = F.sum("n").over(Window.partitionBy("shard").orderBy("key")) - F.col("n")
    numbered = numbered.select("shard", "key", "n", (F.col("earlier") + F.col("inside")).alias("k0"), in_shard.alias("i0"))

    got = plan.select("key", "slots").join(counts.groupBy("key").agg(F.sum("n").alias("got")), "key", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long")))
    order = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.greatest(F.col("got") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("got"), F.lit(0))
    got = written(got.withColumn("over0", F.coalesce(F.sum(over).over(order), F.lit(0).cast("long"))).withColumn("under", under), "mix-got")
    spare = got.agg(F.coalesce(F.sum("under"), F.lit(0)).cast("long")).first()[0]

    each = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).join(few(got.select("key", "slots", "got", "over0")), "key")
    shard_length = F.least(F.lit(SHARD_SLOTS).cast("long"), F.lit(total) - F.col("shard") * SHARD_SLOTS)
    each = each.select(
        "shard", "key", "slots", _permuted(F.col("k0") + F.col("i"), F.col("got"), F.xxhash64("key", F.lit(seed + 2))).alias("k"), "over0",
        _permuted(F.col("i0") + F.col("i"), shard_length, F.xxhash64("shard", F.lit(seed + 3))).alias("slot"))
    own = each.filter("k < slots").select("shard", "slot", "key", "k")
    # draws beyond a source's slots, numbered over all sources, fill the slots that others still lack
    lacking = few(_ranges(got.select("key", "got", "under"), max(spare, 1), "under").select(F.col("key").alias("to"), "got", "lo", "hi", "stretch"))
    left = each.filter("k >= slots").select("shard", "slot", (F.col("over0") + F.col("k") - F.col("slots")).alias("at"))
    left = left.withColumn("stretch", F.floor(F.col("at") / max(1, -(-spare // RANGES))))
    passed = left.join(lacking, "stretch").filter("at >= lo AND at < hi").select("shard", "slot", F.col("to").alias("key"), (F.col("got") + F.col("at") - F.col("lo")).alias("k"))

    slots = own.unionByName(passed).join(few(plan.select("key", "n_blocks", "slots", "cut")), "key")
    # the last, shorter block of a source comes last in every pass, so that no pass comes out short
    whole = F.greatest(F.col("n_blocks") - 1, F.lit(1))
    at, turn = F.pmod(F.col("k"), F.col("n_blocks")), F.floor(F.col("k") / F.col("n_blocks"))
    place = F.when(at < F.col("n_blocks") - 1, _permuted(at, whole, F.xxhash64("key", turn))).otherwise(F.col("n_blocks") - 1)
    words = F.when(F.col("k") == F.col("slots") - 1, F.col("cut")).otherwise(F.lit(block).cast("long"))
    return slots.select("shard", "slot", "key", place.alias("block"), words.alias("words"))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), cap: float = 3.0, block: int = BLOCK, seed: int = 11,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Two frames: ``pieces`` of the mix and ``documents`` with what the mix takes of each.

    pieces: ``shard, slot, source, block, doc_id, first, last`` - output shard
    and slot, and the words ``first`` to ``last`` (exclusive) of the document
    that the block holds. documents: ``doc_id, size, source, source_size,
    target, taken``, one row per input row; ``taken`` is summed from the written
    pieces, counts repeats and is at most ``cap`` (rounded up) times ``size``. The
    words taken of a source are its target, rounded. Reruns give the same mix.

    A null or empty text has size 0 and gives nothing; a null source is a source
    of its own, last in order; null ids and repeated rows are ordinary rows.
    Other columns are ignored; an empty table gives empty frames.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized, "sizes")
    chunks = max(16, sized.count() // CHUNK_ROWS)
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(chunks)).cast("int"))

    # where each chunk, and in it each document, begins in its source's stream
    per_chunk = sized.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = Window.partitionBy("source").orderBy("chunk")
    starts = per_chunk.withColumn("chunk_start", F.sum("chunk_size").over(before) - F.col("chunk_size"))
    sources = capped_targets(per_chunk.groupBy("source").agg(F.sum("chunk_size").alias("source_size")), weights, cap)
    size, target = F.col("source_size"), F.col("target")
    passes = F.when(size > 0, F.floor(F.round(target) / size)).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(F.round(target).cast("long") - F.col("passes") * size, F.lit(0))
    plan = written(
        sources.withColumn("passes", passes)
        .withColumn("n_blocks", F.ceil(size / block).cast("long"))
        .withColumn("more", F.ceil(rest / block).cast("long"))
        .withColumn("cut", F.when(F.col("more") > 0, rest - (F.col("more") - 1) * block).otherwise(F.lit(block)).cast("long"))
        .withColumn("slots", F.col("passes") * F.col("n_blocks") + F.col("more"))
        .withColumn("key", F.xxhash64("source", F.lit(seed))),
        "mix-plan")

    own = Window.partitionBy("source", "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = starts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), "chunk_start")
    placed = sized.withColumn("in_chunk", F.sum("size").over(own) - F.col("size"))
    placed = placed.join(at, _same(F.col("source"), F.col("s")) & (F.col("chunk") == F.col("c")), "left")
    placed = placed.select("doc_id", "source", "size", (F.col("chunk_start") + F.col("in_chunk")).alias("start"))
    # a row number for the sums back to documents: ids may be null or repeat
    placed = written(placed.withColumn("row", F.monotonically_increasing_id()), "mix-docs")

    drawn = draws(plan, block, seed)

    lo, hi = F.col("start"), F.col("start") + F.col("size")
    cut = placed.filter("size > 0").select(
        "doc_id", "source", "row", "start", "size", F.xxhash64("source", F.lit(seed)).alias("key"),
        F.explode(F.sequence(F.floor(lo / block), F.floor((hi - 1) / block))).alias("block"))
    cut = cut.select(
        "doc_id", "source", "row", "key", "block", "start",
        (F.greatest(F.col("block") * block, F.col("start")) - F.col("start")).alias("first"),
        (F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.col("start")).alias("last"))
    # sizes after explode are not known to the planner: no broadcast
    met = cut.join(drawn.hint("merge"), ["key", "block"])
    end = F.col("block") * block + F.col("words") - F.col("start")  # a cut block ends early
    pieces = written(met.withColumn("last", F.least("last", end)).filter("first < last").select("shard", "slot", "source", "block", "doc_id", "first", "last", "row"), "mix-pieces")

    taken = pieces.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    of_source = plan.select(F.col("source").alias("s"), "source_size", "target")
    documents = placed.join(taken, "row", "left").join(of_source, _same(F.col("source"), F.col("s")), "left")
    documents = documents.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return pieces.select("shard", "slot", "source", "block", "doc_id", "first", "last"), documents

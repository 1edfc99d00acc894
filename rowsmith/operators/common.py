"""Shared plan helpers: size-checked broadcast, dense row numbers, file row numbers, blank join keys."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.session import checkpoint_dir


# A side is broadcast only when the optimizer's size estimate is below this
# bound.  Above it the join stays a shuffle join, which AQE may still turn
# into a broadcast at run time from real shuffle sizes.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

_ROW = "_row"


def qcol(name: str):
    """Column by exact name (sheet headers may hold dots or blanks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (``None`` if unknown)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except Exception:  # noqa: BLE001 - Connect sessions have no JVM handle
        return None
    # py4j turns a Scala BigInt into a Python int; keep a fallback for other bridges
    return int(size) if isinstance(size, int) else int(str(size.toString()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its estimated size is known and below ``limit``."""
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def spread_blank(df: DataFrame, key, blank):
    """``key``, but where ``blank`` holds a text that matches nothing and differs from row to row.

    Blank keys are known to match nothing; as one key they would all meet in
    one task of a shuffle join.
    """
    own = F.xxhash64(*([F.col(_ROW)] if _ROW in df.columns else [qcol(c) for c in df.columns]))
    return F.when(blank, F.concat(F.lit("\u0000"), own.cast("string"))).otherwise(key)


def dense_row_number(
    df: DataFrame,
    order_cols: Sequence[str],
    out: str = "_n",
    partition_cols: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """1-based row number by ``order_cols`` (within ``partition_cols`` groups).

    A plain ``row_number()`` window without PARTITION BY moves every row into
    one task.  Instead the rows are range-partitioned and sorted by all keys,
    written once to the checkpoint folder with their partition and position,
    and a small table of rows per partition (and group) gives the offsets.
    Range bounds over all order columns split ties of the first one and NULLs;
    rows equal in all of them share a partition, in the order they were written.

    Writing first matters: range partitioning samples its bounds, and a second
    run could place rows differently.
    """
    spark = df.sparkSession
    keys = [qcol(c).asc_nulls_first() for c in [*partition_cols, *order_cols]]
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    placed = ranged.sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    path = f"{checkpoint_dir(spark).rstrip('/')}/rowsmith-numbered-{uuid.uuid4().hex}"
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    # the id's upper bits are the partition, the lower 33 the position in it
    rows = rows.withColumn("__part", F.shiftright("__id", 33))
    counts = rows.groupBy(*partition_cols, "__part").agg(F.count(F.lit(1)).alias("__cnt"), F.min("__id").alias("__first"))
    w = Window.partitionBy(*partition_cols).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(w), F.lit(0))).drop("__cnt")
    offsets = offsets.select(*[qcol(c).alias(f"__k{i}") for i, c in enumerate(partition_cols)], F.col("__part").alias("__p"), "__first", "__off")
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(partition_cols):
        same = same & qcol(c).eqNullSafe(F.col(f"__k{i}"))
    numbered = rows.join(offsets, same, "inner").withColumn(out, (F.col("__off") + F.col("__id") - F.col("__first") + 1).cast("long"))
    return numbered.drop("__id", "__part", "__p", "__first", "__off", *[f"__k{i}" for i in range(len(partition_cols))])


def with_source_rows(df: DataFrame, out: str = _ROW, first_row: int = 1, file_col: str = "_file") -> DataFrame:
    """Physical row number per input file for file sources (CSV, JSON, ...).

    A split of a file is read by one task, row after row, so the position
    ``monotonically_increasing_id`` gives right after the scan is contiguous
    inside each split.  A small table of rows per split (one row per split)
    gives each split its offset within its file; no shuffle of the rows and no
    sampling is needed.  The first data row gets ``first_row`` (2 for a CSV
    with a header line).
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias(file_col),
        F.col("_metadata.file_block_start").alias("__blk"),
        F.monotonically_increasing_id().alias("__pos"),
    )
    blocks = tagged.groupBy(file_col, "__blk").agg(F.count(F.lit(1)).alias("__cnt"), F.min("__pos").alias("__pmin"))
    w = Window.partitionBy(file_col).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__off", F.coalesce(F.sum("__cnt").over(w), F.lit(0))).drop("__cnt")
    j = tagged.join(blocks, [file_col, "__blk"], "inner")
    row = F.col("__off") + (F.col("__pos") - F.col("__pmin")) + first_row
    return j.withColumn(out, row.cast("long")).drop("__blk", "__pos", "__pmin", "__off")


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "sheet") -> None:
    """Fail before any job when a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} columns not found: {', '.join(missing)}")

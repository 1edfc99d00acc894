"""Keep-first deduplication (W1) and duplicate statistics (A1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.functions.text import duplicate_key
from rowsmith.operators.clean import replace_values, trim_cells
from rowsmith.operators.common import qcol, require_columns

ROW = "_row"


def with_duplicate_key(df: DataFrame, column: str, out: str = "__dupkey") -> DataFrame:
    """Materialise the T2 key once (``reflect`` is non-deterministic)."""
    return df.withColumn(out, duplicate_key(column))


def keep_first(df: DataFrame, column: str, *, order: str | Sequence[str] = ROW, keep_blank_keys: bool = False) -> DataFrame:
    """One row per T2 key of ``column`` -- the first in sheet order.

    Rows of several files are ordered by file and line: ``order=("_path", "_row")``.

    ``row_number() == 1`` over (key ORDER BY _row) is planned as a partial
    ``WindowGroupLimit`` before the shuffle, so a hot key (for example the
    blank key shared by all empty cells, Q7) is cut to one row per map task
    before it is moved.  ``dropDuplicates`` would keep an arbitrary row.
    With ``keep_blank_keys`` rows whose key is blank are all kept: each is a
    group of its own, so the rows are keyed and shuffled once.
    """
    order = [order] if isinstance(order, str) else list(order)
    require_columns(df, [column, *order])
    keyed = with_duplicate_key(df, column)
    group = ["__dupkey"]
    if keep_blank_keys:
        keyed = keyed.withColumn("__own", F.when(F.col("__dupkey") == "", F.struct(*map(qcol, order))))
        group.append("__own")
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*map(qcol, order)))
    return keyed.withColumn("__rn", rn).filter(F.col("__rn") == 1).drop("__rn", *group)


def duplicate_stats(df: DataFrame, column: str, replacements=None, *, approximate: bool = False) -> DataFrame:
    """A1: ``total_rows``, ``unique_rows``, ``removed`` for one column.

    As in the reference the column is always trimmed first and replacements
    are applied, but no split (Q8).  ``count(DISTINCT key)`` is planned as a
    two-level aggregation (partial per key before the shuffle), so hot keys
    do not pile up in one task.
    """
    require_columns(df, [column])
    d = trim_cells(df.select(F.col("`" + column.replace("`", "``") + "`")), [column])
    if replacements:
        d = replace_values(d, replacements)
    keyed = with_duplicate_key(d, column)
    distinct = F.approx_count_distinct("__dupkey") if approximate else F.count_distinct("__dupkey")
    stats = keyed.agg(F.count(F.lit(1)).alias("total_rows"), distinct.cast("long").alias("unique_rows"))
    return stats.withColumn("removed", F.greatest(F.col("total_rows") - F.col("unique_rows"), F.lit(0)).cast("long"))

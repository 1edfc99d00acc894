"""Update by key (J4) on DataFrames.

Reference semantics (Q23, kept): one statement per source record in order,
so for a repeated key the last record wins; one key may update many target
rows; a NULL key matches nothing; a NULL value overwrites.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators.common import maybe_broadcast, qcol, require_columns

ROW = "_row"


def last_per_key(source: DataFrame, key: str, columns: Sequence[str], *, order: str | Sequence[str] = ROW) -> DataFrame:
    """The last source record per key (``max_by`` over ``_row``, or over file and line).

    A partial aggregate runs before the shuffle, so a hot key sends one
    row per map task.  NULL keys are dropped: they match no target row.
    """
    payload = F.struct(*[qcol(c).alias(f"c{i}") for i, c in enumerate(columns)])
    by = qcol(order) if isinstance(order, str) else F.struct(*map(qcol, order))
    agg = source.filter(qcol(key).isNotNull()).groupBy(qcol(key).alias(key)).agg(F.max_by(payload, by).alias("__last"))
    return agg.select(qcol(key), *[F.col(f"__last.c{i}").alias(c) for i, c in enumerate(columns)])


def update_by_key(
    target: DataFrame,
    source: DataFrame,
    key: str,
    set_columns: Sequence[str] | None = None,
    *,
    order: str | Sequence[str] = ROW,
) -> DataFrame:
    """The new version of ``target`` after the update.

    Adds ``_updated`` (boolean) so callers can count changed rows (Q11 fix:
    the reference reported only the number of source records).
    """
    places = [order] if isinstance(order, str) else list(order)
    cols = list(set_columns) if set_columns is not None else [c for c in source.columns if c not in (key, *places)]
    require_columns(source, [key, *places, *cols], "source")
    require_columns(target, [key, *cols], "target")
    last = last_per_key(source, key, cols, order=order)
    src = last.select(qcol(key).alias("__k"), F.lit(True).alias("__hit"), *[qcol(c).alias(f"__s{i}") for i, c in enumerate(cols)])
    joined = target.join(maybe_broadcast(src), qcol(key) == F.col("__k"), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    out = joined.withColumns({c: F.when(hit, F.col(f"__s{i}")).otherwise(qcol(c)) for i, c in enumerate(cols)})
    return out.withColumn("_updated", hit).drop("__k", "__hit", *[f"__s{i}" for i in range(len(cols))])

"""Projection and cleaning operators.

All are column expressions or joins; none loops over rows.  Every function
keeps the ``_row`` column untouched.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.text import is_empty, null_tokens, strip_text
from rowsmith.operators.common import dense_row_number, maybe_broadcast, qcol, require_columns, spread_blank
from rowsmith.plans.spec import SplitRule, TargetColumn

ROW = "_row"


def _string_cols(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))}


# -- P4 -------------------------------------------------------------------
def trim_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip text cells of all (or the given) columns; others unchanged."""
    text = _string_cols(df)
    targets = [c for c in (columns or df.columns) if c in text and c != ROW]
    if not targets:
        return df
    return df.withColumns({c: strip_text(qcol(c)) for c in targets})


# -- S14 / S13 ------------------------------------------------------------
def apply_null_tokens(df: DataFrame, columns: Sequence[str] | None = None, tokens: Sequence[str] | None = None) -> DataFrame:
    """Cells equal to a null token become NULL (text columns only)."""
    text = _string_cols(df)
    targets = [c for c in (columns or df.columns) if c in text and c != ROW]
    kw = {} if tokens is None else {"tokens": tokens}
    return df.withColumns({c: null_tokens(c, **kw) for c in targets}) if targets else df


def normalise_cells(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL (None/NaN/NaT are one null)."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(qcol(c)), qcol(c)) for c in fl}) if fl else df


# -- P5 / T5 ----------------------------------------------------------------
def replacements_frame(spark, replacements: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Long form ``column, source, target`` of a replacement dictionary.

    Sent as one Arrow table, so Spark holds it as a local relation of known size:
    a small dictionary is broadcast and the rows it applies to are not shuffled.
    """
    rows = [(c, s, t) for c, m in replacements.items() for s, t in m.items()]
    columns = zip(*rows) if rows else ((), (), ())
    names = ("column", "source", "target")
    return spark.createDataFrame(pa.table({n: pa.array(list(v), pa.string()) for n, v in zip(names, columns)}))


def replace_values(
    df: DataFrame, replacements, *, match_trimmed: bool = False, columns: Sequence[str] | None = None
) -> DataFrame:
    """P5: per-column exact text -> text replacement; misses keep the value.

    ``replacements`` is either ``{column: {source: target}}`` or a long
    DataFrame ``column, source, target``; a dictionary of any size becomes that
    frame.  Unknown columns are ignored, only text cells are touched (Q6: exact
    match unless ``match_trimmed``).
    """
    return replace_and_count(df, replacements, match_trimmed=match_trimmed, columns=columns)[0]


def replace_and_count(
    df: DataFrame, replacements, *, match_trimmed: bool = False, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``replace_values``, and the cells replaced per column as ``metric, value`` (K6) from the same joins."""
    text = _string_cols(df) - {ROW}
    if not isinstance(replacements, DataFrame):
        columns = [c for c, m in replacements.items() if m]
        replacements = replacements_frame(df.sparkSession, replacements)
    elif columns is None:
        # names of this frame's text columns only: bounded by its width
        named = replacements.select("column").filter(F.col("column").isin(sorted(text))).distinct()
        columns = sorted(r[0] for r in named.collect())
    cols = [c for c in columns if c in text]
    if not cols:
        return df, None
    out = df
    for i, c in enumerate(cols):
        d = replacements.filter(F.col("column") == c).select(
            F.col("source").alias(f"__src{i}"), F.col("target").alias(f"__tgt{i}")
        )
        probe = strip_text(qcol(c)) if match_trimmed else qcol(c)
        out = out.withColumn(f"__probe{i}", spread_blank(out, probe, qcol(c).isNull()))
        out = out.join(maybe_broadcast(d), F.col(f"__probe{i}") == F.col(f"__src{i}"), "left")
        out = out.withColumn(f"__hit{i}", F.col(f"__src{i}").isNotNull())
        out = out.withColumn(c, F.coalesce(F.col(f"__tgt{i}"), qcol(c))).drop(f"__probe{i}", f"__src{i}", f"__tgt{i}")
    hits = [f"__hit{i}" for i in range(len(cols))]
    sums = out.agg(*[F.coalesce(F.sum(F.col(h).cast("long")), F.lit(0)).alias(h) for h in hits])
    metrics = F.explode(F.array(*[F.struct(F.lit(f"replaced:{c}").alias("metric"), F.col(h).alias("value")) for c, h in zip(cols, hits)]))
    return out.drop(*hits), sums.select(metrics.alias("x")).select("x.metric", "x.value")


def apply_conversions(df: DataFrame, column: str, conversions: DataFrame, *, trim: bool = True, out: str | None = None) -> DataFrame:
    """T5: exact hit of the (trimmed) text in the conversion dictionary.

    ``conversions`` has ``column, source, target`` (S19 output).  A miss keeps
    the original value (untrimmed); NULL passes.
    """
    d = conversions.filter(F.col("column") == column).select(
        F.col("source").alias("__csrc"), F.col("target").alias("__ctgt")
    )
    probe = qcol(column).cast("string")
    if trim:
        probe = strip_text(probe)
    keyed = df.withColumn("__probe", spread_blank(df, probe, probe.isNull() | (probe == "")))
    joined = keyed.join(maybe_broadcast(d), F.col("__probe") == F.col("__csrc"), "left")
    return joined.withColumn(out or column, F.coalesce(F.col("__ctgt"), qcol(column).cast("string"))).drop("__probe", "__csrc", "__ctgt")


# -- P6 / P7 ----------------------------------------------------------------
def next_extra_name(columns: Sequence[str], prefix: str = "extra_") -> str:
    """First unused ``extra_<i>``."""
    used = set(columns)
    i = 1
    while f"{prefix}{i}" in used:
        i += 1
    return f"{prefix}{i}"


def split_by_length(df: DataFrame, rule: SplitRule, *, trim_measure: bool = False) -> tuple[DataFrame, str]:
    """Move values longer/shorter than ``rule.length`` to an extra column.

    The moved cell is nulled in the original column; NULLs stay.  The length
    is measured on the trimmed text when ``trim_measure`` (Q22), on
    ``str(value)`` otherwise.  Returns the frame and the extra column name.
    """
    require_columns(df, [rule.column])
    extra = rule.extra_column
    if not extra or extra in df.columns:
        extra = next_extra_name(df.columns)
    c = qcol(rule.column)
    measured = c.cast("string")
    if trim_measure:
        measured = strip_text(measured)
    n = F.length(measured)
    cond = (n > rule.length) if rule.op == "gt" else (n < rule.length)
    move = c.isNotNull() & cond
    out = df.withColumn(extra, F.when(move, c)).withColumn(rule.column, F.when(~move, c))
    return out, extra


# -- P8 / P9 ----------------------------------------------------------------
def all_empty(columns: Sequence[str], float_columns: Sequence[str] = ()) -> Column:
    """True when every given cell is empty (P8 on each; NaN counts as empty in float columns)."""
    if not columns:
        return F.lit(False)
    floats = set(float_columns)
    parts = [(is_empty(c) | F.isnan(qcol(c))) if c in floats else is_empty(c) for c in columns]
    return reduce(lambda a, b: a & b, parts)


def any_filled(df: DataFrame, columns: Sequence[str]) -> Column:
    """P9 as a column: false where all of ``columns`` are empty (true without columns)."""
    if not columns:
        return F.lit(True)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return ~all_empty(columns, floats)


def skip_empty_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows whose mapped source cells are all empty (none mapped: keep all)."""
    return df.filter(any_filled(df, columns)) if columns else df


# -- P1 / P2 / P10 / P11 / P12 ---------------------------------------------
def cast_to(c: Column, dtype: T.DataType) -> Column:
    """Cast a sheet cell to a target type without failing the job (ANSI on)."""
    if isinstance(dtype, T.StringType):
        return c.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("string").try_cast(dtype)
    return c.try_cast(dtype)


def map_columns(
    df: DataFrame,
    mapping: Sequence[tuple[str, str]],
    targets: Sequence[TargetColumn] | None = None,
    *,
    keep: Sequence[str] = (ROW,),
) -> DataFrame:
    """Ordered (sheet column -> target column) pairs, in table order.

    One sheet column may feed several targets.  With ``targets`` given, the
    cells are cast to the target's Spark type and the output follows the
    table's column order.
    """
    require_columns(df, [s for s, _ in mapping])
    by_name = {t.name: t for t in (targets or [])}
    src_for = {t: s for s, t in mapping}
    order = [t.name for t in targets if t.name in src_for] if targets else [t for _, t in mapping]
    order += [t for _, t in mapping if t not in order]
    cols = [F.col(k) for k in keep if k in df.columns]
    for t in order:
        c = qcol(src_for[t])
        if t in by_name:
            c = cast_to(c, by_name[t].spark_type)
        cols.append(c.alias(t))
    return df.select(*cols)


def typed_default(value: Any, target: TargetColumn | None) -> Column:
    """The default as a literal of the column's type."""
    if target is None:
        return F.lit(value)
    dtype = target.spark_type
    if isinstance(value, (_dt.date, _dt.datetime, bool)) or value is None:
        return F.lit(value).cast(dtype)
    return cast_to(F.lit(str(value)), dtype)


def apply_defaults(df: DataFrame, defaults: Mapping[str, Any], targets: Sequence[TargetColumn] | None = None) -> DataFrame:
    """P10: constants for target columns absent from the frame (Q13: NULLs stay)."""
    by_name = {t.name: t for t in (targets or [])}
    add = {c: typed_default(v, by_name.get(c)) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(add) if add else df


def drop_pk(df: DataFrame, pk: str | None) -> DataFrame:
    """Leave the generated key out (the database or P13 fills it)."""
    return df.drop(pk) if pk and pk in df.columns else df


# -- P13 ----------------------------------------------------------------------
def sequence_key(
    df: DataFrame,
    column: str,
    *,
    order: Sequence[str] = (ROW,),
    start: int | Column = 0,
    width: int = 5,
) -> DataFrame:
    """Generated key ``lpad(start + n, width, '0')`` in ``order``.

    ``start`` is usually ``max(pk)`` of the target.  ``lpad`` would silently
    cut a longer number (Q24), so such a row fails the job instead.
    """
    numbered = dense_row_number(df, list(order), out="__seq")
    start_col = start if isinstance(start, Column) else F.lit(int(start))
    num = (start_col.cast("long") + F.col("__seq")).cast("string")
    key = F.when(F.length(num) <= width, F.lpad(num, width, "0")).otherwise(
        F.raise_error(F.concat(F.lit(f"sequence key does not fit in {width} characters: "), num))
    )
    return numbered.withColumn(column, key).drop("__seq")


# -- P15 ----------------------------------------------------------------------
def export_values(df: DataFrame) -> DataFrame:
    """Bool -> ``true``/``false``, dates ISO-8601, rest unchanged."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            out[f.name] = F.when(c, F.lit("true")).when(~c, F.lit("false"))
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            out[f.name] = F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(
                F.concat(whole, F.lit("."), F.date_format(c, "SSSSSS"))
            )
    return df.withColumns(out) if out else df

"""Data-side validation (V1 data check, V5 lengths, V6 summary, L2 first-n).

Violations are rows of one schema, so all checks union into one frame:
``_row long, column string, kind string, value string, detail string``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.functions.text import value_preview

ROW = "_row"


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


VIOLATION_SCHEMA = "_row long, column string, kind string, value string, detail string"
VIOLATION_COLUMNS = [ROW, "column", "kind", "value", "detail"]


class LoadRejected(ValueError):
    """Raised in ``on_error='fail'`` mode before anything is written."""

    def __init__(self, message: str, violations: DataFrame | None = None):
        super().__init__(message)
        self.violations = violations


def violations(df: DataFrame) -> DataFrame:
    """Cast a frame to the violation schema."""
    return df.select(
        F.col(ROW).cast("long").alias(ROW),
        F.col("column").cast("string"),
        F.col("kind").cast("string"),
        F.col("value").cast("string"),
        F.col("detail").cast("string"),
    )


def empty_violations(spark) -> DataFrame:
    return spark.createDataFrame([], VIOLATION_SCHEMA)


ISSUE_TYPE = "array<struct<column:string,kind:string,value:string,detail:string>>"


def _no_issues() -> Column:
    return F.array().cast(ISSUE_TYPE)


def length_issues(df: DataFrame, limits: Mapping[str, int]) -> Column:
    """V5 per row: one issue per bounded column whose text is too long."""
    present = {c: int(n) for c, n in limits.items() if n and c in df.columns}
    if not present:
        return _no_issues()
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(n).alias("limit"), _q(c).cast("string").alias("text"))
        for c, n in present.items()
    ])
    over = F.filter(cells, lambda x: x["text"].isNotNull() & (F.length(x["text"]) > x["limit"]))
    return F.transform(over, lambda x: F.struct(
        x["column"].alias("column"),
        F.lit("too_long").alias("kind"),
        x["text"].alias("value"),
        F.concat(F.length(x["text"]).cast("string"), F.lit(" > "), x["limit"].cast("string"), F.lit(" characters")).alias("detail"),
    ))


def required_issues(df: DataFrame, columns: Sequence[str]) -> Column:
    """V1 data side per row: one issue per NOT NULL column holding NULL."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return _no_issues()
    cells = F.array(*[
        F.when(_q(c).isNull(), F.struct(
            F.lit(c).alias("column"), F.lit("required_null").alias("kind"),
            F.lit(None).cast("string").alias("value"), F.lit("NULL in a NOT NULL column").alias("detail")))
        for c in present
    ])
    return F.filter(cells, lambda x: x.isNotNull())


def bad_value_issues(cells: Sequence[tuple[str, str, str, Column, Column]]) -> Column:
    """One issue per cell that holds something its target type cannot read.

    ``cells``: source column, target column, type text, whether the source cell
    is empty, and the cast value.
    """
    if not cells:
        return _no_issues()
    found = F.array(*[
        F.when(~empty & cast.isNull(), F.struct(
            F.lit(target).alias("column"), F.lit("bad_value").alias("kind"), _q(source).cast("string").alias("value"),
            F.lit(f"cannot be read as {kind}").alias("detail")))
        for source, target, kind, empty, cast in cells
    ])
    return F.filter(found, lambda x: x.isNotNull())


def explode_issues(df: DataFrame, issues: Column, *, row_col: str = ROW) -> DataFrame:
    ex = df.select(F.col(row_col).cast("long").alias(ROW), F.explode(issues).alias("v"))
    return ex.select(ROW, "v.column", "v.kind", "v.value", "v.detail")


def length_violations(df: DataFrame, limits: Mapping[str, int], *, row_col: str = ROW) -> DataFrame:
    """V5: every (row, column) whose text is longer than the column's limit.

    One pass over the rows: an array of (column, limit, text) structs is
    filtered and exploded, so k bounded columns cost one scan, not k.
    """
    if not any(n and c in df.columns for c, n in limits.items()):
        return empty_violations(df.sparkSession)
    return explode_issues(df, length_issues(df, limits), row_col=row_col)


def required_nulls(df: DataFrame, columns: Sequence[str], *, row_col: str = ROW) -> DataFrame:
    """V1 data side: NULL in a NOT NULL target column."""
    if not any(c in df.columns for c in columns):
        return empty_violations(df.sparkSession)
    return explode_issues(df, required_issues(df, columns), row_col=row_col)


def first_violations(v: DataFrame, n: int = 5) -> DataFrame:
    """L2: the first ``n`` violations by row (TakeOrderedAndProject, no full sort)."""
    return v.orderBy(F.col(ROW).asc_nulls_first(), "column", "kind").limit(n)


def summarise(v: DataFrame, n: int = 5) -> str:
    """Q25: text of the first ``n`` violations plus a remaining count.

    Collects ``n`` rows, their values shortened (T8), and one count; the full
    list, with whole values, stays a DataFrame.
    """
    head = first_violations(v, n).withColumn("value", value_preview("value")).collect()
    total = v.count()
    lines = [f"row {r[ROW]} column '{r['column']}': {r['kind']} {r['detail'] or ''} (value: {r['value']})" for r in head]
    if total > len(head):
        lines.append(f"...and {total - len(head)} more")
    return "\n".join(lines)


def violation_summary(v: DataFrame, n: int = 4) -> DataFrame:
    """K6/Q25 as data: per (column, kind) the count and the first ``n`` rows (T7 text).

    The first rows come from ``row_number() <= n`` (a partial top-n before the
    shuffle), so no group is ever collected whole.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("column", "kind").orderBy(F.col(ROW).asc_nulls_first())
    counts = v.groupBy("column", "kind").agg(F.count(F.lit(1)).alias("violations"))
    first = (
        v.withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= n)
        .groupBy("column", "kind")
        .agg(F.array_sort(F.collect_list(F.struct("__rn", F.coalesce(F.col(ROW).cast("string"), F.lit("-")).alias("r")))).alias("__f"))
    )
    j = counts.join(first, ["column", "kind"])
    head = F.array_join(F.transform("__f", lambda x: x["r"]), ", ")
    text = F.when(F.col("violations") > n, F.concat(head, F.lit(" +"), (F.col("violations") - n).cast("string"))).otherwise(head)
    return j.select("column", "kind", F.col("violations").cast("long"), text.alias("first_rows"))

"""The load: section 2.12's ten steps as one lazy DataFrame plan.

``build_load(sheet, spec, tables)`` returns a ``LoadResult`` whose frames are
all lazy: ``candidates`` (rows that reached the target step), ``violations``
(one schema for every kind of rejection) and ``report()`` (counts per stage).
Nothing runs until a caller acts; ``check()`` enforces ``on_error='fail'`` with
one small action (the first violations and a count) before any write, and
``rows`` hands rows out only after it.

Order of steps (part of the semantics): trim -> replacements -> split ->
dedupe -> source-column check -> skip empty rows + project -> defaults ->
FK lookups (on surviving rows only, Q1 fix) -> drop generated PK, then
length and required-column validation.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.text import is_empty
from rowsmith.operators.clean import (
    any_filled,
    apply_defaults,
    cast_to,
    drop_pk,
    map_columns,
    normalise_cells,
    replace_and_count,
    split_by_length,
    trim_cells,
)
from rowsmith.operators.common import qcol, require_columns
from rowsmith.operators.dedupe import keep_first
from rowsmith.operators.lookup import conflict_violations, resolve_lookups
from rowsmith.operators.validate import (
    LoadRejected,
    VIOLATION_COLUMNS,
    bad_value_issues,
    empty_violations,
    explode_issues,
    length_issues,
    required_issues,
    summarise,
)
from rowsmith.session import checkpoint_dir
from rowsmith.plans.spec import GridSlice, LoadSpec, SplitRule

ROW = "_row"


KINDS = ("fk_empty", "fk_not_found", "fk_conflict", "too_long", "required_null", "bad_value")


@dataclass
class LoadResult:
    """Lazy outcome of a load.

    ``ledger`` holds the fate of every row that passed the dedupe: ``__kept``
    (false: skipped as empty) and ``__issues`` (FK, length, type and
    required-column problems of that row).  Rows, row-level violations and every
    counter are projections or aggregates of it, so one computation serves the
    check, the write, the violation list and the report, and a task that runs
    twice counts once.  ``materialize()`` writes it to the checkpoint folder.
    """

    ledger: DataFrame
    table_violations: DataFrame  # violations without a sheet row (lookup conflicts)
    sheet: DataFrame  # the rows asked for, before any step
    quarantine: bool = False
    spec: LoadSpec | None = None
    split_column: str | None = None
    extra_metrics: DataFrame | None = None  # metric, value (replacement counts)
    rows_read: int | None = None  # counted while materializing
    materialized_path: str | None = None
    _accepted: bool = field(default=False, repr=False)

    @property
    def flagged(self) -> DataFrame:
        """Every row that reaches the target step, with its ``__issues``."""
        return self.ledger.filter("__kept").drop("__kept")

    @property
    def candidates(self) -> DataFrame:
        """The rows of the target step, whatever the check says; in quarantine mode those without issues."""
        f = self.flagged.filter(F.size("__issues") == 0) if self.quarantine else self.flagged
        return f.drop("__issues")

    @property
    def rows(self) -> DataFrame:
        """The rows to write.  In fail mode a rejected load raises instead."""
        if not self.quarantine:
            self.check()
        return self.candidates

    @property
    def violations(self) -> DataFrame:
        return explode_issues(self.flagged, F.col("__issues")).unionByName(self.table_violations).select(*VIOLATION_COLUMNS)

    def materialize(self, path: str | None = None) -> "LoadResult":
        """Compute the load once: write the ledger to shared storage and read it back."""
        spark = self.ledger.sparkSession
        if path is None:
            path = f"{checkpoint_dir(spark).rstrip('/')}/rowsmith-load-{uuid.uuid4().hex}"
        self.ledger.write.mode("overwrite").parquet(path)
        if self.rows_read is None:
            self.rows_read = self.sheet.count()
        self.ledger = spark.read.schema(self.ledger.schema).parquet(path)
        self.materialized_path = path
        return self

    def release(self) -> None:
        """Delete the materialized copy; the frames must not be used afterwards."""
        if not self.materialized_path:
            return
        spark = self.ledger.sparkSession
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(self.materialized_path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        finally:
            self.materialized_path = None

    def report(self) -> DataFrame:
        """``metric, value`` -- rows per stage and per violation kind.

        One aggregate over the ledger, one over the lookup conflicts and the
        number of rows read are summed as three rows of counters; nothing is
        joined.  A rejected load writes nothing, whatever rows it holds.
        """
        spark = self.ledger.sparkSession
        total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
        names = ["read", "after_dedupe", "after_skip_empty", "clean", *KINDS]
        zero = {c: F.lit(0).cast("long") for c in names}
        of_kind = {k: total(F.expr(f"size(filter(__issues, x -> x.kind = '{k}'))")) for k in KINDS}
        fates = self.ledger.agg(*[c.alias(n) for n, c in {
            **zero, "after_dedupe": F.count(F.lit(1)), "after_skip_empty": total(F.col("__kept")),
            "clean": total(F.col("__kept") & (F.size("__issues") == 0)), **of_kind}.items()])
        tables = self.table_violations.agg(*[c.alias(n) for n, c in {**zero, **{k: total(F.col("kind") == k) for k in KINDS}}.items()])
        if self.rows_read is None:
            read = self.sheet.agg(*[c.alias(n) for n, c in {**zero, "read": F.count(F.lit(1))}.items()])
        else:
            read = spark.range(1).select(*[c.alias(n) for n, c in {**zero, "read": F.lit(self.rows_read)}.items()])
        counters = fates.unionByName(tables).unionByName(read).agg(*[F.sum(n).alias(n) for n in names])
        rejected = sum((F.col(k) for k in KINDS), F.lit(0))
        written = F.col("clean") if self.quarantine else F.when(rejected > 0, 0).otherwise(F.col("after_skip_empty"))
        shown = {"read": F.col("read"), "after_dedupe": F.col("after_dedupe"), "after_skip_empty": F.col("after_skip_empty"), "written": written, **{k: F.col(k) for k in KINDS}}
        if self.spec is not None and not (self.spec.remove_duplicates and self.spec.duplicate_column):
            del shown["after_dedupe"]
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("long").alias("value")) for n, c in shown.items()]))
        out = counters.select(pairs.alias("x")).select("x.metric", "x.value")
        return out if self.extra_metrics is None else out.unionByName(self.extra_metrics)

    def sample(self, n: int = 5) -> DataFrame:
        """K6: the first ``n`` rows that would be written (top-n, no full sort)."""
        return self.rows.orderBy(ROW).limit(n)  # raises if the load is rejected

    def check(self, n: int = 5) -> "LoadResult":
        """``on_error='fail'``: raise with the first ``n`` violations and a count."""
        if self._accepted:
            return self
        if self.violations.limit(1).count() > 0:
            raise LoadRejected("the load was rejected:\n" + summarise(self.violations, n), self.violations)
        self._accepted = True
        return self


def sliced(sheet: DataFrame, g: GridSlice) -> DataFrame:
    """S5/S6 on a sheet table: the physical rows and the columns, by position, that the plan names."""
    want = g.corrected()
    if g.start_row is not None:
        sheet = sheet.filter(F.col(ROW) >= want.start_row)
    if want.end_row is not None:
        sheet = sheet.filter(F.col(ROW) <= want.end_row)
    if g.start_col is not None or want.end_col is not None:
        cells = [c for c in sheet.columns if c != ROW][want.start_col - 1 : want.end_col]
        sheet = sheet.select(ROW, *[qcol(c) for c in cells])
    return sheet


def build_load(
    sheet: DataFrame,
    spec: LoadSpec,
    tables: Mapping[str, DataFrame] | None = None,
    *,
    conversions: DataFrame | None = None,
    validate_spec: bool = True,
) -> LoadResult:
    """Build the whole load as lazy frames (see module docstring)."""
    if validate_spec:
        spec.validate()
    tables = tables or {}
    spark = sheet.sparkSession
    # 1: the rows and columns asked for
    sheet = sliced(sheet, spec.slice)
    df = sheet
    # 2-3: trim, replacements
    if spec.trim_whitespace:
        df = trim_cells(df)
    extra = None
    if isinstance(spec.replacements, DataFrame) or spec.replacements:
        df, extra = replace_and_count(df, spec.replacements)
    # 4: split by length
    split_col = None
    if spec.split is not None:
        df, split_col = split_by_length(df, spec.split, trim_measure=spec.trim_whitespace)
    # 5: keep-first dedupe
    if spec.remove_duplicates and spec.duplicate_column:
        df = keep_first(df, spec.duplicate_column)
    # 6: every needed sheet column must exist
    mapping = spec.effective_mapping()
    require_columns(df, spec.needed_sheet_columns(), "sheet")
    # 7: mark empty rows, project (FK source cells ride along), normalise
    kept = any_filled(df, [s for s, _ in mapping])
    fk_src = {f"__fk{i}": lk.sheet_column for i, lk in enumerate(spec.lookups)}
    types = {c.name: c for c in spec.columns}
    bad = bad_value_issues([
        (s, t, types[t].type, is_empty(s), cast_to(qcol(s), types[t].spark_type))
        for s, t in mapping if t in types and not isinstance(types[t].spark_type, T.StringType)])
    projected = map_columns(df.withColumns({"__kept": kept, "__bad": bad, **{h: qcol(s) for h, s in fk_src.items()}}), mapping, spec.columns, keep=[ROW, "__kept", "__bad", *fk_src])
    projected = normalise_cells(projected)
    # 8: defaults for unmapped targets
    projected = apply_defaults(projected, spec.defaults, spec.columns)
    # 9: FK lookups on surviving rows
    table_viol = empty_violations(spark)
    issues = [F.col("__bad")]
    if spec.lookups:
        rules = [
            type(lk)(lk.target_column, f"__fk{i}", lk.table, lk.id_column, lk.label_column)
            for i, lk in enumerate(spec.lookups)
        ]
        projected, prepared = resolve_lookups(projected, rules, tables, conversions=_renamed_conversions(conversions, fk_src), trim=spec.fk_trim_whitespace)
        # report the sheet column name, not the carried alias
        names = F.create_map(*[F.lit(x) for kv in fk_src.items() for x in kv])
        issues.append(F.transform("__fk_issues", lambda x: F.struct(
            F.coalesce(F.try_element_at(names, x["column"]), x["column"]).alias("column"),
            x["kind"].alias("kind"), x["value"].alias("value"), x["detail"].alias("detail"))))
        seen = set()
        for lk, rule in zip(spec.lookups, rules):
            if rule.dictionary not in seen:
                seen.add(rule.dictionary)
                table_viol = table_viol.unionByName(conflict_violations(prepared[rule.dictionary], lk))
    projected = projected.drop(*fk_src)
    # 10: generated PK is left out
    projected = drop_pk(projected, spec.generated_pk)
    # validation: lengths (V5) and, for inserts, NOT NULL targets (V1 data side)
    limits = {c.name: c.max_length for c in spec.columns if c.max_length}
    issues.append(length_issues(projected, limits))
    if spec.operation == "insert":
        req = [c.name for c in spec.columns if not c.nullable and c.name != spec.generated_pk]
        issues.append(required_issues(projected, req))
    found = F.concat(*issues)
    ledger = projected.withColumn("__issues", F.when(F.col("__kept"), found).otherwise(F.slice(found, 1, 0))).drop("__bad", "__fk_issues")
    return LoadResult(ledger=ledger, table_violations=table_viol, sheet=sheet, quarantine=spec.on_error == "quarantine",
                      spec=spec, split_column=split_col, extra_metrics=extra)


def _renamed_conversions(conversions: DataFrame | None, fk_src: dict[str, str]) -> DataFrame | None:
    """Conversions are keyed by sheet column; the carried FK cells use aliases."""
    if conversions is None:
        return None
    out = None
    for alias, sheet_col in fk_src.items():
        part = conversions.filter(F.col("column") == sheet_col).select(F.lit(alias).alias("column"), "source", "target")
        out = part if out is None else out.unionByName(part)
    return out


__all__ = ["LoadResult", "build_load", "SplitRule"]

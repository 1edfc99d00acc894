"""FK lookup by description (J1), unresolved rows (J2), label conflicts.

A lookup table is reduced once per (table, id, label) to one row per key
(T1 of the label) and shared by every rule that names it.  The row side is
joined with it; the lookup side is broadcast only when its size estimate is
small, otherwise it stays a shuffle join (AQE may still broadcast it, and its
skew handling splits a hot key on the row side).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.functions.text import lookup_key
from rowsmith.operators.clean import apply_conversions
from rowsmith.operators.common import maybe_broadcast, qcol, require_columns, spread_blank
from rowsmith.operators.validate import violations
from rowsmith.plans.spec import Lookup

ROW = "_row"


@dataclass
class PreparedLookup:
    keys: DataFrame  # key, id, conflict -- one row per key; conflict: the key has 2+ ids
    conflicts: DataFrame  # key, label, id -- every label of a key with 2+ ids


def lookup_frame(table: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """Two columns of a table as ``id, label`` (pruned at the scan)."""
    return table.select(F.col(id_column).alias("id"), F.col(label_column).cast("string").alias("label"))


def prepare_lookup(pairs: DataFrame, *, trim: bool = True) -> PreparedLookup:
    """Reduce ``id, label`` pairs to one id per T1 key; find conflicting keys.

    Blank keys are ignored, as are NULL ids (Q14 fix).
    """
    keyed = pairs.filter(F.col("id").isNotNull()).withColumn("key", lookup_key("label", trim=trim))
    keyed = keyed.filter(F.col("key") != "")
    per_key = keyed.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("__maxid"))
    keys = per_key.select("key", "id", (F.col("id") != F.col("__maxid")).alias("conflict"))
    bad = per_key.filter(F.col("id") != F.col("__maxid")).select("key")
    conflicts = keyed.join(bad, "key", "left_semi").select("key", "label", "id").distinct()
    return PreparedLookup(keys=keys, conflicts=conflicts)


def conflict_violations(prep: PreparedLookup, rule: Lookup) -> DataFrame:
    """A6 as violation rows (``kind = fk_conflict``; no sheet row)."""
    return prep.conflicts.select(
        F.lit(None).cast("long").alias(ROW),
        F.lit(rule.label_column).alias("column"),
        F.lit("fk_conflict").alias("kind"),
        F.col("label").alias("value"),
        F.concat(F.lit(f"{rule.table}.{rule.label_column} key '"), F.col("key"), F.lit("' has several ids")).alias("detail"),
    )


def resolve_lookups(
    df: DataFrame,
    rules: Sequence[Lookup],
    tables: Mapping[str, DataFrame],
    *,
    conversions: DataFrame | None = None,
    trim: bool = True,
    row_col: str = ROW,
) -> tuple[DataFrame, dict[tuple[str, str, str], PreparedLookup]]:
    """J1 + J2 for every rule.

    Returns the rows with each rule's target column set to the resolved id
    and an ``__fk_issues`` array (``fk_empty`` / ``fk_not_found`` /
    ``fk_conflict`` for a label with several ids, in rule order), plus the
    prepared dictionaries (for A6 checks).  Use
    ``split_unresolved`` to separate good rows from violations.
    """
    require_columns(df, [r.sheet_column for r in rules], "sheet")
    prepared: dict[tuple[str, str, str], PreparedLookup] = {}
    out = df
    flags = []
    for i, rule in enumerate(rules):
        if rule.dictionary not in prepared:
            prepared[rule.dictionary] = prepare_lookup(
                lookup_frame(tables[rule.table], rule.id_column, rule.label_column), trim=trim
            )
        keys = prepared[rule.dictionary].keys
        conv_col = f"__conv{i}"
        if conversions is not None:
            out = apply_conversions(out, rule.sheet_column, conversions, trim=trim, out=conv_col)
        else:
            out = out.withColumn(conv_col, qcol(rule.sheet_column).cast("string"))
        out = out.withColumn(f"__key{i}", lookup_key(conv_col, trim=trim))
        out = out.withColumn(f"__keyp{i}", spread_blank(out, F.col(f"__key{i}"), F.col(f"__key{i}") == ""))
        side = maybe_broadcast(keys.select(F.col("key").alias(f"__lk{i}"), F.col("id").alias(f"__id{i}"), F.col("conflict").alias(f"__idc{i}")))
        out = out.join(side, F.col(f"__keyp{i}") == F.col(f"__lk{i}"), "left")
        out = out.withColumn(rule.target_column, F.col(f"__id{i}"))
        flags.append(
            F.when(F.col(f"__key{i}") == "", F.struct(
                F.lit(rule.sheet_column).alias("column"), F.lit("fk_empty").alias("kind"),
                qcol(rule.sheet_column).cast("string").alias("value"),
                F.lit(f"empty value for {rule.target_column}").alias("detail"), F.lit(i).alias("ordinal")))
            .when(F.col(f"__id{i}").isNull(), F.struct(
                F.lit(rule.sheet_column).alias("column"), F.lit("fk_not_found").alias("kind"),
                F.col(conv_col).alias("value"),
                F.lit(f"not found in {rule.table}.{rule.label_column} for {rule.target_column}").alias("detail"),
                F.lit(i).alias("ordinal")))
            .when(F.col(f"__idc{i}"), F.struct(
                F.lit(rule.sheet_column).alias("column"), F.lit("fk_conflict").alias("kind"),
                F.col(conv_col).alias("value"),
                F.lit(f"several ids in {rule.table}.{rule.label_column} for {rule.target_column}").alias("detail"),
                F.lit(i).alias("ordinal")))
        )
    tmp = [c for c in out.columns if c.startswith(("__conv", "__key", "__lk", "__id"))]
    if flags:
        out = out.withColumn("__fk_issues", F.filter(F.array(*flags), lambda x: x.isNotNull()))
    else:
        out = out.withColumn("__fk_issues", F.array().cast("array<struct<column:string,kind:string,value:string,detail:string,ordinal:int>>"))
    out = out.drop(*tmp)
    return out, prepared


def split_unresolved(flagged: DataFrame, row_col: str = ROW) -> tuple[DataFrame, DataFrame]:
    """Rows without FK issues, and the issues as violation rows."""
    good = flagged.filter(F.size("__fk_issues") == 0).drop("__fk_issues")
    bad = flagged.filter(F.size("__fk_issues") > 0).select(F.col(row_col).cast("long").alias(ROW), F.explode("__fk_issues").alias("v"))
    viol = bad.select(ROW, "v.column", "v.kind", "v.value", "v.detail")
    return good, violations(viol)

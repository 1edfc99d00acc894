"""File sinks: mapped data as CSV (K3) or workbooks (K4), conversion dictionaries (K5),
and Parquet tables written by insert (K1) or as a new version after an update (K2).

Spark commits a file write per job (task files are moved into place when the
job commits), so a failed load leaves the target folder as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowsmith.functions.text import slug
from rowsmith.operators.clean import export_values, sequence_key
from rowsmith.operators.update import update_by_key
from rowsmith.plans.load import LoadResult
from rowsmith.sources.files import CONV_COLUMN, CONV_FILE_SUFFIX, CONV_SOURCE, CONV_TARGET
from rowsmith.sources.xlsx import register as register_xlsx

ROW = "_row"
# Spark's CSV writer strips leading/trailing blanks unless told not to;
# exports must keep cell values exactly.
CSV_EXACT = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def accepted(source: LoadResult | DataFrame) -> DataFrame:
    """The rows to write: of a load, computed once and checked (V6) before anything is written."""
    if isinstance(source, DataFrame):
        return source
    source.materialize()
    return source.rows


def export_csv(source: LoadResult | DataFrame, path: str, *, mode: str = "errorifexists", keep_row: bool = False) -> None:
    """K3: header line, no index; booleans and dates as text (P15).  A rejected load writes nothing."""
    df = accepted(source)
    out = df if keep_row else df.drop(ROW)
    export_values(out).write.mode(mode).options(**CSV_EXACT).csv(path)


def export_workbooks(df: DataFrame, path: str, *, mode: str = "append", keep_row: bool = False) -> None:
    """K4: one workbook per task, at most 1,048,575 data rows per sheet."""
    register_xlsx(df.sparkSession)
    out = df if keep_row else df.drop(ROW)
    export_values(out).write.format("xlsx_grid").mode(mode).save(path)


_IN_FILE_NAMES = str.maketrans(dict.fromkeys("/\\ ", "_"))


def conversion_file_name(column: str, stem: str) -> str:
    """``<column>_<file>_conversoes.csv`` with ``/``, ``\\`` and blanks as ``_``."""
    return f"{column.translate(_IN_FILE_NAMES)}_{stem}{CONV_FILE_SUFFIX}"


def export_conversions(replacements: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """K5: long rows ``column, original, corrected`` with the dictionary's header."""
    replacements.select(
        F.col("column").alias(CONV_COLUMN), F.col("source").alias(CONV_SOURCE), F.col("target").alias(CONV_TARGET)
    ).write.mode(mode).options(**CSV_EXACT).csv(path)


@dataclass
class WriteReport:
    records: int
    changed: int | None = None


def insert_rows(result: LoadResult, path: str, *, fmt: str = "parquet", generate_key: str | None = None,
                key_width: int = 5, key_start: int | None = None, materialize: bool = True) -> WriteReport:
    """K1 into a table folder: rejected loads write nothing; one append job.

    With ``materialize`` the load is computed once into the checkpoint folder,
    so the check and the write both read that result instead of running the
    whole plan twice.  With ``generate_key`` the key column is filled by P13,
    counting on from ``key_start`` (default: the largest key already in the
    table).  The count comes from an observation of the write job.
    """
    if materialize:
        result.materialize()
    rows = result.rows
    spark = rows.sparkSession
    if generate_key:
        if key_start is None:
            cur = None  # no table yet; any other failure to read it is an error
            if path_exists(spark, path):
                cur = spark.read.format(fmt).load(path).agg(F.max(F.col(generate_key).cast("long"))).first()[0]
            key_start = int(cur or 0)
        rows = sequence_key(rows, generate_key, start=key_start, width=key_width)
    obs = Observation("insert")
    rows = rows.drop(ROW).observe(obs, F.count(F.lit(1)).alias("n"))
    rows.write.mode("append").format(fmt).save(path)
    return WriteReport(records=int(obs.get.get("n", 0)))


def path_exists(spark, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def update_table(target_path: str, source: LoadResult | DataFrame, key: str, out_path: str, *, columns=None, fmt: str = "parquet") -> WriteReport:
    """K2 on a table folder: J4 semantics, written as a new version at ``out_path``.

    A rejected load writes nothing.  Reports both the number of source records
    (what the reference returned) and the number of target rows changed (Q11 fix).
    """
    source = accepted(source)
    spark = source.sparkSession
    target = spark.read.format(fmt).load(target_path)
    new = update_by_key(target, source, key, columns)
    obs = Observation("update")
    new = new.observe(obs, F.count(F.lit(1)).alias("rows"), F.sum(F.col("_updated").cast("long")).alias("changed"))
    new.drop("_updated").write.mode("errorifexists").format(fmt).save(out_path)
    records = source.count()
    got = obs.get
    return WriteReport(records=int(records), changed=int(got.get("changed") or 0))


def output_folder(base: str, sheet: str, kind: str) -> str:
    """Default export location ``<base>_<sheet>_mapped.<kind>`` (T9 slug)."""
    return f"{base}_{sheet.translate(_IN_FILE_NAMES)}_mapped.{kind}"


__all__ = ["export_csv", "export_workbooks", "export_conversions", "insert_rows", "update_table", "slug"]


def insert_into_table(result: LoadResult, name: str, *, path: str | None = None, materialize: bool = True) -> WriteReport:
    """K1 into a Spark catalog table: create it (optionally at ``path``) or append by column name."""
    if materialize:
        result.materialize()
    spark = result.ledger.sparkSession
    rows = result.rows.drop(ROW)
    obs = Observation("insert_table")
    if spark.catalog.tableExists(name):
        cols = [c.name for c in spark.catalog.listColumns(name)]
        missing = [c for c in rows.columns if c not in cols]
        if missing:
            raise ValueError(f"columns not in {name}: {', '.join(missing)}")
        out = rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).alias(c) for c in cols])
        out.observe(obs, F.count(F.lit(1)).alias("n")).write.insertInto(name)
    else:
        w = rows.observe(obs, F.count(F.lit(1)).alias("n")).write.format("parquet")
        if path:
            w = w.option("path", path)
        w.saveAsTable(name)
    return WriteReport(records=int(obs.get.get("n", 0)))

"""File sources: CSV sheets with physical row numbers, conversion dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions.text import null_tokens, strip_text
from rowsmith.operators.common import with_source_rows

ROW = "_row"

# Column names of the conversion dictionary file (K5/S19),
# kept so files written by either tool read in the other.
CONV_COLUMN = "coluna_excel"
CONV_SOURCE = "valor_original"
CONV_TARGET = "valor_corrigido"
CONV_FILE_SUFFIX = "_conversoes.csv"


def read_csv_sheet(spark: SparkSession, path: str, *, header: bool = True, **options) -> DataFrame:
    """A CSV file (or folder/glob) as a sheet table: string columns + ``_row``.

    No type inference (one text form per cell, as in the grid source);
    ``_row`` numbers the records of each file (2 = first one under a header),
    built without a single-partition window.  Blank lines are not counted and
    rows of several files share numbers: ``sources.lines.read_csv_records`` gives
    physical lines, multi-line cells included, with the file.
    """
    reader = spark.read.option("header", header).option("inferSchema", False)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.csv(path)
    return with_source_rows(df, first_row=2 if header else 1).drop("_file")


def read_conversions(spark: SparkSession, path: str, *, trim: bool = True) -> DataFrame:
    """``column, source, target`` from a conversion dictionary CSV.

    All columns are read as text (Q17 fix: ``1`` stays ``1``).  Fails if a
    required column is missing (V7).  Rows with an empty or missing-value
    (``NA``, ``NULL``, ...) source or target are dropped; with ``trim`` both are stripped; blank sources are dropped; for a
    repeated (column, source) the last line of the file wins.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in (CONV_COLUMN, CONV_SOURCE, CONV_TARGET) if c not in raw.columns]
    if missing:
        raise ValueError("conversion file lacks columns: " + ", ".join(missing))
    # the reader's missing-value texts (NA, N/A, NULL, ...) count as empty cells
    cells = raw.select(*[null_tokens(c).alias(c) for c in (CONV_COLUMN, CONV_SOURCE, CONV_TARGET)])
    rows = with_source_rows(cells, first_row=2)
    src, dst = F.col(CONV_SOURCE), F.col(CONV_TARGET)
    rows = rows.filter(src.isNotNull() & dst.isNotNull())
    if trim:
        rows = rows.withColumn(CONV_SOURCE, strip_text(src)).withColumn(CONV_TARGET, strip_text(dst))
    rows = rows.filter(strip_text(F.col(CONV_SOURCE)) != "")
    last = F.max_by(F.struct("_file", ROW, F.col(CONV_TARGET).alias("t")), F.struct("_file", ROW))
    out = rows.groupBy(F.col(CONV_COLUMN).alias("column"), F.col(CONV_SOURCE).alias("source")).agg(last.alias("x"))
    return out.select("column", "source", F.col("x.t").alias("target"))

"""Text files as records with physical line numbers.

Files are split by byte offset and read by many tasks. A record may hold line ends
inside quotes, so whether a line starts a record depends on the number of quotes
before it in its file, most of which other tasks read. Each task therefore notes,
for every line of its split, the last line that starts a record in both cases, an
even or an odd number of quotes before the split. A table of one row per split
(lines, quotes, last starts) then gives every split its first line number, its
case, and the start of a record that began in an earlier split. Only the lines of
records that span several are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATH, ROW = "_path", "_row"
_LINES = "path string, split long, line long, value string, before int, after int, last0 long, last1 long"


def _last(starts: np.ndarray, lines: np.ndarray, carried: int) -> np.ndarray:
    """Number of the last starting line up to each line; ``carried`` before the first."""
    return np.maximum(np.maximum.accumulate(np.where(starts, lines, -1)), carried)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number in the split (from 0), quote parity before and after, and last starts (-1: none) for an even and an odd beginning."""
    key, line, odd, last = None, 0, 0, [-1, -1]
    for batch in batches:
        splits, paths = batch.column("split").to_numpy(), batch.column("path")
        lo = 0
        while lo < batch.num_rows:
            here = (paths[lo].as_py(), int(splits[lo]))
            same = np.flatnonzero((splits[lo:] != here[1]) | ~pc.equal(paths.slice(lo), paths[lo]).to_numpy(zero_copy_only=False))
            hi = lo + (int(same[0]) if len(same) else batch.num_rows - lo)
            if here != key:
                key, line, odd, last = here, 0, 0, [-1, -1]
            part = batch.slice(lo, hi - lo)
            quotes = pc.count_substring(part.column("value"), '"').to_numpy()
            after = (odd + np.cumsum(quotes)) % 2
            before = np.concatenate([[odd], after[:-1]])
            lines = np.arange(line, line + len(part))
            lasts = [_last(before == p, lines, last[p]) for p in (0, 1)]
            line, odd, last = line + len(part), int(after[-1]), [int(x[-1]) for x in lasts]
            yield pa.RecordBatch.from_arrays(
                [part.column("path"), part.column("split"), pa.array(lines), part.column("value"), pa.array(before, pa.int32()), pa.array(after, pa.int32()), *map(pa.array, lasts)],
                names=[c.split()[0] for c in _LINES.split(", ")])
            lo = hi


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``_path, _row, record``: the records of text files, ``_row`` the line (from 1) a record starts on.

    Line ends are \\n or \\r\\n; those between quotes belong to the record. Blank
    lines outside quotes count and give no record. A file whose quotes never close
    ends in one long record.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value").mapInArrow(_placed, _LINES)
    splits = lines.groupBy("path", "split").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("after", "line").alias("odd"), F.max("last0").alias("end0"), F.max("last1").alias("end1"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({
        "first": F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1,
        "case": F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2})
    end = F.when(F.col("case") == 0, F.col("end0")).otherwise(F.col("end1"))
    splits = splits.withColumn("start", F.when(end >= 0, F.col("first") + end))
    splits = splits.withColumn("open", F.max("start").over(earlier)).select("path", "split", "first", "case", "open")
    at = lines.join(splits, ["path", "split"])
    last = F.when(F.col("case") == 0, F.col("last0")).otherwise(F.col("last1"))
    at = at.select(
        "path", "value", (F.col("first") + F.col("line")).alias("line"), F.when(last >= 0, F.col("first") + last).otherwise(F.col("open")).alias("start"),
        (F.col("before") == F.col("case")).alias("opens"), (F.col("after") == F.col("case")).alias("closes"))
    alone = at.filter("opens AND closes").select("path", F.col("line").alias("start"), F.col("value").alias("record"))
    pieces = at.filter("NOT (opens AND closes)").groupBy("path", "start").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l"))
    spanning = pieces.select("path", "start", F.array_join(F.col("l.value"), "\n").alias("record"))
    out = alone.unionByName(spanning).select(F.col("path").alias(PATH), F.col("start").alias(ROW), F.regexp_replace("record", "\r$", "").alias("record"))
    return out.filter(F.trim("record") != "")


def read_csv_records(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """CSV files as a sheet: text cells, ``_path`` and ``_row``, the physical line of each record.

    The first record of every file is its header; ``columns`` names the cells by
    position (default: the names of the first file by path). Quotes are doubled
    inside quoted cells. Order rows of several files by ``_path`` and ``_row``.
    """
    rows = records(spark, path)
    heads = rows.groupBy(PATH).agg(F.min(ROW).alias("head"))
    if columns is None:
        first = rows.join(heads, PATH).filter(F.col(ROW) == F.col("head")).orderBy(PATH).select("record").first()
        if first is None:
            raise ValueError(f"no header in {path}")
        names = first[0]
        width = spark.range(1).select(F.size(F.split(F.lit(names), ",")).alias("n")).first()[0]
        cells = spark.range(1).select(_cells(F.lit(names), width).alias("c")).first()[0]
        columns = [c for c in cells if c is not None]
    data = rows.join(heads, PATH).filter(F.col(ROW) > F.col("head"))
    cells = data.withColumn("cells", _cells(F.col("record"), len(columns)))
    return cells.select(*[F.col("cells")[f"c{i}"].alias(c) for i, c in enumerate(columns)], PATH, ROW)


def _cells(record, width: int):
    schema = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(record, schema, {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})

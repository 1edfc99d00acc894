"""Sheet grids: ``path, sheet, row_idx (1-based), cells array<string>``.

Operators S3-S11 on frames of that shape.  They work for many sheets in one
job: per-sheet facts (used range, header row) are aggregates grouped by
(path, sheet), joined back to the rows.  Only a header row's names -- at most
16,384 strings -- are ever handled on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from rowsmith.functions.text import DEFAULT_NULL_TOKENS, null_tokens, strip_text
from rowsmith.operators.clean import normalise_cells
from rowsmith.operators.common import maybe_broadcast, qcol
from rowsmith.plans.spec import GridSlice

ROW = "_row"
SHEET_KEYS = ["path", "sheet"]
GRID_SCHEMA = "path string, sheet string, row_idx int, cells array<string>"

# Placeholder prefix of unnamed columns and the marker the
# spreadsheet reader gives to header cells that are empty.
DEFAULT_PREFIX = "column_"
UNNAMED = "unnamed:"


# -- S7 -----------------------------------------------------------------------
def _mangle_repeats(raw: Sequence[str], unnamed: Sequence[int] = ()) -> list[str]:
    """Repeated header texts as the spreadsheet reader delivers them.

    The first cell with a text keeps it; every other one takes the smallest
    suffix ``.1``, ``.2``, ... whose result no cell has yet.  Named cells come
    before empty ones (``Unnamed: <i>``).
    """
    blank = set(unnamed)
    cells: dict[str, list[int]] = {}
    for i in sorted(range(len(raw)), key=lambda i: (i in blank, i)):
        cells.setdefault(raw[i], []).append(i)
    taken, names = set(raw), list(raw)
    for i, base in sorted(((i, base) for base, at in cells.items() for i in at[1:]), key=lambda x: (x[0] in blank, x[0])):
        names[i] = next(name for name in (f"{base}.{k}" for k in count(1)) if name not in taken)
        taken.add(names[i])
    return names


def header_names(cells: Sequence[object], prefix: str = DEFAULT_PREFIX) -> list[str]:
    """Column names from one header row.

    Empty cells read as ``Unnamed: <i>``; repeats arrive as ``A.1``.  Then:
    strip; empty or ``Unnamed:*`` -> ``<prefix><position>``; a name equal to
    an earlier one -> ``<name>_<n>`` with the first unused n >= 2 (Q4 fix).
    """
    texts = ["" if c is None else str(c) for c in cells]
    blank = [i for i, t in enumerate(texts) if t == ""]
    read = _mangle_repeats([t or f"Unnamed: {i}" for i, t in enumerate(texts)], blank)
    names: dict[str, None] = {}  # ordered and unique
    for position, text in enumerate(map(str.strip, read), start=1):
        base = f"{prefix}{position}" if text == "" or text.lower().startswith(UNNAMED) else text
        choices = chain([base], (f"{base}_{n}" for n in count(2)))
        names[next(c for c in choices if c not in names)] = None
    return list(names)


def header_names_col(cells, prefix: str = DEFAULT_PREFIX):
    """S7 for many header rows at once (one small array per sheet)."""

    @pandas_udf(T.ArrayType(T.StringType()))
    def _names(col: pd.Series) -> pd.Series:
        return pd.Series([header_names(list(c) if c is not None else [], prefix) for c in col])

    return _names(F.col(cells) if isinstance(cells, str) else cells)


# -- S3 -----------------------------------------------------------------------
def _last_nonnull_index(cells) -> F.Column:
    """1-based index of the last non-null cell, 0 if none."""
    flags = F.reverse(F.transform(cells, lambda x: x.isNotNull()))
    pos = F.array_position(flags, True)
    return F.when(pos > 0, F.size(cells) - pos + 1).otherwise(F.lit(0))


def used_range(grid: DataFrame) -> DataFrame:
    """S3: drop trailing empty rows and columns per sheet; inner gaps stay.

    If every cell of a sheet is empty nothing is cut.
    """
    last_col = _last_nonnull_index(F.col("cells"))
    stats = grid.groupBy(*SHEET_KEYS).agg(
        F.max(F.when(last_col > 0, F.col("row_idx"))).alias("__last_row"),
        F.max(last_col).alias("__last_col"),
    )
    j = grid.join(maybe_broadcast(stats), SHEET_KEYS, "left")
    keep = F.col("__last_row").isNull() | (F.col("row_idx") <= F.col("__last_row"))
    cells = F.when(F.col("__last_col") > 0, F.slice("cells", 1, F.col("__last_col"))).otherwise(F.col("cells"))
    return j.filter(keep).select(*SHEET_KEYS, "row_idx", cells.alias("cells"))


def sheet_list(grid: DataFrame) -> DataFrame:
    """The (path, sheet) pairs of a grid."""
    return grid.select(*SHEET_KEYS).distinct()


# -- S4 / S5 / S6 / S8 / S9 ----------------------------------------------------
def _col_slice(cells, g: GridSlice) -> F.Column:
    start = g.start_col or 1
    if g.end_col is None:
        return F.slice(cells, start, F.greatest(F.size(cells) - start + 1, F.lit(0)))
    return F.slice(cells, start, g.end_col - start + 1)


def header_row_cells(grid: DataFrame, g: GridSlice, path: str | None = None, sheet: str | None = None) -> list:
    """The header cells of one sheet (one row to the driver)."""
    g = g.corrected()
    h = grid.filter(F.col("row_idx") == g.header_row)
    if path is not None:
        h = h.filter(F.col("path") == path)
    if sheet is not None:
        h = h.filter(F.col("sheet") == sheet)
    row = h.select(_col_slice(F.col("cells"), g).alias("c")).first()
    return list(row["c"]) if row is not None and row["c"] is not None else []


def sheet_layouts(grid: DataFrame, rows: DataFrame, g: GridSlice, prefix: str = DEFAULT_PREFIX) -> list[tuple[list, list[str]]]:
    """The distinct header rows of the sheets and their column names (S7), as wide as the data below.

    A sheet with data but no header row has an empty header: all its names are
    placeholders. Only distinct headers reach the driver, not one per sheet.
    """
    cells = _col_slice(F.col("cells"), g)
    filled = rows.filter(_last_nonnull_index(cells) > 0).select(*SHEET_KEYS).distinct()
    own = grid.filter(F.col("row_idx") == g.header_row).select(*SHEET_KEYS, cells.alias("c")).filter(F.col("c").isNotNull())
    bare = filled.join(own.select(*SHEET_KEYS), SHEET_KEYS, "left_anti").select(F.array().cast("array<string>").alias("c"))
    headers = own.select("c").unionByName(bare).distinct().collect()
    width = rows.agg(F.max(_last_nonnull_index(cells))).first()[0] or 0
    found = [list(r["c"]) for r in headers]
    wide = [h + [None] * (int(width) - len(h)) for h in found]
    return sorted(((h, header_names(w, prefix)) for h, w in zip(found, wide)), key=lambda x: [str(c) for c in x[0]])


def sheet_table(
    grid: DataFrame,
    g: GridSlice,
    names: Sequence[str] | None = None,
    *,
    prefix: str = DEFAULT_PREFIX,
    keep_sheet: bool = False,
    drop_empty: bool = True,
    tokens: Sequence[str] | None = DEFAULT_NULL_TOKENS,
) -> DataFrame:
    """Header row + data rectangle -> table with named string columns + ``_row``.

    Rows are cut by the physical row number (Q2/Q3 fix: ``start <= _row <=
    end``, empty rows do not shift the cut); columns by position (S6).
    Cells equal to a missing-value token become NULL first (S14), so rows
    holding only such tokens are dropped as empty (S8).
    ``names`` defaults to the normalised header row of each sheet.  Data columns
    beyond the header's last cell get placeholder names.  Sheets may order their
    columns differently: cells are matched by name, and a sheet with another set
    of names is an error. So is a sheet with data but no header row beside sheets
    that name their columns: its names are placeholders.
    """
    g = g.corrected()
    rows = grid.filter(F.col("row_idx") >= g.start_row)
    if g.end_row is not None:
        rows = rows.filter(F.col("row_idx") <= g.end_row)
    cells = _col_slice(F.col("cells"), g)
    if names is None:
        layouts = sheet_layouts(grid, rows, g, prefix)
        names = layouts[0][1] if layouts else []
        for header, other in layouts[1:]:
            if set(other) != set(names):
                raise ValueError(f"sheets differ in their columns: {sorted(set(other) ^ set(names))}")
        if len(layouts) > 1:
            headers = grid.filter(F.col("row_idx") == g.header_row).select(*SHEET_KEYS, _col_slice(F.col("cells"), g).alias("__header"))
            rows = rows.join(maybe_broadcast(headers), SHEET_KEYS, "left")
            found = F.coalesce("__header", F.array().cast("array<string>"))
            order = [F.when(found.eqNullSafe(F.array(*[F.lit(c).cast("string") for c in header]).cast("array<string>")), F.array(
                *[F.lit(other.index(n) + 1) for n in names])) for header, other in layouts]
            cells = F.transform(F.coalesce(*order), lambda i: F.try_element_at(cells, i))
    cells_at = [F.try_element_at(cells, F.lit(i + 1)) for i in range(len(names))]
    if tokens:  # S14: the reader's missing-value texts become NULL (header cells keep their text)
        cells_at = [null_tokens(c, tokens) for c in cells_at]
    cols = [c.alias(n) for c, n in zip(cells_at, names)]
    keep = [F.col(k) for k in SHEET_KEYS] if keep_sheet else []
    out = rows.select(*keep, F.col("row_idx").cast("long").alias(ROW), *cols)
    return drop_empty_rows(out, list(names)) if drop_empty else out


def drop_empty_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows whose cells are all NULL (``_row`` never counts)."""
    if not columns:
        return df
    cond = None
    for c in columns:
        nn = qcol(c).isNotNull()
        cond = nn if cond is None else (cond | nn)
    return df.filter(cond)


def preview(df: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` rows in sheet order (TakeOrderedAndProject)."""
    return df.orderBy(ROW).limit(n)


# -- S10 ----------------------------------------------------------------------
def _lowest(bits):
    """The lowest set bit alone; 0 for none."""
    return bits.bitwiseAND(-bits)


def _highest(bits):
    """The highest set bit alone; 0 for none."""
    for n in (1, 2, 4, 8, 16):
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, n))
    return bits.bitwiseXOR(F.shiftrightunsigned(bits, 1))


def _bit_number(bit):
    """The place of a single set bit; null for none."""
    return F.when(bit != 0, F.bit_count(bit - 1).cast("long"))


def _merged(grouped) -> DataFrame:
    """First ``a`` and ``b``, the last ``last``, and in ``prev`` the last row of class ``at`` before that ``b``.

    Parts cover separate ranges of rows: of the part that holds the first ``b`` its own
    ``prev`` counts, of the parts before it their ``last``.
    """
    parts = grouped.agg(
        F.min("a").alias("a"), F.min("b").alias("b"), F.max("last").alias("last"),
        F.collect_list(F.struct("b", "last", "prev")).alias("parts"))
    inside = F.array_max(F.transform(F.filter("parts", lambda p: p["b"] == F.col("b")), lambda p: p["prev"]))
    ahead = F.array_max(F.transform(F.filter("parts", lambda p: p["last"] < F.col("b")), lambda p: p["last"]))
    keys = [c for c in parts.columns if c != "parts"]
    return parts.select(*keys, F.coalesce(F.greatest(inside, ahead), inside, ahead).alias("prev"))


def detect_header(grid: DataFrame, g: GridSlice, *, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """``path, sheet, header_row`` after moving past placeholder headers.

    Reference loop: while every header name is a placeholder and the first
    data row holds a value not starting with the prefix, the header moves one
    row down.  Walking the non-empty rows r0 < r1 < ... from the start row,
    this stops at the first row with a real name (A), unless a row made only
    of prefix-like values (B) comes first -- then at the non-empty row before
    B.  With neither, it stops at the last non-empty row.

    The input is read once. Each 32 rows become three bit sets, one per row
    class, before anything is shuffled; ordered summaries of 65,536 rows and
    then of the sheet follow from these, so no task holds a sheet's rows.
    """
    g = g.corrected()
    cells = _col_slice(F.col("cells"), g)
    tokens = list(DEFAULT_NULL_TOKENS)
    # a cell is present unless the reader reads it as missing (NULL or an NA text)
    present = F.filter(cells, lambda x: x.isNotNull() & ~x.isin(tokens))
    vals = F.filter(F.transform(present, lambda x: strip_text(x)), lambda x: x != "")
    # repeated blank header texts are renamed " .1", " .2", ... by the reader, which
    # strip to real-looking names -- the header then counts as named
    blanks = F.filter(cells, lambda x: x.isNotNull() & (x != "") & (strip_text(x) == ""))
    dup_blank = F.size(F.array_distinct(blanks)) < F.size(blanks)
    real_name = F.exists(vals, lambda x: ~F.lower(x).startswith(UNNAMED) & ~x.startswith(prefix)) | dup_blank
    # a data row stops the walk when it has no text or only placeholder-like text
    stopper = (F.size(vals) == 0) | F.forall(vals, lambda x: x.startswith(prefix))
    h0 = g.header_row
    nonempty = F.size(present) > 0
    at = (F.col("row_idx") >= h0) & ((F.col("row_idx") == h0) | nonempty)
    classes = {"at": at, "real": at & real_name, "stop": (F.col("row_idx") > h0) & nonempty & stopper}
    place = F.col("row_idx").cast("long")
    bit = F.expr("shiftleft(1L, cast(row_idx & 31 as int))")
    words = grid.groupBy(*SHEET_KEYS, F.shiftright(place, 5).alias("word")).agg(
        *[F.bit_or(F.when(F.coalesce(c, F.lit(False)), bit).otherwise(F.lit(0).cast("long"))).alias(n) for n, c in classes.items()])

    base = F.col("word") * 32
    before = F.col("at").bitwiseAND(_lowest(F.col("stop")) - 1)
    marks = words.select(
        *SHEET_KEYS, "word", (base + _bit_number(_lowest(F.col("real")))).alias("a"), (base + _bit_number(_lowest(F.col("stop")))).alias("b"),
        (base + _bit_number(_highest(F.col("at")))).alias("last"), F.when(F.col("stop") != 0, base + _bit_number(_highest(before))).alias("prev"))
    blocks = _merged(marks.groupBy(*SHEET_KEYS, F.shiftright("word", 11).alias("part")))
    j = _merged(blocks.groupBy(*SHEET_KEYS)).select(*SHEET_KEYS, F.col("a").alias("A"), F.col("b").alias("B"), "last", F.col("prev").alias("prevB"))
    header = (
        F.when(F.col("A").isNotNull() & (F.col("B").isNull() | (F.col("A") < F.col("B"))), F.col("A"))
        .when(F.col("B").isNotNull(), F.coalesce(F.col("prevB"), F.lit(h0)))
        .otherwise(F.greatest(F.coalesce(F.col("last"), F.lit(h0)), F.lit(h0)))
    )
    return j.select(*SHEET_KEYS, header.cast("int").alias("header_row"))


# -- S12 ----------------------------------------------------------------------
def read_records(table: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Mapped columns present in the sheet, renamed to target names, cells normalised (S13); ``_row`` stays."""
    pairs = [(s, t) for s, t in mapping.items() if s in table.columns]
    return normalise_cells(table.select(*([F.col(ROW)] if ROW in table.columns else []), *[qcol(s).alias(t) for s, t in pairs]))

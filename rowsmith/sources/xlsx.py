"""Workbook files as a Spark data source (S1, S2) and sink (K4).

``spark.read.format("xlsx_grid").load(glob)`` returns one grid row per sheet
row: ``path, sheet, row_idx, cells``.  Files are listed on the driver (paths
only); every file is one input partition and is parsed inside an executor
with the standard library (``zipfile`` + ``xml.etree.iterparse``), streaming
row by row.  A sheet holds at most 1,048,576 rows, so one task's work is
bounded.  Filters on ``row_idx`` and ``sheet`` are pushed into the parser.

``df.write.format("xlsx_grid").save(folder)`` writes one workbook per task
(at most 1,048,575 data rows per sheet, more rows go to further sheets),
first into ``_temporary`` and moved into place when the job commits.
"""

from __future__ import annotations

import datetime as _dt
import glob as _glob
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

GRID_SCHEMA = "path string, sheet string, row_idx int, cells array<string>"

# OOXML namespaces and the built-in number formats that are dates
# or times (ECMA-376 part 1, 18.8.30).
NS_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
NS_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NS_PKG_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
TIME_ONLY_FORMAT_IDS = {18, 19, 20, 21, 45, 46, 47}
MAX_SHEET_ROWS = 1_048_576


def _q(tag: str, ns: str = NS_MAIN) -> str:
    return f"{{{ns}}}{tag}"


def col_index(ref: str) -> int:
    """``"AB12"`` -> 28 (1-based column of a cell reference)."""
    n = 0
    for ch in ref:
        if "A" <= ch <= "Z":
            n = n * 26 + (ord(ch) - 64)
        elif "a" <= ch <= "z":
            n = n * 26 + (ord(ch) - 96)
        else:
            break
    return n


def col_name(n: int) -> str:
    out = ""
    while n > 0:
        n, rem = divmod(n - 1, 26)
        out = chr(65 + rem) + out
    return out


def _is_date_format(code: str) -> bool:
    s = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or "")
    return bool(re.search(r"[dDyYhHsS]|[mM]", s)) and not re.fullmatch(r"[#0.,%E+\-\s]*", s)


@dataclass
class _Book:
    sheets: list[tuple[str, str]]  # (name, part path inside the zip)
    strings: list[str]
    date_styles: set[int]
    time_styles: set[int]
    date1904: bool


def _read_book(z: zipfile.ZipFile) -> _Book:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = {}
    try:
        for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            target = target.lstrip("/") if target.startswith("/") else "xl/" + target
            rels[r.get("Id")] = os.path.normpath(target).replace(os.sep, "/")
    except KeyError:
        pass
    sheets = []
    for i, s in enumerate(wb.iter(_q("sheet")), start=1):
        rid = s.get(_q("id", NS_REL))
        sheets.append((s.get("name"), rels.get(rid, f"xl/worksheets/sheet{i}.xml")))
    pr = wb.find(_q("workbookPr"))
    date1904 = pr is not None and pr.get("date1904") in ("1", "true")
    strings: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as fh:
            for ev, el in ET.iterparse(fh):
                if el.tag == _q("si"):
                    strings.append("".join(t.text or "" for t in el.iter(_q("t")) if not _in_phonetic(el, t)))
                    el.clear()
    date_styles, time_styles = set(), set()
    if "xl/styles.xml" in z.namelist():
        st = ET.fromstring(z.read("xl/styles.xml"))
        custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in st.iter(_q("numFmt"))}
        xfs = st.find(_q("cellXfs"))
        if xfs is not None:
            for i, xf in enumerate(xfs.findall(_q("xf"))):
                fid = int(xf.get("numFmtId", "0"))
                if fid in DATE_FORMAT_IDS or (fid in custom and _is_date_format(custom[fid])):
                    date_styles.add(i)
                    if fid in TIME_ONLY_FORMAT_IDS:
                        time_styles.add(i)
    return _Book(sheets, strings, date_styles, time_styles, date1904)


def _in_phonetic(si, t) -> bool:
    for rph in si.iter(_q("rPh")):
        if any(x is t for x in rph.iter(_q("t"))):
            return True
    return False


def _number_text(v: str) -> str:
    """Number cells as the spreadsheet reader gives them: integral values as
    integers (``5.0`` -> ``5``), others as the shortest float text."""
    try:
        if not any(ch in v for ch in ".eE"):
            return str(int(v))
        x = float(v)
    except ValueError:
        return v
    return str(int(x)) if x.is_integer() else str(x)


def _serial_to_text(v: str, date1904: bool, time_only: bool) -> str:
    x = float(v)
    base = _dt.datetime(1904, 1, 1) if date1904 else _dt.datetime(1899, 12, 30)
    stamp = base + _dt.timedelta(days=x)
    stamp = stamp.replace(microsecond=round(stamp.microsecond / 1000) * 1000 % 1_000_000) if stamp.microsecond else stamp
    if time_only and 0 <= x < 1:
        return stamp.time().isoformat()
    return stamp.isoformat(sep=" ")


def iter_sheet_rows(z: zipfile.ZipFile, part: str, book: _Book, row_min: int = 1, row_max: int | None = None) -> Iterator[tuple[int, list]]:
    """Stream ``(row number, cells)`` of one worksheet; gaps in rows are skipped."""
    with z.open(part) as fh:
        next_row = 1
        for ev, el in ET.iterparse(fh):
            if el.tag != _q("row"):
                continue
            r = int(el.get("r") or next_row)
            next_row = r + 1
            if r < row_min or (row_max is not None and r > row_max):
                el.clear()
                if row_max is not None and r > row_max:
                    break
                continue
            cells: dict[int, str | None] = {}
            pos = 0
            for c in el.iter(_q("c")):
                ref = c.get("r")
                pos = col_index(ref) if ref else pos + 1
                t = c.get("t", "n")
                v = c.find(_q("v"))
                text = v.text if v is not None else None
                if t == "s" and text is not None:
                    text = book.strings[int(text)]
                elif t == "inlineStr":
                    is_ = c.find(_q("is"))
                    text = "".join(x.text or "" for x in is_.iter(_q("t"))) if is_ is not None else None
                elif t == "b" and text is not None:
                    text = "True" if text.strip() == "1" else "False"
                elif t == "e":
                    text = None  # error cells (#N/A, #DIV/0!, ...) read as missing
                elif t in ("n",) and text is not None:
                    s = int(c.get("s", "0"))
                    if s in book.date_styles:
                        text = _serial_to_text(text, book.date1904, s in book.time_styles)
                    else:
                        text = _number_text(text)
                cells[pos] = text
            el.clear()
            width = max(cells) if cells else 0
            yield r, [cells.get(i) for i in range(1, width + 1)]


def sheet_names(path: str) -> list[str]:
    """S1 for one file (driver-side convenience)."""
    with zipfile.ZipFile(path) as z:
        return [n for n, _ in _read_book(z).sheets]


# -- reader ---------------------------------------------------------------------
class _FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class XlsxGridReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options = options
        self.row_min = 1
        self.row_max: int | None = None
        self.sheets: set[str] | None = None
        if options.get("sheet"):
            self.sheets = {options["sheet"]}

    def pushFilters(self, filters):
        for f in filters:
            col = f.attribute[0] if f.attribute else None
            if col == "row_idx" and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)):
                v = int(f.value)
                if isinstance(f, GreaterThan):
                    self.row_min = max(self.row_min, v + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.row_min = max(self.row_min, v)
                elif isinstance(f, LessThan):
                    self.row_max = v - 1 if self.row_max is None else min(self.row_max, v - 1)
                elif isinstance(f, LessThanOrEqual):
                    self.row_max = v if self.row_max is None else min(self.row_max, v)
                else:
                    self.row_min = max(self.row_min, v)
                    self.row_max = v if self.row_max is None else min(self.row_max, v)
            elif col == "sheet" and isinstance(f, (EqualTo, In)):
                vals = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sheets = vals if self.sheets is None else self.sheets & vals
            else:
                yield f

    def partitions(self):
        paths = []
        for spec in str(self.options.get("path", "")).split(","):
            spec = spec.strip()
            if not spec:
                continue
            if os.path.isdir(spec):
                spec = os.path.join(spec, "*.xls[xm]")
            paths.extend(sorted(_glob.glob(spec)) or [spec])
        return [_FilePartition(p) for p in paths]

    def read(self, partition):
        with zipfile.ZipFile(partition.path) as z:
            book = _read_book(z)
            for name, part in book.sheets:
                if self.sheets is not None and name not in self.sheets:
                    continue
                if part not in z.namelist():
                    continue
                for r, cells in iter_sheet_rows(z, part, book, self.row_min, self.row_max):
                    yield (partition.path, name, r, cells)


# -- writer ---------------------------------------------------------------------
@dataclass
class _Written(WriterCommitMessage):
    files: list


def _cell_xml(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, (_dt.datetime, _dt.date)):
        v = v.isoformat()
    text = escape(str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_workbook(path: str, header: list[str], rows: Iterator[list], sheet_rows: int = MAX_SHEET_ROWS - 1) -> None:
    """One workbook; rows beyond a sheet's capacity continue on a new sheet."""
    sheets: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        buf = None
        n = 0
        idx = 0

        def start():
            nonlocal buf, n, idx
            idx += 1
            sheets.append(f"Sheet{idx}")
            buf = z.open(f"xl/worksheets/sheet{idx}.xml", "w", force_zip64=True)
            buf.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{NS_MAIN}"><sheetData>'.encode())
            hdr = "".join(_cell_xml(f"{col_name(i + 1)}1", h) for i, h in enumerate(header))
            buf.write(f'<row r="1">{hdr}</row>'.encode())
            n = 0

        def finish():
            buf.write(b"</sheetData></worksheet>")
            buf.close()

        start()
        for row in rows:
            if n >= sheet_rows:
                finish()
                start()
            n += 1
            r = n + 1
            body = "".join(_cell_xml(f"{col_name(i + 1)}{r}", v) for i, v in enumerate(row))
            buf.write(f'<row r="{r}">{body}</row>'.encode())
        finish()
        sheet_xml = "".join(
            f'<sheet name="{s}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, start=1)
        )
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{NS_MAIN}" xmlns:r="{NS_REL}"><sheets>{sheet_xml}</sheets></workbook>')
        rels = "".join(
            f'<Relationship Id="rId{i}" Type="{NS_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{NS_PKG_REL}">{rels}</Relationships>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{NS_PKG_REL}"><Relationship Id="rId1" Type="{NS_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        overrides = "".join(
            f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        z.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            f"{overrides}</Types>",
        )


class XlsxGridWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path = options.get("path")
        self.columns = [f.name for f in schema.fields]
        self.overwrite = overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        tmp = os.path.join(self.path, "_temporary")
        os.makedirs(tmp, exist_ok=True)
        name = f"part-{pid:05d}-{uuid.uuid4().hex[:12]}.xlsx"
        write_workbook(os.path.join(tmp, name), self.columns, (list(r) for r in iterator))
        return _Written(files=[name])

    def commit(self, messages):
        tmp = os.path.join(self.path, "_temporary")
        if self.overwrite:
            for old in _glob.glob(os.path.join(self.path, "*.xlsx")):
                os.remove(old)
        for m in messages:
            for f in getattr(m, "files", []):
                os.replace(os.path.join(tmp, f), os.path.join(self.path, f))
        try:
            os.rmdir(tmp)
        except OSError:
            pass
        open(os.path.join(self.path, "_SUCCESS"), "w").close()

    def abort(self, messages):
        tmp = os.path.join(self.path, "_temporary")
        for m in messages or []:
            for f in getattr(m, "files", []) or []:
                try:
                    os.remove(os.path.join(tmp, f))
                except OSError:
                    pass


class XlsxGridSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx_grid"

    def schema(self):
        return GRID_SCHEMA

    def reader(self, schema: StructType):
        return XlsxGridReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool):
        return XlsxGridWriter(self.options, schema, overwrite)


def register(spark) -> None:
    """Make ``format("xlsx_grid")`` available in this session."""
    from rowsmith.session import ship_package

    ship_package(spark)
    # The reader pushes row and sheet filters into the parser.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XlsxGridSource)


def read_grid(spark, path: str, sheet: str | None = None):
    """``path, sheet, row_idx, cells`` of every sheet of every matching file."""
    register(spark)
    r = spark.read.format("xlsx_grid")
    if sheet:
        r = r.option("sheet", sheet)
    return r.load(path)


# -- cluster storage ------------------------------------------------------------
def _grid_batches(batches, sheet: str | None, batch_rows: int = 8192):
    import io

    import pyarrow as pa

    schema = pa.schema([
        ("path", pa.string()), ("sheet", pa.string()), ("row_idx", pa.int32()), ("cells", pa.list_(pa.string())),
    ])
    buf: dict[str, list] = {"path": [], "sheet": [], "row_idx": [], "cells": []}

    def flush():
        out = pa.RecordBatch.from_pydict(buf, schema=schema)
        for v in buf.values():
            v.clear()
        return out

    for batch in batches:
        paths = batch.column("path").to_pylist()
        contents = batch.column("content")
        for i, path in enumerate(paths):
            data = contents[i].as_py()
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                book = _read_book(z)
                for name, part in book.sheets:
                    if (sheet is not None and name != sheet) or part not in z.namelist():
                        continue
                    for r, cells in iter_sheet_rows(z, part, book):
                        buf["path"].append(path)
                        buf["sheet"].append(name)
                        buf["row_idx"].append(r)
                        buf["cells"].append(cells)
                        if len(buf["path"]) >= batch_rows:
                            yield flush()
            del data
    if buf["path"]:
        yield flush()


def read_grid_files(spark, path: str, sheet: str | None = None, *, glob_filter: str = "*.xls[xm]"):
    """S2 for any Hadoop file system (HDFS, object stores): ``binaryFile`` + ``mapInArrow``.

    Spark lists the files (in parallel for large folders) and packs them into
    tasks by size; each task parses its workbooks and streams grid rows out in
    Arrow batches.  Same output as ``read_grid``; filters on the result run in
    Spark after parsing (no pushdown into the parser here).
    """
    from rowsmith.session import ship_package

    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob_filter).load(path).select("path", "content")
    return files.mapInArrow(lambda it: _grid_batches(it, sheet), GRID_SCHEMA)

import os

import pytest
from pyspark.sql import functions as F

from rowsmith.plans.spec import GridSlice
from rowsmith.sources import grid, xlsx
from rowsmith.sources.grid import GRID_SCHEMA, header_names


def _grid(spark, rows, sheet="S"):
    return spark.createDataFrame([("f", sheet, r, c) for r, c in rows], GRID_SCHEMA)


def test_header_names_cases():
    assert header_names(["A", "A", None, "Unnamed: 3", " B ", "B", "", "A_2"]) == \
        ["A", "A.1", "column_3", "column_4", "B", "B_2", "column_7", "A_2"]
    assert header_names(["A ", "A", "A_2"]) == ["A", "A_2", "A_2_2"]  # Q4 fix
    assert header_names([None, None], prefix="Coluna_") == ["Coluna_1", "Coluna_2"]


def test_used_range(spark):
    g = _grid(spark, [(1, ["a", None, None]), (2, [None, None, None]), (3, ["b", "c", None]), (4, [None, None]), (5, None or [])])
    got = sorted((r.row_idx, tuple(r.cells)) for r in grid.used_range(g).collect())
    assert got == [(1, ("a", None)), (2, (None, None)), (3, ("b", "c"))]
    empty = _grid(spark, [(1, [None]), (2, [None])], sheet="E")
    assert grid.used_range(empty).count() == 2  # nothing is cut when all is empty


def test_sheet_table_ranges(spark):
    rows = [(1, ["title", None, None]), (3, ["id", "name", "x"]), (4, ["1", "a", "q"]), (5, ["NA", "", "#N/A"]),
            (6, ["2", "b", "r"]), (7, ["3", "c", "s"]), (8, ["4", "d", "t"])]
    g = _grid(spark, rows)
    t = grid.sheet_table(g, GridSlice(header_row=3, start_row=5, end_row=7, start_col=2, end_col=3))
    assert t.columns == ["_row", "name", "x"]
    assert [tuple(r) for r in t.orderBy("_row").collect()] == [(6, "b", "r"), (7, "c", "s")]  # Q2/Q3: physical rows
    t = grid.sheet_table(g, GridSlice(header_row=3))
    assert [r._row for r in t.orderBy("_row").collect()] == [4, 6, 7, 8]
    assert [r._row for r in grid.preview(t, 2).collect()] == [4, 6]
    kept = grid.sheet_table(g, GridSlice(header_row=3), tokens=None)
    assert [r._row for r in kept.orderBy("_row").collect()] == [4, 5, 6, 7, 8]
    assert [r.sheet for r in grid.sheet_list(g).collect()] == ["S"]


def test_sheets_without_header_row(spark):
    """Their rows never vanish: an error beside named columns, for one layout as for several; else placeholder names."""
    a = _grid(spark, [(1, ["id", "name"]), (2, ["1", "x"])], "a")
    b = _grid(spark, [(1, ["name", "id"]), (2, ["y", "2"])], "b")
    bare, null = _grid(spark, [(2, ["3", "z"])], "bare"), _grid(spark, [(1, None), (2, ["3", "z"])], "null")
    blank = _grid(spark, [(2, [None, None]), (3, None)], "blank")
    for other in (bare, null):
        for named in (a, a.unionByName(b)):
            with pytest.raises(ValueError, match="sheets differ"):
                grid.sheet_table(named.unionByName(other), GridSlice(1))
    t = grid.sheet_table(bare.unionByName(null), GridSlice(1))
    assert t.columns == ["_row", "column_1", "column_2"] and [tuple(r) for r in t.collect()] == [(2, "3", "z")] * 2
    both = a.unionByName(b).unionByName(blank)
    assert sorted(tuple(r) for r in grid.sheet_table(both, GridSlice(1), names=None).collect()) in (
        [(2, "1", "x"), (2, "2", "y")], [(2, "x", "1"), (2, "y", "2")])
    assert grid.sheet_table(both, GridSlice(1), drop_empty=False).count() == 4
    placeholders = _grid(spark, [(1, ["column_2", "column_1"]), (2, ["z", "3"])], "p")
    t = grid.sheet_table(bare.unionByName(placeholders), GridSlice(1))
    assert [(r.column_1, r.column_2) for r in t.collect()] == [("3", "z")] * 2


def test_detect_header(spark):
    g1 = _grid(spark, [(2, ["h1", "h2"]), (3, ["1", "2"])], "one_blank")
    g2 = _grid(spark, [(3, ["h1", None]), (4, ["1", "2"])], "two_blank")
    g3 = _grid(spark, [(1, ["h", "k"]), (2, ["1", "2"])], "at_start")
    g4 = _grid(spark, [(2, ["column_1", "column_2"]), (3, ["x", "y"])], "prefix_row")
    g5 = _grid(spark, [(2, ["Unnamed: 0", None]), (3, ["name", "v"])], "unnamed_row")
    g = g1.unionByName(g2).unionByName(g3).unionByName(g4).unionByName(g5)
    got = {r.sheet: r.header_row for r in grid.detect_header(g, GridSlice(1)).collect()}
    assert got == {"one_blank": 2, "two_blank": 3, "at_start": 1, "prefix_row": 1, "unnamed_row": 3}


def _book(path, rows, header):
    xlsx.write_workbook(path, header, iter(rows))


def test_xlsx_round_trip_and_pushdown(spark, tmp):
    _book(os.path.join(tmp, "a.xlsx"), [["x", 1, None, True], [None, None, None, None], ["z", 2.5, "q", False]],
          ["name", "qty", None, "name"])
    _book(os.path.join(tmp, "b.xlsx"), [[f"r{i}"] for i in range(5)], ["only"])
    g = xlsx.read_grid(spark, os.path.join(tmp, "*.xlsx"))
    assert g.select("path").distinct().count() == 2
    a = g.filter(F.col("path").endswith("a.xlsx"))
    t = grid.sheet_table(a, GridSlice(1))
    assert t.columns == ["_row", "name", "qty", "column_3", "name.1"]
    assert [tuple(r) for r in t.orderBy("_row").collect()] == [(2, "x", "1", None, "True"), (4, "z", "2.5", "q", "False")]
    pushed = g.filter((F.col("row_idx") >= 3) & (F.col("row_idx") <= 4) & (F.col("sheet") == "Sheet1"))
    assert sorted(r.row_idx for r in pushed.collect()) == [3, 3, 4, 4]
    assert xlsx.sheet_names(os.path.join(tmp, "a.xlsx")) == ["Sheet1"]


def test_xlsx_writer_splits_sheets(spark, tmp):
    p = os.path.join(tmp, "big.xlsx")
    xlsx.write_workbook(p, ["n"], ([i] for i in range(7)), sheet_rows=3)
    assert xlsx.sheet_names(p) == ["Sheet1", "Sheet2", "Sheet3"]
    g = xlsx.read_grid(spark, p)
    data = sorted(int(r.cells[0]) for r in g.filter("row_idx > 1").collect())
    assert data == list(range(7))
    out = os.path.join(tmp, "out")
    spark.range(10).repartition(3).write.format("xlsx_grid").mode("append").save(out)
    assert len([f for f in os.listdir(out) if f.endswith(".xlsx")]) == 3
    assert xlsx.read_grid(spark, out).filter("row_idx > 1").count() == 10


def test_header_names_col(spark):
    df = spark.createDataFrame([(["A", "A", None],)], "c array<string>")
    assert df.select(grid.header_names_col("c")).first()[0] == ["A", "A.1", "column_3"]


def test_binary_file_reader_matches_data_source(spark, tmp):
    for name, rows in (("a.xlsx", [["x", 1, None], [None, None, None], ["z", 2.5, "q"]]), ("b.xlsx", [[f"r{i}"] for i in range(20000)])):
        xlsx.write_workbook(os.path.join(tmp, name), ["h1", "h2", "h3"], iter(rows))
    a = xlsx.read_grid(spark, os.path.join(tmp, "*.xlsx"))
    b = xlsx.read_grid_files(spark, tmp)
    norm = lambda df: sorted((os.path.basename(r.path), r.sheet, r.row_idx, tuple(r.cells)) for r in df.collect())
    assert norm(a) == norm(b)
    assert xlsx.read_grid_files(spark, tmp, sheet="nope").count() == 0


def test_xlsx_cell_types_and_date_formats(spark, tmp):
    """Shared strings (with a phonetic run), booleans, date serials by built-in
    and custom number formats, time-only cells, inline strings, formula text,
    sparse cells and a relationship target that differs from sheet order."""
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    path = os.path.join(tmp, "types.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets>'
                   '<sheet name="Data" sheetId="1" r:id="rId7"/><sheet name="Other" sheetId="2" r:id="rId3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId7" Target="worksheets/sheet2.xml"/><Relationship Id="rId3" Target="/xl/worksheets/sheet1.xml"/>'
                   '</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>name</t></si><si><r><t>Ca</t></r><r><t>fé</t></r>'
                   '<rPh><t>KAFE</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/>'
                   '<numFmt numFmtId="165" formatCode="0.00%"/></numFmts><cellXfs>'
                   '<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="20"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData>'
                   '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c></row>'
                   '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" s="1"><v>45292</v></c>'
                   '<c r="D3" s="2"><v>45293.5</v></c><c r="E3" s="3"><v>0.5</v></c><c r="F3" s="4"><v>0.25</v></c>'
                   '<c r="G3"><v>7</v></c><c r="H3"><v>2.50</v></c><c r="I3" t="str"><f>A1</f><v>name</v></c>'
                   '<c r="J3"><v>5.0</v></c><c r="K3"><v>1E3</v></c><c r="L3" t="e"><v>#N/A</v></c><c r="M3"><v>x</v></c></row>'
                   '</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="B1"><v>1</v></c></row></sheetData></worksheet>')
    g = {(r.sheet, r.row_idx): r.cells for r in xlsx.read_grid(spark, path).collect()}
    assert g[("Data", 1)] == ["name", None, "when"]
    assert g[("Data", 3)] == ["Café", "True", "2024-01-01 00:00:00", "2024-01-02 12:00:00", "12:00:00", "0.25", "7", "2.5",
                              "name", "5", "1000", None, "x"]
    assert g[("Other", 1)] == [None, "1"]
    assert xlsx.sheet_names(path) == ["Data", "Other"]


def test_repeat_mangling_matches_pandas_reader(tmp):
    """Repeated and empty header cells must arrive as the spreadsheet reader
    (pandas' Python parser, used for workbooks) names them."""
    import csv
    import io
    import random

    import pandas as pd

    from rowsmith.sources.grid import _mangle_repeats

    rnd = random.Random(4)
    for _ in range(400):
        names = [rnd.choice(["A", "A.1", "B", "A.2", "B.1", "C", "A.1.1", "", "Unnamed: 2"]) for _ in range(rnd.randint(1, 8))]
        if not any(names):
            continue  # a CSV header of empty fields reads as a blank line (a CSV artefact)
        buf = io.StringIO()
        csv.writer(buf).writerow(names)
        buf.write(",".join("0" for _ in names) + "\n")
        got = list(pd.read_csv(io.StringIO(buf.getvalue()), dtype=object, engine="python").columns)
        empty = [i for i, n in enumerate(names) if n == ""]
        raw = [f"Unnamed: {i}" if n == "" else n for i, n in enumerate(names)]
        assert _mangle_repeats(raw, empty) == got, names


def test_header_walk_equals_the_loop_on_random_sheets_in_one_scan(spark):
    """Rows over several words and blocks of 65,536 rows, sheets of one class only, null and empty rows."""
    import random

    from rowsmith.sources import grid

    r = random.Random(3)
    kinds = {"real": ["name", "Unnamed: 1"], "stop": ["col_1", None], "data": ["Unnamed: 4", None], "empty": [None, None]}
    sheets = {"all stop": [(i, "stop") for i in range(5)], "no row at the start": [(70, "data"), (65_600, "stop"), (131_100, "real")], "empty": [(0, "empty"), (3, "empty")]}
    for n in range(60):
        weights = r.choice([(1, 1, 8, 2), (0, 1, 9, 1), (0, 1, 40, 9), (1, 0, 30, 3)])
        places = sorted(r.sample(range(140), 40)) + sorted(r.sample(range(65_500, 65_600), 10)) + sorted(r.sample(range(131_000, 131_200), 5))
        sheets[f"s{n}"] = [(p, r.choices(list(kinds), weights)[0]) for p in places]
    rows = [("f", name, p, kinds[k]) for name, sheet in sheets.items() for p, k in sheet]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "path string, sheet string, row_idx int, cells array<string>")

    def walked(sheet, h0):
        tried = [(p, k) for p, k in sheet if p == h0 or (p > h0 and k != "empty")]
        at = h0
        for i, (p, k) in enumerate(tried):
            if p > h0 and k == "stop":
                return at
            at = p
            if k == "real":
                return p
        return at

    for h0 in (1, 3):
        found = grid.detect_header(frame, grid.GridSlice(header_row=h0, start_row=h0 + 1), prefix="col_")
        assert {x.sheet: x.header_row for x in found.collect()} == {name: walked(sheet, h0) for name, sheet in sheets.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan

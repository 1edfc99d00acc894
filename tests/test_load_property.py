"""The whole load against a plain-Python simulation of the reference's steps."""

from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from rowsmith.plans.load import build_load
from rowsmith.plans.spec import LoadSpec, Lookup, TargetColumn

CELL = st.one_of(st.none(), st.sampled_from(["", " ", "a", "A ", "á", "b", "bb b", "  c", "longer text", "Alpha", "beta"]))
LABELS = [(1, "alpha"), (2, "Beta"), (3, "c"), (None, "b"), (4, " ")]  # a NULL id and a blank label are ignored (Q14)
TARGET = [TargetColumn("x", "text"), TargetColumn("y", "varchar(3)", max_length=3),
          TargetColumn("ref", "bigint", nullable=False), TargetColumn("origin", "text")]


def _lookup_key(v):
    return "" if v is None else str(v).strip().casefold()


def simulate(rows, trim, dedupe, replacements):
    rows = sorted(rows, key=lambda r: r["_row"])
    if trim:
        rows = [{k: (v.strip() if isinstance(v, str) else v) for k, v in r.items()} for r in rows]
    rows = [{k: (replacements.get(v, v) if k == "a" and isinstance(v, str) else v) for k, v in r.items()} for r in rows]
    if dedupe:
        seen, kept = set(), []
        for r in rows:
            k = brute.dup_key(r["a"])
            if k not in seen:
                seen.add(k)
                kept.append(r)
        rows = kept
    lookup = {}
    for i, label in LABELS:
        k = _lookup_key(label)
        if i is not None and k:
            lookup.setdefault(k, i)
    out, issues = [], set()
    for r in rows:
        if all(v is None or str(v).strip() == "" for v in (r["a"], r["b"])):
            continue  # skip empty rows before the lookup (Q1 fix)
        rec = {"x": r["a"], "y": r["b"], "origin": "sheet"}
        key = _lookup_key(r["c"])
        bad = set()
        if key == "":
            bad.add((r["_row"], "c", "fk_empty"))
        elif key not in lookup:
            bad.add((r["_row"], "c", "fk_not_found"))
        rec["ref"] = lookup.get(key) if key else None
        if rec["y"] is not None and len(str(rec["y"])) > 3:
            bad.add((r["_row"], "y", "too_long"))
        if rec["ref"] is None:
            bad.add((r["_row"], "ref", "required_null"))
        issues |= bad
        if not bad:
            out.append((r["_row"], rec["x"], rec["y"], rec["ref"], rec["origin"]))
    return sorted(out), issues


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(CELL, CELL, CELL), min_size=1, max_size=25), st.booleans(), st.booleans())
def test_load_matches_python_simulation(spark, cells, trim, dedupe):
    rows = [{"_row": i + 2, "a": a, "b": b, "c": c} for i, (a, b, c) in enumerate(cells)]
    replacements = {"b": "beta"}
    sheet = spark.createDataFrame([(r["_row"], r["a"], r["b"], r["c"]) for r in rows], "_row long, a string, b string, c string")
    spec = LoadSpec("t", TARGET, mapping=[("a", "x"), ("b", "y")], defaults={"origin": "sheet"},
                    lookups=[Lookup("ref", "c", "lk", "id", "label")], trim_whitespace=trim,
                    remove_duplicates=dedupe, duplicate_column="a", replacements={"a": replacements},
                    on_error="quarantine")
    lk = spark.createDataFrame(LABELS, "id long, label string")
    res = build_load(sheet, spec, {"lk": lk})
    got_rows = sorted((r._row, r.x, r.y, r.ref, r.origin) for r in res.rows.collect())
    got_issues = {(r._row, r.column, r.kind) for r in res.violations.collect() if r._row is not None}
    exp_rows, exp_issues = simulate(rows, trim, dedupe, replacements)
    assert got_rows == exp_rows
    assert got_issues == exp_issues


KEY = st.one_of(st.none(), st.integers(0, 5))
VAL = st.one_of(st.none(), st.sampled_from(["p", "q", "r"]))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(KEY, VAL), min_size=0, max_size=12), st.lists(st.tuples(KEY, VAL), min_size=0, max_size=12))
def test_update_matches_statement_per_record(spark, target, source):
    """One UPDATE ... WHERE k = :k per source record, in record order (Q23)."""
    from rowsmith.operators.update import update_by_key

    expected = [list(t) for t in target]
    for k, v in source:  # records in _row order
        for row in expected:
            if k is not None and row[0] == k:  # NULL matches nothing
                row[1] = v  # a NULL value overwrites
    tgt = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(target)], "i long, k long, v string")
    src = spark.createDataFrame([(i + 2, k, v) for i, (k, v) in enumerate(source)], "_row long, k long, v string")
    got = sorted((r.i, r.k, r.v) for r in update_by_key(tgt, src.repartition(3), "k", ["v"]).collect())
    assert got == sorted((i, k, v) for i, (k, v) in enumerate(expected))


GRID_CELL = st.sampled_from([None, "", " ", "x", "h", "column_1", "Unnamed: 0", "column_2"])


def _simulate_header(rows: dict, h0: int, prefix: str = "column_") -> int:
    """The reference's loop: move the header down while all names are placeholders
    and the first data row has a value that does not look like a placeholder."""
    from rowsmith.sources.grid import header_names

    h = h0
    while True:
        names = header_names(rows.get(h, [None, None]), prefix)
        if not all(n.startswith(prefix) for n in names):
            return h
        from rowsmith.functions.text import DEFAULT_NULL_TOKENS

        # the reader drops rows whose cells are all missing (NULL or an NA text); blanks are text
        later = [r for r in sorted(rows) if r > h and any(c is not None and c not in DEFAULT_NULL_TOKENS for c in rows[r])]
        if not later:
            return h
        values = [str(c).strip() for c in rows[later[0]] if c is not None and c not in DEFAULT_NULL_TOKENS and str(c).strip() != ""]
        if not values or all(v.startswith(prefix) for v in values):
            return h
        h += 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.dictionaries(st.integers(1, 7), st.tuples(GRID_CELL, GRID_CELL), max_size=6), min_size=1, max_size=6))
def test_header_detection_matches_reference_loop(spark, sheets):
    from rowsmith.plans.spec import GridSlice
    from rowsmith.sources.grid import GRID_SCHEMA, detect_header

    data = [("f", f"s{i}", r, list(c)) for i, rows in enumerate(sheets) for r, c in rows.items()]
    if not data:
        return
    grid = spark.createDataFrame(data, GRID_SCHEMA)
    got = {r.sheet: r.header_row for r in detect_header(grid, GridSlice(1)).collect()}
    for i, rows in enumerate(sheets):
        if rows:
            assert got[f"s{i}"] == _simulate_header({r: list(c) for r, c in rows.items()}, 1), rows
    # a sheet of empty rows with no row at the start row still gets an answer
    empty = spark.createDataFrame([("f", "e", 3, [None, " "])], GRID_SCHEMA)
    assert detect_header(empty, GridSlice(1)).first().header_row == 1


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.integers(1, 8), st.lists(st.sampled_from([None, "a", "b"]), max_size=4), min_size=1, max_size=6))
def test_used_range_matches_reference_formula(spark, rows):
    from rowsmith.sources.grid import GRID_SCHEMA, used_range

    grid = spark.createDataFrame([("f", "s", r, c) for r, c in rows.items()], GRID_SCHEMA)
    got = {r.row_idx: list(r.cells) for r in used_range(grid).collect()}
    nonempty = [r for r, c in rows.items() if any(v is not None for v in c)]
    if not nonempty:  # nothing is cut when every cell is empty
        assert got == rows
        return
    last_row = max(nonempty)
    last_col = max(max((i + 1 for i, v in enumerate(c) if v is not None), default=0) for c in rows.values())
    assert got == {r: c[:last_col] for r, c in rows.items() if r <= last_row}

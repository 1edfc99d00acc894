import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rowsmith import catalog
from rowsmith.operators.validate import LoadRejected
from rowsmith.plans.load import build_load
from rowsmith.plans.spec import GridSlice, LoadSpec, Lookup, SpecError, SplitRule, TargetColumn
from rowsmith.sinks import files as fsink
from rowsmith.sinks import jdbc as jsink
from rowsmith.sources import files as fsrc
from rowsmith.sources import jdbc as jsrc

TARGET = [
    TargetColumn("id", "integer", nullable=False, primary_key=True),
    TargetColumn("customer_id", "bigint", nullable=False),
    TargetColumn("ordered_on", "date"),
    TargetColumn("amount", "numeric(12,2)"),
    TargetColumn("flag", "boolean"),
    TargetColumn("note", "varchar(10)", max_length=10),
    TargetColumn("origin", "text"),
]


def _feed(spark):
    rows = [
        (2, " Alpha ", "2024-01-05", "10.50", "N", "ok"),
        (3, "beta", "2024-01-06", "7", "Y", "way too long text"),
        (4, "zeta", "2024-01-07", "1", "N", "x"),      # not found
        (5, None, None, None, None, None),             # all empty -> skipped
        (6, "ALPHA", "2024-01-08", "2", "N", "dup"),   # duplicate of row 2 by customer
        (7, "  ", "2024-01-09", "3", "N", "blank"),    # empty FK
    ]
    return spark.createDataFrame(rows, "_row long, customer string, day string, amount string, flag string, note string")


def _spec(**kw):
    base = dict(
        table="orders", columns=TARGET,
        mapping=[("day", "ordered_on"), ("amount", "amount"), ("note", "note")],
        defaults={"origin": "sheet", "flag": False},
        primary_key="id", autogenerate_pk=True,
        lookups=[Lookup("customer_id", "customer", "cust", "id", "name")],
        trim_whitespace=True, remove_duplicates=True, duplicate_column="customer",
    )
    base.update(kw)
    return LoadSpec(**base)


def _tables(spark):
    return {"cust": spark.createDataFrame([(1, "alpha"), (2, "Beta")], "id long, name string")}


def test_load_fail_mode_rejects(spark):
    res = build_load(_feed(spark), _spec(), _tables(spark))
    kinds = sorted((r._row, r.kind) for r in res.violations.collect())
    # row 7's blank customer shares the blank duplicate key with row 5 (Q7), so
    # keep-first removes it before the lookup; row 5 is then skipped as empty.
    assert kinds == [(3, "too_long"), (4, "fk_not_found"), (4, "required_null")]
    with pytest.raises(LoadRejected):
        res.check()
    report = {r.metric: r.value for r in res.report().collect()}
    assert report["read"] == 6 and report["after_dedupe"] == 4 and report["after_skip_empty"] == 3
    no_dedupe = build_load(_feed(spark), _spec(remove_duplicates=False), _tables(spark))
    assert (7, "fk_empty") in {(r._row, r.kind) for r in no_dedupe.violations.collect()}


def test_load_quarantine_mode(spark):
    res = build_load(_feed(spark), _spec(on_error="quarantine"), _tables(spark))
    rows = res.rows.collect()
    assert [(r._row, r.customer_id, r.ordered_on, str(r.amount), r.flag, r.origin) for r in rows] == \
        [(2, 1, dt.date(2024, 1, 5), "10.50", False, "sheet")]
    assert "id" not in res.rows.columns  # generated key left out


def test_spec_checks():
    with pytest.raises(SpecError):
        _spec(mapping=[("day", "ordered_on")], lookups=[], defaults={}, autogenerate_pk=False).validate()  # V1
    with pytest.raises(SpecError):
        _spec(operation="update", join_column=None).validate()  # V2
    with pytest.raises(SpecError):
        _spec(defaults={"note": "x"}).validate()  # V3: note mapped and defaulted
    with pytest.raises(SpecError):
        LoadSpec("t", TARGET).validate()  # V4
    with pytest.raises(SpecError):
        LoadSpec("t", TARGET, mapping=[("k", "id")], operation="update", join_column="id").validate()  # Q12
    with pytest.raises(SpecError):
        SplitRule("x", "eq", 3)
    assert GridSlice(0, 1, 0, 0, None).corrected() == GridSlice(1, 2, None, 1, None)
    assert _spec().coverage()["missing"] == []


def test_split_and_replacements_in_load(spark):
    spec = _spec(split=SplitRule("note", "gt", 5), replacements={"customer": {"zeta": "beta"}}, on_error="quarantine",
                 mapping=[("day", "ordered_on"), ("amount", "amount"), ("extra_1", "note")])
    res = build_load(_feed(spark), spec, _tables(spark))
    got = sorted((r._row, r.note, r.customer_id) for r in res.rows.collect())
    # row 3's long note moves to extra_1 -> note (varchar(10)) and is quarantined;
    # row 4's customer is replaced zeta -> beta, which makes it a duplicate of row 3
    assert got == [(2, None, 1)]
    report = {r.metric: r.value for r in res.report().collect()}
    assert report["after_dedupe"] == 3 and report["replaced:customer"] == 1
    assert [r._row for r in res.sample(5).collect()] == [2]
    assert res.split_column == "extra_1"
    assert {(r._row, r.column, r.kind) for r in res.violations.collect()} == {(3, "note", "too_long")}


def test_conversion_file_round_trip(spark, tmp):
    rep = spark.createDataFrame([("c", "a", "A"), ("c", " 1 ", "1"), ("d", "x", "y")], "column string, source string, target string")
    path = os.path.join(tmp, fsink.conversion_file_name("c", "book"))
    fsink.export_conversions(rep, path)
    back = sorted(tuple(r) for r in fsrc.read_conversions(spark, path, trim=False).collect())
    assert back == sorted(tuple(r) for r in rep.collect())
    raw = os.path.join(tmp, "raw.csv")
    with open(raw, "w") as fh:
        fh.write("coluna_excel,valor_original,valor_corrigido\nc,a,first\nc,a,last\nc,,x\nc, ,y\nc,b,\nc,007,0.7\nc,NA,z\nc,q,N/A\n")
    got = sorted(tuple(r) for r in fsrc.read_conversions(spark, raw).collect())
    assert got == [("c", "007", "0.7"), ("c", "a", "last")]
    bad = os.path.join(tmp, "bad.csv")
    with open(bad, "w") as fh:
        fh.write("coluna_excel,valor_original\nc,a\n")
    with pytest.raises(ValueError):
        fsrc.read_conversions(spark, bad)


def test_csv_sheet_insert_and_update(spark, tmp):
    src = os.path.join(tmp, "feed.csv")
    with open(src, "w") as fh:
        fh.write("customer,day,amount,note\nalpha,2024-01-05,1.5,a\nbeta,2024-01-06,2,b\n")
    sheet = fsrc.read_csv_sheet(spark, src)
    assert sorted(r._row for r in sheet.collect()) == [2, 3]
    spec = _spec(remove_duplicates=False, trim_whitespace=False)
    res = build_load(sheet, spec, _tables(spark))
    out = os.path.join(tmp, "table")
    rep = fsink.insert_rows(res, out, generate_key="id", key_width=5)
    assert rep.records == 2
    rep = fsink.insert_rows(res, out, generate_key="id", key_width=5)
    ids = sorted(r.id for r in spark.read.parquet(out).collect())
    assert ids == ["00001", "00002", "00003", "00004"]
    upd = spark.createDataFrame([(1, "00001", "new"), (2, "00001", "newer"), (3, "99999", "zz")], "_row long, id string, note string")
    rep = fsink.update_table(out, upd, "id", os.path.join(tmp, "v2"))
    assert (rep.records, rep.changed) == (3, 1)
    notes = {r.id: r.note for r in spark.read.parquet(os.path.join(tmp, "v2")).collect()}
    assert notes["00001"] == "newer"
    csv_out = os.path.join(tmp, "export")
    fsink.export_csv(res.rows, csv_out)
    text = "".join(open(os.path.join(csv_out, f)).read() for f in os.listdir(csv_out) if f.endswith(".csv"))
    assert "false" in text and "2024-01-05" in text


def test_jdbc_statement_text():
    assert jsink.quote('a"b') == '"a""b"'
    assert jsink.update_sql("t", "s", "k", ["k", "v"]).startswith('UPDATE "public"."t" AS t SET "v" = s."v"')
    with pytest.raises(ValueError):
        jsink.update_sql("t", "s", "k", ["k"])
    assert "information_schema.columns" in jsrc.columns_sql("orders")
    assert jsrc.jdbc_options("jdbc:x", "u", "p")["user"] == "u"


def test_catalog_matches_oracles_at_sf0001(spark):
    import duckdb

    import oracle_check

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in oracle_check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for key, sql in catalog.oracle_sql().items():
        df = catalog.queries()[key](spark, sf)
        c1, v1 = oracle_check.canon(df.columns, [tuple(r) for r in df.collect()])
        res = con.execute(sql)
        c2, v2 = oracle_check.canon([d[0] for d in res.description], res.fetchall())
        assert (c1, v1) == (c2, v2), key


def test_load_with_dotted_and_blank_headers(spark, tmp):
    from rowsmith.plans.spec import GridSlice as GS
    from rowsmith.sources import grid, xlsx

    path = os.path.join(tmp, "d.xlsx")
    xlsx.write_workbook(path, ["name", "name", "a b", "qty"], iter([
        [" Alpha", "x", "long text here", "1"], ["alpha", "y", "t", "2"], ["beta ", None, "u", "3"], ["gamma", "z", "v", "4"]]))
    sheet = grid.sheet_table(xlsx.read_grid(spark, path), GS(1))
    assert sheet.columns == ["_row", "name", "name.1", "a b", "qty"]
    spec = LoadSpec(
        table="t", columns=[TargetColumn("cid", "bigint", nullable=False), TargetColumn("alt", "varchar(1)", max_length=1),
                            TargetColumn("note", "varchar(5)", max_length=5), TargetColumn("qty", "integer")],
        mapping=[("name.1", "alt"), ("a b", "note"), ("qty", "qty")],
        lookups=[Lookup("cid", "name", "c", "id", "label")],
        trim_whitespace=True, remove_duplicates=True, duplicate_column="name", on_error="quarantine",
        split=SplitRule("a b", "gt", 8), replacements={"name.1": {"z": "w"}},
    )
    tables = {"c": spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, label string")}
    res = build_load(sheet, spec, tables)
    got = sorted((r._row, r.cid, r.alt, r.note, r.qty) for r in res.rows.collect())
    # row 3 duplicates row 2 by name; row 5 (gamma) has no lookup match
    assert got == [(2, 1, "x", None, 1), (4, 2, None, "u", 3)]
    v = {(r._row, r.column, r.kind) for r in res.violations.collect()}
    assert v == {(5, "name", "fk_not_found"), (5, "cid", "required_null")}
    from rowsmith.operators import dedupe, similar, update

    assert dedupe.duplicate_stats(sheet, "name.1").first().total_rows == 4
    assert similar.value_counts(sheet, "a b").count() == 4
    upd = update.update_by_key(sheet.select("name", "a b"), sheet.select("_row", "name", "a b"), "name", ["a b"])
    assert upd.count() == 4


def test_load_applies_conversions_before_lookup(spark):
    rows = spark.createDataFrame([(2, " alfa ", "a"), (3, "bta", "b"), (4, "beta", "c")], "_row long, customer string, note string")
    conv = spark.createDataFrame([("customer", "alfa", "alpha"), ("customer", "bta", "BETA"), ("other", "beta", "zzz")],
                                 "column string, source string, target string")
    spec = LoadSpec("t", [TargetColumn("cid", "bigint", nullable=False), TargetColumn("note", "text")],
                    mapping=[("note", "note")], lookups=[Lookup("cid", "customer", "cust", "id", "name")],
                    on_error="quarantine")
    res = build_load(rows, spec, _tables(spark), conversions=conv)
    assert sorted((r._row, r.cid) for r in res.rows.collect()) == [(2, 1), (3, 2), (4, 2)]
    assert res.violations.count() == 0


def test_catalog_table_insert_and_schema_targets(spark, tmp):
    from rowsmith.plans.spec import target_columns_from_schema

    spark.sql(f"CREATE TABLE t_orders (id BIGINT, note VARCHAR(5), flag BOOLEAN) USING parquet LOCATION '{tmp}/t_orders'")
    cols = target_columns_from_schema(spark.table("t_orders").schema, primary_key=["id"], required=["id"])
    assert [(c.name, c.type, c.max_length, c.nullable, c.primary_key) for c in cols] == [
        ("id", "bigint", None, False, True), ("note", "varchar(5)", 5, True, False), ("flag", "boolean", None, True, False)]
    sheet = spark.createDataFrame([(2, "1", "short"), (3, "2", "too long"), (4, "3", "ok")], "_row long, a string, b string")
    spec = LoadSpec("t_orders", cols, mapping=[("a", "id"), ("b", "note")], defaults={"flag": True}, on_error="quarantine")
    rep = fsink.insert_into_table(build_load(sheet, spec), "t_orders")
    assert rep.records == 2
    got = sorted(tuple(r) for r in spark.table("t_orders").collect())
    assert got == [(1, "short", True), (3, "ok", True)]
    spark.sql("DROP TABLE t_orders")


def test_rows_of_a_rejected_load_are_not_handed_out(spark):
    res = build_load(_feed(spark), _spec(), _tables(spark))
    with pytest.raises(LoadRejected):
        res.rows  # noqa: B018
    with pytest.raises(LoadRejected):
        jsink.update(res, {}, "t", "customer_id")
    assert res.candidates.count() == 3


def test_report_scans_the_sheet_twice_and_joins_nothing_without_a_key(spark, tmp):
    _feed(spark).write.parquet(f"{tmp}/feed")
    report = build_load(spark.read.parquet(f"{tmp}/feed"), _spec(), _tables(spark)).report()
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet") <= 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_report_counts_taken_while_materializing(spark):
    res = build_load(_feed(spark), _spec(), _tables(spark))
    plain = {r.metric: r.value for r in res.report().collect()}
    res.materialize()
    assert res.rows_read == 6 and res.ledger.count() == 4 and res.flagged.count() == 3
    assert {r.metric: r.value for r in res.report().collect()} == plain
    path = res.materialized_path
    assert path and os.path.exists(path.replace("file:", ""))
    res.release()
    assert not os.path.exists(path.replace("file:", "")) and res.materialized_path is None

"""Updates that rewrite only the files they touch."""

import pytest
from pyspark.sql import functions as F

from rowsmith.sinks import versions
from rowsmith.sources.grid import read_records

TARGET = "k long, v string, w int"
SOURCE = "_row long, k long, v string"


def _table(spark, path, n=1000, files=10):
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.col("id").cast("int").alias("w"))
    versions.create_table(rows.repartitionByRange(files, "k"), path)
    return {f for f in versions._versions(spark, path)[0]}


def test_only_touched_files_are_rewritten(spark, tmp):
    before = _table(spark, tmp + "/t")
    source = spark.createDataFrame([(5, 3, "late"), (2, 3, "early"), (7, 4, None), (8, None, "no key"), (9, 5000, "no row")], SOURCE)
    report = versions.update_files(source, tmp + "/t", "k")
    assert (report.records, report.changed, report.rewritten, report.kept) == (5, 2, 1, 9)
    assert len(before & set(versions._versions(spark, tmp + "/t")[1])) == 9
    got = {r.k: (r.v, r.w) for r in versions.read_version(spark, tmp + "/t").collect()}
    assert got == {k: ({3: "late", 4: None}.get(k, "old"), k) for k in range(1000)}
    assert {r.v for r in versions.read_version(spark, tmp + "/t", 0).collect()} == {"old"}
    assert versions.drop_versions_before(spark, tmp + "/t", 1) == 1
    assert versions.read_version(spark, tmp + "/t").count() == 1000
    with pytest.raises(ValueError):
        versions.read_version(spark, tmp + "/t", 0)


def test_no_match_and_empty_tables_publish_nothing(spark, tmp):
    _table(spark, tmp + "/t", 20, 2)
    none = spark.createDataFrame([(1, 99, "x"), (2, None, "x")], SOURCE)
    assert versions.update_files(none, tmp + "/t", "k").changed == 0
    assert versions.update_files(none.limit(0), tmp + "/t", "k").records == 0
    assert list(versions._versions(spark, tmp + "/t")) == [0]
    with pytest.raises(ValueError):
        versions.update_files(none, tmp + "/absent", "k")
    with pytest.raises(ValueError):
        versions.update_files(none.withColumn("other", F.lit(1)), tmp + "/t", "k")


def test_of_two_updates_of_one_version_one_is_refused(spark, tmp, monkeypatch):
    _table(spark, tmp + "/t", 20, 2)
    source = spark.createDataFrame([(1, 3, "x")], SOURCE)
    seen = versions._versions(spark, tmp + "/t")
    versions.update_files(source, tmp + "/t", "k")
    monkeypatch.setattr(versions, "_versions", lambda *_: seen)
    with pytest.raises(versions.VersionConflict):
        versions.update_files(source.withColumn("v", F.lit("y")), tmp + "/t", "k")
    monkeypatch.undo()
    assert {r.v for r in versions.read_version(spark, tmp + "/t").filter("k = 3").collect()} == {"x"}
    folders = {f.split("/")[0] for files in versions._versions(spark, tmp + "/t").values() for f in files}
    import os

    assert set(os.listdir(tmp + "/t/data")) == folders  # the refused update left no files


def test_records_are_mapped_and_normalised(spark):
    sheet = spark.createDataFrame([(2, float("nan"), "x"), (3, 1.5, None)], "_row long, `a.b` double, c string")
    got = read_records(sheet, {"a.b": "amount", "c": "name", "absent": "z"})
    assert got.columns == ["_row", "amount", "name"]
    assert [tuple(r) for r in got.orderBy("_row").collect()] == [(2, None, "x"), (3, 1.5, None)]

"""Line records of text files against Python's csv module."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from rowsmith.operators.dedupe import keep_first
from rowsmith.operators.update import update_by_key
from rowsmith.sources.lines import PATH, ROW, read_csv_records, records

CELLS = ["x", "", "a,b", 'say "hi"', "two\nlines", "\n\nblank lines\n", '"', " padded ", "é\U0001f600"]


def expected(path):
    """Start line and cells of every record but the header."""
    with open(path, newline="", encoding="utf-8") as f:
        r, out, seen = csv.reader(f), [], 0
        for cells in r:
            if cells and any(cells):
                out.append((seen + 1, tuple(cells)))
            seen = r.line_num
    return out[1:]


def write(path, r, n, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "note", "more"])
        for i in range(n):
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                f.write(end)
            w.writerow([i, r.choice(CELLS), r.choice(CELLS)])


@pytest.mark.parametrize("split", ["64", "200", "1000000"])
def test_rows_are_physical_lines_whatever_the_splits(spark, tmp, split):
    r = random.Random(int(split))
    for name, n in (("a.csv", 120), ("b.csv", 40)):
        write(f"{tmp}/{name}", r, n)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = read_csv_records(spark, tmp)
        assert got.columns == ["id", "note", "more", PATH, ROW]
        rows = got.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("a.csv", "b.csv"):
        mine = sorted((x[ROW], (x.id, x.note or "", x.more or "")) for x in rows if x[PATH].endswith(name))
        assert mine == expected(f"{tmp}/{name}")


def test_carriage_returns_and_files_without_rows(spark, tmp):
    with open(f"{tmp}/a.csv", "w", newline="") as f:
        f.write('id,note\r\n\r\n1,"x\r\ny"\r\n2,z\r\n')
    with open(f"{tmp}/b.csv", "w", newline="") as f:
        f.write("id,note\n")
    open(f"{tmp}/c.csv", "w").close()
    assert sorted((r[ROW], r.id, r.note) for r in read_csv_records(spark, tmp).collect()) == [(3, "1", "x\r\ny"), (5, "2", "z")]
    assert records(spark, f"{tmp}/c.csv").count() == 0


def test_first_and_last_row_over_files_go_by_path_then_line(spark, tmp):
    for name, rows in (("a.csv", "1,old\n2,x\n"), ("b.csv", "\n1,new\n1,newest\n")):
        with open(f"{tmp}/{name}", "w") as f:
            f.write("id,note\n" + rows)
    sheet = read_csv_records(spark, tmp)
    kept = keep_first(sheet, "id", order=(PATH, ROW))
    assert sorted((r.id, r.note) for r in kept.collect()) == [("1", "old"), ("2", "x")]
    target = spark.createDataFrame([("1", "?"), ("3", "?")], "id string, note string")
    done = update_by_key(target, sheet, "id", ["note"], order=(PATH, ROW))
    assert sorted((r.id, r.note) for r in done.select(F.col("id"), F.col("note")).collect()) == [("1", "newest"), ("3", "?")]

"""Inserts that happen once, and reserved key ranges."""

import threading

import pytest

from rowsmith.operators.validate import LoadRejected
from rowsmith.plans.load import build_load
from rowsmith.plans.spec import LoadSpec, TargetColumn
from rowsmith.sinks import commits


def load(spark, rows, on_error="fail"):
    spec = LoadSpec("t", [TargetColumn("key", "varchar(5)", nullable=True), TargetColumn("note", "varchar(4)", max_length=4)], mapping=[("a", "note")], on_error=on_error)
    return build_load(spark.createDataFrame(list(enumerate(rows, 2)), "_row long, a string"), spec)


def notes(spark, path):
    return sorted(r.note for r in commits.read_committed(spark, path).collect())


def test_a_load_sent_twice_is_written_once(spark, tmp):
    first = commits.insert_once(load(spark, ["a", "b"]), tmp, "2024/01 a")
    again = commits.insert_once(load(spark, ["a", "b"]), tmp, "2024/01 a")
    other = commits.insert_once(load(spark, ["c"]), tmp, "2024/01 b")
    assert (first.records, again.records, other.records) == (2, 2, 1)
    assert notes(spark, tmp) == ["a", "b", "c"]


def test_a_rejected_or_failed_load_leaves_nothing_visible(spark, tmp, monkeypatch):
    with pytest.raises(LoadRejected):
        commits.insert_once(load(spark, ["a", "too long"]), tmp, "1")
    with pytest.raises(ValueError):
        commits.read_committed(spark, tmp)
    commits.insert_once(load(spark, ["a"]), tmp, "1")
    with monkeypatch.context() as m:
        m.setattr(commits, "_create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            commits.insert_once(load(spark, ["b"]), tmp, "2")
    spark.createDataFrame([("k", "stray")], "key string, note string").write.parquet(f"{tmp}/loads/load-3-dead")  # a writer that died
    assert notes(spark, tmp) == ["a"]
    assert commits.insert_once(load(spark, ["b"]), tmp, "2").records == 1
    assert notes(spark, tmp) == ["a", "b"]


def test_two_writers_of_one_load(spark, tmp):
    got = []
    writers = [threading.Thread(target=lambda: got.append(commits.insert_once(load(spark, ["a", "b"]), tmp, "x").records)) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert got == [2, 2] and notes(spark, tmp) == ["a", "b"]


def test_loads_planned_from_the_same_state_get_disjoint_keys(spark, tmp):
    ranges = []
    threads = [threading.Thread(target=lambda k=k: ranges.append((commits.reserve_keys(spark, tmp, f"load {k}", 10 + k, 7), 10 + k))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    keys = [k for start, n in ranges for k in range(start + 1, start + n + 1)]
    assert len(set(keys)) == len(keys) == 46 and min(keys) == 8
    assert commits.reserve_keys(spark, tmp, "load 2", 12, 7) in [s for s, n in ranges if n == 12]
    with pytest.raises(ValueError):
        commits.reserve_keys(spark, tmp, "load 2", 13, 7)


def test_generated_keys_go_on_from_the_reserved_range(spark, tmp):
    commits.insert_once(load(spark, ["a", "b"]), tmp, "1", generate_key="key")
    commits.insert_once(load(spark, ["c"]), tmp, "2", generate_key="key")
    assert sorted((r.key, r.note) for r in commits.read_committed(spark, tmp).collect()) == [("00001", "a"), ("00002", "b"), ("00003", "c")]


def test_of_many_writers_of_one_marker_one_gets_it(spark, tmp):
    from concurrent.futures import ThreadPoolExecutor

    from rowsmith.sinks import commits

    for i in range(20):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda n: commits._create(spark, f"writer {n}", tmp, "marks", f"m{i}"), range(8)))
        assert sum(won) == 1
        assert commits._texts(spark, tmp, "marks")[f"m{i}"] == f"writer {won.index(True)}"

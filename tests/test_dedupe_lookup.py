import random

from pyspark.sql import functions as F

import brute
from rowsmith.operators import dedupe, lookup, update, validate
from rowsmith.plans.spec import Lookup

DUPES = [(1, "Café"), (2, "cafe"), (3, " CAFÉ "), (4, None), (5, ""), (6, "Straße"), (7, "strasse"),
         (8, "a b"), (9, "a b"), (10, "ﬁ"), (11, "fi"), (12, "x")]


def test_keep_first_matches_pandas_semantics(spark):
    df = spark.createDataFrame(DUPES, "_row long, v string")
    got = sorted(r._row for r in dedupe.keep_first(df, "v").collect())
    seen, exp = set(), []
    for r, v in DUPES:
        k = brute.dup_key(v)
        if k not in seen:
            seen.add(k)
            exp.append(r)
    assert got == exp == [1, 4, 6, 8, 10, 12]  # Q7: None and "" share the blank key


def test_keep_first_invariant_under_partitioning(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "A", "b", " b", "c", None, ""])) for i in range(500)]
    df = spark.createDataFrame(rows, "_row long, v string")
    base = sorted(r._row for r in dedupe.keep_first(df, "v").collect())
    for n in (1, 3, 11):
        assert sorted(r._row for r in dedupe.keep_first(df.repartition(n), "v").collect()) == base
    again = dedupe.keep_first(dedupe.keep_first(df, "v"), "v")
    assert sorted(r._row for r in again.collect()) == base  # idempotent
    keep_blank = dedupe.keep_first(df, "v", keep_blank_keys=True)
    assert keep_blank.count() == len(base) - 1 + sum(1 for _, v in rows if brute.dup_key(v) == "")


def test_duplicate_stats(spark):
    df = spark.createDataFrame(DUPES, "_row long, v string")
    r = dedupe.duplicate_stats(df, "v").first()
    assert (r.total_rows, r.unique_rows, r.removed) == (12, 6, 6)
    r = dedupe.duplicate_stats(df, "v", {"v": {"x": "Café"}}).first()
    assert r.unique_rows == 5


def _lk(spark):
    return spark.createDataFrame(
        [(1, " Alpha "), (1, "ALPHA"), (2, "beta"), (3, "Gamma"), (4, "gamma "), (None, "delta"), (5, None), (6, "  ")],
        "id long, label string")


def test_lookup_resolution_and_violations(spark):
    rows = spark.createDataFrame([(10, "alpha"), (11, " BETA "), (12, "zeta"), (13, "  "), (14, None), (15, "delta")],
                                 "_row long, name string")
    rule = Lookup("ref_id", "name", "t", "id", "label")
    flagged, prep = lookup.resolve_lookups(rows, [rule], {"t": _lk(spark)})
    good, viol = lookup.split_unresolved(flagged)
    assert sorted((r._row, r.ref_id) for r in good.collect()) == [(10, 1), (11, 2)]
    v = sorted((r._row, r.kind) for r in viol.collect())
    assert v == [(12, "fk_not_found"), (13, "fk_empty"), (14, "fk_empty"), (15, "fk_not_found")]  # Q14: NULL id ignored
    conf = sorted((r.key, r.label, r.id) for r in prep[rule.dictionary].conflicts.collect())
    assert conf == [("gamma", "Gamma", 3), ("gamma", "gamma ", 4)]


def test_lookup_with_conversions_and_shared_dictionary(spark):
    rows = spark.createDataFrame([(1, " bta ", "alpha")], "_row long, a string, b string")
    conv = spark.createDataFrame([("a", "bta", "beta")], "column string, source string, target string")
    rules = [Lookup("x", "a", "t", "id", "label"), Lookup("y", "b", "t", "id", "label")]
    flagged, prep = lookup.resolve_lookups(rows, rules, {"t": _lk(spark)}, conversions=conv)
    r = flagged.first()
    assert (r.x, r.y) == (2, 1) and len(prep) == 1


def test_length_violations_and_summary(spark):
    rows = [(i, "x" * (9 + i), "ok") for i in range(1, 9)] + [(20, "🙂" * 10, "ok"), (21, "🙂" * 11, "y" * 50)]
    df = spark.createDataFrame(rows, "_row long, code string, note string")
    v = validate.length_violations(df, {"code": 10, "note": 40, "absent": 3})
    got = sorted((r._row, r.column) for r in v.collect())
    assert got == [(i, "code") for i in range(2, 9)] + [(21, "code"), (21, "note")]
    note = [r for r in v.collect() if r.column == "note"][0]
    assert note.value == "y" * 50 and note.detail == "50 > 40 characters"
    assert "y" * 37 + "..." in validate.summarise(v, 20) and "y" * 38 not in validate.summarise(v, 20)
    text = validate.summarise(v, 5)
    assert text.count("\n") == 5 and text.endswith("...and 4 more")
    first = [r._row for r in validate.first_violations(v, 5).collect()]
    assert first == [2, 3, 4, 5, 6]


def test_required_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 3, None)], "_row long, q int, t string")
    assert sorted((r._row, r.column) for r in validate.required_nulls(df, ["q", "t"]).collect()) == [(1, "q"), (2, "t")]


def test_update_by_key(spark):
    target = spark.createDataFrame([(1, "a", "o1"), (1, "a2", "o2"), (2, "b", "o3"), (3, "c", "o4"), (None, "n", "o5")],
                                   "k long, v string, other string")
    source = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, None), (4, None, "z"), (5, 9, "w")],
                                   "_row long, k long, v string")
    out = update.update_by_key(target, source, "k", ["v"])
    got = sorted((r.k if r.k is not None else -1, r.v, r.other, r._updated) for r in out.collect())
    assert got == [(-1, "n", "o5", False), (1, "y", "o1", True), (1, "y", "o2", True), (2, None, "o3", True), (3, "c", "o4", False)]

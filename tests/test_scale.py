"""Skew and plan-shape checks: hot keys must not end up whole in one task."""

import re

from pyspark.sql import functions as F

from rowsmith.operators import components, dedupe, lookup, similar
from rowsmith.operators.common import maybe_broadcast
from rowsmith.plans.spec import Lookup
from rowsmith.session import checkpoint_dir


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_blank_key_is_cut_before_the_shuffle(spark):
    # a third of the rows share the blank key
    df = spark.range(0, 30000).select(F.col("id").alias("_row"),
                                      F.when(F.col("id") % 3 == 0, F.lit("  ")).otherwise(F.col("id").cast("string")).alias("v"))
    out = dedupe.keep_first(df, "v")
    plan = _plan(out)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert out.count() == 20001
    assert out.filter(F.col("v") == "  ").first()._row == 0


def test_hot_lookup_key_joins_without_gathering(spark, tmp):
    rows = spark.range(0, 20000).select(F.col("id").alias("_row"),
                                        F.when(F.col("id") % 3 == 0, F.lit("alpha")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("name"))
    mem = spark.createDataFrame([(i, f"k{i}") for i in range(50)] + [(999, "ALPHA")], "id long, label string")
    mem.write.parquet(f"{tmp}/lk")
    lk = spark.read.parquet(f"{tmp}/lk")
    # known, small size: broadcast in the static plan, the hot key never shuffles
    flagged, _ = lookup.resolve_lookups(rows, [Lookup("ref", "name", "t", "id", "label")], {"t": lk})
    assert "BroadcastHashJoin" in _plan(flagged)
    good, viol = lookup.split_unresolved(flagged)
    assert viol.count() == 0 and good.filter(F.col("ref") == 999).count() == 6667
    # unknown size (in-memory rows): no hint, AQE decides from the real size at run time
    flagged2, _ = lookup.resolve_lookups(rows, [Lookup("ref", "name", "t", "id", "label")], {"t": mem})
    flagged2.collect()
    assert "BroadcastHashJoin" in flagged2._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_below_the_size_bound(spark):
    small = spark.range(10)
    assert "broadcast" in str(maybe_broadcast(small)._jdf.queryExecution().logical()).lower()
    assert maybe_broadcast(small, limit=1) is small


def test_hot_bigram_does_not_pair_everything(spark):
    # every key shares the bigram 'th'; the rest is diverse.  Plain bigram
    # blocking would pair all keys through 'th'; the prefix index leaves the
    # most frequent tokens out.
    import random

    rnd = random.Random(11)
    words = set()
    while len(words) < 400:
        w = "".join(rnd.choice("abcdefghijklmnopqrsuvwxyz") for _ in range(10))
        i = rnd.randrange(11)
        words.add(w[:i] + "th" + w[i:])
    df = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(words))], "_row long, v string")
    _, keys = similar._keys(similar.value_counts(df, "v"))
    n = keys.count()
    cand = similar.candidate_pairs(keys).count()
    assert cand < n * (n - 1) / 2 / 4


def test_no_registered_query_plans_a_cross_join(spark):
    from rowsmith import catalog

    for name, fn in catalog.queries().items():
        df = fn(spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_a_round_of_components_shuffles_its_edges_five_times(spark):
    # each shuffle is as many tasks as the session has partitions, and the driver keeps a record of each
    import random

    r = random.Random(4)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(500, 540)] + [(900, k) for k in range(600, 700)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in pairs:
        if u != v:
            a, b = sorted((root(u), root(v)))
            top[b] = a
    edges = spark.createDataFrame(pairs + pairs[:50] + [(v, u) for u, v in pairs[50:90]], "u long, v long")
    got = [tuple(x) for x in components.connected_components(edges).collect()]
    assert sorted(got) == sorted((x, root(x)) for x in top)
    oriented = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    oriented.write.mode("overwrite").parquet(f"{checkpoint_dir(spark)}/edges")
    cur = spark.read.parquet(f"{checkpoint_dir(spark)}/edges")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(components._small_star(components._large_star(cur)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"- Exchange hashpartitioning", plan)) <= 5, plan

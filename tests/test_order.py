"""Order-sensitive operators give the same answer however the rows are partitioned."""

import random

from pyspark.sql import functions as F

import brute
from rowsmith.operators import clean, similar, update


def _rows(n=400, seed=2):
    rnd = random.Random(seed)
    words = ["Porca", "porcas", "Parafuso", "parafusos", "Arruela", "aruela", "bolt", "bolts", "x"]
    return [(i * 3 + rnd.randrange(3), rnd.choice(words), rnd.randrange(20), rnd.random()) for i in range(n)]


def test_order_sensitive_operators_ignore_partitioning(spark):
    rows = _rows()
    base = spark.createDataFrame(rows, "_row long, v string, k long, x double")
    for n in (1, 5, 13):
        df = base.repartition(n)
        # A2 first_row, A5 canonical, L1 order, J3/T4 orientation by first-seen order
        got = [tuple(r) for r in similar.suggestions(df, "v").collect()]
        assert got == brute.suggestions([v for _, v, _, _ in sorted(rows)])
        # The last record per key wins
        last = {r.k: r.x for r in update.last_per_key(df, "k", ["x"]).collect()}
        exp = {}
        for r, _, k, x in sorted(rows):
            exp[k] = x
        assert last == exp
        # Dense numbers follow _row
        seq = sorted((r._row, r.s) for r in clean.sequence_key(df.select("_row"), "s", width=6).collect())
        assert [s for _, s in seq] == [f"{i + 1:06d}" for i in range(len(rows))]

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from rowsmith.functions.similarity import similar_keys_py
from rowsmith.operators import similar
from rowsmith.operators.components import connected_components

SPELLINGS = ["Parafuso", "parafusos", "Parafuso ", "Porca", "Porcas", "porca", "Arruela", "Arruelas", "Aruela",
             "tide", "diet", "abcdefghij", "abcdefghik", "abcdefghzz", "abcdefgzzz", "pass", "s", "ss",
             "x" * 210, "x" * 209 + "y", "alpha beta", "alpha  beta", "Ça va", "ca va", None, "", "  "]


def _run(spark, values):
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "_row long, v string")
    return [tuple(r) for r in similar.suggestions(df, "v").collect()]


def test_suggestions_match_brute_force(spark):
    assert _run(spark, SPELLINGS) == brute.suggestions(SPELLINGS)


def test_chain_and_ties(spark):
    values = ["abcdefghij", "abcdefghik", "abcdefghkk", "abcdefgkkk"] * 2 + ["bbbb", "bbba", "bbba"]
    assert _run(spark, values) == brute.suggestions(values)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="abcdeé sS", min_size=0, max_size=9), min_size=2, max_size=40))
def test_suggestions_property(spark, values):
    assert _run(spark, values) == brute.suggestions(values)


def test_candidates_lose_no_pair(spark):
    rnd = random.Random(5)
    words = set()
    base = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 25))) for _ in range(40)]
    for w in base:
        words.add(w)
        for _ in range(3):
            i = rnd.randrange(len(w))
            words.add(w[:i] + rnd.choice("abcdefghxyz") + w[i + 1:])
            words.add(w[:i] + w[i + 1:])
    words = sorted(words)
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "_row long, v string")
    _, keys = similar._keys(similar.value_counts(df, "v"))
    cand = {(r.k1, r.k2) for r in similar.candidate_pairs(keys).collect()}
    ks = sorted({brute.sim_key(w) for w in words if brute.sim_key(w)})
    truth = {(a, b) for i, a in enumerate(ks) for b in ks[i + 1:] if similar_keys_py(a, b) or similar_keys_py(b, a)}
    assert truth <= cand
    assert len(cand) < len(ks) * (len(ks) - 1) / 2  # the blocking prunes


def test_components_match_union_find(spark):
    rnd = random.Random(7)
    n = 300
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(220)] + [(i, i + 1) for i in range(100, 160)]
    df = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in edges], "u string, v string")
    got = {r.node: r.component for r in connected_components(df).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(f"{a:04d}"), find(f"{b:04d}")
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = {x for a, b in edges if a != b for x in (f"{a:04d}", f"{b:04d}")}
    groups = {}
    for x in nodes:
        groups.setdefault(find(x), set()).add(x)
    assert set(got) == nodes
    for root, members in groups.items():
        assert {got[m] for m in members} == {min(members)}


def test_value_counts_and_guard(spark):
    df = spark.createDataFrame([(1, " a"), (2, "a "), (3, "b"), (4, None), (5, " ")], "_row long, v string")
    got = sorted(tuple(r) for r in similar.value_counts(df, "v").collect())
    assert got == [("a", 2, 1), ("b", 1, 3)]
    import pytest

    with pytest.raises(similar.TooManyValues):
        similar.suggestions(df, "v", max_distinct=1)
    rep = similar.suggestions_to_replacements(similar.suggestions(
        spark.createDataFrame([(1, "Porca"), (2, "Porcas"), (3, "Porca")], "_row long, v string"), "v"), "v")
    assert [tuple(r) for r in rep.collect()] == [("v", "Porcas", "Porca")]


def test_common_characters_bound_the_ratio_and_spare_calls(spark):
    """Every pair of seven-digit codes that is dropped is dissimilar, and most are dropped before Python."""
    import random

    from rowsmith.functions.similarity import similar_keys_py
    from rowsmith.operators import similar

    r = random.Random(7)
    codes = sorted({"".join(r.choice("0123456789") for _ in range(7)) for _ in range(300)} | {"aab", "aba", "ba", "b"})
    df = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "value string, first_row long").withColumn("n", F.lit(1))
    _, keys = similar._keys(df)
    candidates = similar.candidate_pairs(keys)
    kept = {(x.k1, x.k2) for x in similar.plausible_pairs(candidates, keys).collect()}
    near = {(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if similar_keys_py(a, b) or similar_keys_py(b, a)}
    assert near <= kept and len(kept) < candidates.count() / 5
    assert spark.range(1).select(similar.numbered_characters(F.lit("abaa"))).first()[0] == ["a1", "b1", "a2", "a3"]


def test_deletions_lose_no_pair_and_keep_codes_apart(spark):
    """Seven-digit codes give far less than 1 % of all pairs; variants of all lengths around the border are all found."""
    r = random.Random(11)
    codes = sorted({"".join(r.choice("0123456789") for _ in range(7)) for _ in range(2000)})
    frame = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "value string, first_row long").withColumn("n", F.lit(1))
    _, keys = similar._keys(frame)
    assert similar.blocked_pairs(keys).count() < len(codes) * (len(codes) - 1) / 200

    words = set()
    for n in range(1, 19):
        for _ in range(6):
            w = "".join(r.choice("abcé") for _ in range(n))
            words |= {w, w[::-1], w + r.choice("abxy"), w[1:], w[: n // 2] + "x" + w[n // 2 + 1 :], "x" + w + "y", w[: n // 2] + w[n // 2 + 2 :]}
    words = sorted(w for w in words if w)
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "value string, first_row long").withColumn("n", F.lit(1))
    _, keys = similar._keys(frame)
    found = [(x.k1, x.k2) for x in similar.blocked_pairs(keys).collect()]
    assert len(found) == len(set(found)) and all(a < b for a, b in found)
    ks = sorted({brute.sim_key(w) for w in words if brute.sim_key(w)})
    near = {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if similar_keys_py(a, b) or similar_keys_py(b, a)}
    assert len(near) > 300 and near <= set(found)

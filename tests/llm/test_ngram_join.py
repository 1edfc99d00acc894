"""The n-gram Jaccard join against a comparison of all pairs."""

import random

import numpy as np
import pytest
from llm_cases import ROWS, documents, empty, prose, spaced, LOWER
from pyspark.sql import functions as F

from rowsmith.llm import ngram_join, queries


def shingles(text, size):
    w = spaced((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, percent):
    """doc_id, n_shingles, component_id per row."""
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    names = {}
    for (i, _), c in zip(rows, label):
        names[c] = min([x for x in (names.get(c), i) if x is not None], default=None)
    return sorted(((i, len(s), names[c] if s else i) for (i, _), s, c in zip(rows, sets, label)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def family(seed, n_words, members, edits, start):
    """Copies of one text with some words changed, as ids and texts."""
    r = random.Random(seed)
    base = prose(seed, n_words, 5000).split(" ")
    out = []
    for k in range(members):
        w = list(base)
        for _ in range(edits(k)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append((start + k, " ".join(w)))
    return out


def test_awkward_rows_and_clashing_columns(spark):
    extra = [
        (20, "a b c d e f g h i j k l", "en", "a"), (21, "A B C D E F G H I J K L", "en", "a"), (22, "a b c", "en", "a"), (23, "a b  c", "en", "a"),
        (24, "a b c d", "en", "a"), (None, None, "en", "a"), (25, " ".join(["w"] * 5000), None, None), (26, " ".join(["w"] * 5001), None, None),
        (20, "quite another text with that id", "en", "a"), (None, "a b c d", "en", "a"), (None, "only rows without an id hold this", "en", "a")]
    rows = [*ROWS, *extra]
    docs = documents(spark, rows).withColumns({c: F.lit("clash") for c in ("n", "a", "token", "text_", "x.y", "component", "k", "pos")})
    assert rows_of(ngram_join.similar_classes(docs, size=4, percent=85)) == brute([r[:2] for r in rows], 4, 85)


def test_empty_table(spark):
    assert ngram_join.similar_classes(empty(spark)).count() == 0


@pytest.mark.parametrize("size,percent,most", [(4, 85, 8), (2, 80, 3), (1, 50, 8), (3, 100, 1)])
def test_families_chains_and_shared_passages(spark, monkeypatch, size, percent, most):
    monkeypatch.setattr(ngram_join, "MOST", most)
    monkeypatch.setattr(ngram_join, "STRETCH", 500)
    rows = family(1, 120, 40, lambda k: k % 6, 100) + family(2, 60, 30, lambda k: 1 + k % 2, 200)
    r = random.Random(3)
    chain = prose(9, 80, 5000).split(" ")
    for k in range(25):  # each differs a little from the one before
        chain[r.randrange(len(chain))] = f"c{k}"
        rows.append((300 + k, " ".join(chain)))
    passages = [prose(50 + k, 30, 5000) for k in range(4)]
    for k in range(40):  # texts made of frequent passages only
        rows.append((400 + k, " ".join(r.sample(passages, r.randrange(1, 4)))))
    rows += [(500 + k, passages[0] + " " + prose(100 + k, 4 + k)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(ngram_join.similar_classes(docs, size=size, percent=percent)) == brute(rows, size, percent)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op12_ngram_jaccard_join(spark, sf)) == brute(rows, 4, 85)


def test_prefixes_lengthen_where_lists_are_long():
    n = np.array([40, 40])
    edges = np.array([0, 40, 80])
    rare, frequent = np.zeros(40), np.full(40, 500.0)
    base, k = ngram_join.extensions(n, np.concatenate([rare, frequent]), edges, 85)
    assert base.tolist() == [6, 6] and k[0] == 1 and k[1] > 1
    steep = np.concatenate([np.full(7, 10.0), np.full(33, 1e6)])  # the next tokens are far more frequent
    assert ngram_join.extensions(np.array([40]), steep, np.array([0, 40]), 85)[1].tolist() == [1]


def test_similar_sets_share_as_many_prefix_tokens_as_either_asks_for():
    r = random.Random(5)
    for _ in range(3000):
        n = r.randrange(1, 60)
        x = set(r.sample(range(200), n))
        y = set(x)
        for _ in range(r.randrange(0, 6)):
            y.discard(r.choice(sorted(y or {0})))
            y.add(r.randrange(200))
        percent = r.choice([50, 80, 85, 100])
        if not y or 100 * len(x & y) < percent * len(x | y):
            continue
        need = ngram_join.overlap(len(x), len(y), percent)
        assert len(x & y) >= need >= max(-(-percent * len(x) // 100), -(-percent * len(y) // 100))
        for k in range(1, need + 1):
            a, b = (set(sorted(s)[: len(s) - need + k]) for s in (x, y))
            assert len(a & b) >= k


def test_the_most_frequent_tokens_by_whole_classes(spark, monkeypatch):
    counts = spark.createDataFrame([(t, 2 ** (t % 5) + 1) for t in range(-50, 50)] * 2, "token long, seen long")
    tokens, seen = ngram_join.common_tokens(counts)
    assert len(tokens) == 100 and (np.diff(tokens.astype(object)) > 0).all() and set(seen) == {4, 6, 10, 18, 34}
    monkeypatch.setattr(ngram_join, "COMMON", 45)
    assert set(ngram_join.common_tokens(counts)[1]) == {18, 34}
    monkeypatch.setattr(ngram_join, "COMMON", 5)
    assert len(ngram_join.common_tokens(counts)[0]) == 0


def test_links_found_last_join_the_names_of_classes(spark, monkeypatch):
    calls = []

    def recorded(edges, components=ngram_join.connected_components):
        found = components(edges)
        calls.append(({x for r in edges.select("u", "v").collect() for x in r}, {r["node"]: r["component"] for r in found.collect()}))
        return found

    monkeypatch.setattr(ngram_join, "connected_components", recorded)
    chain, rows, r = prose(9, 80, 5000).split(" "), [], random.Random(3)
    for k in range(30):
        chain[r.randrange(len(chain))] = f"c{k}"
        rows += [(300 - k, " ".join(chain)), (600 + k, " ".join(chain))]
    rows += family(1, 120, 30, lambda k: k % 6, 700)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(ngram_join.similar_classes(docs, size=4, percent=85)) == brute(rows, 4, 85)
    (_, classes), (nodes, _) = calls
    assert nodes and all(classes.get(x, x) == x for x in nodes)  # no member of a class but the one that names it

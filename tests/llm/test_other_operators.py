import gzip
import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import ROWS, documents, empty, spaced
from pyspark.sql import functions as F

from rowsmith.llm import mixing, nra, rollups, warc


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshare the excess by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix_on_awkward_rows(spark):
    pieces, docs = mixing.mix(documents(spark), block=8)
    rows = docs.collect()
    sizes = defaultdict(int)
    for _, t, _, s in ROWS:
        sizes[s] += len(spaced(t))
    want = brute_targets(sizes)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), len(spaced(t))) for i, t, *_ in ROWS)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 8
    assert sum(p["last"] - p["first"] for p in pieces.collect()) == sum(taken.values())
    again = mixing.mix(documents(spark).repartition(3), block=8)[1].collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(empty(spark))[1].collect() == []


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, None: 1000}, {"a": 1, "b": 1, "c": 1, "d": 10_000}, {"a": 5}, {"x": 0}, {"Ä": 7, "a": 9, "": 100, None: 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.capped_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_every_block_is_drawn_before_any_comes_again(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(64)), "en", "a" if i < 30 else "b") for i in range(40)]
    pieces, docs = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    times = defaultdict(int)
    for p in pieces.collect():
        times[p.source, p.block] += 1
    for s in ("a", "b"):
        n = [times[s, k] for k in range(30 if s == "a" else 10)]
        assert max(n) - min(n) <= 1
    assert len({(p.source, p.slot) for p in pieces.collect()}) == sum(times.values())


def test_rollups(spark, tmp):
    cols = ["doc_id", "source", "lang", "text", "op", "seq"]
    schema = "doc_id long, source string, lang string, text string, op string, seq long"
    batches = {
        "1": [(1, "a", "en", "x y", "insert", 1), (2, "a", "en", "x", "insert", 1), (2, "a", "en", "x", "insert", 1), (3, None, None, None, "insert", 1), (None, "a", "en", "n", "insert", 1)],
        "2": [(1, "b", "en", "x y z", "revise", 1), (9, "b", "en", "gone", "delete", 1), (4, "b", "en", "late", "revise", 1), (None, "a", "en", "n", "delete", 1)],
        "3": [(2, "a", "en", None, "delete", 2), (2, "a", "en", "old", "revise", 1), (4, "b", "en", "a b c d", "insert", 1), (4, "b", "en", "a b", "insert", 2)],
        "4": [],
    }
    r = rollups.TokenRollups(spark, f"{tmp}/r")
    assert r.totals().collect() == []
    for k, rows in batches.items():
        df = spark.createDataFrame(rows, schema).select(*cols, F.lit("clash").alias("n0"))
        assert r.apply(k, df)
        assert not r.apply(k, df)
    got = {(x.source, x.lang): (x.docs, x.tokens) for x in r.totals().filter("tokenizer = 'words/1'").collect()}
    assert got == {("b", "en"): (2, 5), (None, None): (1, 0), ("a", "en"): (1, 1)}
    assert {x.tokenizer for x in r.totals().collect()} == {rollups.WORDS, rollups.BPE}
    # a batch that wrote rows and sums but no marker counts for nothing and can come again
    spark.createDataFrame([(7, "z", "z", "words/1", 1, 1)], "doc_id long, source string, lang string, tokenizer string, docs long, tokens long").write.parquet(f"{tmp}/r/rows/5")
    assert {(x.source, x.lang): (x.docs, x.tokens) for x in rollups.TokenRollups(spark, f"{tmp}/r").totals().filter("tokenizer = 'words/1'").collect()} == got
    assert r.apply("5", spark.createDataFrame([(7, "c", "en", "q", "insert", 1)], schema))
    assert r.totals().filter("source = 'c' AND tokenizer = 'words/1'").first().tokens == 1


def brute_warc(rows):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first[h or ""] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def test_warc(spark, tmp):
    from rowsmith.llm import queries

    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" + "é" * 80
    rows = [(10, "http://a", tricky), (9, "http://b\r\nX: y", tricky), (100, None, tricky), (3, "u v", None), (4, "", ""), (5, "z", "short"), (6, "z", "short"),
            (7, "q", "\r\n\r\n\r\n"), (7, "q", "\r\n\r\n\r\n"), (8, "long", "ab " * 60000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("capture", F.lit(0))
    df.write.parquet(f"{tmp}/pages.parquet")
    assert sorted(map(tuple, queries.op8_warc_transactions(spark, tmp).collect()), key=str) == brute_warc(rows)
    for one in warc.captures(df, file_bytes=100_000).collect():
        assert one.request.fields == {} and one.metadata.fields["payloadBytes"].isdigit()
        if one.response.type == "response":
            assert hashlib.sha256(one.response.payload).hexdigest() == one.response.payload_sha256 == one.response.payload_digest.removeprefix("sha256:")
    assert warc.captures(df.limit(0)).collect() == []


def test_warc_rejects_broken_files():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert len(list(warc.parse_records(good * 3))) == 3
    assert list(warc.parse_records(gzip.compress(good) + gzip.compress(good))) == list(warc.parse_records(good * 2))
    for bad in (good[:-8], b"junk\r\n\r\n" + good):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


def brute_top(rows, k):
    """Every row is a candidate of every query row but itself."""
    v = [(i, [math.floor(64 * c) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for no, (q, x) in enumerate(v):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), c) for other, (c, y) in enumerate(v) if other != no)[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,block", [(120, 16), (700, 8192), (5, 4)])
def test_top_k(spark, n, block):
    rng = np.random.default_rng(n)
    rows = [(i, [float(c) for c in np.float32(rng.integers(-3, 4, 6) / 8)]) for i in range(n)]  # many ties
    rows += [(n + 20, None), (n + 21, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (n + 22, [math.nan] * 6), (n + 23, [math.inf] * 6), (3, rows[3][1]), (None, rows[0][1])]
    # ids that repeat with the same vector and with others, among candidates and queries; more copies than are asked for
    rows += [(0, rows[0][1]), (0, rows[1][1]), (1, rows[2][1])] + [(2, [1.0] * 6)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash")).withColumn("part", F.lit("clash"))
    got = nra.top_k(df, df.filter("vec_id % 20 = 0"), k=20, block=block, query_block=4).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 20)
    assert nra.top_k(df.limit(0), df.limit(0)).collect() == []


def test_reading_stops_early_and_stays_exact():
    rng = np.random.default_rng(5)
    v = rng.integers(-40, 40, (3000, 8))
    q = v[:50] * np.array([40, 1, 1, 1, 1, 1, 1, 1])
    rows, cols, scores = nra.top_of_block(v, np.arange(3000), q, np.arange(50), 5)
    full = v @ q.T
    for k in range(50):
        order = [c for c in np.lexsort((np.arange(3000), -full[:, k])) if c != k][:5]
        assert cols[rows == k].tolist() == order and scores[rows == k].tolist() == full[order, k].tolist()


def test_mix_draws_every_slot_of_every_shard_once(spark, monkeypatch):
    """Shards are full, their counts differ by chance, and each source gives its target to the word."""
    import collections

    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    rows = [(i, " ".join(["w"] * (i % 97)), "abcd"[0 if i % 3 == 0 else i % 4]) for i in range(900)] + [(901, "x y z", None), (902, None, "e"), (903, "one", "f")]
    pieces, docs = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16)
    pieces, docs = pieces.collect(), docs.collect()
    taken, want = collections.Counter(), {}
    for r in docs:
        taken[r.source] += r.taken
        want[r.source] = round(r.target)
        assert r.taken <= 3 * r.size
    assert all(taken[s] == want[s] for s in want)
    assert sum(p.last - p.first for p in pieces) == sum(taken.values())
    slots = collections.defaultdict(set)
    for p in pieces:
        slots[p.shard].add((p.slot, p.source, p.block))
    sizes = {k: len(v) for k, v in slots.items()}
    last = max(sizes)
    assert set(sizes) == set(range(last + 1)) and all(sizes[k] == 64 for k in range(last)) and sizes[last] <= 64
    assert all({s for s, _, _ in v} == set(range(len(v))) for v in slots.values())  # a slot holds one block
    assert len({sum(s == "a" for _, s, _ in slots[k]) for k in range(last)}) > 3
    # every block of a source is taken once per whole pass before any is taken once more
    uses = collections.Counter((s, b) for v in slots.values() for _, s, b in v)
    for s in "abcd":
        times = [n for (source, _), n in uses.items() if source == s]
        assert max(times) - min(times) <= 1


def test_permutations_are_whole_even_where_a_multiplier_divides_the_count(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000, 4096):
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(-5).cast("long"))).collect()
        assert sorted(r[0] for r in got) == list(range(n))
    p, n = mixing._PRIMES, mixing._PRIMES[0] * 3
    got = spark.range(4).select(*[mixing._permuted(F.col("id") * mixing._PRIMES[0], F.lit(n).cast("long"), F.lit(4 * k).cast("long")) for k in range(1)]).collect()
    assert len({r[0] for r in got[:3]}) == 3
    assert all(x % d for x in p for d in range(2, 4100))
    assert spark.range(1).select(mixing._permuted(F.lit((1 << 38) - 1), F.lit(1 << 38), F.lit(9).cast("long"))).first()[0] >= 0

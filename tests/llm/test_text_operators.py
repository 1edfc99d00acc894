import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import LOWER, ROWS, alnum, documents, empty, prose, spaced
from pyspark.sql import functions as F

from rowsmith.llm import decontaminate, hyperminhash, secrets, substring
from rowsmith.llm.words import ALNUM, Words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0bé9-_\U0001f600"))))
@settings(max_examples=60, deadline=None)
def test_words_match_the_regular_expressions(texts):
    w = Words(pa.array(texts, pa.string()))
    assert w.counts.tolist() == [len(spaced(t)) for t in texts]
    assert Words(pa.array(texts, pa.string()), ALNUM, lower=True).counts.tolist() == [len(alnum(t)) for t in texts]
    flat = [x for t in texts for x in spaced(t)]
    known = dict(zip(flat, w.hashes().tolist()))
    assert [known[x] for x in flat] == w.hashes().tolist() and len(set(known.values())) == len(known)


def brute_cut(rows, size):
    words = [spaced(t) for _, t in rows]
    seen = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [300, 1 << 22])
@pytest.mark.parametrize("size", [1, 7, 35])
def test_substring_dedup(spark, shard_bytes, size):
    got = substring.remove_repeats(documents(spark), size, shard_bytes=shard_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute_cut([(r[0], r[1]) for r in ROWS], size)
    for r in got:
        assert sum(s["last"] - s["first"] for s in r.removed) == r.n_removed
        assert all(a["last"] < b["first"] for a, b in zip(r.removed, r.removed[1:]))


def test_empty_tables(spark):
    none = empty(spark)
    assert substring.remove_repeats(none).collect() == []
    assert hyperminhash.near_duplicates(none).collect() == []
    assert secrets.find_secrets(none).collect() == []
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, bench).collect() == []
    assert {r.n_hit for r in decontaminate.decontaminate(documents(spark), bench).collect()} == {0}


def shingles(text, size):
    w = spaced((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_classes(rows, size):
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    got = hyperminhash.near_duplicates(documents(spark), size).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == brute_classes([r[:2] for r in ROWS], size)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """One row of each class stays; an id with two texts does not join their classes."""
    import corpus_pipeline

    near, a, b, c, d = prose(21, 100) + " end", prose(21, 100) + " END2", prose(22, 90), prose(23, 60), prose(24, 60)
    rows = [(3, near), (5, a), (5, b), (7, c), (7, c), (7, c), (None, d), (None, d), (None, c), (8, None), (None, ""), (9, prose(25, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "no": F.lit("clash"), "first": F.lit("clash")})
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    want = [(3, near), (5, b), (7, c), (None, d), (8, None), (None, ""), (9, prose(25, 40))]
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text and r.doc_id) == sorted(x for x in want if all(x))
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, want))
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(df).collect()}
    assert {(5, 86, 5, True), (5, 97, 3, False), (3, 97, 3, True), (None, 56, 7, False)} <= got


def test_near_duplicates_over_class_borders(spark):
    """A chain of edits: neighbours are near, ends are not; a hub of many copies; blocks smaller than the group."""
    base = prose(9, 100).split(" ")
    rows = []
    for i in range(40):
        base = list(base)
        base[(i * 7) % 100] = f"new{i}"
        rows.append((100 - i, " ".join(base)))
    rows += [(200 + i, prose(50, 60) + f" tail{i}") for i in range(30)]
    block, hyperminhash.BLOCK = hyperminhash.BLOCK, 8
    try:
        got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    finally:
        hyperminhash.BLOCK = block
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_classes(rows, 2)


def test_estimate_is_collision_corrected():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.8):
        got = []
        for _ in range(30):
            both = rng.integers(0, 2**64, 2000, dtype=np.uint64)
            n = int(2000 * 2 * share / (1 + share))
            a, b = both[:2000], np.concatenate([both[:n], rng.integers(0, 2**64, 2000 - n, dtype=np.uint64)])
            regs = [hyperminhash.registers(np.zeros(2000, np.int64), np.sort(x), 1) for x in (a, b)]
            chance = hyperminhash.collision_rate(np.array([2000.0]))
            got.append(hyperminhash.estimates(regs[0], chance, regs[1], chance)[0][0])
        assert abs(np.mean(got) - share) < 0.03


def test_suffix_array_and_index():
    rng = np.random.default_rng(1)
    for n, letters in ((1, 1), (60, 1), (200, 2), (2000, 30)):
        codes = rng.integers(1, letters + 1, n)
        text = codes.tolist()
        assert decontaminate.suffix_array(codes.astype(np.int64)).tolist() == sorted(range(n), key=lambda i: text[i:])
        index = decontaminate.FMIndex(codes.astype(np.int64))
        patterns = rng.integers(1, letters + 2, (50, 3))
        sizes = rng.integers(1, 4, 50)
        lo, hi = index.search(np.minimum(patterns, letters), sizes)
        for k in range(50):
            want = [i for i in range(n) if text[i : i + sizes[k]] == np.minimum(patterns, letters)[k, : sizes[k]].tolist()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


@pytest.mark.parametrize("piece_bytes,shard_bytes", [(1 << 23, 1 << 22), (60, 200)])
def test_decontamination(spark, piece_bytes, shard_bytes):
    items = [(1, " ".join(spaced(ROWS[6][1])[20:45])), (2, "same SAME same"), (3, "one"), (4, None), (5, "- -"), (6, " ".join(spaced(ROWS[0][1])[5990:])), (1, "one"), (None, "one"), (None, "\U0001f600 tab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])] |= {str(i)} - {"None"}  # an item without id hits, but has no name
    want = []
    for i, t, *_ in ROWS:
        w = alnum(t)
        hit, found = [False] * len(w), set()
        for x, owners in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit[k : k + len(x)] = [True] * len(x)
                    found |= owners
        want.append((str(i), len(w), sum(hit), sorted(found)))
    got = decontaminate.decontaminate(documents(spark), bench, piece_bytes=piece_bytes, shard_bytes=shard_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(want)
    texts = {r.row.doc_id: r for r in got}
    assert texts[2].clean is None and texts[7].row.spans == "clash"
    assert alnum(texts[7].clean) == [x for k, x in enumerate(alnum(ROWS[6][1])) if not any(s["first"] <= k < s["last"] for s in texts[7].spans)]


def test_secrets(spark):
    key = "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9"
    texts = {
        1: ("password = 'abcdefghijkl'", "assign:0:24"),
        2: ("éé API_key:shortvalue Token=" + "x" * 12, "assign:22:40"),
        3: ("secret: token: abcdefghijklmnop", ""),
        4: ("AKIA" + "A" * 14 + " AKIA123", "access:0:18"),
        5: ("0123456789abcdef 0123456789abcde", "hex:0:16"),
        6: (f"\U0001f600 {key}.", "entropy:2:29"),
        7: ("Donaudampfschifffahrtsgesellschaft this-is-just-a-long-name 4111111111111111222222", "hex:60:82"),
        8: (f"token={key}", f"assign:0:{6 + len(key)}"),
        9: ("123e4567-e89b-12d3-a456-426614174000", ""),
        10: (None, ""),
        11: ("", ""),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("base", F.lit(1))
    found = secrets.find_secrets(df)
    got = found.select("row.doc_id", secrets.labels(F.col("spans")).alias("s"), secrets.redacted(F.col("row.text"), F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.s for r in got} == {k: s for k, (_, s) in texts.items()}
    clean = {r.doc_id: r.t for r in got}
    assert clean[1] == "[SECRET]'" and clean[6] == "\U0001f600 [SECRET]." and clean[10] is None and clean[3] == texts[3][0]


def _entropy(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secrets.find_secrets(df).select("row.doc_id", secrets.labels(F.col("spans")).alias("s"), secrets.redacted(F.col("row.text"), F.col("spans")).alias("t")).collect()
    return [(r.s, r.t) for r in sorted(got, key=lambda r: r.doc_id)]


def test_secrets_behind_names_and_paths(spark):
    """Each window has the threshold of its own class, and the whole run of the class is reported."""
    hexes = "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"
    lower = "q7x2m9k4v8w3z6p1r5t0y2b7n4c9d6f1"
    tail = "aB3dE5fG7hJ9kL1mN3pQ" + "Z" * 15  # only the beginning is dense
    texts = [f"key_id={hexes}", f"a/{hexes}", f"a/{lower}", f"key {tail}", f"x/{hexes}/y/{lower}", f"zz{hexes}zz", "src/main/java/org/apache/spark/sql"]
    got = _entropy(spark, texts)
    for text, (_, clean) in zip(texts[:-1], got):
        assert "[SECRET]" in clean
        assert all(part not in clean for key in (hexes, lower, tail) for part in (key[:6], key[-6:])), text
    assert got[-1] == ("", texts[-1])


def test_secrets_of_letters_and_beside_examples(spark):
    letters, key = "qZxKvBnMwRtYpLsDfGhJ", "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9"
    joined = "qZxKvBnMwR+tYpLsDfGhJcVu=="
    dashed = "aB3dE5fG7h-J9kL1mN3pQ-5rS7tU9wX"
    secret = [letters, f"a/{letters}", f"id={letters}", joined, f"api/example/live/{key}", f"sample={letters}", f"my-dummy/{dashed}", f"{dashed}/example"]
    words = ["Donaudampfschifffahrtsgesellschaft", "src/main/java/org/apache/spark/sql", "rounding=ROUND_HALF_EVEN", "kIoSfOdNn7EXAMPLE1234567Qz",
             "123e4567-e89b-12d3-a456-426614174000", "2024-01-31_23-59-59_000000"]
    got = _entropy(spark, secret + words)
    for text, (_, clean) in zip(secret, got):
        assert "[SECRET]" in clean and not any(part in clean for k in (letters, key, joined, dashed) for part in (k[:6], k[-6:])), text
    assert [clean for _, clean in got[len(secret) :]] == words


def brute_secrets(text):
    """Base spans and all spans, every window counted anew."""
    base = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text, re.A) if len(m[2]) >= 12]
    base += [(m.start(), kind, m.end()) for kind, p in ((1, secrets.ACCESS), (2, secrets.HEX)) for m in re.finditer(p, text)]
    runs = set()
    for c in re.finditer(secrets.CANDIDATE, text):
        shown = re.sub(secrets.EXAMPLE, lambda m: " " * len(m[0]), c[0])
        for m in (m for p in secrets.RUNS for m in re.finditer(p, shown)):
            least = next(bits for p, bits in secrets.CLASSES if re.search(p, m[0]))
            bits = 0.0
            for k in range(len(m[0]) - 19):
                share = [n / 20 for n in Counter(m[0][k : k + 20]).values()]
                bits = max(bits, -sum(x * math.log2(x) for x in share))
            if len(m[0]) >= 20 and bits >= least - 1e-9 and not any(re.search(p, m[0]) for p in secrets.ALLOW):
                runs.add((c.start() + m.start(), 3, c.start() + m.end()))
    known = base + list(runs)
    alone = [r for r in runs if not any(o != r and o[0] <= r[0] and r[2] <= o[2] for o in known)]
    return sorted(base), sorted(base + alone)


def brute_redacted(text, spans):
    out, at = "", 0
    for start, _, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def _scanned(spark, texts):
    found = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8))
    rows = found.select("row.doc_id", "base", "spans", secrets.redacted(F.col("row.text"), F.col("spans")).alias("clean")).collect()
    return [r for r in sorted(rows, key=lambda r: r.doc_id)]


def test_secrets_equal_brute_force(spark):
    r = random.Random(5)
    parts = ["0123456789abcdef", "ABCDEF", "abcXYZ019", "ghijkl", "+/_=-", " ", "é😀 ", "example", "password=", "token: '", "AKIA", "\n.", "q7x2m9k4v8w3z6p1r5t0", "aB3dE5fG7hJ9kL1mN3pQ"]
    texts = []
    for k in range(400):
        chosen = r.sample(parts, r.randint(2, 6))
        texts.append("".join(r.choice(chosen) if r.random() < 0.3 else "".join(r.choice(x := r.choice(chosen)) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 40))))
    # borders of pieces and chunks: the one dense window at every place, more matches than a chunk holds
    texts += ["ab" * (110 + k // 2) + "a" * (k % 2) + "q7x2m9k4v8w3z6p1r5t0" + "ab" * 130 for k in range(40)]
    texts += [" ".join(f"{n:016x}" for n in range(m)) for m in (255, 256, 257, 600)]
    texts += ["é" + "-".join(f"{r.getrandbits(96):024x}G" for _ in range(300)), "AKIA" + "password=0123456789abcdef" * 300]
    for text, got in zip(texts, _scanned(spark, texts)):
        base, spans = brute_secrets(text)
        assert [tuple(s) for s in got.base] == base and [tuple(s) for s in got.spans] == spans, text
        assert got.clean == brute_redacted(text, spans)


def test_time_of_secret_scans_follows_the_text(spark):
    """An unbroken run without a dense window, one whose last window is dense, and a text of matches, of 1 MB each."""
    n = 1_000_000
    tail = "q7x2m9k4v8w3z6p1r5t0"
    texts = ["xy" * (n // 2), "xy" * (n // 2) + tail, " ".join(f"{k:016x}" for k in range(n // 17))]
    _scanned(spark, ["x"])
    for text, want in zip(texts, ([], [(0, 3, n + 20)], [(17 * k, 2, 17 * k + 16) for k in range(n // 17)])):
        started = time.monotonic()
        (got,) = _scanned(spark, [text])
        assert time.monotonic() - started < 20
        assert [tuple(s) for s in got.spans] == want and got.clean == brute_redacted(text, want)


def test_digests_of_the_queries(spark):
    from rowsmith.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op4_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    for i, _, n, kept in [(int(a), b, c, d) for a, b, c, d in brute_cut(list(docs.items()), 35)]:
        assert got[i].n_removed == n and got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()

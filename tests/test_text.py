import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from rowsmith.functions import text as T
from rowsmith.sources.xlsx import col_name

SAMPLES = [
    None, "", "   ", "Café", "CAFE", "café", "  Straße ", "STRASSE", "ﬁne", "a b", "a  b",
    "\x1cx\x1f", "İstanbul", "pass", "Passes  ", "ǅ", "x s", "ss", "s", "Ⅻ", "①",
]


def _py_lookup(v, trim=True):
    if v is None:
        return ""
    t = str(v)
    return (t.strip() if trim else t).casefold()


def test_keys_match_python_formulas(spark):
    df = spark.createDataFrame([(v,) for v in SAMPLES], "v string")
    rows = df.select("v", T.duplicate_key("v").alias("d"), T.similarity_key("v").alias("s"),
                     T.lookup_key("v").alias("l"), T.lookup_key("v", trim=False).alias("l2")).collect()
    for r in rows:
        assert r.d == brute.dup_key(r.v), r.v
        assert r.s == ("" if r.v is None else brute.sim_key(r.v)), r.v
        assert r.l == _py_lookup(r.v), r.v
        assert r.l2 == _py_lookup(r.v, trim=False), r.v


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=12), min_size=1, max_size=20))
def test_keys_property(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: (r.d, r.s, r.st) for r in df.select("i", T.duplicate_key("v").alias("d"), T.similarity_key("v").alias("s"),
                                                      T.strip_text("v").alias("st")).collect()}
    for i, v in enumerate(values):
        assert got[i] == (brute.dup_key(v), brute.sim_key(v), v.strip())


def test_blank_and_mark_sets_follow_python():
    assert set(T.blank_chars()) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert all(unicodedata.combining(c) for c in T.combining_chars())
    assert len(T.blank_chars()) == 29


def test_is_empty_and_null_tokens(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t",), ("x",), ("NA",), ("#N/A",), ("n/a ",)], "v string")
    r = df.select(T.is_empty("v").alias("e"), T.null_tokens("v").alias("n")).collect()
    assert [x.e for x in r] == [True, True, True, False, False, False, False]
    assert [x.n for x in r] == [None, None, " \t", "x", None, None, "n/a "]


def test_column_labels(spark):
    ns = [1, 2, 26, 27, 52, 53, 702, 703, 16384, 18278, 18279, 475254]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = [r.l for r in df.select(T.column_label("n").alias("l")).collect()]
    assert got == [col_name(n) for n in ns]
    assert got[8] == "XFD"


def test_report_helpers(spark):
    df = spark.createDataFrame([("x" * 41, ["a", "b", "c", "d", "e", "f", "g"], "a b/c\\d")], "v string, a array<string>, p string")
    r = df.select(T.value_preview("v").alias("p"), T.compact_list("a").alias("c"), T.slug("p").alias("s"),
                  T.compact_list(F.slice("a", 1, 2)).alias("c2")).first()
    assert r.p == "x" * 37 + "..."
    assert r.c == "a, b, c, d +3"
    assert r.c2 == "a, b"
    assert r.s == "a_b_c_d"
    emoji = spark.createDataFrame([("🙂" * 11,)], "v string").select(T.text_length("v")).first()[0]
    assert emoji == 11

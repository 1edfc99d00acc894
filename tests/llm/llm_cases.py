"""Awkward documents for every operator, and plain-Python counterparts of the word classes."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}é" if r.random() < 0.2 else f"Word{r.randrange(vocabulary)}" for _ in range(n))


_LONG = prose(1, 6000)
_BASE = prose(2, 120).split(" ")
ROWS = [
    (1, _LONG, "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \t\n ", "fr", None),
    (5, "one", "fr", None),
    (6, "one", "fr", "b"),
    (7, " ".join(_BASE), "de", "c"),
    (8, " ".join(_BASE), "de", "c"),
    (9, " ".join([*_BASE[:60], "changed", *_BASE[61:]]), "de", "c"),
    (10, " ".join(_BASE[:40]) + "\n" + prose(3, 50), "de", "c"),
    (11, prose(4, 90), "es", "Ä"),
    (11, prose(4, 90), "es", "Ä"),
    (None, prose(5, 30), "es", "b"),
    (12, "same same " * 40, "en", "b"),
    (13, "ONE", "en", ""),
    (14, "\U0001f600 tab\tand\x0bmore\x1fx \xa0y", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns that operators use inside.
CLASHING = ["row", "shard", "key", "spans", "items", "score", "rep", "block", "n_words", "__x", "a.b", "row.doc_id"]


def documents(spark, rows=ROWS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def empty(spark):
    return documents(spark).limit(0)

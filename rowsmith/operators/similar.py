"""Similar spellings and one canonical form per group.

Plan, all distributed:

1. A2 ``value_counts``: stripped non-empty text -> count and first row.
2. Values are grouped by their similarity key (T3).  Equal keys are similar
   by definition, so work continues on distinct keys.
3. J3 candidate pairs of keys, no pair lost, in two ways by the shorter key.
   Up to ``SHORT`` characters: similar keys of lengths a and b match at least
   m(a, b) characters in order, so deleting a - m from the one and b - m from
   the other can leave the same text; keys meet on these texts, per pair of
   lengths, with at most two deletions each. Keys that meet share m characters
   in order, so codes do not meet by a few common digits.
   Longer ones by prefix-filtered bigram blocking:
   a similar pair with M matched characters in B <= U+1 matching blocks
   (U = unmatched characters) shares at least ``t = 3M - (a+b) - 1`` bigram
   occurrences.  Occurrences are numbered (gram, k) so multisets become
   sets, every token gets a global rank (rarest first), and each key indexes
   only its ``size - t + 1`` rarest tokens; two keys sharing >= t tokens
   must share a prefix token.  With t <= 1 every token is indexed (any
   similar unequal pair shares a bigram).  No pair is lost and hot bigrams
   rarely enter a prefix.
4. T4 on candidates only, in the orientation(s) that occur in first-seen
   order (the ratio is not symmetric, Q9).  Matching blocks cannot match more
   characters than the two keys have in common as multisets, in any order:
   pairs whose ratio stays too small even then never reach Python.
5. A4 connected components over similar keys; A5 canonical per group;
   L1 order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.functions.similarity import length_window, similar_from_ratio, sm_ratio
from rowsmith.functions.text import casefold, similarity_key, strip_text
from rowsmith.operators.common import qcol, require_columns
from rowsmith.operators.components import connected_components, written_table
from rowsmith.session import checkpoint_dir

ROW = "_row"


class TooManyValues(ValueError):
    pass


def value_counts(df: DataFrame, column: str, *, row_col: str = ROW) -> DataFrame:
    """A2: ``value, n, first_row`` of the non-empty stripped texts."""
    require_columns(df, [column, row_col])
    v = strip_text(qcol(column).cast("string"))
    d = df.select(v.alias("value"), qcol(row_col).alias("__r")).filter(F.col("value").isNotNull() & (F.col("value") != ""))
    return d.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("__r").alias("first_row"))


def _keys(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    vals = counts.withColumn("k", similarity_key("value"))
    keys = (
        vals.filter(F.col("k") != "")
        .groupBy("k")
        .agg(F.min("first_row").alias("kmin"), F.max("first_row").alias("kmax"))
        .withColumn("klen", F.length("k"))
    )
    return vals, keys


def _bound_t(a: F.Column) -> F.Column:
    """Lower bound of shared bigram occurrences for a key of length ``a``.

    Minimum over all partner lengths the predicate allows: near case
    (gap <= 1, ratio >= 0.82, sum >= 2a-1) and far case (ratio >= 0.9,
    partner >= ceil(9a/11)); t >= (1.5 r - 1)(a+b) - 1.
    """
    # floor() keeps the bound safe against float rounding: a smaller t only
    # lengthens the prefix.
    near = F.floor(F.lit(23) * (2 * a - 1) / 100 - 1)
    far = F.floor(F.lit(7) * (a + F.floor(9 * a / 11)) / 20 - 1)
    return F.least(near, far).cast("long")


SHORT = 12  # longest shorter key of a pair that is found by deletions
_LONGEST = SHORT * 11 // 9 + 1  # no partner of such a key is longer


def least_matched(a: int, b: int) -> int | None:
    """Fewest matched characters of similar keys of ``a`` and ``b`` characters; None where no such keys are similar."""
    m = -(-41 * (a + b) // 100) if abs(a - b) <= 1 else -(-9 * (a + b) // 20)
    return m if m <= min(a, b) else None


def _deleted(texts: F.Column, start: F.Column) -> F.Column:
    """The texts that deleting one character, not before the ``start``-th, leaves."""
    return F.transform(F.sequence(start, F.length(texts)), lambda i: F.concat(F.substring(texts, F.lit(1), i - 1), F.substring(texts, i + 1, F.length(texts))))


def deletion_pairs(keys: DataFrame) -> DataFrame:
    """J3 for keys up to ``SHORT`` characters and their partners: ``k1 < k2`` pairs with enough characters in order, each once."""
    partners = []
    for a in range(1, _LONGEST + 1):
        found = [(b, least_matched(a, b)) for b in range(1, _LONGEST + 1) if min(a, b) <= SHORT]
        partners.append(F.array(*[F.struct(F.lit(min(a, b)).alias("lo"), F.lit(max(a, b)).alias("hi"), F.lit(a - m).alias("gone")) for b, m in found if m is not None]))
    k = F.col("k")
    once = _deleted(k, F.lit(1))
    # the second deletion takes a character behind the first one
    twice = F.flatten(F.transform(F.sequence(F.lit(1), F.col("klen") - 1), lambda i: _deleted(F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))), i)))
    left = [F.array(k), F.array_distinct(once), F.when(F.col("klen") > 2, F.array_distinct(twice))]
    kinds = keys.filter(F.col("klen") <= _LONGEST).select("k", "klen", "kmin", "kmax", F.explode(F.element_at(F.array(*partners), F.col("klen"))).alias("p"))
    marked = kinds.select("k", "klen", "kmin", "kmax", "p.lo", "p.hi", F.explode(F.when(F.col("p.gone") == 0, left[0]).when(F.col("p.gone") == 1, left[1]).otherwise(left[2])).alias("left"))
    one, two = (
        marked.filter(F.col("klen") == F.col(end)).select(F.col("k").alias(f"k{n}"), F.col("klen").alias(f"l{n}"), F.col("kmin").alias(f"min{n}"), F.col("kmax").alias(f"max{n}"), "lo", "hi", "left")
        for n, end in ((1, "lo"), (2, "hi")))
    met = one.join(two, ["lo", "hi", "left"]).filter((F.col("lo") < F.col("hi")) | (F.col("k1") < F.col("k2")))
    behind = F.col("k1") > F.col("k2")
    return met.select(*[
        F.when(behind, F.col(c + other)).otherwise(F.col(c + n)).alias(c + n) for n, other in ("12", "21") for c in ("k", "l", "min", "max")]).distinct()


def blocked_pairs(keys: DataFrame) -> DataFrame:
    """The pairs of keys that may be similar, by deletions up to ``SHORT`` characters and by bigrams beyond."""
    long = candidate_pairs(keys.filter(F.col("klen") > SHORT))
    return deletion_pairs(keys).select(*long.columns).unionByName(long)


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """``k1 < k2`` key pairs that may be similar (a superset of the true pairs), by bigrams.

    Carries each key's length and first/last row through the token stages,
    so no join back to the key table is needed.
    """
    meta = ["klen", "kmin", "kmax"]
    k = keys.filter(F.col("klen") >= 2)
    grams = k.select("k", *meta, F.explode(F.sequence(F.lit(1), F.col("klen") - 1)).alias("pos")).select(
        "k", *meta, F.substring(F.col("k"), F.col("pos"), 2).alias("gram")
    )
    per = grams.groupBy("k", *meta, "gram").agg(F.count(F.lit(1)).alias("cnt"))
    tokens = per.select("k", *meta, "gram", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int"))).alias("occ"))
    freq = tokens.groupBy("gram", "occ").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(freq, ["gram", "occ"])
    size = F.col("klen") - 1
    t = _bound_t(F.col("klen"))
    p = F.when(t <= 1, size).otherwise(F.greatest(F.least(size - t + 1, size), F.lit(1)))
    w = Window.partitionBy("k").orderBy("df", "gram", "occ")
    prefix = ranked.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= p).drop("__rank", "df")
    a = prefix.select(F.col("k").alias("k1"), F.col("klen").alias("l1"), F.col("kmin").alias("min1"), F.col("kmax").alias("max1"), "gram", "occ")
    b = prefix.select(F.col("k").alias("k2"), F.col("klen").alias("l2"), F.col("kmin").alias("min2"), F.col("kmax").alias("max2"), "gram", "occ")
    pairs = a.join(b, ["gram", "occ"]).filter((F.col("k1") < F.col("k2")) & length_window(F.col("l1"), F.col("l2")))
    return pairs.drop("gram", "occ").distinct()


def numbered_characters(key) -> F.Column:
    """The characters of a key, each with the number of its occurrence: a multiset as a set."""
    chars = F.split(key, "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c)).cast("string")))


def plausible_pairs(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """The candidates whose common characters allow a sufficient ratio (2 * common / both lengths bounds it)."""
    used = candidates.select(F.col("k1").alias("k")).union(candidates.select("k2")).distinct()
    chars = keys.select("k").join(used, "k").withColumn("chars", numbered_characters(F.col("k")))
    one = candidates.join(chars.select(F.col("k").alias("k1"), F.col("chars").alias("c1")), "k1")
    both = one.join(chars.select(F.col("k").alias("k2"), F.col("chars").alias("c2")), "k2")
    bound = 2.0 * F.size(F.array_intersect("c1", "c2")) / (F.col("l1") + F.col("l2"))
    return both.filter(similar_from_ratio(bound, F.col("l1"), F.col("l2"))).drop("c1", "c2")


def similar_key_edges(keys: DataFrame) -> DataFrame:
    """Similar key pairs ``u < v`` (T4 in every orientation that occurs).

    Keys and candidates are read several times, so each is written once to the checkpoint folder.
    """
    base = f"{checkpoint_dir(keys.sparkSession).rstrip('/')}/rowsmith-similar-{uuid.uuid4().hex}"
    keys = written_table(keys, f"{base}/keys")
    c = plausible_pairs(written_table(blocked_pairs(keys), f"{base}/pairs"), keys)
    # value of k1 seen before a value of k2 -> ratio(k1, k2); and the reverse.
    fwd = c.filter(F.col("min1") < F.col("max2")).select(F.col("k1").alias("left"), F.col("k2").alias("right"), "k1", "k2", "l1", "l2")
    bwd = c.filter(F.col("min2") < F.col("max1")).select(F.col("k2").alias("left"), F.col("k1").alias("right"), "k1", "k2", "l1", "l2")
    both = fwd.unionByName(bwd).withColumn("ratio", sm_ratio("left", "right"))
    hits = both.filter(similar_from_ratio(F.col("ratio"), F.col("l1"), F.col("l2")))
    return hits.select(F.col("k1").alias("u"), F.col("k2").alias("v")).distinct()


def similarity_groups(counts: DataFrame) -> DataFrame:
    """A4: ``value, n, first_row, group`` -- group label for every counted value.

    Values with an empty key are never similar and keep their own group.
    """
    vals, keys = _keys(counts)
    edges = similar_key_edges(keys)
    comp = connected_components(edges)
    labelled = vals.join(comp.select(F.col("node").alias("k"), "component"), "k", "left")
    group = F.when(F.col("k") == "", F.concat(F.lit("\u0000"), F.col("value"))).otherwise(F.coalesce("component", "k"))
    return labelled.select("value", "n", "first_row", group.alias("group"))


def suggestions(df: DataFrame, column: str, *, row_col: str = ROW, max_distinct: int | None = None, ordered: bool = True) -> DataFrame:
    """A2 -> J3 -> T4 -> A4 -> A5 -> L1: ``value, canonical, n``.

    One row per member of a group of 2+ values that is not the group's
    canonical value (highest count, then longest, then smallest text).
    ``max_distinct`` restores the reference's guard (it refused more than
    800 distinct values); by default there is no limit.
    """
    counts = value_counts(df, column, row_col=row_col)
    if max_distinct is not None:
        nd = counts.count()
        if nd > max_distinct:
            raise TooManyValues(f"{nd} distinct values (limit {max_distinct})")
    groups = similarity_groups(counts)
    best = F.struct((-F.col("n")).alias("a"), (-F.length("value")).alias("b"), F.col("value").alias("c"))
    canon = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min_by("value", best).alias("canonical"))
    canon = canon.filter(F.col("size") > 1)
    out = groups.join(canon, "group").filter(F.col("value") != F.col("canonical")).select("value", "canonical", "n")
    if not ordered:
        return out
    keyed = out.withColumn("__c", casefold("canonical")).withColumn("__v", casefold("value"))
    return keyed.orderBy("__c", "__v").drop("__c", "__v")


def suggestions_to_replacements(sugg: DataFrame, column: str) -> DataFrame:
    """Accepted suggestions as a long replacement frame ``column, source, target`` (feeds P5, K5)."""
    return sugg.select(F.lit(column).alias("column"), F.col("value").alias("source"), F.col("canonical").alias("target"))

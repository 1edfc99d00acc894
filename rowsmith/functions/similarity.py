"""T4: the similar predicate on similarity keys.

Spark has no Ratcliff-Obershelp ratio, so the ratio is an Arrow-batched
``pandas_udf`` around ``difflib.SequenceMatcher``.  It only ever sees the
candidate pairs produced by the blocked join in
``rowsmith.operators.similar`` (never all pairs), and the cheap conditions
(empty keys, equal keys, length window) are decided JVM-side first.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from rowsmith.functions.text import SIMILAR_NEAR_GAP, SIMILAR_RATIO, SIMILAR_RATIO_NEAR


def ratio_py(left: str, right: str) -> float:
    """``SequenceMatcher(None, left, right).ratio()`` (order matters)."""
    return SequenceMatcher(None, left, right).ratio()


def similar_keys_py(left: str, right: str) -> bool:
    """Plain-Python form of the predicate on two similarity keys."""
    if not left or not right:
        return False
    if left == right:
        return True
    r = ratio_py(left, right)
    if r >= SIMILAR_RATIO:
        return True
    return abs(len(left) - len(right)) <= SIMILAR_NEAR_GAP and r >= SIMILAR_RATIO_NEAR


@pandas_udf(T.DoubleType())
def sm_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Vectorised over Arrow batches; one ``SequenceMatcher`` per pair."""
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else None for a, b in zip(left, right)],
        dtype="float64",
    )


def length_window(len_a, len_b) -> Column:
    """Necessary length condition of the predicate.

    ratio = 2M/(a+b) <= 2*min/(a+b), so ratio >= 0.9 needs min/max >= 9/11;
    otherwise the length gap must be <= 1.
    """
    lo = F.least(len_a, len_b)
    hi = F.greatest(len_a, len_b)
    return ((hi - lo) <= SIMILAR_NEAR_GAP) | (lo * 11 >= hi * 9)


def similar_from_ratio(ratio: Column, len_a, len_b) -> Column:
    gap = F.abs(len_a - len_b)
    return (ratio >= SIMILAR_RATIO) | ((gap <= SIMILAR_NEAR_GAP) & (ratio >= SIMILAR_RATIO_NEAR))


def similar(left_key, right_key) -> Column:
    """T4 as a Column: ``left_key``/``right_key`` are similarity keys."""
    a = F.col(left_key) if isinstance(left_key, str) else left_key
    b = F.col(right_key) if isinstance(right_key, str) else right_key
    la, lb = F.length(a), F.length(b)
    nonempty = (a != "") & (b != "")
    return (
        F.when(~nonempty, F.lit(False))
        .when(a == b, F.lit(True))
        .when(~length_window(la, lb), F.lit(False))
        .otherwise(F.coalesce(similar_from_ratio(sm_ratio(a, b), la, lb), F.lit(False)))
    )

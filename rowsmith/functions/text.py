"""Text keys and small text functions as JVM-side ``Column`` expressions.

No Python runs per row here: blanks and combining marks are handled with
``translate``/``trim(BOTH chars FROM s)`` (hash lookups per character), NFKD
and Unicode case folding come from the ICU4J classes that ship with Spark
(called through ``reflect``).

``reflect`` is non-deterministic to Catalyst, so callers materialise keys with
``withColumn`` (a Project) before they group, join or filter on them, and
compute them after the selective filters so pushdown is not blocked.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Character classes built from a rule (Python's own definitions), not typed in.
# ---------------------------------------------------------------------------


@functools.lru_cache(maxsize=None)
def blank_chars() -> str:
    """Every code point Python's ``str.split()``/``str.strip()`` treat as blank."""
    return "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def _ranges(codepoints: Iterable[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in codepoints:
        if out and cp == out[-1][1] + 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def _java_class(ranges: list[tuple[int, int]]) -> str:
    parts = []
    for lo, hi in ranges:
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "[" + "".join(parts) + "]"


@functools.lru_cache(maxsize=None)
def blank_class() -> str:
    """Java/RE2 regex class of ``blank_chars()``."""
    return _java_class(_ranges(ord(c) for c in blank_chars()))


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------

# Texts read as missing by the default NA handling of the
# pandas CSV/Excel readers the reference relies on (public pandas docs).
DEFAULT_NULL_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Similarity thresholds of the reference.
SIMILAR_RATIO = 0.9
SIMILAR_RATIO_NEAR = 0.82
SIMILAR_NEAR_GAP = 1

# Text preview limits of violation reports.
PREVIEW_MAX = 40
PREVIEW_KEEP = 37


def _c(c) -> Column:
    """A column by exact name: sheet headers may hold dots (``name.1``) or blanks."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Blank handling
# ---------------------------------------------------------------------------


def strip_text(c) -> Column:
    """``str.strip()``: remove all Unicode blanks at both ends."""
    return F.trim(_c(c), F.lit(blank_chars()))


def collapse_blanks(c) -> Column:
    """``" ".join(s.split())``: blank runs become one space, ends stripped.

    Every blank is first mapped to a space by ``translate`` (hash lookup per
    character), so the regex only squeezes runs of one literal character.
    """
    others = blank_chars().replace(" ", "")
    spaced = F.translate(_c(c), others, " " * len(others))
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def is_empty(c) -> Column:
    """Null, or text that is blank after stripping (NaN handled by callers)."""
    col = _c(c)
    return col.isNull() | (strip_text(col.cast("string")) == F.lit(""))


def null_tokens(c, tokens: Sequence[str] = DEFAULT_NULL_TOKENS) -> Column:
    """Cells holding one of ``tokens`` exactly become NULL."""
    col = _c(c)
    return F.when(col.isin(list(tokens)), F.lit(None).cast("string")).otherwise(col)


# ---------------------------------------------------------------------------
# Unicode keys (JVM only)
# ---------------------------------------------------------------------------


def nfkd(c) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), _c(c), F.lit(True))


def casefold(c) -> Column:
    """Full Unicode case folding (``str.casefold``), e.g. ``ß`` -> ``ss``."""
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _c(c), F.lit(True))


@functools.lru_cache(maxsize=None)
def combining_chars() -> str:
    """Every code point with a non-zero combining class, as one string."""
    return "".join(chr(cp) for cp in range(0x110000) if unicodedata.combining(chr(cp)))


def drop_marks(c) -> Column:
    """Delete combining marks.

    ``translate`` with an empty replacement deletes every listed character
    through a hash lookup per character; a regex class of 192 ranges costs
    a range scan per character and was ~40x slower on long texts.
    """
    return F.translate(_c(c), combining_chars(), "")


def lookup_key(c, trim: bool = True) -> Column:
    """Null -> ``""``; text; stripped if ``trim``; case-folded."""
    s = F.coalesce(_c(c).cast("string"), F.lit(""))
    if trim:
        s = strip_text(s)
    return casefold(s)


def duplicate_key(c) -> Column:
    """Null -> ``""``; blanks collapsed; NFKD; marks dropped; case-folded."""
    s = collapse_blanks(F.coalesce(_c(c).cast("string"), F.lit("")))
    return casefold(drop_marks(nfkd(s)))


def similarity_key(c) -> Column:
    """As T2, but trailing ``s``/``S`` removed right after collapsing."""
    s = collapse_blanks(F.coalesce(_c(c).cast("string"), F.lit("")))
    s = F.regexp_replace(s, "[sS]+$", "")
    return casefold(drop_marks(nfkd(s)))


# ---------------------------------------------------------------------------
# Report helpers
# ---------------------------------------------------------------------------


def value_preview(c, max_len: int = PREVIEW_MAX, keep: int = PREVIEW_KEEP) -> Column:
    """Longer than ``max_len`` -> first ``keep`` characters + ``...``."""
    s = _c(c).cast("string")
    return F.when(F.length(s) <= max_len, s).otherwise(F.concat(F.substring(s, 1, keep), F.lit("...")))


def compact_list(arr, limit: int = 4) -> Column:
    """``a, b, c, d +3`` from an array column; ``--`` when empty."""
    a = _c(arr)
    head = F.array_join(F.slice(a, 1, limit), ", ")
    return (
        F.when(F.size(a) <= 0, F.lit("--"))
        .when(F.size(a) <= limit, head)
        .otherwise(F.concat(head, F.lit(" +"), (F.size(a) - limit).cast("string")))
    )


def slug(c) -> Column:
    """``/``, ``\\`` and blank become ``_`` (for folder names)."""
    return F.translate(_c(c), "/\\ ", "___")


# Digits that cover every positive bigint: 26 + ... + 26^14 > 2^63.
_LABEL_DIGITS = 14


def column_label(n) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA (bijective base 26), for every positive bigint.

    Digit k (from the right) exists when n > S_k = 26 + ... + 26^k and is
    ((n - S_k - 1) div 26^k) mod 26, so every digit is computed directly
    (no nesting).
    """
    num = _c(n).cast("long")
    out = F.lit("")
    s_k = 0
    for k in range(_LABEL_DIGITS):
        p = 26**k
        digit = F.pmod(F.call_function("div", num - F.lit(s_k + 1).cast("long"), F.lit(p).cast("long")), F.lit(26))
        out = F.concat(F.when(num > s_k, F.char(digit + 65)).otherwise(F.lit("")), out)
        s_k += 26 ** (k + 1)
    return F.when(num > 0, out)


def text_length(c) -> Column:
    """Length in code points (``len(str(v))``)."""
    return F.length(_c(c).cast("string"))

"""Secret scans in DataFrame functions: patterns, and sliding-window entropy over the runs of each
character class in candidate strings: a window is judged by the narrowest class it
lies in, and the whole run is the secret.

Positions come from the pieces between the matches: match i begins after the
first i + 1 pieces and i matches. The entropy of a window of ``WINDOW``
characters is log2(w) - S / w with S the sum of c * log2(c) over the counts c;
a step changes S by the counts of the character that leaves and the one that
enters, so no window is counted anew. Runs are searched in pieces and arrays made
in chunks, so time grows in proportion to the text, unbroken or full of matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.frames import whole_row

# Fixed patterns. Letters of the keywords in either case.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{14,}"  # leftmost runs of 18 or more characters
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LENGTH = 12

WINDOW = 20
PIECE = 236  # windows that begin in one piece of a run
CHUNK = 256  # items of an array handled at a time
CANDIDATE = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Runs of each character class in a candidate. A run with a dense window is reported whole.
RUNS = (*(f"[{c}]{{{WINDOW},}}" for c in ("0-9a-fA-F", "A-Za-z0-9", "A-Za-z0-9+/_=-")), f"[A-Za-z+/_-]{{{WINDOW - 2},}}=*")
#: Classes of runs, the first that fits counts: pattern and least entropy of a window in bits.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z]+$", 3.8), ("^[A-Za-z0-9]+$", 3.7), ("^[A-Za-z0-9+/_=-]+$", 3.9))
#: Runs that are never secrets: letters given to a name (both are runs of their own), numbers, UUIDs.
ALLOW = (
    "^[A-Za-z+/_-]*=+[A-Za-z+/_-][A-Za-z+/_=-]*$",
    "^[0-9+/_=-]+$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)
#: Segments, between joiners, of documented examples: they belong to no run, what is beside them does.
EXAMPLE = "(?<![A-Za-z0-9])[A-Za-z0-9]*(?i:example|sample|dummy|placeholder|xxxx)[A-Za-z0-9]*"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(items: Column) -> Column:
    """``items`` in arrays of ``CHUNK``, at least one: an array built item by item is copied at every step."""
    return _let(items, lambda v: F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / CHUNK).cast("int")), lambda j: F.slice(v, j * CHUNK + 1, F.lit(CHUNK))))


def _before(values: Column, n: Column) -> Column:
    return F.slice(values, F.lit(1), n)


def _positions(text: Column, pattern: str, found: Column) -> Column:
    """Start and end, in code points, of each match in ``found`` (all matches of ``pattern``)."""
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    parts = F.arrays_zip(between.alias("gap"), F.transform(found, lambda m: F.length(m).cast("long")).alias("len"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        return F.when(x["len"].isNull(), acc).otherwise(
            F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("spans")))

    def placed(chunks: Column) -> Column:
        widths = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda n, x: n + x["gap"] + F.coalesce(x["len"], zero)))
        return _let(widths, lambda w: F.flatten(F.transform(chunks, lambda c, j: F.aggregate(
            c, F.struct(F.aggregate(_before(w, j), zero, lambda n, x: n + x).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"]))))

    return F.when(F.size(found) > 0, _let(_chunks(parts), placed)).otherwise(none)


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _lowest(piece: Column) -> Column:
    """The least sum S of the windows of ``piece``; the window travels in the state."""
    weight = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)]
    gain = F.array(*[F.lit(b - a) for a, b in zip([0.0, *weight], weight)])  # of S when a count rises to c
    begin = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("lowest"))

    def lowest(acc: Column) -> Column:
        return F.when(F.length(acc["last"]) >= WINDOW, F.least(acc["lowest"], acc["sum"])).otherwise(acc["lowest"])

    def step(acc: Column, came: Column) -> Column:
        last = acc["last"]
        full = F.length(last) >= WINDOW
        out, rest = F.substr(last, F.lit(1), F.lit(1)), F.when(full, F.substr(last, F.lit(2))).otherwise(last)
        gone = WINDOW - F.length(F.replace(last, out, F.lit("")))
        there = F.least(F.length(last), F.lit(WINDOW - 1)) - F.length(F.replace(rest, came, F.lit("")))
        total = acc["sum"] - F.when(full, F.get(gain, gone)).otherwise(F.lit(0.0)) + F.get(gain, there + 1)
        return F.struct(F.concat(rest, came).alias("last"), total.alias("sum"), lowest(acc).alias("lowest"))

    return F.aggregate(F.split(piece, ""), begin, step, lowest)


def _is_dense(s: Column, least: Column) -> Column:
    """Whether a window of ``s`` has at least ``least`` bits: looked for in pieces that overlap by a window less one character."""
    cut = F.regexp_extract_all(s, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    pieces = _let(cut, lambda p: F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.substr(F.get(p, i + 1), F.lit(1), F.lit(WINDOW - 1)), F.lit("")))))
    return F.exists(pieces, lambda x: F.log2(F.lit(float(WINDOW))) - _lowest(x) / WINDOW >= least - 1e-9)


def _without_examples(s: Column) -> Column:
    """``s`` with blanks in place of the segments of ``EXAMPLE``."""
    parts = F.arrays_zip(F.split(s, EXAMPLE, -1).alias("gap"), F.regexp_extract_all(s, F.lit(EXAMPLE), F.lit(0)).alias("m"))
    blank = F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], F.coalesce(F.repeat(F.lit(" "), F.length(x["m"])), F.lit("")))), "")
    return F.when(F.rlike(s, F.lit(EXAMPLE)), blank).otherwise(s)


def _runs(s: Column) -> Column:
    """The runs of every class in ``s`` with their offsets, each once."""

    def placed(t: Column, pattern: str):
        return lambda m: F.transform(F.arrays_zip(m.alias("s"), _positions(t, pattern, m).alias("at")), lambda x: F.struct(
            x["at"]["start"].alias("start"), x["at"]["end"].alias("end"), x["s"].alias("s")))

    def of(t: Column) -> Column:
        found = [_let(F.regexp_extract_all(t, F.lit(p), F.lit(0)), placed(t, p)) for p in RUNS]
        # equal ones are neighbours after the sort
        return _let(F.array_sort(F.concat(*found)), lambda v: F.filter(v, lambda r, i: (F.length(r["s"]) >= WINDOW) & (
            (i == 0) | (F.get(v, i - 1)["start"] != r["start"]) | (F.get(v, i - 1)["end"] != r["end"]))))

    return _let(s, of)


def _entropy_spans(strings: Column, at: Column, allow: tuple) -> Column:
    """Every run with a dense window, also those inside another."""

    def dense(x: Column) -> Column:
        least = F.lit(CLASSES[-1][1])
        for pattern, bits in reversed(CLASSES[:-1]):
            least = F.when(F.rlike(x["s"], F.lit(pattern)), F.lit(bits)).otherwise(least)
        found = _let(least, lambda bits: _is_dense(x["s"], bits))
        return ~F.rlike(x["s"], F.lit("|".join(f"(?:{p})" for p in allow))) & found if allow else found

    def spans(x: Column) -> Column:
        found = F.filter(_runs(_without_examples(x["s"]) if allow else x["s"]), dense)
        return F.transform(found, lambda r: F.struct((x["at"]["start"] + r["start"]).alias("start"), F.lit(3).alias("kind"), (x["at"]["start"] + r["end"]).alias("end")))

    return F.flatten(F.transform(F.arrays_zip(strings.alias("s"), at.alias("at")), spans))


def _outermost(spans: Column) -> Column:
    """``spans`` without those of kind 3 that lie in another one: sorted by start, the longer and the patterns first, none ends before them."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def alone(c: Column, top: Column):
        return lambda s, i: (s["kind"] < 3) | ((-s["back"] > top) & ~F.exists(_before(c, i), lambda o: o["back"] <= s["back"]))

    def kept(chunks: Column) -> Column:
        ends = F.transform(chunks, lambda c: -F.array_min(F.transform(c, lambda s: s["back"])))
        return _let(ends, lambda e: F.flatten(F.transform(chunks, lambda c, j: _let(
            F.coalesce(F.array_max(_before(e, j)), F.lit(0).cast("long")), lambda top: F.filter(c, alone(c, top))))))

    return F.transform(_let(_chunks(ordered), kept), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (-s["back"]).alias("end")))


def find_secrets(docs: DataFrame, text_col: str = "text", allow: tuple = ALLOW) -> DataFrame:
    """The rows of ``docs`` as struct ``row`` with ``base`` and ``spans``: start, kind, end in code points, sorted by start, then kind.

    ``base`` holds pattern matches, leftmost and non-overlapping per kind: assign
    (value of 12 or more characters), access, hex. ``spans`` adds kind 3, the
    high-entropy runs of candidate strings that are not allowed and do not lie
    in a base span or in another such run. A null or empty text has none. Rows pass through one to one,
    whatever their other columns are called; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(whole_row(docs).alias("row"), text.alias("text"))
    rows = rows.select(
        "row", "text", F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)).alias("assign"), F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)).alias("value"),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)).alias("access"), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)).alias("hex"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("strings"))
    t = F.col("text")
    assign = F.filter(F.arrays_zip(_positions(t, ASSIGN, F.col("assign")).alias("at"), F.col("value")), lambda x: F.length(x["value"]) >= ASSIGN_LENGTH)
    base = F.array_sort(F.concat(
        _kind(F.transform(assign, lambda x: x["at"]), 0), _kind(_positions(t, ACCESS, F.col("access")), 1), _kind(_positions(t, HEX, F.col("hex")), 2)))
    rows = rows.select("row", base.cast(SPAN).alias("base"), "strings", F.when(F.size("strings") > 0, _positions(t, CANDIDATE, F.col("strings"))).alias("at"))
    extra = F.when(F.size("strings") > 0, _entropy_spans(F.col("strings"), F.col("at"), allow)).otherwise(F.array())
    spans = F.when(F.size("extra") > 0, F.array_sort(_outermost(F.concat("base", "extra")))).otherwise(F.col("base"))
    return rows.select("row", "base", extra.cast(SPAN).alias("extra")).select("row", "base", spans.cast(SPAN).alias("spans"))


def labels(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the union of the spans replaced by ``mark``; null stays null."""
    zero = F.lit(0).cast("long")

    def part(at: Column, end: Column) -> Column:
        return F.substr(text, (at + 1).cast("int"), (end - at).cast("int"))

    def cut(c: Column, own: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.substr(own["s"], (acc["at"] - own["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
            return F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"))

        return F.aggregate(c, F.struct(own["at"].alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def pieces(chunks: Column) -> Column:
        """A chunk of spans stands for the text from the end of those before it to its own end."""
        ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))

        def joined(e: Column) -> Column:
            def piece(c: Column, j: Column) -> Column:
                at, end = F.coalesce(F.array_max(_before(e, j)), zero), F.array_max(_before(e, j + 1))
                return _let(F.struct(at.alias("at"), part(at, end).alias("s")), lambda own: cut(c, own))

            return F.concat(F.array_join(F.transform(chunks, piece), ""), F.substr(text, (F.array_max(e) + 1).cast("int")))

        return _let(ends, joined)

    return F.when(F.size(spans) > 0, _let(_chunks(spans), pieces)).otherwise(text)

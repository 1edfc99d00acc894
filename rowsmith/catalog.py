"""Registered queries over the driver tables, each with an SQL oracle.

Every query reads whole tables and runs one library operator (or the whole
load) on input built from them by an expression that the oracle repeats in
SQL.  ``queries()`` maps key -> ``fn(spark, sf_dir) -> DataFrame``;
``oracle_sql()`` maps key -> DuckDB SQL over the same tables.  The
similarity keys use a recursive-CTE spelling of the Ratcliff-Obershelp
ratio, written independently of the blocked Spark plan.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions.text import DEFAULT_NULL_TOKENS, blank_class, column_label, duplicate_key, lookup_key
from rowsmith.operators import clean, dedupe, lookup, similar, update, validate
from rowsmith.operators.clean import SplitRule
from rowsmith.plans.load import build_load
from rowsmith.plans.spec import GridSlice, LoadSpec, Lookup, TargetColumn
from rowsmith.session import checkpoint_dir
from rowsmith.sinks import commits, files, versions
from rowsmith.sources import grid, lines
from rowsmith.sources.files import read_conversions, read_csv_sheet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# SQL spellings of the text keys (DuckDB, RE2 classes built by the same rule)
# ---------------------------------------------------------------------------
_B = blank_class()


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_B}+', ' ', 'g'))"


def sql_dup_key(x: str) -> str:
    return f"replace(lower(strip_accents({sql_collapse(f'coalesce({x}, %s)' % repr(''))})), 'ß', 'ss')"


def sql_lookup_key(x: str) -> str:
    return f"replace(lower({sql_strip(f'coalesce(CAST({x} AS VARCHAR), %s)' % repr(''))}), 'ß', 'ss')"


def sql_is_empty(x: str) -> str:
    return f"({x} IS NULL OR {sql_strip(f'CAST({x} AS VARCHAR)')} = '')"


# Variant spelling used to make case/accent/blank duplicates by expression.
def _variant(c):
    return F.replace(F.replace(c, F.lit(" "), F.lit("  ")), F.lit("e"), F.lit("é"))


_SQL_VARIANT = "replace(replace({x}, ' ', '  '), 'e', 'é')"


# ---------------------------------------------------------------------------
# P4 trim
# ---------------------------------------------------------------------------
@query(
    "trim_cells",
    f"""
SELECT conv_id, turn,
       {sql_strip("chr(160) || role || ' '")} AS role,
       {sql_strip("'  ' || text || chr(9)")} AS text
FROM conversations
""",
)
def q_trim_cells(spark, d):
    c = table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.concat(F.lit("\u00a0"), F.col("role"), F.lit(" ")).alias("role"),
        F.concat(F.lit("  "), F.col("text"), F.lit("\t")).alias("text"),
    )
    return clean.trim_cells(c, ["role", "text"])


# ---------------------------------------------------------------------------
# S14 null tokens
# ---------------------------------------------------------------------------
def _token_list_sql(tokens) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in tokens)


_TOKENS = (*DEFAULT_NULL_TOKENS, "error")


@query(
    "null_tokens",
    f"""
WITH s AS (
  SELECT event_id, event_type,
         CASE event_type WHEN 'view' THEN 'N/A' WHEN 'click' THEN 'null' ELSE event_type END AS cell
  FROM events)
SELECT event_id,
       CASE WHEN event_type IN ({_token_list_sql(_TOKENS)}) THEN NULL ELSE event_type END AS event_type,
       CASE WHEN cell IN ({_token_list_sql(_TOKENS)}) THEN NULL ELSE cell END AS cell
FROM s
""",
)
def q_null_tokens(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "event_type",
        F.when(F.col("event_type") == "view", "N/A").when(F.col("event_type") == "click", "null")
        .otherwise(F.col("event_type")).alias("cell"),
    )
    return clean.apply_null_tokens(e, ["event_type", "cell"], tokens=_TOKENS)


# ---------------------------------------------------------------------------
# T1 / T2 keys
# ---------------------------------------------------------------------------
@query(
    "dup_key",
    f"""
SELECT doc_id,
       CAST(length({sql_dup_key('text')}) AS BIGINT) AS key_len,
       md5({sql_dup_key('text')}) AS key_md5,
       md5({sql_dup_key(_SQL_VARIANT.format(x='text'))}) AS variant_md5
FROM documents
""",
)
def q_dup_key(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    k = docs.withColumn("k", duplicate_key("text")).withColumn("kv", duplicate_key(_variant(F.col("text"))))
    return k.select("doc_id", F.length("k").cast("long").alias("key_len"), F.md5("k").alias("key_md5"), F.md5("kv").alias("variant_md5"))


@query(
    "lookup_key",
    f"""
SELECT doc_id,
       CAST(length({sql_lookup_key('text')}) AS BIGINT) AS key_len,
       md5({sql_lookup_key('text')}) AS key_md5
FROM documents
""",
)
def q_lookup_key(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    k = docs.withColumn("k", lookup_key("text"))
    return k.select("doc_id", F.length("k").cast("long").alias("key_len"), F.md5("k").alias("key_md5"))


# ---------------------------------------------------------------------------
# W1 keep-first dedupe, A1 duplicate stats
# ---------------------------------------------------------------------------
def _dup_input(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    a = docs.select((F.col("doc_id") * 2).alias("_row"), "doc_id", F.col("text").alias("v"))
    b = docs.select((F.col("doc_id") * 2 + 1).alias("_row"), "doc_id", _variant(F.col("text")).alias("v"))
    return a.unionByName(b)


_SQL_DUP_INPUT = f"""
  SELECT doc_id * 2 AS _row, doc_id, text AS v FROM documents
  UNION ALL
  SELECT doc_id * 2 + 1 AS _row, doc_id, {_SQL_VARIANT.format(x='text')} AS v FROM documents
"""


@query(
    "dedupe_first",
    f"""
WITH s AS ({_SQL_DUP_INPUT}),
k AS (SELECT _row, doc_id, {sql_dup_key('v')} AS k FROM s)
SELECT _row, doc_id FROM (
  SELECT _row, doc_id, row_number() OVER (PARTITION BY k ORDER BY _row) AS rn FROM k) WHERE rn = 1
""",
)
def q_dedupe_first(spark, d):
    return dedupe.keep_first(_dup_input(spark, d), "v").select("_row", "doc_id")


@query(
    "duplicate_stats",
    f"""
SELECT 'documents' AS source, CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(DISTINCT {sql_dup_key(sql_strip('v'))}) AS BIGINT) AS unique_rows,
       CAST(greatest(count(*) - count(DISTINCT {sql_dup_key(sql_strip('v'))}), 0) AS BIGINT) AS removed
FROM ({_SQL_DUP_INPUT})
UNION ALL
SELECT 'conversations', CAST(count(*) AS BIGINT),
       CAST(count(DISTINCT {sql_dup_key(sql_strip('text'))}) AS BIGINT),
       CAST(greatest(count(*) - count(DISTINCT {sql_dup_key(sql_strip('text'))}), 0) AS BIGINT)
FROM conversations
""",
)
def q_duplicate_stats(spark, d):
    a = dedupe.duplicate_stats(_dup_input(spark, d), "v").select(F.lit("documents").alias("source"), "*")
    b = dedupe.duplicate_stats(table(spark, d, "conversations"), "text").select(F.lit("conversations").alias("source"), "*")
    return a.unionByName(b)


# ---------------------------------------------------------------------------
# P5 replacements
# ---------------------------------------------------------------------------
_PARTS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
_COLD_TO_OLD = {f"cold {p}": f"old {p}" for p in _PARTS}


@query(
    "replace_values",
    "SELECT p_partkey, CASE p_name "
    + " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in _COLD_TO_OLD.items())
    + " ELSE p_name END AS p_name FROM part",
)
def q_replace_values(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return clean.replace_values(p, {"p_name": _COLD_TO_OLD})


@query(
    "replace_values_frame",
    """
WITH dict AS (SELECT DISTINCT p_type AS source, 'T:' || p_type AS target FROM part WHERE p_size > 10)
SELECT p.p_partkey, coalesce(dict.target, p.p_type) AS p_type
FROM part p LEFT JOIN dict ON p.p_type = dict.source
""",
)
def q_replace_values_frame(spark, d):
    p = table(spark, d, "part")
    dct = p.filter(F.col("p_size") > 10).select(
        F.lit("p_type").alias("column"), F.col("p_type").alias("source"), F.concat(F.lit("T:"), F.col("p_type")).alias("target")
    ).distinct()
    return clean.replace_values(p.select("p_partkey", "p_type"), dct, columns=["p_type"])


# ---------------------------------------------------------------------------
# P6 split by length
# ---------------------------------------------------------------------------
@query(
    "split_by_length_gt",
    """
SELECT conv_id, turn,
       CASE WHEN length(text) > 40 THEN NULL ELSE text END AS text,
       CASE WHEN length(text) > 40 THEN text END AS extra_1
FROM conversations
""",
)
def q_split_gt(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    out, _ = clean.split_by_length(c, SplitRule("text", "gt", 40))
    return out


@query(
    "split_by_length_lt",
    f"""
WITH s AS (SELECT conv_id, turn, ' ' || text || ' ' AS text FROM conversations)
SELECT conv_id, turn,
       CASE WHEN length({sql_strip('text')}) < 40 THEN NULL ELSE text END AS text,
       CASE WHEN length({sql_strip('text')}) < 40 THEN text END AS extra_1
FROM s
""",
)
def q_split_lt(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("text"))
    out, _ = clean.split_by_length(c, SplitRule("text", "lt", 40), trim_measure=True)
    return out


# ---------------------------------------------------------------------------
# P8 / P9 skip empty rows
# ---------------------------------------------------------------------------
@query(
    "skip_empty_rows",
    f"""
WITH s AS (
  SELECT d.doc_id AS _row, d.lang,
         CASE WHEN d.lang = 'es' THEN ' ' || chr(9) || ' ' ELSE d.text END AS text, l.quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT _row, lang, quality FROM s
WHERE NOT ({sql_is_empty('text')} AND {sql_is_empty('quality')})
""",
)
def q_skip_empty_rows(spark, d):
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    s = docs.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("_row"), "lang",
        F.when(F.col("lang") == "es", F.lit(" \t ")).otherwise(F.col("text")).alias("text"), "quality",
    )
    return clean.skip_empty_rows(s, ["text", "quality"]).select("_row", "lang", "quality")


# ---------------------------------------------------------------------------
# P1 / P2 / P10 / P11 map columns, P12 / P13 keys, P15 export
# ---------------------------------------------------------------------------
_ORDER_TARGET = [
    TargetColumn("order_id", "bigint", nullable=False, primary_key=True),
    TargetColumn("customer_id", "bigint"),
    TargetColumn("status", "varchar(1)", max_length=1),
    TargetColumn("total", "double precision"),
    TargetColumn("ordered_at", "timestamp"),
    TargetColumn("priority", "text"),
    TargetColumn("priority_code", "varchar(15)", max_length=15),
    TargetColumn("active", "boolean"),
    TargetColumn("loaded_on", "date"),
    TargetColumn("origin", "text"),
]
_ORDER_MAP = [
    ("o_orderkey", "order_id"), ("o_custkey", "customer_id"), ("o_orderstatus", "status"), ("o_totalprice", "total"),
    ("o_orderdate", "ordered_at"), ("o_orderpriority", "priority"), ("o_orderpriority", "priority_code"),
]
_ORDER_DEFAULTS = {"active": True, "loaded_on": _dt.date(2024, 1, 31), "origin": "sheet", "status": "X"}


def _orders_sheet(spark, d) -> DataFrame:
    """``orders`` as a sheet: every cell is text, ``_row`` is the order key."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("_row"), *[F.col(c).cast("string").alias(c) for c in o.columns])


@query(
    "map_columns",
    """
SELECT o_orderkey AS _row, o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
       o_totalprice AS total, o_orderdate AS ordered_at, o_orderpriority AS priority,
       o_orderpriority AS priority_code, true AS active, DATE '2024-01-31' AS loaded_on, 'sheet' AS origin
FROM orders
""",
)
def q_map_columns(spark, d):
    m = clean.map_columns(_orders_sheet(spark, d), _ORDER_MAP, _ORDER_TARGET)
    return clean.apply_defaults(m, _ORDER_DEFAULTS, _ORDER_TARGET)


@query(
    "drop_pk",
    """
SELECT o_orderkey AS _row, o_custkey AS customer_id, o_orderstatus AS status, o_orderpriority AS priority
FROM orders
""",
)
def q_drop_pk(spark, d):
    spec = LoadSpec("orders", _ORDER_TARGET, mapping=[m for m in _ORDER_MAP if m[1] in ("order_id", "customer_id", "status", "priority")],
                    primary_key="order_id", autogenerate_pk=True)
    m = clean.map_columns(_orders_sheet(spark, d), spec.effective_mapping(), _ORDER_TARGET)
    return clean.drop_pk(m, spec.generated_pk)


@query(
    "sequence_key",
    """
SELECT o_orderkey,
       lpad(CAST((SELECT max(o_custkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), 12, '0') AS seq_key
FROM orders
""",
)
def q_sequence_key(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    # start = max(pk) of the target: one scalar
    start = o.agg(F.max("o_custkey")).first()[0] or 0
    return clean.sequence_key(o.select("o_orderkey"), "seq_key", order=["o_orderkey"], start=int(start), width=12)


@query(
    "export_values",
    """
SELECT o_orderkey,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ordered_at,
       strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS ordered_on,
       CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS finished
FROM orders
""",
)
def q_export_values(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("ordered_at"), F.to_date("o_orderdate").alias("ordered_on"),
        (F.col("o_orderstatus") == "F").alias("finished"),
    )
    return clean.export_values(o)


# ---------------------------------------------------------------------------
# S20 column labels
# ---------------------------------------------------------------------------
def _sql_column_label(n: str, letters: int = 7) -> str:
    parts = []
    s_k = 0
    for k in range(letters):
        p = 26**k
        parts.append(f"CASE WHEN {n} > {s_k} THEN chr(CAST(65 + (({n} - {s_k + 1}) // {p}) % 26 AS INTEGER)) ELSE '' END")
        s_k += 26 ** (k + 1)
    return " || ".join(reversed(parts))


@query("column_labels", f"SELECT p_partkey, {_sql_column_label('(p_partkey + 1)')} AS label FROM part")
def q_column_labels(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    return p.select("p_partkey", column_label(F.col("p_partkey") + 1).alias("label"))


# ---------------------------------------------------------------------------
# S3 / S4-S9 grids, S7 header names, S10 header detection
# ---------------------------------------------------------------------------
def _events_grid(spark, d) -> DataFrame:
    """One sheet per event type; rows are event ids + 2; some rows are empty."""
    e = table(spark, d, "events")
    empty = F.col("props") == '{"k": 0}'
    c1 = F.when(~empty, F.col("event_id").cast("string"))
    c2 = F.when(~empty, F.col("user_id").cast("string"))
    c3 = F.when(~empty & (F.col("event_type") != "error"), F.col("props"))
    return e.select(
        F.lit("events").alias("path"), F.col("event_type").alias("sheet"), (F.col("event_id") + 2).cast("int").alias("row_idx"),
        F.array(c1, c2, c3, F.lit(None).cast("string")).alias("cells"),
    )


_SQL_EVENTS_GRID = """
  SELECT 'events' AS path, event_type AS sheet, CAST(event_id + 2 AS INTEGER) AS row_idx,
         CASE WHEN props = '{"k": 0}' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS c1,
         CASE WHEN props = '{"k": 0}' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS c2,
         CASE WHEN props = '{"k": 0}' OR event_type = 'error' THEN NULL ELSE props END AS c3,
         CAST(NULL AS VARCHAR) AS c4
  FROM events
"""


@query(
    "used_range",
    f"""
WITH g AS ({_SQL_EVENTS_GRID}),
l AS (SELECT *, CASE WHEN c4 IS NOT NULL THEN 4 WHEN c3 IS NOT NULL THEN 3 WHEN c2 IS NOT NULL THEN 2
                     WHEN c1 IS NOT NULL THEN 1 ELSE 0 END AS lastc FROM g),
s AS (SELECT path, sheet, max(CASE WHEN lastc > 0 THEN row_idx END) AS last_row, max(lastc) AS last_col
      FROM l GROUP BY path, sheet)
SELECT l.path, l.sheet, l.row_idx,
       CAST(CASE WHEN s.last_col > 0 THEN s.last_col ELSE 4 END AS INTEGER) AS n_cells,
       array_to_string(list_transform(
         list_slice([l.c1, l.c2, l.c3, l.c4], 1, CASE WHEN s.last_col > 0 THEN s.last_col ELSE 4 END),
         lambda x: coalesce(x, '~')), '|') AS cells_text
FROM l JOIN s ON l.path = s.path AND l.sheet = s.sheet
WHERE s.last_row IS NULL OR l.row_idx <= s.last_row
""",
)
def q_used_range(spark, d):
    u = grid.used_range(_events_grid(spark, d))
    return u.select("path", "sheet", "row_idx", F.size("cells").cast("int").alias("n_cells"),
                    F.array_join(F.transform("cells", lambda x: F.coalesce(x, F.lit("~"))), "|").alias("cells_text"))


def _events_sheet_grid(spark, d) -> DataFrame:
    """All events on one sheet under a header row."""
    e = table(spark, d, "events")
    header = spark.createDataFrame([("events", "all", 1, ["event_id", "type", "user", "props", None])], grid.GRID_SCHEMA)
    body = e.select(
        F.lit("events").alias("path"), F.lit("all").alias("sheet"), (F.col("event_id") + 2).cast("int").alias("row_idx"),
        F.array(
            F.when(F.col("props") != '{"k": 0}', F.col("event_id").cast("string")),
            F.when(F.col("props") != '{"k": 0}', F.col("event_type")),
            F.when(F.col("props") != '{"k": 0}', F.col("user_id").cast("string")),
            F.when(F.col("props") != '{"k": 0}', F.col("props")),
            F.lit(None).cast("string"),
        ).alias("cells"),
    )
    return header.unionByName(body)


@query(
    "grid_slice",
    """
SELECT event_id + 2 AS _row, event_type AS type, CAST(user_id AS VARCHAR) AS user, props
FROM events WHERE props <> '{"k": 0}' AND event_id + 2 >= 3
""",
)
def q_grid_slice(spark, d):
    g = _events_sheet_grid(spark, d)
    return grid.sheet_table(g, GridSlice(header_row=1, start_row=3, start_col=2, end_col=4))


@query(
    "drop_empty_rows",
    """
SELECT event_id + 2 AS _row, CAST(event_id AS VARCHAR) AS event_id, event_type AS type
FROM events WHERE props <> '{"k": 0}'
""",
)
def q_drop_empty_rows(spark, d):
    g = _events_sheet_grid(spark, d)
    t = grid.sheet_table(g, GridSlice(header_row=1, end_col=2), drop_empty=False)
    return grid.drop_empty_rows(t, ["event_id", "type"])


@query(
    "header_names",
    """
SELECT n_nationkey AS sheet, 1 AS position, n_name AS name FROM nation
UNION ALL SELECT n_nationkey, 2, n_name || '_2' FROM nation
UNION ALL SELECT n_nationkey, 3, 'column_3' FROM nation
UNION ALL SELECT n_nationkey, 4, 'column_4' FROM nation
UNION ALL SELECT n_nationkey, 5, 'R' || CAST(n_regionkey AS VARCHAR) FROM nation
UNION ALL SELECT n_nationkey, 6, n_name || '.1' FROM nation
""",
)
def q_header_names(spark, d):
    n = table(spark, d, "nation")
    cells = F.array(
        F.col("n_name"), F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")), F.lit(None).cast("string"),
        F.lit("Unnamed: 3"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.col("n_name"),
    )
    h = n.select(F.col("n_nationkey").alias("sheet"), grid.header_names_col(cells).alias("names"))
    return h.select("sheet", F.posexplode("names").alias("position", "name")).select(
        "sheet", (F.col("position") + 1).alias("position"), "name")


def _pages_grid(spark, d) -> DataFrame:
    """Per page: 0-2 leading blank rows, for French pages a row of placeholder
    names, then a header row and a data row."""
    p = table(spark, d, "pages")
    b = F.when(F.col("url").contains("#"), 0).when(F.col("url").startswith("https"), 2).otherwise(1)
    pf = F.when(F.col("url").contains("/fr/"), 1).otherwise(0)
    none = F.lit(None).cast("string")

    def row(n, keep, cells):
        return F.struct(n.cast("int").alias("r"), keep.alias("keep"), F.array(*cells).alias("cells"))

    rows = F.array(
        row(F.lit(1), b >= 1, [none, none]),
        row(F.lit(2), b >= 2, [none, none]),
        row(b + 1, pf == 1, [F.lit("column_1"), F.lit("column_2")]),
        row(b + pf + 1, F.lit(True), [F.lit("url"), F.lit("page")]),
        row(b + pf + 2, F.lit(True), [F.col("url"), F.col("page_id").cast("string")]),
    )
    ex = p.select("page_id", F.explode(rows).alias("x")).filter("x.keep")
    return ex.select(F.lit("pages").alias("path"), F.col("page_id").cast("string").alias("sheet"),
                     F.col("x.r").alias("row_idx"), F.col("x.cells").alias("cells"))


def _sql_real(v: str) -> str:
    return f"({v} IS NOT NULL AND {v} <> '' AND NOT starts_with(lower({v}), 'unnamed:') AND NOT starts_with({v}, 'column_'))"


def _sql_prefix_or_empty(v: str) -> str:
    return f"({v} IS NULL OR {v} = '' OR starts_with({v}, 'column_'))"


@query(
    "header_detect",
    f"""
WITH b AS (SELECT page_id, url,
                  CASE WHEN url LIKE '%#%' THEN 0 WHEN url LIKE 'https%' THEN 2 ELSE 1 END AS b,
                  CASE WHEN url LIKE '%/fr/%' THEN 1 ELSE 0 END AS pf FROM pages),
g AS (
  SELECT page_id, 1 AS row_idx, NULL AS v1, NULL AS v2 FROM b WHERE b >= 1
  UNION ALL SELECT page_id, 2, NULL, NULL FROM b WHERE b >= 2
  UNION ALL SELECT page_id, b + 1, 'column_1', 'column_2' FROM b WHERE pf = 1
  UNION ALL SELECT page_id, b + pf + 1, 'url', 'page' FROM b
  UNION ALL SELECT page_id, b + pf + 2, url, CAST(page_id AS VARCHAR) FROM b),
f AS (SELECT page_id, row_idx,
             (v1 IS NOT NULL AND v1 <> '') OR (v2 IS NOT NULL AND v2 <> '') AS nonempty,
             {_sql_real('v1')} OR {_sql_real('v2')} AS real,
             {_sql_prefix_or_empty('v1')} AND {_sql_prefix_or_empty('v2')} AS allp
      FROM g),
c AS (SELECT * FROM f WHERE row_idx = 1 OR nonempty),
s AS (SELECT page_id,
             min(CASE WHEN real THEN row_idx END) AS a,
             min(CASE WHEN row_idx > 1 AND nonempty AND allp THEN row_idx END) AS bb,
             max(row_idx) AS last
      FROM c GROUP BY page_id),
p AS (SELECT s.page_id, max(c.row_idx) AS prev_b FROM s JOIN c ON c.page_id = s.page_id AND c.row_idx < s.bb GROUP BY s.page_id)
SELECT 'pages' AS path, CAST(s.page_id AS VARCHAR) AS sheet,
       CAST(CASE WHEN s.a IS NOT NULL AND (s.bb IS NULL OR s.a < s.bb) THEN s.a
                 WHEN s.bb IS NOT NULL THEN coalesce(p.prev_b, 1)
                 ELSE greatest(s.last, 1) END AS INTEGER) AS header_row
FROM s LEFT JOIN p ON p.page_id = s.page_id
""",
)
def q_header_detect(spark, d):
    return grid.detect_header(_pages_grid(spark, d), GridSlice(header_row=1))


# ---------------------------------------------------------------------------
# J1 / J2 / A6 lookups, T5 conversions
# ---------------------------------------------------------------------------
def _order_customer_sheet(spark, d, spoil: bool) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    s = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    name = F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))
    if spoil:
        name = (F.when(F.col("o_orderstatus") == "P", F.lit(" "))
                .when(F.col("o_orderpriority") == "5-LOW", F.concat(name, F.lit("x"))).otherwise(name))
    return s.select(F.col("o_orderkey").alias("_row"), name.alias("customer"))


_SQL_CUSTOMER_KEYS = f"SELECT {sql_lookup_key('c_name')} AS k, min(c_custkey) AS id FROM customer WHERE c_custkey IS NOT NULL GROUP BY 1"
_SQL_SHEET = """
  SELECT o.o_orderkey AS _row, '  ' || upper(c.c_name) || ' ' AS customer, o.o_orderstatus, o.o_orderpriority
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
"""
_SQL_SPOILED = f"""
  SELECT _row, CASE WHEN o_orderstatus = 'P' THEN ' ' WHEN o_orderpriority = '5-LOW' THEN customer || 'x' ELSE customer END AS customer
  FROM ({_SQL_SHEET})
"""
_CUSTOMER_RULE = Lookup("customer_id", "customer", "customer", "c_custkey", "c_name")


@query(
    "fk_lookup",
    f"""
WITH s AS ({_SQL_SHEET}), k AS ({_SQL_CUSTOMER_KEYS})
SELECT s._row, k.id AS customer_id FROM s LEFT JOIN k ON k.k = {sql_lookup_key('s.customer')}
""",
)
def q_fk_lookup(spark, d):
    flagged, _ = lookup.resolve_lookups(_order_customer_sheet(spark, d, False), [_CUSTOMER_RULE],
                                        {"customer": table(spark, d, "customer")})
    return flagged.select("_row", "customer_id")


@query(
    "fk_unresolved",
    f"""
WITH s AS ({_SQL_SPOILED}), k AS ({_SQL_CUSTOMER_KEYS})
SELECT s._row, 'customer' AS column,
       CASE WHEN {sql_lookup_key('s.customer')} = '' THEN 'fk_empty' ELSE 'fk_not_found' END AS kind,
       s.customer AS value
FROM s LEFT JOIN k ON k.k = {sql_lookup_key('s.customer')}
WHERE k.id IS NULL
""",
)
def q_fk_unresolved(spark, d):
    flagged, _ = lookup.resolve_lookups(_order_customer_sheet(spark, d, True), [_CUSTOMER_RULE],
                                        {"customer": table(spark, d, "customer")})
    _, viol = lookup.split_unresolved(flagged)
    return viol.select("_row", "column", "kind", "value")


@query(
    "fk_conflicts",
    f"""
WITH k AS (SELECT p_partkey AS id, p_name AS label, {sql_lookup_key('p_name')} AS key FROM part WHERE p_partkey IS NOT NULL),
k2 AS (SELECT * FROM k WHERE key <> ''),
bad AS (SELECT key FROM k2 GROUP BY key HAVING min(id) <> max(id))
SELECT DISTINCT key, label, id FROM k2 WHERE key IN (SELECT key FROM bad)
""",
)
def q_fk_conflicts(spark, d):
    prep = lookup.prepare_lookup(lookup.lookup_frame(table(spark, d, "part"), "p_partkey", "p_name"))
    return prep.conflicts.select("key", "label", "id")


def _priority_conversions(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.filter(F.col("o_orderpriority") != "3-MEDIUM").select(
        F.lit("priority").alias("column"), F.col("o_orderpriority").alias("source"),
        F.substring("o_orderpriority", 3, 100).alias("target")).distinct()


@query(
    "fk_conversion",
    f"""
WITH dict AS (SELECT DISTINCT o_orderpriority AS source, substr(o_orderpriority, 3, 100) AS target
              FROM orders WHERE o_orderpriority <> '3-MEDIUM'),
s AS (SELECT o_orderkey AS _row, ' ' || o_orderpriority AS priority FROM orders)
SELECT s._row, coalesce(dict.target, s.priority) AS priority
FROM s LEFT JOIN dict ON {sql_strip('s.priority')} = dict.source
""",
)
def q_fk_conversion(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row"),
                                          F.concat(F.lit(" "), F.col("o_orderpriority")).alias("priority"))
    return clean.apply_conversions(s, "priority", _priority_conversions(spark, d)).select("_row", "priority")


# ---------------------------------------------------------------------------
# V5 lengths, L2 first violations, V1 required nulls
# ---------------------------------------------------------------------------
_DOC_LIMITS = {"text": 500, "source": 4}


def _sql_len_violation(col: str, limit: int) -> str:
    return f"""
SELECT doc_id AS _row, '{col}' AS column, 'too_long' AS kind,
       {col} AS value,
       CAST(length({col}) AS VARCHAR) || ' > {limit} characters' AS detail
FROM documents WHERE length({col}) > {limit}"""


_SQL_LEN = " UNION ALL ".join(_sql_len_violation(c, n) for c, n in _DOC_LIMITS.items())


@query("length_violations", _SQL_LEN)
def q_length_violations(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_row"), "text", "source")
    return validate.length_violations(docs, _DOC_LIMITS)


@query("length_violations_first5", f"SELECT * FROM ({_SQL_LEN}) ORDER BY _row, \"column\", kind LIMIT 5")
def q_length_first5(spark, d):
    return validate.first_violations(q_length_violations(spark, d), 5)


@query(
    "required_nulls",
    """
SELECT d.doc_id AS _row, 'quality' AS column, 'required_null' AS kind
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL
UNION ALL
SELECT d.doc_id, 'toxic', 'required_null'
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL
""",
)
def q_required_nulls(spark, d):
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "_row")
    return validate.required_nulls(s, ["quality", "toxic"]).select("_row", "column", "kind")


# ---------------------------------------------------------------------------
# J4 update by key
# ---------------------------------------------------------------------------
@query(
    "update_by_key",
    """
WITH last AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name, CASE WHEN last.o_custkey IS NOT NULL THEN last.v ELSE c.c_acctbal END AS c_acctbal,
       last.o_custkey IS NOT NULL AS updated
FROM customer c LEFT JOIN last ON c.c_custkey = last.o_custkey
""",
)
def q_update_by_key(spark, d):
    src = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row"), F.col("o_custkey").alias("c_custkey"),
                                           F.col("o_totalprice").alias("c_acctbal"))
    tgt = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    out = update.update_by_key(tgt, src, "c_custkey", ["c_acctbal"])
    return out.withColumnRenamed("_updated", "updated")


# ---------------------------------------------------------------------------
# A2 value counts, J3/T4 pairs, A4/A5/L1 suggestions
# ---------------------------------------------------------------------------
@query(
    "value_counts",
    f"""
SELECT {sql_strip('p_name')} AS value, count(*) AS n, min(p_partkey) AS first_row
FROM part WHERE p_name IS NOT NULL AND {sql_strip('p_name')} <> '' GROUP BY 1
""",
)
def q_value_counts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("_row"), "p_name")
    return similar.value_counts(p, "p_name")


# ---------------------------------------------------------------------------
# SQL oracle for the similarity operators.  Written from the reference's own
# formulation -- every pair of distinct values in first-seen order, the
# Ratcliff-Obershelp ratio by the recursive longest-match rule (longest block,
# then earliest in the left text, then earliest in the right), groups by
# transitive closure -- so it shares nothing with the blocked Spark plan.
# (Valid for texts shorter than 200 characters, where the matcher applies no
# junk heuristic.)
# ---------------------------------------------------------------------------
def sql_sim_key(x):
    collapsed = f"trim(regexp_replace(coalesce({x}, ''), '{_B}+', ' ', 'g'))"
    return f"replace(lower(strip_accents(regexp_replace({collapsed}, '[sS]+$', ''))), 'ß', 'ss')"

def similarity_ctes(src: str) -> str:
    """src: a query with columns _row, v.  Defines vals, sim (similar value pairs)."""
    return f"""
vals AS (
  SELECT value, count(*) AS n, min(_row) AS first_row, {sql_sim_key('value')} AS k
  FROM (SELECT _row, {sql_strip('CAST(v AS VARCHAR)')} AS value FROM ({src}) WHERE v IS NOT NULL)
  WHERE value <> '' GROUP BY value),
vp AS (
  SELECT l.value AS lv, r.value AS rv, l.k AS a, r.k AS b
  FROM vals l JOIN vals r ON l.first_row < r.first_row
  WHERE l.k <> '' AND r.k <> ''),
todo AS (
  SELECT DISTINCT a, b FROM vp
  WHERE a <> b AND (abs(length(a) - length(b)) <= 1 OR 11 * least(length(a), length(b)) >= 9 * greatest(length(a), length(b)))),
sm AS (
  WITH RECURSIVE q(a, b, alo, ahi, blo, bhi, kind, sz) AS (
    SELECT a, b, 0, length(a), 0, length(b), 'range', 0 FROM todo
    UNION ALL
    SELECT best.a, best.b,
           CASE o.kind WHEN 'left' THEN best.alo WHEN 'right' THEN best.i + best.k ELSE 0 END,
           CASE o.kind WHEN 'left' THEN best.i WHEN 'right' THEN best.ahi ELSE 0 END,
           CASE o.kind WHEN 'left' THEN best.blo WHEN 'right' THEN best.j + best.k ELSE 0 END,
           CASE o.kind WHEN 'left' THEN best.j WHEN 'right' THEN best.bhi ELSE 0 END,
           CASE o.kind WHEN 'block' THEN 'block' ELSE 'range' END,
           CASE o.kind WHEN 'block' THEN best.k ELSE 0 END
    FROM (
      SELECT *, row_number() OVER (PARTITION BY a, b, alo, blo ORDER BY k DESC, i, j) AS rn
      FROM (
        SELECT q.a, q.b, q.alo, q.ahi, q.blo, q.bhi, ii.i, jj.j, max(ll.l) AS k
        FROM q, range(q.alo, q.ahi) ii(i), range(q.blo, q.bhi) jj(j),
             range(1, least(q.ahi - ii.i, q.bhi - jj.j) + 1) ll(l)
        WHERE q.kind = 'range' AND substr(q.a, ii.i + 1, ll.l) = substr(q.b, jj.j + 1, ll.l)
        GROUP BY ALL)) best,
      (VALUES ('block'), ('left'), ('right')) o(kind)
    WHERE best.rn = 1 AND (o.kind = 'block'
       OR (o.kind = 'left' AND best.i > best.alo AND best.j > best.blo)
       OR (o.kind = 'right' AND best.i + best.k < best.ahi AND best.j + best.k < best.bhi)))
  SELECT t.a, t.b, CAST(2 * coalesce(sum(q.sz), 0) AS DOUBLE) / CAST(length(t.a) + length(t.b) AS DOUBLE) AS ratio
  FROM todo t LEFT JOIN q ON q.a = t.a AND q.b = t.b AND q.kind = 'block'
  GROUP BY t.a, t.b),
sim AS (
  SELECT vp.lv, vp.rv, vp.a, vp.b FROM vp LEFT JOIN sm ON sm.a = vp.a AND sm.b = vp.b
  WHERE vp.a = vp.b OR sm.ratio >= 0.9 OR (abs(length(vp.a) - length(vp.b)) <= 1 AND sm.ratio >= 0.82))"""

def pairs_sql(src):
    return f"WITH {similarity_ctes(src)}\nSELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM sim WHERE a <> b"

def suggestions_sql(src):
    return f"""WITH RECURSIVE {similarity_ctes(src)},
e AS (SELECT lv AS s, rv AS t FROM sim UNION SELECT rv, lv FROM sim),
reach(s, t) AS (SELECT s, t FROM e UNION SELECT reach.s, e.t FROM reach JOIN e ON reach.t = e.s),
grp AS (SELECT vals.value, vals.n, least(vals.value, coalesce(min(reach.t), vals.value)) AS g
        FROM vals LEFT JOIN reach ON reach.s = vals.value GROUP BY vals.value, vals.n),
ranked AS (SELECT *, count(*) OVER (PARTITION BY g) AS size,
                  first_value(value) OVER (PARTITION BY g ORDER BY n DESC, length(value) DESC, value) AS canonical
           FROM grp)
SELECT value, canonical, n FROM ranked WHERE size > 1 AND value <> canonical"""


_PART_SRC = "SELECT p_partkey AS _row, p_name AS v FROM part"
_NATION_SRC = "SELECT n_nationkey AS _row, n_name AS v FROM nation"


@query("similar_pairs", pairs_sql(_PART_SRC))
def q_similar_pairs(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("_row"), "p_name")
    _, keys = similar._keys(similar.value_counts(p, "p_name"))
    return similar.similar_key_edges(keys)


@query("similar_pairs_nation", pairs_sql(_NATION_SRC))
def q_similar_pairs_nation(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("_row"), "n_name")
    _, keys = similar._keys(similar.value_counts(n, "n_name"))
    return similar.similar_key_edges(keys)


@query("similar_suggestions", suggestions_sql(_PART_SRC))
def q_similar_suggestions(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("_row"), "p_name")
    return similar.suggestions(p, "p_name")


@query("similar_suggestions_nation", suggestions_sql(_NATION_SRC))
def q_similar_suggestions_nation(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("_row"), "n_name")
    return similar.suggestions(n, "n_name")


# ---------------------------------------------------------------------------
# 2.12 the whole load, A7/K6 report
# ---------------------------------------------------------------------------
_FEED_TARGET = [
    TargetColumn("order_id", "bigint", nullable=False, primary_key=True),
    TargetColumn("customer_id", "bigint", nullable=False),
    TargetColumn("status", "varchar(1)", max_length=1),
    TargetColumn("total", "double precision"),
    TargetColumn("ordered_at", "timestamp"),
    TargetColumn("priority", "varchar(8)", max_length=8),
    TargetColumn("active", "boolean"),
    TargetColumn("origin", "text"),
]


def feed_spec() -> LoadSpec:
    return LoadSpec(
        table="orders_copy",
        columns=_FEED_TARGET,
        mapping=[("order_date", "ordered_at"), ("amount", "total"), ("flag", "status"), ("note", "priority")],
        defaults={"active": True, "origin": "sheet"},
        primary_key="order_id",
        autogenerate_pk=True,
        lookups=[Lookup("customer_id", "customer", "customer", "c_custkey", "c_name")],
        trim_whitespace=True,
        remove_duplicates=True,
        duplicate_column="customer",
        on_error="fail",
    )


def feed_sheet(spark, d) -> DataFrame:
    """The minimum slice: orders joined to customer names, every cell text."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    s = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    return s.select(
        F.col("o_orderkey").alias("_row"),
        F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("customer"),
        F.col("o_orderdate").cast("string").alias("order_date"),
        F.col("o_totalprice").cast("string").alias("amount"),
        F.col("o_orderstatus").alias("flag"),
        F.col("o_orderpriority").alias("note"),
    )


def run_feed(spark, d):
    return build_load(feed_sheet(spark, d), feed_spec(), {"customer": table(spark, d, "customer")})


_SQL_FEED = f"""
s AS (SELECT o.o_orderkey AS _row, '  ' || upper(c.c_name) || ' ' AS customer, o.o_orderdate, o.o_totalprice,
             o.o_orderstatus, o.o_orderpriority
      FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
t AS (SELECT _row, {sql_strip('customer')} AS customer, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority FROM s),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {sql_dup_key('customer')} ORDER BY _row) AS rn FROM t) WHERE rn = 1),
k AS ({_SQL_CUSTOMER_KEYS}),
r AS (SELECT dd._row, k.id AS customer_id, dd.o_orderstatus AS status, dd.o_totalprice AS total,
             dd.o_orderdate AS ordered_at, dd.o_orderpriority AS priority, true AS active, 'sheet' AS origin
      FROM dd LEFT JOIN k ON k.k = {sql_lookup_key('dd.customer')})
"""


@query("load_chain", f"WITH {_SQL_FEED} SELECT * FROM r")
def q_load_chain(spark, d):
    return run_feed(spark, d).candidates


@query(
    "load_violations",
    f"""
WITH {_SQL_FEED}
SELECT _row, 'customer_id' AS column, 'required_null' AS kind FROM r WHERE customer_id IS NULL
UNION ALL
SELECT _row, 'priority', 'too_long' FROM r WHERE length(priority) > 8
UNION ALL
SELECT _row, 'status', 'too_long' FROM r WHERE length(status) > 1
""",
)
def q_load_violations(spark, d):
    return run_feed(spark, d).violations.select("_row", "column", "kind")


@query(
    "load_report",
    f"""
WITH {_SQL_FEED}
SELECT 'read' AS metric, CAST(count(*) AS BIGINT) AS value FROM s
UNION ALL SELECT 'after_dedupe', count(*) FROM dd
UNION ALL SELECT 'after_skip_empty', count(*) FROM dd
UNION ALL SELECT 'written', CASE WHEN count(*) FILTER (WHERE customer_id IS NULL OR length(priority) > 8 OR length(status) > 1) > 0 THEN 0 ELSE count(*) END FROM r
UNION ALL SELECT 'bad_value', CAST(0 AS BIGINT)
UNION ALL SELECT 'fk_empty', count(*) FILTER (WHERE {sql_lookup_key('customer')} = '') FROM dd
UNION ALL SELECT 'fk_not_found', count(*) FILTER (WHERE customer_id IS NULL AND {sql_lookup_key('customer')} <> '') FROM dd LEFT JOIN k ON k.k = {sql_lookup_key('dd.customer')} LEFT JOIN (SELECT _row, customer_id FROM r) rr ON rr._row = dd._row
UNION ALL SELECT 'fk_conflict', CAST(0 AS BIGINT)
UNION ALL SELECT 'too_long', (SELECT count(*) FROM r WHERE length(priority) > 8) + (SELECT count(*) FROM r WHERE length(status) > 1)
UNION ALL SELECT 'required_null', count(*) FILTER (WHERE customer_id IS NULL) FROM r
""",
)
def q_load_report(spark, d):
    return run_feed(spark, d).report()


# ---------------------------------------------------------------------------
# S11 preview, W1 with blank keys kept, the suggestion -> replacement chain,
# the load in quarantine mode, K6 violation summary
# ---------------------------------------------------------------------------
_SQL_GRID_SLICE = ORACLES["grid_slice"]


@query("preview_first30", f"SELECT * FROM ({_SQL_GRID_SLICE}) ORDER BY _row LIMIT 30")
def q_preview(spark, d):
    return grid.preview(q_grid_slice(spark, d), 30)


@query(
    "dedupe_keep_blank",
    f"""
WITH s AS (SELECT doc_id AS _row, CASE WHEN lang = 'es' THEN '  ' ELSE text END AS v FROM documents),
k AS (SELECT _row, {sql_dup_key('v')} AS k FROM s)
SELECT _row FROM k WHERE k = ''
UNION ALL
SELECT _row FROM (SELECT _row, row_number() OVER (PARTITION BY k ORDER BY _row) AS rn FROM k WHERE k <> '') WHERE rn = 1
""",
)
def q_dedupe_keep_blank(spark, d):
    docs = table(spark, d, "documents")
    s = docs.select(F.col("doc_id").alias("_row"), F.when(F.col("lang") == "es", F.lit("  ")).otherwise(F.col("text")).alias("v"))
    return dedupe.keep_first(s, "v", keep_blank_keys=True).select("_row")


@query(
    "suggestions_replaced",
    f"""
SELECT p.p_partkey, coalesce(sg.canonical, p.p_name) AS p_name
FROM part p LEFT JOIN ({suggestions_sql(_PART_SRC)}) sg ON p.p_name = sg.value
""",
)
def q_suggestions_replaced(spark, d):
    """Standardising similar words: suggestions become a replacement dictionary (P5)."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("_row"), "p_partkey", "p_name")
    rep = similar.suggestions_to_replacements(similar.suggestions(p, "p_name", ordered=False), "p_name")
    return clean.replace_values(p, rep, columns=["p_name"]).select("p_partkey", "p_name")


@query(
    "load_quarantine",
    f"""
WITH {_SQL_FEED}
SELECT * FROM r WHERE customer_id IS NOT NULL AND length(priority) <= 8 AND length(status) <= 1
""",
)
def q_load_quarantine(spark, d):
    spec = feed_spec()
    spec.on_error = "quarantine"
    return build_load(feed_sheet(spark, d), spec, {"customer": table(spark, d, "customer")}).rows


@query(
    "violation_summary",
    f"""
WITH {_SQL_FEED},
v AS (SELECT _row, 'customer_id' AS "column", 'required_null' AS kind FROM r WHERE customer_id IS NULL
      UNION ALL SELECT _row, 'priority', 'too_long' FROM r WHERE length(priority) > 8
      UNION ALL SELECT _row, 'status', 'too_long' FROM r WHERE length(status) > 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column", kind ORDER BY _row) AS rn,
              count(*) OVER (PARTITION BY "column", kind) AS cnt FROM v)
SELECT "column", kind, CAST(max(cnt) AS BIGINT) AS violations,
       string_agg(CAST(_row AS VARCHAR), ', ' ORDER BY _row) FILTER (WHERE rn <= 4)
         || CASE WHEN max(cnt) > 4 THEN ' +' || CAST(max(cnt) - 4 AS VARCHAR) ELSE '' END AS first_rows
FROM rk GROUP BY "column", kind
""",
)
def q_violation_summary(spark, d):
    return validate.violation_summary(run_feed(spark, d).violations, 4)


# ---------------------------------------------------------------------------
# The load at volume: every lineitem row, supplier resolved by name
# ---------------------------------------------------------------------------
_LINE_TARGET = [
    TargetColumn("line_id", "bigint", nullable=False),
    TargetColumn("supplier_id", "bigint", nullable=False),
    TargetColumn("quantity", "double precision"),
    TargetColumn("price", "double precision"),
    TargetColumn("return_flag", "varchar(1)", max_length=1),
    TargetColumn("line_status", "varchar(1)", max_length=1),
    TargetColumn("shipped_at", "timestamp"),
]


def lineitem_sheet(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    su = table(spark, d, "supplier").select("s_suppkey", "s_name")
    s = li.join(su, li["l_suppkey"] == su["s_suppkey"], "left")
    return s.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_row"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("line"),
        F.concat(F.lit(" "), F.upper("s_name"), F.lit("  ")).alias("supplier"),
        F.col("l_quantity").cast("string").alias("qty"),
        F.col("l_extendedprice").cast("string").alias("price"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_shipdate").cast("string").alias("shipped"),
    )


def lineitem_spec() -> LoadSpec:
    return LoadSpec(
        table="lines", columns=_LINE_TARGET,
        mapping=[("line", "line_id"), ("qty", "quantity"), ("price", "price"), ("flag", "return_flag"),
                 ("status", "line_status"), ("shipped", "shipped_at")],
        lookups=[Lookup("supplier_id", "supplier", "supplier", "s_suppkey", "s_name")],
        trim_whitespace=True, on_error="quarantine",
    )


@query(
    "load_lineitem",
    f"""
WITH k AS (SELECT {sql_lookup_key('s_name')} AS k, min(s_suppkey) AS id FROM supplier WHERE s_suppkey IS NOT NULL GROUP BY 1),
s AS (SELECT l.l_orderkey * 10 + l.l_linenumber AS _row, ' ' || upper(su.s_name) || '  ' AS supplier, l.*
      FROM lineitem l LEFT JOIN supplier su ON l.l_suppkey = su.s_suppkey)
SELECT s._row, s._row AS line_id, k.id AS supplier_id, s.l_quantity AS quantity, s.l_extendedprice AS price,
       s.l_returnflag AS return_flag, s.l_linestatus AS line_status, s.l_shipdate AS shipped_at
FROM s LEFT JOIN k ON k.k = {sql_lookup_key(sql_strip('s.supplier'))}
WHERE k.id IS NOT NULL AND length(s.l_returnflag) <= 1 AND length(s.l_linestatus) <= 1
""",
)
def q_load_lineitem(spark, d):
    tables = {"supplier": table(spark, d, "supplier")}
    return build_load(lineitem_sheet(spark, d), lineitem_spec(), tables).rows


# ---------------------------------------------------------------------------
# Cells the target type cannot read, row ranges, ambiguous labels
# ---------------------------------------------------------------------------
_SPOILED_TARGET = [TargetColumn("order_id", "bigint", nullable=False), TargetColumn("total", "numeric(12,2)"), TargetColumn("ordered_on", "date")]
_SQL_SPOILED_ORDERS = """
  SELECT o_orderkey AS _row, CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_orderstatus = 'P' THEN '12,50' WHEN o_orderpriority = '5-LOW' THEN 'oops' ELSE CAST(o_custkey AS VARCHAR) END AS amount,
         CASE WHEN o_orderkey % 7 = 0 THEN '31.31.2024' WHEN o_orderkey % 7 = 1 THEN ' ' ELSE '2024-02-29' END AS day
  FROM orders
"""


def _spoiled_load(spark, d):
    o = table(spark, d, "orders")
    sheet = o.select(
        F.col("o_orderkey").alias("_row"), F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "P", "12,50").when(F.col("o_orderpriority") == "5-LOW", "oops").otherwise(F.col("o_custkey").cast("string")).alias("amount"),
        F.when(F.col("o_orderkey") % 7 == 0, "31.31.2024").when(F.col("o_orderkey") % 7 == 1, " ").otherwise("2024-02-29").alias("day"),
    )
    spec = LoadSpec("orders_copy", _SPOILED_TARGET, mapping=[("id", "order_id"), ("amount", "total"), ("day", "ordered_on")], on_error="quarantine")
    return build_load(sheet, spec)


@query(
    "load_bad_values",
    f"""
WITH s AS ({_SQL_SPOILED_ORDERS})
SELECT _row, 'total' AS "column", 'bad_value' AS kind, amount AS value FROM s WHERE amount IN ('12,50', 'oops')
UNION ALL SELECT _row, 'ordered_on', 'bad_value', day FROM s WHERE day = '31.31.2024'
""",
)
def q_load_bad_values(spark, d):
    return _spoiled_load(spark, d).violations.select("_row", "column", "kind", "value")


@query(
    "load_bad_values_rows",
    f"""
WITH s AS ({_SQL_SPOILED_ORDERS})
SELECT _row, _row AS order_id, CAST(CAST(amount AS DECIMAL(12,2)) AS VARCHAR) AS total, CASE WHEN day = '2024-02-29' THEN day END AS ordered_on
FROM s WHERE amount NOT IN ('12,50', 'oops') AND day <> '31.31.2024'
""",
)
def q_load_bad_values_rows(spark, d):
    return _spoiled_load(spark, d).rows.select("_row", "order_id", F.col("total").cast("string").alias("total"), F.col("ordered_on").cast("string").alias("ordered_on"))


_SLICE = (101, 5000)


@query("load_sliced", f"WITH {_SQL_FEED.replace(' FROM s),', f' FROM s WHERE _row BETWEEN {_SLICE[0]} AND {_SLICE[1]}),', 1)} SELECT * FROM r")
def q_load_sliced(spark, d):
    spec = feed_spec()
    spec.slice = GridSlice(header_row=1, start_row=_SLICE[0], end_row=_SLICE[1])
    return build_load(feed_sheet(spark, d), spec, {"customer": table(spark, d, "customer")}).candidates


@query(
    "load_conflicts",
    f"""
WITH k AS (SELECT p_partkey, p_name, {sql_lookup_key('p_name')} AS key FROM part),
bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING min(p_partkey) <> max(p_partkey))
SELECT p_partkey AS _row, 'part' AS "column", 'fk_conflict' AS kind, p_name AS value FROM k WHERE key IN (SELECT key FROM bad)
""",
)
def q_load_conflicts(spark, d):
    """Rows that use an ambiguous label are rejected one by one in quarantine mode."""
    part = table(spark, d, "part")
    sheet = part.select(F.col("p_partkey").alias("_row"), F.col("p_name").alias("part"), F.col("p_size").cast("string").alias("size"))
    spec = LoadSpec("parts", [TargetColumn("part_id", "bigint"), TargetColumn("size", "integer")], mapping=[("size", "size")],
                    lookups=[Lookup("part_id", "part", "part", "p_partkey", "p_name")], on_error="quarantine")
    found = build_load(sheet, spec, {"part": part}).violations
    return found.filter("_row IS NOT NULL").select("_row", "column", "kind", "value")


@query(
    "replace_values_large",
    "SELECT c_custkey, 'C' || CAST(c_custkey AS VARCHAR) AS c_name FROM customer",
)
def q_replace_values_large(spark, d):
    """One dictionary entry per customer name."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    entries = c.select(F.lit("c_name").alias("column"), F.col("c_name").alias("source"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("target"))
    return clean.replace_values(c, entries)


@query(
    "sequence_key_ties",
    """
SELECT o_orderkey, lpad(CAST(row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END NULLS FIRST, o_orderkey) AS VARCHAR), 12, '0') AS seq_key
FROM orders
""",
)
def q_sequence_key_ties(spark, d):
    """The first order column is text with three values and NULLs."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s"))
    return clean.sequence_key(o, "seq_key", order=["s", "o_orderkey"], width=12).drop("s")


# ---------------------------------------------------------------------------
# Columns beyond the header, sheets with columns in another order
# ---------------------------------------------------------------------------
@query(
    "grid_short_header",
    """
SELECT event_id + 2 AS _row, CAST(event_id AS VARCHAR) AS event, event_type AS column_2, props AS column_3 FROM events
""",
)
def q_grid_short_header(spark, d):
    e = table(spark, d, "events")
    header = spark.createDataFrame([("events", "all", 1, ["event"])], grid.GRID_SCHEMA)
    body = e.select(F.lit("events").alias("path"), F.lit("all").alias("sheet"), (F.col("event_id") + 2).cast("int").alias("row_idx"),
                    F.array(F.col("event_id").cast("string"), "event_type", "props").alias("cells"))
    return grid.sheet_table(header.unionByName(body), GridSlice(header_row=1))


@query(
    "grid_two_layouts",
    """
SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS path, 's' AS sheet, n_nationkey + 2 AS _row, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation
""",
)
def q_grid_two_layouts(spark, d):
    n = table(spark, d, "nation")
    header = spark.createDataFrame([("a", "s", 1, ["id", "name"]), ("b", "s", 1, ["name", "id"])], grid.GRID_SCHEMA)
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    even = F.col("n_nationkey") % 2 == 0
    body = n.select(F.when(even, "a").otherwise("b").alias("path"), F.lit("s").alias("sheet"), (F.col("n_nationkey") + 2).cast("int").alias("row_idx"),
                    F.when(even, F.array(key, name)).otherwise(F.array(name, key)).alias("cells"))
    return grid.sheet_table(header.unionByName(body), GridSlice(header_row=1), keep_sheet=True)


# ---------------------------------------------------------------------------
# Rows of many CSV files by physical line; W1 and J4 over files; K1 sent twice
# ---------------------------------------------------------------------------
_PER_FILE = 1000


def customer_files(spark, d) -> str:
    """Customers as CSV files of up to 1,000 records, later keys in earlier files, with cells of two lines and blank lines."""
    c = table(spark, d, "customer").withColumn("part", F.lpad((9_999_999 - F.floor(F.col("c_custkey") / _PER_FILE)).cast("string"), 7, "0"))
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("\n"), F.col("c_mktsegment"))).otherwise(""))
    note = F.concat(F.lit('say "'), F.col("c_mktsegment"), F.lit('", once'))
    blank = F.when(F.col("c_custkey") % 5 == 0, "\n").otherwise("")
    body = c.select("part", F.col("c_custkey").alias("at"), F.concat(F.col("c_custkey").cast("string"), F.lit(","), quoted(name), F.lit(","), quoted(note), blank).alias("value"))
    heads = c.select("part", F.lit(-1).cast("long").alias("at"), F.lit("id,name,note").alias("value")).distinct()
    path = f"{checkpoint_dir(spark).rstrip('/')}/rowsmith-customers-{uuid.uuid4().hex}"
    body.unionByName(heads).repartition("part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").text(path)
    return f"{path}/*/*.txt"


_SQL_CUSTOMER_FILES = f"""
f AS (SELECT c_custkey AS id, c_mktsegment AS segment, lpad(CAST(9999999 - c_custkey // {_PER_FILE} AS VARCHAR), 7, '0') AS part,
             c_name || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || c_mktsegment ELSE '' END AS name, 'say "' || c_mktsegment || '", once' AS note,
             1 + CAST(c_custkey % 3 = 0 AS BIGINT) + CAST(c_custkey % 5 = 0 AS BIGINT) AS lines FROM customer),
l AS (SELECT part, CAST(id AS VARCHAR) AS id, name, note,
             CAST(2 + coalesce(sum(lines) OVER (PARTITION BY part ORDER BY f.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS _row FROM f)"""


def customer_sheet(spark, d) -> DataFrame:
    return lines.read_csv_records(spark, customer_files(spark, d), ["id", "name", "note"])


@query("csv_rows", f"WITH {_SQL_CUSTOMER_FILES} SELECT part, id, name, note, _row FROM l")
def q_csv_rows(spark, d):
    sheet = customer_sheet(spark, d)
    return sheet.select(F.regexp_extract("_path", "part=([0-9]+)/", 1).alias("part"), "id", "name", "note", "_row")


@query(
    "dedupe_two_files",
    f"WITH {_SQL_CUSTOMER_FILES}, k AS (SELECT *, row_number() OVER (PARTITION BY {sql_dup_key('note')} ORDER BY part, _row) AS rn FROM l) SELECT id, name, _row FROM k WHERE rn = 1",
)
def q_dedupe_two_files(spark, d):
    return dedupe.keep_first(customer_sheet(spark, d), "note", order=("_path", "_row")).select("id", "name", "_row")


@query(
    "update_two_files",
    f"""WITH {_SQL_CUSTOMER_FILES}, k AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY part DESC, _row DESC) AS rn FROM l)
SELECT c_custkey, k.name AS name FROM customer JOIN k ON k.note = 'say "' || c_mktsegment || '", once' AND rn = 1""",
)
def q_update_two_files(spark, d):
    target = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit('say "'), F.col("c_mktsegment"), F.lit('", once')).alias("note"), F.col("c_name").alias("name"))
    done = update.update_by_key(target, customer_sheet(spark, d), "note", ["name"], order=("_path", "_row"))
    return done.select("c_custkey", "name")


@query("insert_twice", f"SELECT * EXCLUDE (_row) FROM ({ORACLES['load_quarantine']})")
def q_insert_twice(spark, d):
    path = f"{checkpoint_dir(spark).rstrip('/')}/rowsmith-inserted-{uuid.uuid4().hex}"
    for _ in range(2):
        spec = feed_spec()
        spec.on_error = "quarantine"
        commits.insert_once(build_load(feed_sheet(spark, d), spec, {"customer": table(spark, d, "customer")}), path, "orders")
    return commits.read_committed(spark, path)


# ---------------------------------------------------------------------------
# Round trips: K2 by files, K3 and S12, K5 and S19
# ---------------------------------------------------------------------------
def _fresh(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/rowsmith-{name}-{uuid.uuid4().hex}"


@query(
    "update_rewrites",
    """
WITH last AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
SELECT c.c_custkey, c.c_nationkey, CASE WHEN last.o_custkey IS NOT NULL THEN last.v ELSE c.c_acctbal END AS c_acctbal
FROM customer c LEFT JOIN last ON c.c_custkey = last.o_custkey
""",
)
def q_update_rewrites(spark, d):
    """K2: customers as a table ranged by key, then every customer with an open order takes that order's price."""
    path = _fresh(spark, "customers")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    versions.create_table(c.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey"), path)
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    sheet = o.select(F.col("o_orderkey").alias("_row"), F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    versions.update_files(sheet, path, "c_custkey")
    return versions.read_version(spark, path)


@query(
    "csv_export_read",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ordered,
       CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS finished, ' a "' || o_orderpriority || '", b ' AS remark
FROM orders
""",
)
def q_csv_export_read(spark, d):
    """K3 then S12: orders exported as CSV, read back as a sheet and scanned by a mapping that names a column it lacks."""
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("ordered at"), (F.col("o_orderstatus") == "F").alias("finished"),
        F.concat(F.lit(' a "'), F.col("o_orderpriority"), F.lit('", b ')).alias("note"))
    path = _fresh(spark, "export")
    files.export_csv(o, path)
    sheet = read_csv_sheet(spark, path, escape="\\")
    return grid.read_records(sheet, {"o_orderkey": "id", "ordered at": "ordered", "finished": "finished", "note": "remark", "not there": "x"}).drop("_row")


@query(
    "conversions_read",
    f"""
WITH s AS (SELECT DISTINCT 'name' AS "column", p_name AS source, upper(p_name) AS target FROM part
           UNION SELECT DISTINCT 'brand', ' ' || p_brand || ' ', p_brand || ', "' || substr(p_brand, 1, 3) || '"' FROM part)
SELECT "column", {sql_strip('source')} AS source, {sql_strip('target')} AS target FROM s
""",
)
def q_conversions_read(spark, d):
    """K5 then S19: a conversion dictionary of all part names and brands, written and read back."""
    p = table(spark, d, "part")
    names = p.select(F.lit("name").alias("column"), F.col("p_name").alias("source"), F.upper("p_name").alias("target"))
    brands = p.select(
        F.lit("brand").alias("column"), F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")).alias("source"),
        F.concat(F.col("p_brand"), F.lit(', "'), F.substring("p_brand", 1, 3), F.lit('"')).alias("target"))
    path = _fresh(spark, "conversions")
    files.export_conversions(names.unionByName(brands).distinct(), path)
    return read_conversions(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

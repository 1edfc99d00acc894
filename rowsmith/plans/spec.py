"""The load plan a user writes, and its driver-side checks (V1-V4, Q12).

These objects hold metadata only -- column names, row numbers, small
constants.  No data passes through them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, Optional

from pyspark.sql import types as T

MAX_ROWS = 1_048_576  # rows of a sheet
MAX_COLS = 16_384  # columns of a sheet


class SpecError(ValueError):
    """The load plan is inconsistent; raised before any Spark job runs."""


# Whole type names, as catalogs and Spark report them.
_BOOLEANS = {"bool", "boolean"}
_DATES = {
    "date", "time", "timetz", "timestamp", "timestamptz", "datetime", "timestamp_ntz", "timestamp_ltz",
    "time with time zone", "time without time zone", "timestamp with time zone", "timestamp without time zone",
}
_SPARK_TYPES: dict[str, T.DataType] = {
    **{n: T.BooleanType() for n in _BOOLEANS},
    **{n: T.LongType() for n in ("bigint", "int8", "long", "bigserial", "serial8")},
    **{n: T.IntegerType() for n in ("int", "integer", "int4", "serial", "serial4")},
    **{n: T.ShortType() for n in ("smallint", "int2", "short", "smallserial", "serial2")},
    **{n: T.DoubleType() for n in ("double precision", "double", "float", "float4", "float8", "real")},
    **{n: T.TimestampNTZType() for n in ("timestamp", "timestamp without time zone", "timestamp_ntz", "datetime")},
    **{n: T.TimestampType() for n in ("timestamp with time zone", "timestamptz", "timestamp_ltz")},
    "date": T.DateType(),
}


def type_parts(text: str) -> tuple[str, Optional[int], Optional[int]]:
    """A type text as name, precision and scale: ``numeric(12,2)``, ``timestamp(3) with time zone``."""
    t = " ".join(text.lower().split())
    m = re.fullmatch(r"([^()]*?)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)\s*([^()]*)", t)
    if not m:
        return t, None, None
    name = f"{m[1]} {m[4]}".strip()
    return name, int(m[2]), int(m[3]) if m[3] else None


@dataclass(frozen=True)
class TargetColumn:
    """One column of the target table."""

    name: str
    type: str = "text"  # type text as the catalog reports it, e.g. "varchar(10)"
    nullable: bool = True
    primary_key: bool = False
    max_length: Optional[int] = None

    @property
    def kind(self) -> str:
        """``bool`` / ``date`` / ``text`` from the type name."""
        name, _, _ = type_parts(self.type)
        if name in _BOOLEANS:
            return "bool"
        return "date" if name in _DATES else "text"

    @property
    def spark_type(self) -> T.DataType:
        """Spark type used to cast mapped cells and defaults (Q18); an unknown type stays text."""
        name, precision, scale = type_parts(self.type)
        if name in ("numeric", "decimal"):
            if precision is None:
                return T.DecimalType(38, 10)
            return T.DecimalType(min(precision, 38), min(scale or 0, 38))
        return _SPARK_TYPES.get(name, T.StringType())


@dataclass(frozen=True)
class Lookup:
    """FK lookup rule: replace the sheet text by the id whose label matches."""

    target_column: str
    sheet_column: str
    table: str
    id_column: str
    label_column: str

    @property
    def dictionary(self) -> tuple[str, str, str]:
        """One dictionary per (table, id, label), shared by rules."""
        return (self.table, self.id_column, self.label_column)


@dataclass(frozen=True)
class GridSlice:
    """Header row and data rectangle, all 1-based; ``None`` means open."""

    header_row: int = 1
    start_row: Optional[int] = None
    end_row: Optional[int] = None
    start_col: Optional[int] = None
    end_col: Optional[int] = None

    def corrected(self) -> "GridSlice":
        """S5/S6 bound corrections: header >= 1, start > header, end >= start."""
        header = max(1, int(self.header_row or 1))
        start = self.start_row if self.start_row and self.start_row > header else header + 1
        end = self.end_row if self.end_row is not None and self.end_row >= start else None
        c0 = self.start_col if self.start_col and self.start_col >= 1 else 1
        c1 = self.end_col if self.end_col is not None and self.end_col >= c0 else None
        return GridSlice(header, start, end, c0, c1)

    def clamp(self, n_rows: int, n_cols: int) -> "GridSlice":
        """Clamp an initial rectangle to the used range of a sheet."""
        g = self.corrected()
        end = min(g.end_row, n_rows) if g.end_row else n_rows
        c1 = min(g.end_col, n_cols) if g.end_col else n_cols
        return GridSlice(min(g.header_row, max(n_rows, 1)), g.start_row, end, g.start_col, c1)

    def validate(self) -> None:
        if self.end_row is not None and self.start_row is not None and self.end_row < self.start_row:
            raise SpecError("end row lies before start row")
        if self.end_col is not None and self.start_col is not None and self.end_col < self.start_col:
            raise SpecError("end column lies before start column")
        if self.header_row > MAX_ROWS or (self.end_col or 0) > MAX_COLS:
            raise SpecError("range outside sheet limits")


@dataclass(frozen=True)
class SplitRule:
    """Move values longer (``gt``) or shorter (``lt``) than ``length``."""

    column: str
    op: str  # "gt" | "lt"
    length: int
    extra_column: Optional[str] = None

    def __post_init__(self):
        if self.op not in ("gt", "lt"):
            raise SpecError("split operator must be 'gt' or 'lt'")
        if not 1 <= int(self.length) <= 10_000:
            raise SpecError("split length must lie in 1..10000")


@dataclass
class LoadSpec:
    """The logical plan of one load (the reference's mapping selection)."""

    table: str
    columns: list[TargetColumn]
    mapping: list[tuple[str, str]] = field(default_factory=list)  # (sheet column, target column)
    defaults: dict[str, Any] = field(default_factory=dict)
    operation: str = "insert"  # "insert" | "update" | "export"
    join_column: Optional[str] = None
    primary_key: Optional[str] = None
    autogenerate_pk: bool = False
    lookups: list[Lookup] = field(default_factory=list)
    trim_whitespace: bool = False
    fk_trim_whitespace: bool = True
    remove_duplicates: bool = False
    duplicate_column: Optional[str] = None
    replacements: dict[str, dict[str, str]] = field(default_factory=dict)
    split: Optional[SplitRule] = None
    slice: GridSlice = field(default_factory=GridSlice)
    on_error: str = "fail"  # "fail" | "quarantine"

    # -- metadata helpers -------------------------------------------------
    def column(self, name: str) -> Optional[TargetColumn]:
        for c in self.columns:
            if c.name == name:
                return c
        return None

    @property
    def primary_keys(self) -> list[str]:
        """Q20: all PK columns (the first one is used for key generation)."""
        return [c.name for c in self.columns if c.primary_key]

    @property
    def generated_pk(self) -> Optional[str]:
        if not self.autogenerate_pk:
            return None
        return self.primary_key or (self.primary_keys[0] if self.primary_keys else None)

    def effective_mapping(self) -> list[tuple[str, str]]:
        """The generated PK is dropped from the mapping."""
        pk = self.generated_pk
        return [(s, t) for s, t in self.mapping if t != pk]

    def mapped_targets(self) -> list[str]:
        """Mapped target columns in table order."""
        mapped = {t for _, t in self.mapping}
        return [c.name for c in self.columns if c.name in mapped]

    def fed_columns(self) -> set[str]:
        return {t for _, t in self.mapping} | set(self.defaults) | {lk.target_column for lk in self.lookups}

    def needed_sheet_columns(self) -> list[str]:
        seen: list[str] = []
        for s, _ in self.effective_mapping():
            if s not in seen:
                seen.append(s)
        for lk in self.lookups:
            if lk.sheet_column not in seen:
                seen.append(lk.sheet_column)
        return seen

    # -- checks -----------------------------------------------------------
    def missing_required(self) -> list[str]:
        """V1: NOT NULL targets not fed by mapping, default or lookup (generated PK exempt)."""
        fed = self.fed_columns()
        out = []
        for c in self.columns:
            if c.nullable:
                continue
            if c.primary_key and self.autogenerate_pk:
                continue
            if c.name not in fed:
                out.append(c.name)
        return out

    def coverage(self) -> dict[str, list[str]]:
        """Required/fed/missing summary of the target columns."""
        fed = self.fed_columns()
        required = [c.name for c in self.columns if not c.nullable]
        return {
            "required": required,
            "fed": [c.name for c in self.columns if c.name in fed],
            "missing": self.missing_required(),
        }

    def validate(self) -> "LoadSpec":
        """V1-V4 and Q12 on the driver; returns self for chaining."""
        if self.operation not in ("insert", "update", "export"):
            raise SpecError(f"unknown operation {self.operation!r}")
        if not self.mapping and not self.lookups and not self.defaults:
            raise SpecError("the load maps no column")  # V4
        names = {c.name for c in self.columns}
        fed: dict[str, str] = {}
        for kind, targets in (
            ("mapping", [t for _, t in self.mapping]),
            ("default", list(self.defaults)),
            ("lookup", [lk.target_column for lk in self.lookups]),
        ):
            for t in targets:
                if names and t not in names:
                    raise SpecError(f"{kind} target {t!r} is not a column of {self.table}")
                if t in fed:
                    raise SpecError(f"target column {t!r} is fed twice ({fed[t]} and {kind})")  # V3
                fed[t] = kind
        if self.operation == "insert":
            missing = self.missing_required()
            if missing:
                raise SpecError("required columns not fed: " + ", ".join(missing))  # V1
        if self.operation == "update":
            if not self.join_column:
                raise SpecError("update needs a join column")  # V2
            if self.join_column not in {t for _, t in self.mapping}:
                raise SpecError(f"join column {self.join_column!r} must be mapped")  # V2
            others = [t for t in self.fed_columns() if t != self.join_column]
            if not others:
                raise SpecError("update sets no column besides the join column")  # Q12
        if self.remove_duplicates and not self.duplicate_column:
            raise SpecError("duplicate removal needs a check column")
        if self.on_error not in ("fail", "quarantine"):
            raise SpecError("on_error must be 'fail' or 'quarantine'")
        self.slice.validate()
        return self


def target_columns_from_schema(
    schema: T.StructType,
    *,
    primary_key: list[str] | tuple[str, ...] = (),
    required: list[str] | tuple[str, ...] = (),
) -> list[TargetColumn]:
    """S17 for lake tables: target columns from a Spark schema.

    ``varchar(n)``/``char(n)`` lengths come from the field metadata Spark
    keeps for such columns; keys and NOT NULL columns that the table format
    does not record are declared by the caller.
    """
    out = []
    for f in schema.fields:
        declared = (f.metadata or {}).get("__CHAR_VARCHAR_TYPE_STRING")
        type_text = declared or f.dataType.simpleString()
        max_len = None
        if declared:
            m = re.search(r"\((\d+)\)", declared)
            max_len = int(m.group(1)) if m else None
        out.append(TargetColumn(
            f.name, type_text, nullable=f.nullable and f.name not in required,
            primary_key=f.name in primary_key, max_length=max_len,
        ))
    return out

"""Database tables through Spark's JDBC source.

Only standard ``spark.read.format("jdbc")`` is used: catalog queries go
through the ``query`` option, lookups through ``dbtable`` so column pruning
reaches the database.  Large lookup tables can be read in parallel with
``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.plans.spec import TargetColumn


def jdbc_options(url: str, user: str | None = None, password: str | None = None, driver: str | None = None, **extra) -> dict:
    opts = {"url": url}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver is not None:
        opts["driver"] = driver
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def postgres_url(host: str, port: int, database: str) -> str:
    return f"jdbc:postgresql://{host}:{port}/{database}"


def read_query(spark: SparkSession, opts: Mapping[str, str], sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**opts).option("query", sql).load()


def connect(spark: SparkSession, opts: Mapping[str, str]) -> bool:
    """The connection works when ``SELECT 1`` returns one row."""
    return read_query(spark, opts, "SELECT 1 AS ok").first()["ok"] == 1


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def list_tables(spark: SparkSession, opts: Mapping[str, str], schema: str = "public") -> DataFrame:
    """Table names of a schema, ordered case-insensitively (L4)."""
    sql = (
        "SELECT table_name FROM information_schema.tables "
        f"WHERE table_schema = {_lit(schema)} AND table_type = 'BASE TABLE'"
    )
    return read_query(spark, opts, sql).orderBy(F.lower("table_name"), "table_name")


def columns_sql(table: str, schema: str = "public") -> str:
    """S17 catalog query: name, type text, nullable, primary key, max length."""
    return f"""
SELECT c.column_name AS name,
       CASE WHEN c.character_maximum_length IS NOT NULL
            THEN c.data_type || '(' || c.character_maximum_length || ')' ELSE c.data_type END AS type,
       c.is_nullable = 'YES' AS nullable,
       EXISTS (SELECT 1 FROM information_schema.table_constraints tc
               JOIN information_schema.key_column_usage k
                 ON tc.constraint_name = k.constraint_name AND tc.table_schema = k.table_schema
               WHERE tc.constraint_type = 'PRIMARY KEY' AND tc.table_schema = c.table_schema
                 AND tc.table_name = c.table_name AND k.column_name = c.column_name) AS primary_key,
       c.character_maximum_length AS max_length
FROM information_schema.columns c
WHERE c.table_schema = {_lit(schema)} AND c.table_name = {_lit(table)}
ORDER BY c.ordinal_position"""


def get_columns(spark: SparkSession, opts: Mapping[str, str], table: str, schema: str = "public") -> list[TargetColumn]:
    """Column metadata of a target table (one small result to the driver)."""
    rows = read_query(spark, opts, columns_sql(table, schema)).collect()
    return [
        TargetColumn(r["name"], r["type"], bool(r["nullable"]), bool(r["primary_key"]),
                     int(r["max_length"]) if r["max_length"] is not None else None)
        for r in rows
    ]


def lookup_table(spark: SparkSession, opts: Mapping[str, str], table: str, id_column: str, label_column: str,
                 schema: str = "public", **partitioning) -> DataFrame:
    """``id, label`` of a table; only these two columns are fetched."""
    r = spark.read.format("jdbc").options(**opts).option("dbtable", f"{schema}.{table}")
    for k, v in partitioning.items():
        r = r.option(k, str(v))
    return r.load().select(F.col(id_column).alias("id"), F.col(label_column).cast("string").alias("label"))

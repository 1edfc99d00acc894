"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame, cols: list[str] | None = None) -> Column:
    """A struct of the columns, whatever they are called."""
    return F.struct(*[df["`" + c.replace("`", "``") + "`"] for c in (df.columns if cols is None else cols)])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/rowsmith-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the path for ``drop_scratch``."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; its frames must not be used afterwards."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes in a text column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long")).first()[0]


def shard_of(n: int, *cols: str) -> Column:
    """One of ``n`` shards by hash; equal ids with other texts spread out as well."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def power_of_two(n: float) -> int:
    return 1 << max(0, (max(1, int(n)) - 1).bit_length())

"""Updates by key that rewrite only the files that hold a matching row.

A table folder holds ``data/<id>`` with Parquet files, and ``versions/<number>``
with the names of the files that make up a version, one per line. A version is
published by creating its file exclusively: readers see a whole version or the one
before, and of two updates planned from the same version one is refused. Files of
older versions stay until ``drop_versions_before``.

The driver handles names of files, as it does when it plans a scan; rows and keys
stay in Spark.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.operators.common import maybe_broadcast, qcol, require_columns
from rowsmith.operators.components import written_table
from rowsmith.operators.update import ROW, last_per_key, update_by_key
from rowsmith.plans.load import LoadResult
from rowsmith.session import checkpoint_dir
from rowsmith.sinks.commits import _create, _path, _texts
from rowsmith.sinks.files import WriteReport, accepted

DIGITS = 12  # of a version in its file name
EMPTY = "#"  # a published version is never an empty file: that is one still being written


class VersionConflict(RuntimeError):
    """Another update published a version first; run the update again."""


@dataclass
class RewriteReport(WriteReport):
    rewritten: int = 0  # files replaced
    kept: int = 0  # files taken over as they are


def _versions(spark: SparkSession, table: str) -> dict[int, list[str]]:
    texts = _texts(spark, table, "versions")
    return {int(name): [line for line in text.split("\n") if line != EMPTY] for name, text in texts.items() if text}


def _files(spark: SparkSession, table: str, folder: str) -> list[str]:
    path, fs = _path(spark, table, "data", folder)
    if not fs.exists(path):
        return []
    return sorted(f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet"))


def _publish(spark: SparkSession, table: str, version: int, files: list[str]) -> None:
    if not _create(spark, "\n".join([EMPTY, *files]), table, "versions", f"{version:0{DIGITS}d}"):
        raise VersionConflict(f"version {version} of {table} exists")


def _drop(spark: SparkSession, *parts: str) -> None:
    path, fs = _path(spark, *parts)
    fs.delete(path, True)


def create_table(df: DataFrame, table: str) -> int:
    """The first version of a table. Rows sorted or ranged by the update key keep later updates to few files."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    published = False
    try:
        df.write.parquet(_path(spark, table, "data", folder)[0].toString())
        _publish(spark, table, 0, _files(spark, table, folder))
        published = True
    finally:
        if not published:
            _drop(spark, table, "data", folder)
    return 0


def _scan(spark: SparkSession, table: str, files: list[str]) -> DataFrame:
    return spark.read.parquet(*[_path(spark, table, "data", f)[0].toString() for f in files])


def read_version(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default of the latest."""
    found = _versions(spark, table)
    if not found or (version is not None and version not in found):
        raise ValueError(f"no such version of {table}")
    return _scan(spark, table, found[max(found) if version is None else version])


def update_files(source: LoadResult | DataFrame, table: str, key: str, columns=None) -> RewriteReport:
    """K2 with J4 semantics, as a new version: the last record of a key wins, a null key matches nothing, a null value overwrites.

    Files without a matching row are taken over as they are; an update that matches
    nothing publishes no version. Each touched file's rows go to new files by the
    scan's own splits, no row is shuffled unless the source is too large to broadcast.
    A rejected load changes nothing.
    """
    source = accepted(source)
    spark = source.sparkSession
    found = _versions(spark, table)
    if not found:
        raise ValueError(f"no version of {table}")
    base = max(found)
    if not found[base]:
        return RewriteReport(records=source.count(), changed=0)
    target = _scan(spark, table, found[base])
    columns = [c for c in source.columns if c not in (key, ROW)] if columns is None else list(columns)
    require_columns(source, [key, ROW, *columns], "source")
    require_columns(target, [key, *columns], "target")

    scratch, folder = f"{checkpoint_dir(spark).rstrip('/')}/rowsmith-update-{uuid.uuid4().hex}", uuid.uuid4().hex
    published = False
    try:
        # read twice: to find the files and to change them
        last = written_table(last_per_key(source, key, columns).withColumn(ROW, F.lit(0)), scratch)
        keys = maybe_broadcast(last.select(qcol(key).alias("__k")))
        hits = target.select(qcol(key).alias("__t"), F.col("_metadata.file_path").alias("__f")).join(keys, F.col("__t") == F.col("__k"), "left_semi")
        per_file = {r["__f"]: r["n"] for r in hits.groupBy("__f").agg(F.count(F.lit(1)).alias("n")).collect()}
        changed = {"/".join(f.rsplit("/", 2)[1:]): n for f, n in per_file.items()}
        touched = [f for f in found[base] if f in changed]
        if len(touched) != len(changed):
            raise RuntimeError("a file of the scan is not a file of the version")
        records = source.count()
        if not touched:
            return RewriteReport(records=records, changed=0, kept=len(found[base]))
        new = update_by_key(_scan(spark, table, touched), last, key, columns).drop("_updated")
        new.write.parquet(_path(spark, table, "data", folder)[0].toString())
        kept = [f for f in found[base] if f not in changed]
        _publish(spark, table, base + 1, kept + _files(spark, table, folder))
        published = True
        return RewriteReport(records=records, changed=sum(changed.values()), rewritten=len(touched), kept=len(kept))
    finally:
        _drop(spark, scratch)
        if not published:
            _drop(spark, table, "data", folder)


def drop_versions_before(spark: SparkSession, table: str, version: int) -> int:
    """Forget older versions and delete the files that no later one has; returns the number of files deleted.

    No reader of an older version may be running.
    """
    found = _versions(spark, table)
    if version not in found:
        raise ValueError(f"no version {version} of {table}")
    needed = {f for v, files in found.items() if v >= version for f in files}
    gone = {f for v, files in found.items() if v < version for f in files} - needed
    for v in found:
        if v < version:
            _drop(spark, table, "versions", f"{v:0{DIGITS}d}")
    for f in gone:
        _drop(spark, table, "data", f)
    return len(gone)

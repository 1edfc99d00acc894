"""Inserts that happen once or not at all (K1), and key ranges reserved for them.

A table folder holds ``loads/<id>-<attempt>`` with the files of one attempt,
``commits/<id>`` naming the attempt that counts, and ``reserved/<start>`` per
range of generated keys. Markers are created exclusively: of two writers of one
load id, or of two loads asking for keys at once, the file system lets one through.
Readers see the folders that markers name, so neither a failed attempt nor a
second one of the same load shows. The file system must create files exclusively,
as HDFS does; on a mounted folder, where Hadoop's local file system looks first and
creates then, a finished file is linked to its name instead.
"""

from __future__ import annotations

import os
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.operators.clean import sequence_key
from rowsmith.plans.load import LoadResult
from rowsmith.sinks.files import ROW, WriteReport

DIGITS = 20  # of a range's start in its file name


def _path(spark: SparkSession, *parts: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([parts[0].rstrip("/"), *parts[1:]]))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _create(spark: SparkSession, text: str, *parts: str) -> bool:
    """A new file with ``text``; false if there is one already."""
    path, fs = _path(spark, *parts)
    if fs.getUri().getScheme() == "file":
        return _link(text, fs.makeQualified(path).toUri().getPath())
    try:
        out = fs.create(path, False)
    except Py4JJavaError:
        if fs.exists(path):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _link(text: str, name: str) -> bool:
    """A new file that has its whole text from the moment it has its name; false if the name is taken."""
    folder = os.path.dirname(name)
    os.makedirs(folder, exist_ok=True)
    whole = os.path.join(os.path.dirname(folder), f".marker-{uuid.uuid4().hex}")
    with open(whole, "x", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    try:
        os.link(whole, name)
    except FileExistsError:
        return False
    finally:
        os.unlink(whole)
    return True


def _texts(spark: SparkSession, *parts: str) -> dict[str, str]:
    """Name and text of the small files in a folder; a file still being written has an empty text."""
    path, fs = _path(spark, *parts)
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    lines = spark.read.text(path.toString(), wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()
    return dict.fromkeys(names, "") | {r["name"]: r["value"] for r in lines}


def _name(load_id: str) -> str:
    return "load-" + re.sub("[^A-Za-z0-9.-]", lambda m: f"_{ord(m[0]):x}_", load_id)


def _committed(spark: SparkSession, table: str, load_id: str) -> WriteReport | None:
    found = _texts(spark, table, "commits").get(_name(load_id))
    if found is None:
        return None
    if not found:
        raise RuntimeError(f"the commit of load {load_id!r} was begun and not finished: if no writer runs, delete its marker in commits/")
    return WriteReport(records=int(found.split(" ")[1]))


def reserve_keys(spark: SparkSession, table: str, load_id: str, count: int, start: int = 0) -> int:
    """The number before a range of ``count`` keys that no other load gets; the same range when a load asks again.

    ``start`` is the largest key the table had before the first reservation.
    """
    for attempt in range(200):
        taken = {int(name): text.split(" ") for name, text in _texts(spark, table, "reserved").items()}
        if all(len(t) == 2 for t in taken.values()):
            for begin, (n, owner) in taken.items():
                if owner == _name(load_id):
                    if int(n) < count:
                        raise ValueError(f"load {load_id!r} reserved {n} keys and now needs {count}")
                    return begin
            begin = max([start, *[b + int(n) for b, (n, _) in taken.items()]])
            if not count or _create(spark, f"{count} {_name(load_id)}", table, "reserved", f"{begin:0{DIGITS}d}"):
                return begin
        time.sleep(0.01 * min(attempt, 20))
    raise RuntimeError("no key range could be reserved: a reservation in reserved/ is not finished")


def insert_once(result: LoadResult, table: str, load_id: str, *, generate_key: str | None = None, key_width: int = 5, key_start: int = 0) -> WriteReport:
    """K1: the rows of a load, visible all at once; a load id that was committed is not written again.

    A rejected load writes nothing. The number of rows is counted in the files
    written, so a task that runs twice counts once. With ``generate_key`` the keys
    count on from a range reserved for this load: loads planned from the same state
    of the table never share a key.
    """
    spark = result.ledger.sparkSession
    done = _committed(spark, table, load_id)
    if done is not None:
        return done
    result.materialize()
    folder = f"{_name(load_id)}-{uuid.uuid4().hex}"
    path, fs = _path(spark, table, "loads", folder)
    counts = False
    try:
        rows = result.rows
        if generate_key:
            start = reserve_keys(spark, table, load_id, rows.count(), key_start)
            rows = sequence_key(rows, generate_key, start=start, width=key_width)
        rows.drop(ROW).write.parquet(path.toString())
        n = spark.read.parquet(path.toString()).count()
        counts = _create(spark, f"{folder} {n}", table, "commits", _name(load_id))
        return WriteReport(records=n) if counts else _committed(spark, table, load_id)
    finally:
        if not counts:
            fs.delete(path, True)
        result.release()


def read_committed(spark: SparkSession, table: str) -> DataFrame:
    """The rows of all committed loads."""
    folders = sorted(t.split(" ")[0] for t in _texts(spark, table, "commits").values() if t)
    if not folders:
        raise ValueError(f"no load was committed to {table}")
    return spark.read.parquet(*[_path(spark, table, "loads", f)[0].toString() for f in folders])

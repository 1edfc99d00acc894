"""Session helpers.

On a cluster the session is created by the caller; these helpers only fill in
settings that are unset, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults for local runs and tests.  On a cluster, size shuffle partitions to
# the data (about 128-256 MB per partition after AQE coalescing).
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
}


def get_spark(master: str | None = None, app: str = "rowsmith", conf: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one with ``LOCAL_CONF``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[*]")
    for k, v in {**LOCAL_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read ``spark.checkpoint.dir`` (or the directory already set on the
    context).  Only when neither is set -- a local test session -- a folder is
    created here.  Jobs cut lineage with ``DataFrame.checkpoint()`` into this
    folder, which survives executor loss (``localCheckpoint`` would not).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        conf_dir = tempfile.mkdtemp(prefix="rowsmith-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_SHIPPED: set[int] = set()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ship_package(spark: SparkSession) -> None:
    """Make ``rowsmith`` importable in Python workers (UDFs, data sources).

    In local mode the package is zipped once per process and added with
    ``addPyFile``.  On a cluster the job ships it (``spark-submit --py-files``),
    so nothing is done there.
    """
    import shutil

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED or not _is_local(spark):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="rowsmith-pkg-")
    archive = shutil.make_archive(os.path.join(out_dir, "rowsmith"), "zip", os.path.dirname(pkg_dir), "rowsmith")
    sc.addPyFile(archive)
    _SHIPPED.add(key)

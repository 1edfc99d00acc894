"""Connected components of an edge list (A4).

Alternating large-star / small-star (Kiveris et al., "Connected Components
in MapReduce and Beyond", SoCC 2014): O(log^2 n) rounds, each a few
aggregations and joins, no step that gathers a component into one task.

Every round is written as a Parquet table under the session's checkpoint
folder and read back: lineage stays one round deep, a lost executor costs at
most one round, and each round is computed once (``checkpoint()`` would run
the plan a second time to save it).  The loop stops when the edges form
stars: every non-root node has exactly one edge, to a root that has none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.session import checkpoint_dir


# The edges of a round are distinct, from the larger node ``u`` to the smaller ``v``,
# so no step but the last one of a round has repeats to remove.


def _large_star(edges: DataFrame) -> DataFrame:
    # m(u) = min(N(u) + u); link every larger neighbour of u to m(u). Edges may repeat in the result.
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    m = edges.union(larger).groupBy("u").agg(F.min("v").alias("mv")).select("u", F.least("mv", "u").alias("m"))
    return larger.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # m(u) = min of the smaller neighbours N'(u); link N'(u) and u to m(u).
    m = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(m, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
    return linked.filter(F.col("u") != F.col("v")).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """True when no node has two out-edges and no edge ends at a non-root."""
    out = edges.select(F.col("u").alias("node"), "v", F.lit(False).alias("end"))
    ends = edges.select(F.col("v").alias("node"), F.lit(None).alias("v"), F.lit(True).alias("end"))
    nodes = out.union(ends).groupBy("node").agg(F.min("v").alias("x"), F.max("v").alias("y"), F.max("end").alias("end"))
    return nodes.filter("x <> y OR (x IS NOT NULL AND end)").limit(1).count() == 0


def _delete(spark, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - best effort; the folder is scratch space
        pass


def written_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` (shared storage) and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node, component`` for every node that has an edge.

    ``edges`` has columns ``u, v`` of one orderable type; the component label
    is the smallest node of the component.  Isolated nodes are the caller's
    business (they are their own component).  Raises if the rounds do not
    converge (never returns a partial answer).
    """
    spark = edges.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/rowsmith-cc-{uuid.uuid4().hex}"
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    cur = written_table(oriented.distinct(), f"{base}/r0")
    paths = [f"{base}/r0"]
    for i in range(1, max_rounds + 2):
        if _is_star_forest(cur):  # also true for an empty edge list
            break
        if i > max_rounds:
            raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")
        cur = written_table(_small_star(_large_star(cur)), f"{base}/r{i}")
        paths.append(f"{base}/r{i}")
        if len(paths) > 2:
            _delete(spark, paths.pop(0))
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(roots)

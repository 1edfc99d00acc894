"""Token counts kept as delta-maintained rollups.

Every batch of inserts, revisions and deletes becomes signed rows: what a
document had is taken back, what it has now is added. Sums of the rows by
source, language and tokenizer version are additive, so totals are sums over
batches. A batch writes its rows, its sums and last its commit marker, each
under its own id; readers see marked batches only, so a batch that failed half
way, or comes again, changes nothing twice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm.words import Words

WORDS = "words/1"
BPE = "byte_bpe_50k/1"
BPE_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer that goes with the vocabulary file.
BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
KEYS = ["source", "lang", "tokenizer"]
_ENTRY = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"


def load_ranks(path: str = BPE_FILE) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def _count(versions: list[str], ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = None
        if BPE in versions:
            bpe = tiktoken.Encoding(BPE, pat_str=BPE_PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            texts = batch.column("text")
            counts = []
            for v in versions:
                if v == WORDS:
                    counts.append(pa.array(Words(texts).counts, pa.int64()))
                else:
                    counts.append(pa.array([len(bpe.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int64()))
            keep = [batch.column(c) for c in ("doc_id", "source", "lang", "op", "seq")]
            yield pa.RecordBatch.from_arrays([*keep, *counts], names=["doc_id", "source", "lang", "op", "seq", *[f"n{k}" for k in range(len(versions))]])

    return run


class TokenRollups:
    """Rollups below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, versions: tuple[str, ...] = (WORDS, BPE), bpe_file: str = BPE_FILE):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), list(versions)
        if unknown := set(versions) - {WORDS, BPE}:
            raise ValueError(f"unknown tokenizer versions: {sorted(unknown)}")
        self.ranks = spark.sparkContext.broadcast(load_ranks(bpe_file)) if BPE in versions else None

    def committed(self) -> list[str]:
        """Ids of marked batches."""
        spark = self.spark
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        return sorted(r.id for r in spark.read.schema("id string").parquet(f"{self.path}/commits/*").distinct().collect())

    def _read(self, kind: str, batches: list[str], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{b}" for b in batches])

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` as ``batch``; False if it was committed before.

        Columns: doc_id, source, lang, text, op (insert, revise or delete), seq.
        An insert of a known document is a revision, a revision of an unknown one
        an insert, a delete of an unknown one nothing. Of several changes to a
        document the one with the largest seq counts; ties go to deletes, then to
        the largest counts, so repeated rows count once. Without id a row is an
        insert of its own, or, as a delete, nothing. Null texts have no tokens;
        null sources and languages are groups. Other columns are ignored.
        """
        before = self.committed()
        if batch in before:
            return False
        src = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            F.col("text").cast("string").alias("text"), F.col("op").cast("string").alias("op"), F.col("seq").cast("long").alias("seq"))
        src = src.withColumn("text", F.when(F.col("op") != "delete", F.col("text")))
        n = [f"n{k}" for k in range(len(self.versions))]
        counted = src.mapInArrow(_count(self.versions, self.ranks), "doc_id long, source string, lang string, op string, seq long, " + ", ".join(f"{c} long" for c in n))
        counted = counted.withColumn("deletes", F.col("op") == "delete")
        rank = F.struct("seq", "deletes", *n, "source", "lang")
        last = counted.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(rank).alias("last")).select("doc_id", "last.*")
        nameless = counted.filter("doc_id IS NULL AND NOT deletes").select("doc_id", "seq", "deletes", *n, "source", "lang")
        now = last.filter("NOT deletes").unionByName(nameless)
        pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(c).alias("tokens")) for v, c in zip(self.versions, n)]))
        added = now.select("doc_id", "source", "lang", pairs.alias("p")).select("doc_id", "source", "lang", "p.tokenizer", F.lit(1).cast("long").alias("docs"), "p.tokens")
        if before:
            old = self._read("rows", before, _ENTRY).join(last.select("doc_id"), "doc_id", "left_semi")
            held = old.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")
            added = added.unionByName(held.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        added.write.mode("overwrite").parquet(f"{self.path}/rows/{batch}")
        sums = self._read("rows", [batch], _ENTRY).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/{batch}")
        self.spark.createDataFrame([(batch,)], "id string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over all committed batches; groups without documents are left out."""
        sums = self._read("sums", self.committed(), "source string, lang string, tokenizer string, docs long, tokens long")
        return sums.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")

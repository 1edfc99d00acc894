"""A training corpus from raw documents: toxicity, near duplicates, decontamination, secrets, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written
as Parquet and reread as the next stage's documents. All but the last return the
columns of ``docs``; rows and columns a stage does not decide on pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import decontaminate, hyperminhash, mixing, secrets, toxicity
from rowsmith.llm.frames import table, written

TOXIC = 0.3
BENCHMARK_WORDS = 10
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The input rows in ``row``, with a new text and, where there is a column of lengths, its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below ``TOXIC``, learned from the labels that the operator may see. Null texts score as empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, one with the smallest id, whether ids repeat, are missing or not. Documents without words stay."""
    rows = hyperminhash.row_classes(docs, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT).filter("first")
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that benchmark windows cover; every document stays."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), size=BENCHMARK_WORDS)
    return _with_text(found, docs.columns, "clean")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; every document stays."""
    found = secrets.find_secrets(docs)
    found = found.withColumn("clean", secrets.redacted(F.col("row.text"), F.col("spans")))
    return _with_text(found, docs.columns, "clean")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: ``doc_id, size, source, source_size, target, taken``."""
    return mixing.mix(docs)[1]


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmarks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The stages learn a model and hash; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

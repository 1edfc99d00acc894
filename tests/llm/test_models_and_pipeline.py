import numpy as np
import pyarrow as pa
from llm_cases import ROWS, documents, empty, prose
from pyspark.sql import functions as F

from rowsmith.llm import quality, queries, toxicity
from rowsmith.llm.fitting import Logistic, labelled_sample

SF = "/root/testdata/sf0.1"


def _held_out(spark, scores, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = scores.filter("held_out").join(labels, "doc_id").toPandas()
    a, b = rows[rows[label] == 1], rows[rows[label] == 0]
    rank = rows.score.rank()
    auc = (rank[rows[label] == 1].sum() - len(a) * (len(a) + 1) / 2) / (len(a) * len(b))
    return auc, a.predicted.mean(), b.predicted.mean()


def test_toxicity_on_held_out_rows(spark):
    """These 329 toxic labels show few of the words of two languages; more labels give 0.99 and more."""
    auc, caught, wrong = _held_out(spark, queries.op2_toxicity(spark, SF), "toxic")
    assert auc > 0.9 and caught > 0.75 and wrong < 0.03


def test_quality_on_held_out_rows(spark):
    auc, kept, wrong = _held_out(spark, queries.op3_quality(spark, SF), "quality")
    assert auc > 0.98 and kept > 0.98 and wrong < 0.15


def test_models_on_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, 1, None), (8, 0, 1), (9, None, 0), (10, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        got = module.scored(documents(spark), labels).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert by[2] == by[3] and len(by[11]) == 1  # null as empty; repeated rows alike
        assert module.scored(empty(spark), labels).collect() == []
        # without labels every text gets the same share
        assert len({r.score for r in module.scored(documents(spark), labels.limit(0)).collect()}) == 1


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for module, label, folds, fold in ((toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)):
        spoiled = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = ({r.doc_id: r.score for r in module.scored(docs, x).collect()} for x in (labels, spoiled))
        assert a == b


def test_sample_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (3, "d"), (3, "c"), (4, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    for n in (1, 4):
        sample, totals = labelled_sample(docs.repartition(n), labels, "toxic", 1, 5, 10, 100)
        assert sample.text.tolist() == ["a", "c", "e"] and totals == {0: 1, 1: 2}


def test_telling_passages_ignore_copies():
    ordinary = [prose(k, 80).encode() for k in range(60)]
    toxic = [prose(100 + k, 80).encode() + b" you zorblax " + prose(k, 5).encode() + b" zorblax" for k in range(30)] + [prose(999, 80, 100_000).encode()] * 30
    found = [g for g, _ in toxicity.telling_passages(toxic, ordinary)]
    assert any(g in b" zorblax" for g in found) and not any(g in t for g in found for t in ordinary)


def test_gradient_of_attention_model():
    import pandas as pd

    texts = [prose(k, 150) if k % 2 else "SHOUT!! " * 100 + prose(k, 100) for k in range(60)]
    model = quality.AttentionModel(pd.DataFrame({"text": texts, "label": [k % 2 for k in range(60)]}), {0: 30, 1: 30})
    p = model.predict(pa.array([*texts, None, ""]))
    assert (p[:60:2] < 0.3).all() and (p[1:60:2] > 0.7).all() and p[60] == p[61]


def test_logistic_recovers_odds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x[:, 0] - 1)))).astype(float)
    p = Logistic(x, y, np.ones(4000)).predict(np.array([[1.0, 0.0], [3.0, 0.0]]))
    assert abs(p[0] - 0.5) < 0.06 and abs(p[1] - 0.88) < 0.06


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.withColumns({"row": F.lit("clash"), "spans": F.lit("clash"), "clean": F.lit("clash"), "key": F.lit("clash")})
    at = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == extra.columns, name
        out.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getCheckpointDir()}/stage-{name}")
        at = spark.read.parquet(path)
        assert at.count() <= docs.count()
        if name in ("decontamination", "secrets"):
            assert at.count() == kept
        kept = at.count()
    assert at.filter("n_chars <> length(text)").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert mixed.count() == kept
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, mixed.collect()))


def test_pipeline_stages_on_awkward_and_empty_documents(spark, tmp):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    for at in (documents(spark), empty(spark)):
        n = at.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, tmp)
            if name != "mixing":
                assert out.columns == at.columns
            out = spark.createDataFrame(out.collect(), out.schema)
            assert out.count() <= n
            if n:
                assert out.filter("doc_id = 2").count() == 1  # the null text stays
            at = out

import numpy as np
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from mdframes.llm.quality import WIDTH, _cut, _pairs, features, fit, held_out, keep_good, quality, rank

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality(docs, labels).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.95
    assert got.where("(score >= 0.7) <> (predicted = 1)").count() == 0


def test_awkward_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs, labels, ~held_out())
    rows = rank(documents(spark, AWKWARD), model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[0] == by[1] == by[2] and by[5] == by[6]
    assert rank(documents(spark, []), model).count() == 0


def test_without_labels_everything_stays(spark):
    docs = documents(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 0), (4, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert keep_good(docs, labels).count() == len(AWKWARD)


def test_bad_documents_go(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    marked = kept.join(labels, "doc_id").groupBy("quality").count().collect()
    by = {r[0]: r[1] for r in marked}
    assert by.get(0, 0) <= 0.1 * labels.where("quality = 0").count() and by[1] >= 0.97 * labels.where("quality = 1").count()


def test_every_labelled_document_takes_part(spark):
    """Statistics, pairs and threshold come from all rows: more rows of a class than any sample, and a rare other class."""
    n, few = 500, 3
    texts = [f"word{k} runs on" for k in range(n)] + ["!!! ||| $$$"] * few
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k < n)) for k in range(n + few)], "doc_id long, quality int")
    rows = docs.select("doc_id", "text").join(labels, "doc_id").select("doc_id", "quality", F.array(*[F.col("doc_id").cast("double")] * WIDTH).alias("x"))
    pairs = _pairs(rows, 1, {1: n, 0: few}, 2).select(F.col("good")[0], F.col("bad")[0]).toArrow()
    assert sorted(pairs.column(0).to_pylist()) == sorted([float(k) for k in range(n)] * 2)
    assert set(pairs.column(1).to_pylist()) == {float(k) for k in range(n, n + few)}
    model = fit(docs, labels, F.lit(True))
    x = np.array([features(t) for t in texts])
    assert np.allclose(model.centre, x.mean(axis=0), atol=1e-9) and np.allclose(model.spread, np.maximum(x.std(axis=0), 1e-6), atol=1e-9)
    raw = np.sort(model.raw(x))
    assert np.isclose(model.cut, (raw[few - 1] + raw[few]) / 2)


def test_threshold_between_ranks(spark):
    values = [float(v) for v in range(1000)] + [2.5] * 7
    raw = spark.createDataFrame([(v,) for v in values], "raw double")
    for k in (0, 2, 4, 9, 500, len(values) - 1):
        order = sorted(values)
        assert _cut(raw, k) == (order[k] + order[min(k + 1, len(order) - 1)]) / 2

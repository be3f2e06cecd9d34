from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from mdframes.llm.language import fit, held_out, identify, keep_identified, language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.98


def test_awkward_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit(docs, ~held_out(), 200)
    rows = {r["doc_id"]: r for r in identify(documents(spark, AWKWARD), model).collect()}
    for i, t in enumerate(AWKWARD):
        letters = t is not None and any(c.isalpha() for c in t)
        assert (rows[i]["lang_pred"] == "und") == (not letters) and 0 <= rows[i]["score"] <= 1
        assert rows[i]["rejected"] or letters
    assert identify(documents(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = documents(spark, ["some text", "more text"], langs=[None, None])
    assert [r["lang_pred"] for r in language_id(docs).collect()] == ["und", "und"]
    assert language_id(documents(spark, [])).count() == 0


def test_rejected_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = documents(spark, ["12345 67890", None, "!!! ???"], [900001, 900002, 900003]).select(*docs.columns)
    kept = keep_identified(docs.unionByName(extra))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not ids & {900001, 900002, 900003} and len(ids) >= 0.97 * docs.count()


def test_texts_of_no_learned_language_are_rejected(spark):
    import random
    random.seed(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters = "bcdfghjklmnpqrstvwxzaeiouy"
    noise = ["".join(random.choices(letters, k=random.randint(2, 9))) for _ in range(4000)]
    gibberish = documents(spark, [" ".join(noise[i:i + 80]) for i in range(0, 4000, 80)])
    for learned in (["en"], ["en", "fr"], ["en", "fr", "es"]):
        model = fit(docs, F.col("lang").isin(learned) & ~held_out())
        rows = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out())
        share = dict(rows.groupBy(F.col("lang").isin(learned)).agg(F.avg(F.col("rejected").cast("int"))).collect())
        assert share[True] <= 0.03 and share[False] >= 0.9, (learned, share)
        assert identify(gibberish, model).where("rejected").count() >= 48


def test_a_thousand_texts_of_a_language_are_learned_from():
    import inspect
    assert all(inspect.signature(f).parameters["per_language"].default == 1000 for f in (fit, language_id, keep_identified))

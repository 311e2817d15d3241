"""Language profiles: held-out accuracy, exact vector algebra, edges."""

import numpy as np
from pyspark.sql import functions as F

from assayloom.llm.common import fold
from assayloom.llm import language
from assayloom.llm.language import GRAM, bundles, classify, gram_vectors, identify, learn_prototypes

SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs, ["doc_id", "lang", "n_chars"])
    right = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.98 and right[1] > 200 and 0 <= right[2] <= right[3] <= 1
    assert got.count() == docs.count()


def test_document_vector_is_the_sum_of_bound_letters():
    d = 64
    v = gram_vectors(d)
    letter = lambda c, k: v.turned[k][{" ": 0}.get(c) or (ord(c) - 96 if c != " " else 0)]
    padded = " ab a "
    want = sum(np.prod([letter(padded[i + k], k) for k in range(GRAM)], axis=0) for i in range(len(padded) - GRAM + 1))
    assert (bundles(["Ab,  a"], d)[0] == want).all()


def test_prototypes_add_up_over_tasks(spark):
    rows = [(k, f"text {k} abc", "en" if k % 2 else "fr") for k in range(40)]
    one, many = (learn_prototypes(spark.createDataFrame(rows, SCHEMA).repartition(n), 128) for n in (1, 7))
    assert one[0] == many[0] == ["en", "fr"] and (one[1] == many[1]).all()


def test_edges(spark):
    train = [(k, "the cat sat on the mat", "en") for k in range(30)] + [(k, "le chat est sur la table", "fr") for k in range(30, 60)]
    odd = [(100, None, "en"), (101, "", "fr"), (102, "123 !? \n", "en"), (103, "the mat", None), (None, "le chat", None), (104, "the " * 50_000, "en"), (105, "日本", "en"), (106, "x", None), (106, "x", None)]
    got = identify(spark.createDataFrame(train + odd, SCHEMA), ["doc_id", "text"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[k][0].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and [by[k][0].score for k in (100, 101, 102)] == [0.0] * 3
    assert by[103][0].lang_pred == "en" and by[None][0].lang_pred == "fr" and by[104][0].lang_pred == "en" and len(by[106]) == 2
    assert by[105][0].lang_pred in ("en", "fr") and not by[None][0].held_out
    assert identify(spark.createDataFrame([], SCHEMA), ["doc_id"]).collect() == []


def test_nothing_to_learn_from(spark):
    got = identify(spark.createDataFrame([(1, "abc", None), (2, None, "en")], SCHEMA), ["doc_id"]).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def test_predictions_do_not_see_lang_and_columns_stay(spark):
    docs = spark.createDataFrame([(k, "the cat" if k % 2 else "le chat", "en" if k % 2 else "fr", 1.5, "p") for k in range(30)], SCHEMA + ", score double, lang_pred string")
    langs, protos = learn_prototypes(docs.where(fold("doc_id", 3) != 1))
    a = classify(docs, langs, protos, "pred", "cos")
    b = classify(docs.withColumn("lang", F.lit("xx")), langs, protos, "pred", "cos")
    assert a.columns == [*docs.columns, "pred", "cos"]
    key = lambda df: sorted((r.doc_id, r.pred, r.cos, r.score, r.lang_pred) for r in df.collect())
    assert key(a) == key(b)


def test_vectors_beyond_those_kept_are_the_same(monkeypatch):
    grams = np.arange(0, 3000, 7)
    want = language.GramVectors(64).of(grams)
    monkeypatch.setattr(language, "KEPT", 100)
    few = language.GramVectors(64)
    assert np.array_equal(few.of(grams), want) and np.array_equal(few.of(grams[::-1]), want[::-1]) and few.used == 100

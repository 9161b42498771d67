import corpus
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import langid


def rows():
    return corpus.documents(seed=11, count=240)


def test_held_out_accuracy(spark, tmp_path):
    every = rows()
    gold = {d: x for d, t, x, *_ in every}
    found = langid.op1_language(spark, corpus.saved(spark, tmp_path, every)).collect()
    assert len(found) == len(every) and {r.lang_pred for r in found} <= {"en", "de", "fr", "und"}
    judged = [r.lang_pred == gold[r.doc_id] for r in found if r.held_out and gold[r.doc_id] and r.lang_pred != "und"]
    assert len(judged) > 40 and sum(judged) / len(judged) >= 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_ids_and_labels_are_no_inputs(spark):
    df = corpus.frame(spark, rows())
    model = langid.train(df.where(~langid.held_out()))
    first = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    other = langid.identify(df.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit(1).alias("score")), model).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in other} == first
    same = {}
    for d, t, *_ in rows():
        assert same.setdefault(t, first[d]) == first[d]


def test_texts_without_letters(spark):
    df = corpus.frame(spark, rows())
    model = langid.train(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "é"), (5, "the and " * 50_000)], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] != "und" and found[5][0] == "en"
    assert langid.identify(odd.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    df = corpus.frame(spark)
    for empty in (df.limit(0), df.withColumn("lang", F.lit(None).cast("string"))):
        model = langid.train(empty)
        assert {(r.lang_pred, r.score) for r in langid.identify(df, model).collect()} == {("und", 0.0)}


def test_a_language_of_long_texts_alone_is_learnt(spark):
    long = [(k, " ".join(f"zyq{j % 7}wu" for j in range(k, k + 400)), "zz") for k in range(12)]
    df = corpus.frame(spark, rows()).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(long, "doc_id long, text string, lang string"))
    model = langid.train(df, fit_chars=1000)
    assert "zz" in model.languages and model.predict([long[0][1]])[0] == ["zz"]
    assert langid.train(df, grams=50).kernel.tables[4][1] <= 50


def test_letters():
    assert langid.letters("Ab1c, É") == " ab c é ".encode() and langid.letters(" 1") is None
    with pytest.raises(AttributeError):
        langid.letters(5)

import numpy as np
from pyspark.sql import functions as F

from sondage.llm import language_id as li
from sondage.llm import language_model

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang", F.lit("x").alias("score"))
    held = language_model.is_fold("doc_id", 5, 0)
    model = li.fit(docs.where(~held), rows_a_language=60)
    out = li.predict(docs, model).join(docs, "doc_id").where(held).toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.95
    assert (model.weights == 0).mean() > 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? "), (None, "der die und schtz"), (4, "the and " * 9000), (4, "the and " * 9000)], "doc_id long, text string")
    rows = li.predict(odd, model).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and [r.score for r in rows[:3]] == [0.0] * 3
    assert [r.lang_pred for r in rows[3:]] == ["de", "en", "en"] and all(0.25 <= r.score <= 1 for r in rows[3:])
    assert li.predict(odd.limit(0), model).count() == 0
    none = li.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in li.predict(odd, none).collect()} == {"und"}


def test_batches_equal_single_texts(spark):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(li._SIZE, 2)).astype(np.float32)
    texts = ["", "a", "Ab c", "über 漢字 😀", "x" * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.logits for r in li._logits(docs, li.LanguageId(["p", "q"], weights, 1.0), "doc_id", "long").collect()}
    letters = li.letter_table()
    for i, text in enumerate(texts):
        ids, share = li.text_features(text, letters)
        assert np.allclose(got[i], share @ weights[ids].astype(float), atol=1e-5)


def test_ftrl_is_sparse_and_learns():
    z, n = np.zeros((3, 2)), np.zeros((3, 2))
    for i in range(200):
        li.ftrl_step(z, n, np.array([0, 2]), np.array([1.0, 1e-6]), 0)
        li.ftrl_step(z, n, np.array([1, 2]), np.array([1.0, 1e-6]), 1)
    w = li.ftrl_weights(z, n)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and (w[2] == 0).all()


def test_only_letters_of_any_plane_count(spark):
    letters = li.letter_table()
    assert all(letters[c] == chr(c).isalpha() for c in [*range(0xFFF0, 0x20000), 0x2A6D6, 0x10FFFF])
    weights = np.random.default_rng(3).normal(size=(li._SIZE, 2)).astype(np.float32)
    texts = ["\U0001F600", "\U0001F600 12 \U0001D7D8", "\uffff", "\U00020000", "a \U0001F600 b", "a   b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = li.LanguageId(["p", "q"], weights, 1.0)
    rows = {r.doc_id: r for r in li.predict(docs, model).collect()}
    assert [(rows[i].lang_pred, rows[i].score) for i in range(3)] == [("und", 0.0)] * 3
    assert all(rows[i].lang_pred in ("p", "q") and rows[i].score >= 0.5 for i in (3, 4))
    assert rows[4].score == rows[5].score

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import language_model, quality_classifier as qc

SF = "/root/testdata/sf0.01"


def test_score_equals_the_formula(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    features = qc.with_features(docs).drop("text").cache()
    model = qc.fit(features, labels)
    rows = features.join(labels, "doc_id").toPandas()
    x, y = rows[list(qc.FEATURES)].to_numpy(), rows["quality"].to_numpy()
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * cov[c] for c in (0, 1))
    density = []
    for c in (0, 1):
        s = (1 - qc.POOLED) * cov[c] + qc.POOLED * pooled + qc.RIDGE * np.trace(pooled) / len(pooled) * np.eye(len(pooled))
        d = x - x[y == c].mean(0)
        density.append(math.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d))
    expected = density[1] - density[0]
    got = features.select("doc_id", model.log_odds().alias("odds")).join(labels, "doc_id").toPandas().set_index("doc_id").loc[rows["doc_id"], "odds"]
    assert np.allclose(got.to_numpy(), expected, rtol=1e-6, atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = language_model.is_fold("doc_id", 5, 0)
    features = qc.with_features(docs).drop("text").cache()
    model = qc.fit(features.where(~held), labels)
    test = features.where(held).select("doc_id", model.score().alias("score")).join(labels, "doc_id").toPandas()
    assert ((test["score"] >= 0.3) == (test["quality"] == 1)).mean() > 0.97
    assert test["score"].between(0, 1).all()


def test_edges(spark):
    rows = [(None, None, 3.0), (1, "", 1.0), (2, "a b " * 5000, 1.0), (2, "a b " * 5000, 1.0), (3, "#" * 20_000, 0.0), (4, "Ein Satz. Noch einer!", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words double")
    features = qc.with_features(docs)
    assert features.count() == 6
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (9, 1), (4, 1), (4, 1)], "doc_id long, quality int")
    for some in (labels, labels.where("quality = 1"), labels.limit(0)):
        model = qc.fit(features, some)
        scores = [r[0] for r in features.select(model.score()).collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert features.limit(0).select(model.score()).count() == 0
    twins = qc.with_counts(spark.createDataFrame([("Of Of the thee and and",)], "text string")).first()
    assert (twins["n_twins"], twins["n_words"], twins["n_distinct"]) == (2, 6, 4)

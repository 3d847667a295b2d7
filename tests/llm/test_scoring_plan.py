import numpy as np
from pyspark.sql import functions as F

from sondage.llm import quality_classifier as qc


def _model():
    rng = np.random.default_rng(4)
    d = len(qc.FEATURES)
    inverse = [np.linalg.inv(np.linalg.cholesky(np.cov(rng.normal(size=(d, 4 * d))) + np.eye(d))) for _ in range(2)]
    return qc.Discriminant([rng.normal(size=d) for _ in range(2)], inverse, [0.25, -1.5], temperature=1.5)


def test_a_filter_on_the_score_counts_once(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "x")], "doc_id long, text string")
    kept = qc.with_features(docs).where(_model().score() >= 0.3)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 7  # the words and six counted patterns, each once
    assert len(plan) < 10_000
    assert len(_model().score()._jc.toString()) < 10_000


def test_score_is_the_one_of_numpy(spark):
    model = _model()
    texts = ["", "One two, two three!\nOne two, two three!", "# * $ 1 2 3", "Ä é ß", "a b " * 300, None]
    features = qc.with_features(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = features.select("doc_id", *qc.FEATURES, model.log_odds().alias("odds"), model.score().alias("score"), F.col("text")).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == texts
    x = np.array([[r[f] for f in qc.FEATURES] for r in rows])
    sides = [o - 0.5 * (((x - m) @ np.tril(a).T) ** 2).sum(1) for m, a, o in zip(model.means, model.inverse, model.offset)]
    odds = sides[1] - sides[0]
    assert np.allclose([r["odds"] for r in rows], odds, rtol=1e-12)
    assert np.allclose([r["score"] for r in rows], 1 / (1 + np.exp(-odds / 1.5)), rtol=1e-12)

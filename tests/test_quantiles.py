import numpy as np

from sondage.operators import stats


def test_quantiles_are_exact_and_held_by_no_aggregate(spark):
    random = np.random.default_rng(5)
    values = {"a": random.normal(size=997).tolist(), "b": random.integers(0, 4, 300).astype(float).tolist(), None: [2.5], "c": []}
    rows = [(k, v) for k, vs in values.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.97, 1.0]
    for buckets in (2, 7, 1024):
        out = stats.quantiles(df, ["k"], "v", shares, buckets=buckets)
        got = {r.k: r.quantiles for r in out.collect()}
        assert set(got) == set(values) and got["c"] is None
        for k in ("a", "b", None):
            np.testing.assert_allclose(got[k], np.quantile(values[k], shares), atol=1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan  # which holds every distinct value of a key in one buffer


def test_deciles_round(spark):
    df = spark.createDataFrame([(i / 3,) for i in range(11)], "v double")
    (row,) = stats.deciles(df.selectExpr("1 AS k", "v"), ["k"], "v").collect()
    assert tuple(row)[1:] == tuple(round(i / 3, 6) for i in range(11))
    assert stats.deciles(df.selectExpr("1 AS k", "v").limit(0), ["k"], "v").collect() == []

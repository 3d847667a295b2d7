"""Ridge, leave-one-out, rotations and canonical correlations against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import linear

X, Y = ["a", "b", "c"], ["y", "z"]


def data(n=40, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 20, 0.01] + [5, -300, 0]
    y = x @ rng.normal(size=(3, 2)) * [1, 0.1] + rng.normal(size=(n, 2)) + [1000, 0]
    return x, y


def frame(spark, x, y, more=()):
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame([*rows, *more], "id int, " + ", ".join(f"{c} double" for c in X + Y)).repartition(3)


def plain(x, y, penalty, mean, scale):
    d = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    eye = penalty * np.eye(4)
    eye[3, 3] = 0
    return np.linalg.solve(d.T @ d + eye, d.T @ y), d


@pytest.mark.parametrize("penalty", [0.0, 0.5, 30.0])
def test_ridge_and_leaving_out_equal_refits(spark, penalty):
    x, y = data()
    odd = [(98, None, 1.0, 1.0, 1.0, 1.0), (99, 1.0, float("nan"), 1.0, 1.0, 1.0), (97, 1.0, 1.0, 1.0, None, 1.0)]
    df = frame(spark, x, y, odd)
    model = linear.fit_ridge(df, X, Y, penalty)
    w, d = plain(x, y, penalty, x.mean(0), x.std(0))
    got = {r.id: r for r in df.select("id", *[c.alias(f"p_{t}") for t, c in model.predictions().items()], *[c.alias(f"o_{t}") for t, c in model.left_out().items()]).collect()}
    fitted = d @ w
    for i in range(len(x)):
        assert (got[i].p_y, got[i].p_z) == pytest.approx(tuple(fitted[i]), rel=1e-8)
        rest = np.arange(len(x)) != i
        without, _ = plain(x[rest], y[rest], penalty, x.mean(0), x.std(0))
        assert (got[i].o_y, got[i].o_z) == pytest.approx(tuple(d[i] @ without), rel=1e-7)
    assert got[98].p_y is None and got[99].p_y is None and got[97].p_y is not None and got[97].o_y is None


def test_constant_features_and_no_rows(spark):
    x, y = data()
    x[:, 2] = 7
    model = linear.fit_ridge(frame(spark, x, y), X, Y, 1.0)
    assert model.weights[2].tolist() == [0, 0]
    empty = linear.fit_ridge(frame(spark, x, y).limit(0), X, Y, 1.0)
    assert empty.n == 0 and not empty.weights.any()


def test_penalty_curve_and_its_best(spark):
    x, y = data()
    df = frame(spark, x, y - y.mean(0))
    grid = [1e-3, 1.0, 50.0]
    curve = linear.penalty_curve(df, X, Y, grid)
    rows = {r.penalty: r for r in curve.collect()}
    cosines = {}
    for penalty in grid:
        out = linear.fit_ridge(df, X, Y, penalty).left_out()
        guess = np.array([list(r)[1:] for r in sorted(df.select("id", *[out[t].alias(t) for t in Y]).collect())])
        t = y - y.mean(0)
        cosines[penalty] = (guess * t).sum(1) / np.linalg.norm(guess, axis=1) / np.linalg.norm(t, axis=1)
        assert rows[penalty].median_cosine == pytest.approx(np.median(cosines[penalty]))
        assert rows[penalty].mean_cosine == pytest.approx(cosines[penalty].mean())
        assert rows[penalty].mean_squared_error == pytest.approx(((guess - t) ** 2).mean())
    assert linear.best_penalty(curve) == max(grid, key=lambda p: (np.median(cosines[p]), -p))


def test_planted_rotation_of_embeddings_is_recovered(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    source = [f"s{i}" for i in range(8)]
    df = df.select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(source)])
    q, _ = np.linalg.qr(np.random.default_rng(4).normal(size=(8, 8)))
    turned = linear.rotated([F.col(c) for c in source], q)
    df = df.select("*", *[c.alias(f"t{i}") for i, c in enumerate(turned)])
    found = linear.orthogonal_map(df, source, [f"t{i}" for i in range(8)])
    assert np.abs(found - q).max() < 1e-6


def test_covariances_turn_with_the_axes(spark):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    s = np.cov(rng.normal(size=(3, 9)))
    row = spark.createDataFrame([(s.ravel().tolist(),)], "s array<double>").select(linear.rotated_covariance(F.col("s"), q).alias("t")).first()
    assert np.reshape(row.t, (3, 3)) == pytest.approx(q.T @ s @ q)


def test_canonical_correlations_equal_those_of_orthonormal_bases(spark):
    x, y = data()
    y[:, 0] = x[:, 0] * 2 + 1  # one pair is the same up to scale
    df = frame(spark, x, y)
    a, b = x - x.mean(0), y - y.mean(0)
    want = np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False)
    assert linear.canonical_correlations(df, X, Y) == pytest.approx(want, abs=1e-6)
    assert linear.canonical_correlations(df.limit(0), X, Y).tolist() == [0, 0]


def test_penalties_do_not_multiply_rows(spark):
    df = spark.range(200).selectExpr("cast(id % 7 as double) a", "cast(id * 0.5 + id % 3 as double) y")
    curve = linear.penalty_curve(df, ["a"], ["y"], [0.1, 10.0, 0.1])
    assert sorted(r.penalty for r in curve.collect()) == [0.1, 10.0]
    plan = curve.select("penalty", "mean_squared_error")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the rows are added up below
    assert "percentile" not in plan and "median" not in plan
    assert linear.penalty_curve(df.limit(0), ["a"], ["y"], [0.1]).count() == 0

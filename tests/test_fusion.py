"""Draws, coverage and the fusion of scores, against plain numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import coverage, fusion, graded


def uniform(*parts):
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16], 16) / 2**64


def plain_normal(*parts):
    return math.sqrt(-2 * math.log(1 - uniform(*parts, "r"))) * math.cos(2 * math.pi * uniform(*parts, "a"))


def test_draws_are_hashes_and_normal(spark):
    rows = spark.range(300).select("id", coverage.normal_draws(F.col("id"), 4, 2, seed=9).alias("z")).collect()
    for r in rows[:5]:
        assert r.z == [pytest.approx([plain_normal(9, r.id, i, j) for j in range(2)]) for i in range(4)]
    z = np.array([r.z for r in rows]).reshape(-1)
    assert abs(z.mean()) < 4 / math.sqrt(len(z)) and abs(z.std() - 1) < 4 / math.sqrt(2 * len(z))


def test_draws_follow_a_covariance_and_predictions_average_over_them(spark):
    s = np.array([[1.0, 0.6], [0.6, 0.5]])
    flat = [[0.0, 0.0], [0.0, 0.0]]
    people = spark.createDataFrame([("a", [0.5, -1.0], s.ravel().tolist()), ("b", [0.2, 0.1], np.ravel(flat).tolist())], "pid string, theta array<double>, covariance array<double>")
    items = spark.createDataFrame([(1, [1.0, 0.3], [-0.5, 0.4, 1.0, 2.0]), (2, [-0.7, 1.0], [0.1])], "item_id int, loadings array<double>, cuts array<double>")
    factored = {r.pid: r.factor for r in coverage.with_factor(people.where("pid = 'a'"), "covariance", 2).collect()}
    lower = np.linalg.cholesky(s)
    assert np.reshape(factored["a"], (2, 2)) == pytest.approx(lower)
    got = {(r.pid, r.item_id): r.p for r in coverage.posterior_predictions(people.where("pid = 'a'"), items, 2, n_draws=50, seed=3).collect()}
    z = np.array([[plain_normal(3, "a", i, j) for j in range(2)] for i in range(50)])
    theta = np.array([0.5, -1.0]) + z @ lower.T
    for item, a, cuts in ((1, [1.0, 0.3], [-0.5, 0.4, 1.0, 2.0]), (2, [-0.7, 1.0], [0.1])):
        up = np.concatenate([np.ones((50, 1)), 1 / (1 + np.exp(-(theta @ a)[:, None] + np.array(cuts))), np.zeros((50, 1))], 1)
        assert got["a", item] == pytest.approx((up[:, :-1] - up[:, 1:]).mean(0).tolist())
    still = {r.pid: r.factor for r in coverage.with_factor(people, "covariance", 2).collect()}
    assert np.abs(np.reshape(still["b"], (2, 2))).max() < 1e-4
    assert np.reshape(still["a"], (2, 2)) @ np.reshape(still["a"], (2, 2)).T == pytest.approx(s, abs=1e-6)


def test_coverage_of_planted_normals(spark):
    n = 20_000
    cells = spark.range(n).select((F.col("id") % 2).alias("dim"), F.lit(0.0).alias("centre"), F.lit(2.0).alias("spread"), (2 * coverage.normal(F.lit("planted"), F.col("id"))).alias("truth"))
    cells = cells.unionByName(spark.createDataFrame([(0, None, 1.0, 1.0), (1, 1.0, None, 1.0)], "dim long, centre double, spread double, truth double"))
    row = coverage.honesty(cells).first()
    assert row.cells == n and row["pass"] and abs(row.coverage - 0.6827) < 4 * math.sqrt(0.683 * 0.317 / n)
    assert row.variance_ratio == pytest.approx(1, abs=0.04) and row.nominal_factor == pytest.approx(0.9945, abs=0.03)
    assert sum(r.cells for r in coverage.honesty(cells, ["dim"]).collect()) == n


def test_calibration_factors(spark):
    rng = np.random.default_rng(1)
    full, centre, spread = rng.normal(size=(30, 2)), rng.normal(size=(30, 2)), rng.uniform(0.2, 1, (30, 2))
    rows = [(i, d, float(centre[i, d]), float(spread[i, d]), float(full[i, d])) for i in range(30) for d in range(2)]
    got = {r.dim: r.kappa for r in coverage.calibration(spark.createDataFrame(rows, "pid int, dim int, centre double, spread double, full double"), ["dim"]).collect()}
    kappa = np.sqrt(((centre - full) ** 2).mean(0)) / np.sqrt((spread**2).mean(0))
    assert [got[0], got[1]] == pytest.approx(kappa.tolist())
    s = spark.createDataFrame([([4.0, 1.0, 1.0, 9.0],)], "s array<double>").select(coverage.calibrated_covariance(F.col("s"), [2.0, 0.5]).alias("t")).first()
    assert s.t == [16.0, 1.0, 1.0, 2.25]


def test_low_rank_density_equals_the_dense_one():
    rng = np.random.default_rng(2)
    own, factor, x = rng.uniform(0.3, 2, 7), rng.normal(size=(7, 2)), rng.normal(size=(5, 7))
    dense = np.diag(own) + factor @ factor.T
    want = [-0.5 * (v @ np.linalg.solve(dense, v) + np.linalg.slogdet(dense)[1] + 7 * np.log(2 * np.pi)) for v in x]
    assert fusion.log_density(own, factor, x) == pytest.approx(want)
    assert fusion.log_density(own, factor[:, :0], x) == pytest.approx([-0.5 * ((v * v / own).sum() + np.log(own).sum() + 7 * np.log(2 * np.pi)) for v in x])
    found, f = fusion.noise_parts(dense, 2)
    assert np.diag(found) + f @ f.T == pytest.approx(dense, abs=1e-3)


SCORES, TRAITS = [f"y{i}" for i in range(6)], ["t0", "t1"]


def scored(n=150, seed=6):
    rng = np.random.default_rng(seed)
    t, b = rng.normal(size=(n, 2)), rng.normal(size=(6, 2))
    y = t @ b.T + rng.normal(size=(n, 1)) @ rng.normal(size=(1, 6)) + 0.5 * rng.normal(size=(n, 6)) + np.arange(6)
    return t, y


def table(spark, t, y):
    rows = [(f"p{i:03d}", *map(float, y[i]), *map(float, t[i])) for i in range(len(t))]
    return spark.createDataFrame(rows, "pid string, " + ", ".join(f"{c} double" for c in SCORES + TRAITS)).repartition(3)


def test_measurement_model_equals_one_from_the_rows(spark):
    t, y = scored()
    df, fold = table(spark, t, y), fusion.hash_fold(F.col("pid"), 5)
    model, curve = fusion.fit_measurement(df, SCORES, TRAITS, fold)
    label = np.array([int(uniform(0, f"p{i:03d}") * 5) for i in range(len(t))])
    z = (y - y.mean(0)) / y.std(0)

    def regress(rows, ridge):
        tc, fc = t[rows] - t[rows].mean(0), z[rows] - z[rows].mean(0)
        b = np.linalg.solve(tc.T @ tc + ridge * np.eye(2), tc.T @ fc).T
        return b, z[rows].mean(0) - b @ t[rows].mean(0)

    for ridge, n_factors, loss in curve:
        total = 0.0
        for k in range(5):
            train, test = np.flatnonzero(label != k), np.flatnonzero(label == k)
            b, c = regress(train, ridge)
            e = z[train] - t[train] @ b.T - c
            own, f = fusion.noise_parts(e.T @ e / len(train), n_factors)
            psi = np.diag(own) + f @ f.T
            p = np.eye(2) + b.T @ np.linalg.solve(psi, b)
            off = t[test] - np.linalg.solve(p, b.T @ np.linalg.solve(psi, (z[test] - c).T)).T
            total += (0.5 * np.einsum("ni,ij,nj->n", off, p, off) - 0.5 * np.linalg.slogdet(p)[1] + np.log(2 * np.pi)).sum()
        assert loss == pytest.approx(total / len(t), rel=1e-8)
    best = min(curve, key=lambda c: c[2])
    assert model.ridge == best[0] and model.factor.shape[1] == best[1] and best[1] >= 1
    b, c = regress(np.arange(len(t)), model.ridge)
    assert model.loading == pytest.approx(b) and model.offset == pytest.approx(c, abs=1e-9)


def test_evidence_in_information_form(spark):
    t, y = scored(n=60)
    df = table(spark, t, y)
    model, _ = fusion.fit_measurement(df, SCORES, TRAITS, fusion.hash_fold(F.col("pid"), 3))
    evidence = model.evidence(df.withColumn("y0", F.when(F.col("pid") != "p007", F.col("y0"))))
    alone = {r.pid: r for r in fusion.scores_only(evidence, model).collect()}
    assert len(alone) == 59
    psi = np.diag(model.own) + model.factor @ model.factor.T
    z = (y - model.centre) / model.scale
    p = np.eye(2) + model.loading.T @ np.linalg.solve(psi, model.loading)
    assert alone["p003"].theta == pytest.approx(np.linalg.solve(p, model.loading.T @ np.linalg.solve(psi, z[3] - model.offset)).tolist())
    assert alone["p003"].covariance == pytest.approx(np.linalg.inv(p).ravel().tolist())
    # with answers: the same posterior as from evidence alone where there are none, and a tighter one where there are
    items = spark.createDataFrame([("q", [1.0, 0.5], [-0.3, 0.2])], "item_id string, loadings array<double>, cuts array<double>")
    cells = spark.createDataFrame([("p003", "q", 2), ("new", "q", 0)], "pid string, item_id string, code int")
    both = {r.pid: r for r in graded.posteriors(cells, items, 2, evidence=evidence).collect()}
    assert len(both) == 60 and both["p004"].n_answers == 0 and both["p004"].theta == pytest.approx(alone["p004"].theta)
    assert both["new"].theta == pytest.approx(graded.posteriors(cells, items, 2).where("pid = 'new'").first().theta)
    theta, shift = np.array(both["p003"].theta), np.array([r.shift for r in evidence.where("pid = 'p003'").collect()][0])
    a, cut = np.array([1.0, 0.5]), 0.2
    slope = (1 - 1 / (1 + np.exp(-(a @ theta - cut)))) * a + shift - p @ theta
    assert np.abs(slope).max() < 1e-8 and np.trace(np.reshape(both["p003"].covariance, (2, 2))) < np.trace(np.linalg.inv(p))


def test_what_cannot_be_fitted(spark):
    t, y = scored(n=20)
    with pytest.raises(ValueError):
        fusion.fit_measurement(table(spark, t, y), SCORES, TRAITS, F.lit(0))
    y[:, 2] = 1
    with pytest.raises(ValueError):
        fusion.fit_measurement(table(spark, t, y), SCORES, TRAITS, fusion.hash_fold(F.col("pid"), 3))

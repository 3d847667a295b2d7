"""Verdicts and accuracy reports against plain figures, and fits turned onto each other."""

import numpy as np
import pytest

from sondage.operators import bars, graded


def test_verdicts(spark):
    metrics = spark.createDataFrame([("max_pair_agreement", 0.95), ("median_pair_agreement", 0.81), ("effective_dimensions", float("nan")), ("retest_agreement", 0.7), ("other", 1.0)], "metric string, value double")
    got = {r.metric: (r["pass"], r.all_pass) for r in bars.verdict(metrics).collect()}
    assert got == {"max_pair_agreement": (True, False), "median_pair_agreement": (False, False), "effective_dimensions": (None, False), "median_obedience": (None, False), "retest_agreement": (True, False)}
    assert all(r.all_pass for r in bars.verdict(metrics, [bars.Bar("other", 1.0, 1.0)]).collect())


def test_accuracy_and_its_bars(spark):
    rng = np.random.default_rng(2)
    truth, centre = rng.normal(size=(40, 2)), rng.normal(size=(40, 2))
    centre[:, 1] = truth[:, 1] + 0.1 * centre[:, 1]
    rows = [(f"d{k}", float(centre[i, k]), float(truth[i, k]), 0.0) for i in range(40) for k in range(2)] + [("d0", None, 1.0, 0.0)]
    report = bars.accuracy(spark.createDataFrame(rows, "dim string, centre double, truth double, baseline double"))
    got = {r.dim: r for r in report.collect()}
    for k, dim in enumerate(("d0", "d1")):
        assert got[dim].rmse == pytest.approx(np.sqrt(((centre - truth)[:, k] ** 2).mean())) and got[dim].corr == pytest.approx(np.corrcoef(centre[:, k], truth[:, k])[0, 1])
    pooled, base = np.sqrt(((centre - truth) ** 2).mean()), np.sqrt((truth**2).mean())
    assert got[None].n == 80 and got[None].lift == pytest.approx(1 - pooled / base)
    row = bars.accuracy_bars(report).first()
    assert (row.worst_dimension, row.passing, row.rmse_pass, row.lift_pass) == ("d0", 1, False, bool(1 - pooled / base >= 0.3))


def test_a_turned_fit_agrees_with_itself(spark):
    rng = np.random.default_rng(3)
    theta, a = rng.normal(size=(30, 2)), rng.normal(size=(8, 2))
    q, _ = np.linalg.qr(rng.normal(size=(2, 2)))

    def fit(t, x):
        items = spark.createDataFrame([(j, x[j].tolist(), [0.0]) for j in range(8)], "item_id int, loadings array<double>, cuts array<double>")
        people = spark.createDataFrame([(i, 8, t[i].tolist(), [1.0, 0.0, 0.0, 1.0]) for i in range(30)], "pid int, n_answers int, theta array<double>, covariance array<double>")
        return graded.JointFit(items, people, [], True)

    found = graded.restart_agreement(fit(theta, a), fit(theta @ q, a @ q), 2)
    assert all(v == pytest.approx([1, 1]) for v in found.values())
    other = graded.restart_agreement(fit(theta, a), fit(rng.normal(size=(30, 2)), a), 2)
    assert max(other["canonical"]) < 0.8

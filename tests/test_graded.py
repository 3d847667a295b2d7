"""The response model of several traits against plain numpy: solves, fits, prefixes and what to ask next."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import graded

TRAITS = 2


def logistic(x):
    return 1 / (1 + np.exp(-x))


def plain_log_p(z, cuts, code):
    up = np.concatenate([[1.0], logistic(z - np.asarray(cuts)), [0.0]])
    return np.log(up[code] - up[code + 1])


def population(people=60, likert=8, binary=4, seed=7):
    """Codes drawn from known parameters, some of them missing: (people x items), loadings, cuts, traits."""
    rng = np.random.default_rng(seed)
    theta, a = rng.normal(size=(people, TRAITS)), rng.normal(0, 1.2, (likert + binary, TRAITS))
    cuts = [np.sort(rng.normal(0, 1.2, 4)) + [0, 0.2, 0.4, 0.6] for _ in range(likert)] + [rng.normal(0, 0.5, 1) for _ in range(binary)]
    u = rng.random((people, len(cuts)))
    codes = np.array([[int((logistic(a[j] @ theta[i] - cuts[j]) > u[i, j]).sum()) for j in range(len(cuts))] for i in range(people)])
    codes[rng.random(codes.shape) < 0.05] = -1
    return codes, a, cuts, theta


def cells_of(spark, codes, parts=3):
    rows = [(f"p{i:03d}", f"q{j:02d}", int(codes[i, j]) if codes[i, j] >= 0 else None, (7 * j) % codes.shape[1]) for i in range(len(codes)) for j in range(codes.shape[1])]
    return spark.createDataFrame(rows, "pid string, item_id string, code int, position int").repartition(parts)


def items_of(spark, a, cuts):
    return spark.createDataFrame([(f"q{j:02d}", a[j].tolist(), [float(c) for c in cuts[j]]) for j in range(len(cuts))], "item_id string, loadings array<double>, cuts array<double>")


def categories_of(spark, cuts):
    return spark.createDataFrame([(f"q{j:02d}", len(c) + 1) for j, c in enumerate(cuts)], "item_id string, n_categories int")


def plain_posterior(codes, a, cuts):
    """One person's mode and information by plain Newton steps with numeric derivatives of the log density."""
    seen = [j for j in range(len(codes)) if codes[j] >= 0]

    def f(t):
        return sum(plain_log_p(a[j] @ t, cuts[j], codes[j]) for j in seen) - t @ t / 2

    t, h, eye = np.zeros(TRAITS), 1e-4, np.eye(TRAITS)
    for _ in range(30):
        g = np.array([(f(t + h * e) - f(t - h * e)) / (2 * h) for e in eye])
        hess = np.array([[(f(t + h * e + h * k) - f(t + h * e - h * k) - f(t - h * e + h * k) + f(t - h * e - h * k)) / (4 * h * h) for k in eye] for e in eye])
        t = t - np.linalg.solve(hess, g)
    return t, -hess


def test_posteriors_of_two_traits_equal_plain_ones(spark):
    codes, a, cuts, _ = population(people=12)
    codes[3] = -1  # nobody to solve
    codes[4, 1:] = -1
    got = {r.pid: r for r in graded.posteriors(cells_of(spark, codes), items_of(spark, a, cuts), TRAITS).collect()}
    assert set(got) == {f"p{i:03d}" for i in range(12) if i != 3}
    for i in set(range(12)) - {3}:
        t, info = plain_posterior(codes[i], a, cuts)
        r = got[f"p{i:03d}"]
        assert r.n_answers == (codes[i] >= 0).sum()
        assert r.theta == pytest.approx(t.tolist(), abs=1e-5)
        assert r.covariance == pytest.approx(np.linalg.inv(info).ravel().tolist(), rel=2e-3)


def test_every_prefix_equals_a_solve_from_scratch(spark):
    codes, a, cuts, _ = population(people=9)
    cells, items = cells_of(spark, codes), items_of(spark, a, cuts)
    order = sorted(range(len(cuts)), key=lambda j: (7 * j) % len(cuts))
    rows = {(r.pid, r.step): r for r in graded.prefix_posteriors(cells, items, TRAITS, order="position").collect()}
    assert len(rows) == (codes >= 0).sum()
    for i in range(len(codes)):
        asked = [j for j in order if codes[i, j] >= 0]
        for step in (1, 2, len(asked) // 2, len(asked)):
            some = np.full(len(cuts), -1)
            some[asked[:step]] = codes[i, asked[:step]]
            r, (t, info) = rows[f"p{i:03d}", step], plain_posterior(some, a, cuts)
            assert r.item_id == f"q{asked[step - 1]:02d}" and r.theta == pytest.approx(t.tolist(), abs=1e-5)
            assert r.blur == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))).tolist(), rel=2e-3)
    last = {r.pid: r.theta for r in graded.posteriors(cells, items, TRAITS).collect()}
    for (pid, step), r in rows.items():
        if (pid, step + 1) not in rows:
            assert r.theta == pytest.approx(last[pid], abs=1e-8)


def test_repeated_strange_and_missing_cells(spark):
    codes, a, cuts, _ = population(people=3)
    cells = cells_of(spark, codes).unionByName(spark.createDataFrame([("p000", "q99", 1, 0), ("p001", "q00", 9, 0), ("p002", "q00", -3, 0), ("px", "q00", None, 0)], "pid string, item_id string, code int, position int"))
    items = items_of(spark, a, cuts)
    plain = {r.pid: r.theta for r in graded.posteriors(cells_of(spark, codes), items, TRAITS).collect()}
    assert {r.pid: r.theta for r in graded.posteriors(cells, items, TRAITS).collect()} == plain
    assert graded.posteriors(cells.limit(0), items, TRAITS).collect() == []
    assert graded.prefix_posteriors(cells.limit(0), items, TRAITS, order="position").collect() == []


def total_loss(codes, theta, a, cuts, ridge=0.01):
    seen = [(i, j) for i in range(codes.shape[0]) for j in range(codes.shape[1]) if codes[i, j] >= 0]
    return -sum(plain_log_p(a[j] @ theta[i], cuts[j], codes[i, j]) for i, j in seen) + (theta**2).sum() / 2 + ridge * (a**2).sum() / 2


def test_item_slopes_equal_differences(spark):
    codes, a, cuts, theta = population(people=15, likert=3, binary=2)
    bank = graded.bank_of(items_of(spark, a, cuts), TRAITS)
    traits = spark.createDataFrame([(f"p{i:03d}", t.tolist()) for i, t in enumerate(theta)], "pid string, theta array<double>")
    people = graded.packed_people(cells_of(spark, codes), bank).join(traits, "pid")
    sums = graded._item_sums(people, bank, TRAITS)
    flat, h = bank.flat(), 1e-5

    def item_loss(j, x):
        return -sum(plain_log_p(x[:TRAITS] @ theta[i], x[TRAITS:][np.isfinite(x[TRAITS:])], codes[i, j]) for i in range(len(codes)) if codes[i, j] >= 0)

    for j in range(len(cuts)):
        free = np.flatnonzero(np.isfinite(flat[j]))
        e = np.eye(len(flat[j]))
        assert sums.loss[j] == pytest.approx(item_loss(j, flat[j]), rel=1e-9)
        for k in free:
            shift = np.where(e[k] > 0, h, 0)
            assert sums.gradient[j, k] == pytest.approx((item_loss(j, flat[j] + shift) - item_loss(j, flat[j] - shift)) / (2 * h), abs=1e-4)
    moved = bank.flat()
    moved[:, 0] += h
    other = graded._item_sums(people, bank.with_flat(moved), TRAITS)
    for j in range(len(cuts)):
        free = np.isfinite(flat[j])
        assert ((other.gradient[j] - sums.gradient[j]) / h)[free] == pytest.approx(sums.hessian[j, 0][free], abs=1e-2)


def plain_joint_fit(codes, theta, a, cuts, steps=3000):
    """The joint objective by gradient steps with momentum over everything at once."""
    gaps = np.full((len(a), max(map(len, cuts))), np.inf)
    for j, c in enumerate(cuts):
        gaps[j, : len(c)] = c
    theta, a, seen = theta.copy(), a.copy(), codes >= 0

    def slopes(theta, a, cuts):
        z = theta @ a.T
        edged = np.concatenate([np.full((len(a), 1), -np.inf), cuts, np.full((len(a), 1), np.inf)], 1)
        j = np.arange(len(a))[None].repeat(len(codes), 0)
        c = np.maximum(codes, 0)
        low, high = edged[j, c], edged[j, c + 1]
        u, v = 0.5 * (1 + np.tanh((z - low) / 2)), 0.5 * (1 + np.tanh((z - high) / 2))
        p = np.maximum(u - v, 1e-12)
        dz = np.where(seen, 1 - u - v, 0)
        loss = -np.log(p[seen]).sum() + (theta**2).sum() / 2 + 0.005 * (a**2).sum()
        gc = np.zeros_like(cuts)
        for k in range(cuts.shape[1]):
            gc[:, k] = np.where(seen & (c == k + 1), u * (1 - u) / p, 0).sum(0) - np.where(seen & (c == k), v * (1 - v) / p, 0).sum(0)
        return loss, -dz @ a + theta, -dz.T @ theta + 0.01 * a, gc

    free = np.isfinite(gaps)
    m = [np.zeros_like(x) for x in (theta, a, gaps)]
    s = [np.zeros_like(x) for x in (theta, a, gaps)]
    best = np.inf
    for t in range(1, steps + 1):
        loss, *g = slopes(theta, a, gaps)
        best = min(best, loss)
        g[2] = np.where(free, g[2], 0)
        rate = 0.02 * (1 - t / (steps + 1))
        for i, x in enumerate((theta, a, gaps)):
            m[i], s[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * s[i] + 0.001 * g[i] ** 2
            step = rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
            x -= np.where(np.isfinite(x), step, 0)
    return best


@pytest.fixture(scope="module")
def joint(spark):
    codes, a, cuts, theta = population()
    cells, categories = cells_of(spark, codes, 2), categories_of(spark, cuts)
    return codes, a, cuts, theta, cells, categories, graded.fit_joint(cells, categories, TRAITS)


def fitted(fit):
    items = sorted(fit.items.collect(), key=lambda r: r.item_id)
    people = sorted(fit.people.collect(), key=lambda r: r.pid)
    return np.array([r.loadings for r in items]), [np.array(r.cuts) for r in items], np.array([r.theta for r in people]), people


def test_joint_fit_reaches_a_plain_optimisers_objective(spark, joint):
    codes, _, cuts, _, cells, categories, fit = joint
    a, c, theta, _ = fitted(fit)
    loss = total_loss(codes, theta, a, c)
    assert fit.converged and fit.losses == sorted(fit.losses, reverse=True)
    assert fit.losses[-1] == pytest.approx(loss, rel=1e-6)
    # from a place nearby, as the objective has several modes
    rng = np.random.default_rng(1)
    nearby = theta + rng.normal(0, 0.2, theta.shape), a + rng.normal(0, 0.2, a.shape), [x + 0.05 * np.arange(len(x)) for x in c]
    plain = plain_joint_fit(codes, *nearby)
    assert loss == pytest.approx(plain, rel=1e-4)


def test_the_best_start_is_taken(spark, joint, monkeypatch):
    fits = [graded.JointFit(None, None, [5.0, loss], True) for loss in (3.0, 2.0, 4.0)]
    monkeypatch.setattr(graded, "fit_joint", lambda *_, seed: fits[seed])
    assert graded.fit_best(None, None, 2) is fits[1]


def test_linked_traits_have_unit_variance_and_the_same_answers(joint):
    codes, *_, fit = joint
    linked = graded.linked(fit)
    a, c, theta, _ = fitted(fit)
    b, e, traits, people = fitted(linked)
    assert np.allclose(a @ theta.T, b @ traits.T) and all(np.allclose(x, y) for x, y in zip(c, e))
    assert np.mean([(np.square(r.theta).sum() + np.trace(np.reshape(r.covariance, (2, 2)))) / 2 for r in people]) == pytest.approx(1)


def test_items_of_known_people_equal_a_fit_with_the_others_fixed(spark, joint):
    codes, *_, cells, categories, fit = joint
    a, c, theta, people = fitted(fit)
    got = sorted(graded.fit_items(cells, categories, fit.people, TRAITS).collect(), key=lambda r: r.item_id)
    # at the joint mode each item is at its own mode, given the people
    assert np.allclose([r.loadings for r in got], a, atol=2e-2)
    losses = [sum(-plain_log_p(x @ theta[i], k, codes[i, j]) for i in range(len(codes)) if codes[i, j] >= 0) + 0.005 * x @ x for j, (x, k) in enumerate((np.array(r.loadings), r.cuts) for r in got)]
    mine = [sum(-plain_log_p(a[j] @ theta[i], c[j], codes[i, j]) for i in range(len(codes)) if codes[i, j] >= 0) + 0.005 * a[j] @ a[j] for j in range(len(a))]
    assert sum(losses) <= sum(mine) + 1e-6


def test_what_to_ask_next_equals_inverting_the_updated_matrix(spark):
    codes, a, cuts, _ = population(people=8)
    items = items_of(spark, a, cuts)
    cells = cells_of(spark, codes).where("position < 4")
    asked = cells.where("code IS NOT NULL").groupBy("pid").agg(F.collect_list("item_id").alias("asked"))
    people = graded.posteriors(cells, items, TRAITS).join(asked, "pid")
    got = {(r.pid, r.place): r for r in graded.next_items(people, items, TRAITS, asked="asked", k=20).collect()}
    for r in people.collect():
        theta, cov = np.array(r.theta), np.reshape(r.covariance, (TRAITS, TRAITS))
        want = []
        for j in range(len(cuts)):
            if f"q{j:02d}" in r.asked:
                continue
            drop = 0.0
            for code in range(len(cuts[j]) + 1):
                f = lambda z: plain_log_p(z, cuts[j], code)  # noqa: B023, E731
                z, h = a[j] @ theta, 1e-4
                c = -(f(z + h) - 2 * f(z) + f(z - h)) / h**2
                drop += np.exp(f(z)) * (np.trace(cov) - np.trace(np.linalg.inv(np.linalg.inv(cov) + c * np.outer(a[j], a[j]))))
            want.append((-drop, f"q{j:02d}"))
        assert len([1 for pid, _ in got if pid == r.pid]) == len(want)
        for place, (drop, item) in enumerate(sorted(want), 1):
            assert got[r.pid, place].item_id == item and got[r.pid, place].reduction == pytest.approx(-drop, rel=1e-4)

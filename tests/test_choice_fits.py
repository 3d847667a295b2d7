"""Choice fits, replicates and refits under a learned prior, against plain solves."""

import datetime
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import choice, choice_fits
from sondage.plans import fits as plans

FEATURES = ["cost", "time"]


def options(people=6, sets=30, seed=1):
    """(who, set, place, cost, time, chosen) of choices drawn from known coefficients."""
    rng = np.random.default_rng(seed)
    out = []
    for w in range(people):
        beta = rng.normal([-1.0, -0.5], 0.4)
        for s in range(sets + w):
            x = rng.normal(size=(rng.integers(2, 5), 2))
            pick = int(np.argmax(x @ beta + rng.gumbel(size=len(x))))
            out += [(f"w{w}", s, k, float(a), float(b), k == pick) for k, (a, b) in enumerate(x)]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "who string, set int, place int, cost double, time double, chosen boolean").repartition(3)


def sets_of(spark, rows):
    return choice_fits.choice_sets(table(spark, rows), "who", "set", FEATURES, "chosen", order=["place"])


def plain(rows, weights, prior):
    """Mode by plain Newton steps over a dictionary of sets, and minus the second differences of the log density there."""
    sets = {}
    for _, s, _, a, b, c in rows:
        sets.setdefault(s, []).append((a, b, c))

    def f(beta):
        total = 0.0
        for s, o in sets.items():
            u = np.array([[a, b] for a, b, _ in o]) @ beta
            total += weights[s] * (u[[c for *_, c in o].index(True)] - np.log(np.exp(u - u.max()).sum()) - u.max())
        d = beta - prior.mean
        return total - 0.5 * d @ prior.precision @ d

    beta, h, eye = prior.mean.copy(), 1e-4, np.eye(2)
    for _ in range(40):
        g = np.array([(f(beta + h * e) - f(beta - h * e)) / (2 * h) for e in eye])
        hess = np.array([[(f(beta + h * (e + k)) - f(beta + h * (e - k)) - f(beta - h * (e - k)) + f(beta - h * (e + k))) / (4 * h * h) for k in eye] for e in eye])
        beta = beta - np.linalg.solve(hess, g)
    return beta, -hess


def of(rows, who):
    return [r for r in rows if r[0] == who]


def test_fits_equal_plain_ones_and_the_older_solver(spark):
    rows = options()
    got = {r.who: r for r in choice_fits.fit_choices(sets_of(spark, rows), 2).collect()}
    assert len(got) == 6 and all(r.converged and r.replicate == 1 for r in got.values())
    for who, r in got.items():
        mine = sorted(of(rows, who))
        beta, info = plain(mine, dict.fromkeys(range(100), 1.0), choice_fits.Prior.ridge(2))
        assert r.beta == pytest.approx(beta.tolist(), abs=1e-5) and r.n_sets == len({x[1] for x in mine})
        assert r.covariance == pytest.approx(np.linalg.inv(info).ravel().tolist(), rel=1e-2, abs=1e-5)
        starts = [i for i, x in enumerate(mine) if x[2] == 0]
        old, ll, _ = choice.logit_newton(np.array([x[3:5] for x in mine]), np.array(starts), np.flatnonzero([x[5] for x in mine]))
        assert r.beta == pytest.approx(old.tolist(), abs=1e-6)
        assert r.log_likelihood - 0.5e-4 * old @ old == pytest.approx(ll, abs=1e-8)


def poisson(seed, who, s, b):
    u = int(hashlib.sha256(f"{seed}:{who}|{s}:{b}".encode()).hexdigest()[:16], 16) / 2**64
    n, p, total = 0, np.exp(-1), np.exp(-1)
    while total <= u:
        n += 1
        p /= n
        total += p
    return n


def test_replicates_equal_plain_weighted_refits(spark):
    rows = options(people=2)
    got = {(r.who, r.replicate): r for r in choice_fits.fit_choices(sets_of(spark, rows), 2, replicates=4, seed=3).collect()}
    assert len(got) == 8
    for (who, b), r in got.items():
        weights = {s: poisson(3, who, s, b) for s in range(40)}
        assert r.beta == pytest.approx(plain(of(rows, who), weights, choice_fits.Prior.ridge(2))[0].tolist(), abs=1e-5)
    spread = {r.who: r for r in choice_fits.spread_of_replicates(choice_fits.fit_choices(sets_of(spark, rows), 2, replicates=4, seed=3), 2).collect()}
    assert spread["w0"].sd == pytest.approx(np.std([got["w0", b].beta for b in (1, 2, 3, 4)], axis=0, ddof=1).tolist())


def test_one_decision_maker_with_most_sets_is_summed_over_tasks(spark):
    rows = options(people=3) + [("hot", *r[1:]) for r in options(people=1, sets=300, seed=5)]
    sets = sets_of(spark, rows)
    for replicates in (0, 3):
        here = {(r.who, r.replicate): r for r in choice_fits.fit_choices(sets, 2, replicates=replicates).collect()}
        apart = {(r.who, r.replicate): r for r in choice_fits.fit_choices(sets, 2, replicates=replicates, large=31).collect()}
        assert here.keys() == apart.keys() and len(here) == 4 * max(1, replicates)
        for key, r in here.items():
            assert apart[key].beta == pytest.approx(r.beta, abs=1e-8) and apart[key].converged
            assert apart[key].covariance == pytest.approx(r.covariance, rel=1e-6) and apart[key].n_sets == r.n_sets


def test_prior_and_short_refits(spark):
    rows = options() + [("short", *r[1:]) for r in options(people=1, sets=2, seed=9)]
    sets = sets_of(spark, rows)
    training = spark.createDataFrame([(f"w{i}",) for i in range(5)], "who string")
    fits, prior = choice_fits.shrunk_fits(sets, 2, training)
    betas = np.array([r.beta for r in choice_fits.fit_choices(sets, 2).collect() if r.who in {f"w{i}" for i in range(5)}])
    assert prior.mean == pytest.approx(betas.mean(0)) and np.linalg.inv(prior.precision) == pytest.approx(np.cov(betas.T) + 1e-6 * np.eye(2))
    got = {r.who: r for r in fits.collect()}
    assert set(got) == {f"w{i}" for i in range(6)} | {"short"}
    for who in ("short", "w5"):
        beta, info = plain(of(rows, who), dict.fromkeys(range(100), 1.0), prior)
        assert got[who].beta == pytest.approx(beta.tolist(), abs=1e-5)
        assert got[who].covariance == pytest.approx(np.linalg.inv(info).ravel().tolist(), rel=1e-2, abs=1e-5)


def test_sets_that_tell_nothing(spark):
    rows = [("a", 1, 0, 1.0, 1.0, True), ("a", 1, 1, 1.0, 1.0, False), ("a", 2, 0, 1.0, 2.0, False), ("a", 2, 1, 2.0, 1.0, None), ("a", 3, 0, None, 1.0, True), ("a", 3, 1, 1.0, 1.0, False), (None, 4, 0, 1.0, 2.0, True), (None, 4, 1, 0.0, 2.0, False), ("a", 5, 1, 3.0, 1.0, True), ("a", 5, 0, 2.0, 1.0, True)]
    sets = sets_of(spark, rows).collect()
    assert [(r.who, r.set, r.x, r.chosen) for r in sets] == [("a", 5, [2.0, 1.0, 3.0, 1.0], 0)]
    assert choice_fits.fit_choices(sets_of(spark, rows), 2).collect() == []
    assert choice_fits.fit_choices(sets_of(spark, []), 2, min_sets=1).collect() == []
    assert choice_fits.learned_prior(choice_fits.fit_choices(sets_of(spark, []), 2), 2).mean.tolist() == [0, 0]


def test_many_are_solved_together_as_each_alone(spark):
    rows = options(people=9, sets=6, seed=4)
    sets = sets_of(spark, rows).repartition(2)
    prior = choice_fits.Prior(np.array([-0.5, 0.2]), np.array([[2.0, 0.3], [0.3, 1.0]]))
    together = choice_fits.fit_choices(sets, 2, replicates=4, prior=prior, min_sets=1).collect()
    batch = sets.withColumn("n_sets", F.lit(1).cast("long")).groupBy("who", "n_sets").agg(F.collect_list("x").alias("x"), F.collect_list("chosen").alias("chosen"), F.flatten(F.collect_list(F.array(F.lit(1.0), F.lit(2.0)))).alias("w")).toArrow().combine_chunks().to_batches()[0]
    many = choice_fits._fit_together(batch, 2, 2, prior, 60, 1e-9).to_pylist()
    for i in range(batch.num_rows):
        x, starts, chosen = choice_fits._flat(batch.column("x")[i].values, batch.column("chosen")[i].values, 2)
        weights = batch.column("w")[i].values.to_numpy().reshape(-1, 2)
        climb = choice_fits._Climb(np.tile(prior.mean, (2, 1)), prior)
        for _ in range(60):
            climb.found(*choice_fits.sums_at(x, starts, chosen, weights, climb.trial))
            if not climb.moves(1e-9).any():
                break
        for b in range(2):
            row = many[2 * i + b]
            np.testing.assert_allclose(row["beta"], climb.at[b], rtol=1e-9, atol=1e-11)
            np.testing.assert_allclose(row["covariance"], np.linalg.inv(climb.information)[b].ravel(), rtol=1e-7, atol=1e-10)
            assert (row["who"], row["replicate"], row["converged"]) == (batch.column("who")[i].as_py(), b + 1, True)
    assert len(together) == 36 and all(r.converged for r in together)


def test_refits_make_the_sets_once(spark):
    rows = options()
    sets, made = sets_of(spark, rows), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    training = spark.createDataFrame([(f"w{i}",) for i in (0, 0, 1, 2, 3, 4)], "who string")
    fits, _ = choice_fits.shrunk_fits(sets.mapInArrow(counted, sets.schema), 2, training)
    assert len(fits.collect()) == 6 and made.value == sets.count()


def test_refits_of_large_decision_makers_equal_those_that_meet(spark):
    rows = options(people=4) + [("hot", *r[1:]) for r in options(people=1, sets=300, seed=5)]
    sets = sets_of(spark, rows)
    for trained in (["w0", "w1", "w3", "hot"], ["w0", "w1", "w2"]):
        training = spark.createDataFrame([(w,) for w in trained], "who string")
        here, prior = choice_fits.shrunk_fits(sets, 2, training)
        apart, same = choice_fits.shrunk_fits(sets, 2, training, large=31)
        assert same.mean == pytest.approx(prior.mean) and same.precision == pytest.approx(prior.precision, rel=1e-6)
        here, apart = ({r.who: r for r in x.collect()} for x in (here, apart))
        assert here.keys() == apart.keys() and len(here) == 5
        for who, r in here.items():
            assert apart[who].beta == pytest.approx(r.beta, abs=1e-7) and apart[who].n_sets == r.n_sets


def test_lines_move_once_to_their_order(spark):
    plan = plans._choice_sets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1
    assert plan.count("Exchange hashpartitioning") == 1  # orders are few here and broadcast


def test_options_of_orders_with_equal_lines(spark, tmp_path):
    day = datetime.datetime(2001, 1, 1)
    line = lambda order, number, quantity, price, days: (order, 1, 1, number, float(quantity), price, 0.0, day + datetime.timedelta(days))
    lines = [line(1, 1, 10, 100.0, 5), line(1, 1, 10, 100.0, 5), line(1, 2, 20, 50.0, 5), line(1, 2, 20, 50.0, 3), line(2, 1, 5, 10.0, 1), line(2, 1, 5, 10.0, 1), line(3, 1, 5, 10.0, 1), line(3, 2, 6, 10.0, 2), line(None, 1, 5, 10.0, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (None, 7), (4, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = [(r.who, r.set, r.x, r.chosen) for r in plans._choice_sets(spark, str(tmp_path)).collect()]
    # the line shipped first was chosen; lines equal in all but the day are two options, those equal in all are one; the chosen one of equal options comes last
    assert got == [(7, 1, pytest.approx([100 / 100000, 0.2, 50 / 100000, 0.4, 50 / 100000, 0.4]), 2)]

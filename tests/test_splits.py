"""Design classes, hold-outs, interviews and strata on planted items, and transmission against plain figures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import splits as P
from sondage.operators import transmission as R


def test_classes_and_dimensions(spark):
    rows = [([0.0, 1.0], "strong"), ([0.0, -0.5], "strong"), ([1.0, -1.0], "strong"), ([0.0, 1.0], "weak"), ([0.0, 0.0], "strong"), ([0.0, 1.0], "none"), ([], "strong"), (None, "strong"), ([0.0, -1.0], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l array<double>, s string")
    got = df.select("i", P.item_class(F.col("l"), F.col("s")).alias("c"), P.primary_dimension(F.col("l")).alias("d"), P.is_candidate(F.col("l"), F.col("s")).alias("k")).orderBy("i").collect()
    assert [r.c for r in got][:7] == ["primary", "primary", "cross", "weak", "distractor", "distractor", "distractor"]
    assert [r.d for r in got] == [1, 1, 0, 1, None, 1, None, None, 1]
    assert [bool(r.k) for r in got] == [True, False, False, False, False, False, False, False, True]


def test_holdout_is_exact_and_stays(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    held = lambda d: {r.k for r in P.holdout(d, "k", 37, 5).where("held").collect()}
    assert len(held(df)) == 37 and held(df) == held(df.repartition(7))
    with pytest.raises(Exception, match="cannot hold out 37 of 10"):
        P.holdout(df.limit(10), "k", 37, 5).collect()


def candidates(spark, binary=True):
    rows = [(i, i % 4, f"d{i % 7}", "binary" if binary and i % 3 == 0 else "likert5") for i in range(60)]
    return spark.createDataFrame(rows, "item_id long, dimension int, domain string, kind string")


def test_interviews_keep_the_constraints(spark):
    rule = P.Interview(each=2, most_domains=4, least_binary=3, least_other=3)
    rows = P.interview(candidates(spark), rule, 3, batch=2).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 8)) and len({r.item_id for r in rows}) == 7
    per = sorted(sum(r.dimension == d for r in rows) for d in range(4))
    assert per == [1, 2, 2, 2] and len({r.domain for r in rows}) <= 4
    assert sum(r.kind == "binary" for r in rows) >= 3 and sum(r.kind != "binary" for r in rows) >= 3
    first = P.draws(candidates(spark), rule, 3, 1, rows[0].attempt).where("fits").collect()
    assert [r.attempt for r in first] == [rows[0].attempt]  # none before it fits
    assert rows == P.interview(candidates(spark).repartition(5), rule, 3).orderBy("place").collect()


def test_constraints_that_cannot_be_kept_are_an_error(spark):
    with pytest.raises(ValueError, match="no interview"):
        P.interview(candidates(spark, binary=False), P.Interview(), 3, attempts=40, batch=16)


def test_strata(spark):
    items = spark.createDataFrame([(1, 0, "a"), (2, 1, "a"), (3, 0, "b"), (4, 0, "z"), (5, None, "a"), (6, 0, None)], "item_id int, dimension int, domain string")
    asked = spark.createDataFrame([(0, "a"), (2, None)], "dimension int, domain string")
    opened = spark.createDataFrame([("b",), ("b",), (None,)], "domain string")
    got = {r.item_id: r.stratum for r in P.strata(items, asked, opened).collect()}
    assert got == {1: "near", 2: "same-domain", 3: "same-domain", 4: "far", 5: "same-domain", 6: "far"}


def test_transmission_equals_plain_figures(spark):
    rng = np.random.default_rng(2)
    phi = rng.normal(size=40)
    scores = {(p, i): float(phi[p] + rng.normal()) for p in range(40) for i in range(6) if (p + i) % 9}
    rows = [(p, i, 0, s) for (p, i), s in scores.items()] + [(0, 0, 0, None)]
    df = spark.createDataFrame(rows, "pid int, item_id int, dim int, score double")
    truth = spark.createDataFrame([(p, 0, float(v)) for p, v in enumerate(phi)] + [(99, 0, None)], "pid int, dim int, value double")
    half = {r.item_id: r.half for r in R.halves(df.select("dim", "item_id").distinct(), 4).collect()}
    assert sorted(half.values()) == [0, 0, 0, 1, 1, 1]
    mean = lambda p, h: np.mean([scores[p, i] for i in range(6) if (p, i) in scores and (h is None or half[i] == h)])
    t, a, b = ([mean(p, h) for p in range(40)] for h in (None, 0, 1))
    r, h = np.corrcoef(phi, t)[0, 1], np.corrcoef(a, b)[0, 1]
    (got,) = R.transmission(df, truth, 4).collect()
    assert (got.n_items, got.n_people, got.n_both) == (6, 40, 40)
    assert got.r_raw == pytest.approx(r) and got.reliability == pytest.approx(2 * h / (1 + h))
    assert got.rho == pytest.approx(min(1, r / math.sqrt(2 * h / (1 + h))))


def test_transmission_without_spread_or_rows_is_null(spark):
    df = spark.createDataFrame([(p, i, 0, 1.0) for p in range(3) for i in range(2)], "pid int, item_id int, dim int, score double")
    truth = spark.createDataFrame([(p, 0, float(p)) for p in range(3)], "pid int, dim int, value double")
    (got,) = R.transmission(df, truth, 4).collect()
    assert (got.r_raw, got.r, got.reliability, got.rho) == (None, None, None, None)
    assert R.transmission(df.limit(0), truth, 4).count() == 0


def test_noise_curve_of_fixed_and_empty_cells(spark):
    cells = spark.range(200).select(F.col("id").alias("pid"), F.lit(1).alias("item_id"), F.lit(1.0).alias("wobble"), F.lit(0.0).alias("gap"), F.lit(False).alias("can_flip"))
    assert [(r.agreement, r.chosen) for r in R.noise_curve(cells, [0.1, 5.0], 1.0, 0.9).orderBy("strength").collect()] == [(1.0, True), (1.0, False)]
    free = R.noise_curve(cells.withColumn("can_flip", F.lit(True)), [0.0, 5.0], 1.0, 0.5).orderBy("strength").collect()
    assert free[0].agreement == 1.0 and abs(free[1].agreement - 0.5) < 0.15 and free[1].chosen
    assert [r.agreement for r in R.noise_curve(cells.limit(0), [0.1], 1.0, 0.9).collect()] == [None]

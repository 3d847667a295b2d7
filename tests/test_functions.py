"""Readers, choice fits and record files on small planted inputs."""

import numpy as np
from pyspark.sql import functions as F

from sondage.functions import noise, text
from sondage.operators import answers, choice, sequential, stats, windows
from sondage.sources import records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_replies(spark):
    cases = [
        ("5.", "5", None), ("5.5", None, "none"), ("15", None, "none"), ("strongly agree", "5", None), ("I Strongly  Disagree", "1", None),
        ("1 or 2", None, "ambiguous"), ("", None, "empty"), (None, None, "empty"), ("neutral", "3", None), ("agree, 4", "4", None),
    ]
    df = spark.createDataFrame([(t,) for t, *_ in cases], "t string")
    got = [(r["a"]["answer"], r["a"]["reason"]) for r in df.select(text.normalize_answer(F.col("t"), F.lit("likert5")).alias("a")).collect()]
    assert got == [(a, r) for _, a, r in cases]
    assert [one(spark, text.normalize_answer(F.lit(t), F.lit("binary")))["answer"] for t in ("Yes", "no!", "yes no", "y")] == ["yes", "no", None, "yes"]


def test_whole_phrase_lists(spark):
    likert = [("Neither agree nor disagree.", "3"), ("neither  agree or disagree", "3"), ("Strongly agreed!", "5"), ("(4)", "4"), ("I disagree, not agree", None)]
    binary = [("yup", "yes"), ("Correct.", "yes"), ("nah", "no"), ("incorrect", "no"), ("y.", "yes"), ("(N)", "no"), ("incorrect, yes", None), ("why", None)]
    for kind, cases in (("likert5", likert), ("binary", binary)):
        df = spark.createDataFrame(cases, "t string, a string")
        assert [(r.t, r.got) for r in df.select("t", text.normalize_answer(F.col("t"), F.lit(kind))["answer"].alias("got")).collect()] == cases


def test_wording(spark):
    got = one(spark, text.wording_features(F.lit("I rarely, maybe NEVER, don't"), F.lit("binary")))
    assert tuple(got) == (5, 1, 1, 1)
    assert tuple(one(spark, text.wording_features(F.lit("fine"), F.lit(None).cast("string")))) == (1, 0, 0, 0)


def test_noise_functions(spark):
    logs = F.create_map(F.lit("1"), F.lit(-1000.0), F.lit("2"), F.lit(-1001.0))
    got = one(spark, noise.answer_distribution(logs, ["1", "2"]))
    assert np.isclose(got["1"], 1 / (1 + np.exp(-1)))
    dist = F.create_map(F.lit("a"), F.lit(0.64), F.lit("b"), F.lit(0.36))
    assert one(spark, noise.conviction(dist)) == 0.64
    assert np.isclose(one(spark, noise.flattened(dist, 2.0))["a"], 0.8 / 1.4)
    assert np.isclose(one(spark, noise.event_probability(F.lit(0.5), F.lit(0.6), 0.2, 1.0)), 0.3)
    assert one(spark, noise.event_probability(F.lit(50.0), F.lit(0.0), 1.0, 1.0)) == noise.EVENT_CAP
    top = F.array(*[F.struct(F.lit(t).alias("tok"), F.lit(p).alias("p")) for t, p in (("x", 0.2), ("1", 0.5), ("2", 0.3))])
    gap = one(spark, noise.conviction_gap(top, ["1", "2"]))
    assert np.isclose(gap["gap"], 0.25) and gap["second"] == "2"
    assert [one(spark, text.is_clean_reply(F.lit(t), 0, 10)) for t in (" 7 ", "11", "7 of 10", "+3")] == [True, False, False, True]


def test_scores_and_shares(spark):
    assert one(spark, text.parse_score(F.lit("between 3 and 7, so 6"), 0, 10)) == 6
    assert one(spark, text.parse_score(F.lit("12"), 0, 10)) is None
    assert one(spark, text.parse_shares(F.lit("A=1 B=3"))) == {"A": 0.25, "B": 0.75}
    assert one(spark, text.parse_shares(F.lit("nothing"))) is None
    assert one(spark, text.leak_reasons(F.lit("My openness is +2"), ["openness"])) == ["name:openness", "number"]


def test_answer_distribution(spark):
    logs = F.create_map(F.lit("1"), F.lit(-0.1), F.lit("2"), F.lit(-3.0), F.lit("junk"), F.lit(-5.0))
    got = one(spark, noise.answer_distribution(logs, ["1", "2", "3"]))
    w = np.exp([-0.1, -3.0, -7.0])
    assert np.allclose([got[k] for k in "123"], w / w.sum())


def test_last_wins_empty_and_ties(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, o int, v string")
    assert sorted(map(tuple, answers.last_wins(df, ["k"], ["o"]).collect())) == [(1, 2, "b"), (2, 1, None)]
    assert answers.last_wins(df.limit(0), ["k"], ["o"]).count() == 0


def test_queue_and_as_of(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(5)], "pid int, t double").withColumn("day", F.lit(1))
    assert [r["exit"] for r in windows.queue_exits(df, ["day"], "t", "pid", 1.0).orderBy("pid").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    profile = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 3.0)], "day int, x double, y double")
    ask = spark.createDataFrame([(1, 5.0), (1, 15.0), (1, 25.0), (2, 1.0)], "day int, x double")
    got = {(r["day"], r["x"]): r["interpolated"] for r in windows.interpolated_as_of(ask, profile, "day", "x", "y").collect()}
    assert got == {(1, 5.0): 1.0, (1, 15.0): 2.0, (1, 25.0): 3.0, (2, 1.0): None}


def test_constant_sides_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(stats.safe_corr(F.col("x"), F.col("y")).alias("r")).first()["r"] is None


def test_logit_recovers_its_weights(spark):
    rng = np.random.default_rng(3)
    rows, beta = [], np.array([1.0, -2.0])
    for s in range(400):
        x = rng.normal(size=(3, 2))
        best = int(np.argmax(x @ beta + rng.gumbel(size=3)))
        rows += [(1, s, i, float(a), float(b), i == best) for i, (a, b) in enumerate(x)]
    rows += [(2, 1, 0, 0.0, 0.0, True)]  # too few sets
    df = spark.createDataFrame(rows, "who int, s int, i int, a double, b double, chosen boolean")
    (got,) = choice.fit_logits(df, "who", "s", ["a", "b"], "chosen", order=["i"]).collect()
    assert got["converged"] and got["n_sets"] == 400
    assert abs(got["b_a"] - 1) < 0.4 and abs(got["b_b"] + 2) < 0.5


def test_posterior_narrows(spark):
    df = spark.createDataFrame([(1, i, 1.0) for i in range(4)], "p int, i int, z double")
    got = sequential.gaussian_posterior(df, ["p"], "i", "z").orderBy("i").collect()
    assert [round(r["mean"], 6) for r in got] == [0.5, 0.666667, 0.75, 0.8]


def test_records(spark, tmp_path):
    path = str(tmp_path / "rows")
    assert records.read_records(spark, path, "a int").count() == 0
    records.append_records(spark.createDataFrame([(1,)], "a int"), path)
    records.append_records(spark.createDataFrame([(2,)], "a int"), path)
    assert sorted(r["a"] for r in records.read_records(spark, path, "a int").collect()) == [1, 2]


def test_logits_of_many_share_batches(spark):
    rng = np.random.default_rng(8)
    rows = [(w, s, i, float(rng.normal()), i == (w + s) % 3) for w in range(5) for s in range(6) for i in range(3)]
    df = spark.createDataFrame(rows, "who int, s int, i int, a double, chosen boolean").repartition(3)
    out = choice.fit_logits(df, "who", "s", ["a"], "chosen", order=["i"], min_sets=5)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()  # a pandas frame for each decision maker
    for r in out.collect():
        x = np.array([[a] for w, _, _, a, _ in rows if w == r.who])
        beta, ll, ok = choice.logit_newton(x, np.arange(0, 18, 3), np.flatnonzero([c for w, *_, c in rows if w == r.who]))
        assert (r.n_sets, r.converged) == (6, ok) and abs(r.b_a - beta[0]) < 1e-12 and abs(r.log_likelihood - ll) < 1e-12

"""Neighbours, the response model, grading and the questionnaire sources, against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.functions import noise
from sondage.operators import answers, calibration, neighbours, responses, stats
from sondage.sources import questionnaire


def test_neighbours_in_blocks_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 5, (70, 6))
    codes[3] = codes[9]  # twins stay each other's neighbours
    there = rng.random(codes.shape) < 0.8
    rows = [(f"p{i:02d}", j, float(codes[i, j]) / 4) for i in range(70) for j in range(6) if there[i, j]]
    cells = spark.createDataFrame([*rows, ("p00", 99, None), (None, 1, 0.5)], "pid string, item_id int, x double")
    got = {(r.target, r["rank"]): (r.neighbour, r.distance, r.shared) for r in neighbours.nearest_neighbours(cells, 5, people_a_block=16).collect()}
    for a in range(70):
        both = there[a] & there
        d = [(round(float(np.abs(codes[a] - codes[b])[both[b]].sum() / 4), 9), f"p{b:02d}", int(both[b].sum())) for b in range(70) if b != a and both[b].any()]
        for place, (distance, who, met) in enumerate(sorted(d)[:5], 1):
            assert got[f"p{a:02d}", place] == (who, distance, met)


def test_neighbours_of_nobody(spark):
    none = spark.createDataFrame([], "pid long, item_id int, x double")
    assert neighbours.nearest_neighbours(none, 3).count() == 0
    alone = spark.createDataFrame([(1, 1, 0.5)], "pid long, item_id int, x double")
    assert neighbours.nearest_neighbours(alone, 3).count() == 0


def test_chosen_k_takes_the_smaller_of_two(spark):
    curve = spark.createDataFrame([(3, 0.2), (1, 0.2), (5, 0.3)], "k int, loo_brier double")
    assert neighbours.chosen_k(curve).first().k == 1


def test_back_off_takes_the_first_rung_that_serves(spark):
    people = [(i, "a", "x" if i < 3 else "y") for i in range(12)] + [(50, "a", "x"), (51, "b", None)]
    profiles = spark.createDataFrame(people, "pid long, f string, g string")
    answers = spark.createDataFrame([(i, 1, "yes" if i % 2 else "no") for i in range(12)], "pid long, item_id int, answer string")
    out = neighbours.back_off_shares(profiles, profiles.where("pid < 20"), answers, [("f", "g"), ("f",), ()])
    got = {(r.pid, r.answer): (r.rung, r.share) for r in out.collect()}
    assert got[50, "yes"] == (1, 0.5)  # only 3 of (a, x)
    assert got[51, "yes"] == (2, 0.5)
    few = neighbours.back_off_shares(profiles, profiles.where("pid < 5"), answers, [("f", "g"), ("f",), ()])
    assert few.count() == 0


def test_answer_codes(spark):
    rows = [("likert5", "1", 0), ("likert5", " 5 ", 4), ("likert5", "6", None), ("likert5", "yes", None), ("binary", " Yes", 1), ("binary", "FALSE", 0), ("binary", "0", 0), ("binary", "maybe", None), ("likert5", None, None), ("open", "1", None)]
    df = spark.createDataFrame(rows, "kind string, answer string, want int")
    for r in df.select("want", "answer", responses.answer_code(F.col("answer"), F.col("kind")).alias("got")).collect():
        assert r.got == r.want, r


def test_probabilities_sum_to_one_and_survive_extremes(spark):
    df = spark.createDataFrame([(0.3,), (800.0,), (-800.0,)], "z double").select(responses.category_probabilities(F.col("z"), F.array(*[F.lit(c) for c in (-1.0, 0.0, 0.5, 2.0)])).alias("p"))
    for (p,) in df.collect():
        assert len(p) == 5 and sum(p) == pytest.approx(1) and min(p) >= 0


def test_posterior_equals_a_grid(spark):
    rng = np.random.default_rng(4)
    cuts = [-1.0, -0.2, 0.6, 1.4]
    items = [(i, [float(rng.normal(1, 0.3))], cuts if i % 2 else [0.1]) for i in range(12)]
    cells = [(p, i, int(rng.integers(0, len(c) + 1))) for p in range(4) for i, _, c in items]
    frame = spark.createDataFrame([*cells, (9, 1, 7), (9, 2, None)], "pid long, item_id int, code int")
    table = spark.createDataFrame(items, "item_id int, loadings array<double>, cuts array<double>")
    got = {r.pid: r for r in responses.person_posteriors(frame, table, 1).collect()}
    assert sorted(got) == [0, 1, 2, 3]  # nobody without a readable answer
    grid = np.linspace(-4, 4, 160_001)
    for p in range(4):
        log = -(grid**2) / 2
        for who, i, code in cells:
            if who == p:
                seen = np.array([np.ones_like(grid), *[1 / (1 + np.exp(-(items[i][1][0] * grid - c))) for c in items[i][2]], np.zeros_like(grid)])
                log = log + np.log(seen[code] - seen[code + 1])
        best = int(log.argmax())
        assert got[p].theta[0] == pytest.approx(grid[best], abs=1e-4)
        h = grid[1] - grid[0]
        step = 2000
        bend = -(log[best + step] - 2 * log[best] + log[best - step]) / (h * step) ** 2
        assert got[p].covariance[0] == pytest.approx(1 / bend, rel=1e-2)


def test_marginals_and_intervals_equal_numpy(spark):
    rng = np.random.default_rng(6)
    p, t = rng.random((40, 3)), rng.random((40, 3))
    pairs = spark.createDataFrame([(i, 1, c, float(p[i, c]), float(t[i, c])) for i in range(40) for c in range(3)], "pid long, item_id int, category int, p double, t double")
    weights = calibration.resample_weights(pairs, "pid", 30, noise.hash_uniform(F.col("round"), F.col("__slot")))
    w = np.zeros((30, 40))
    for r in weights.collect():
        w[r["round"], r.pid] = r.w
    assert (w.sum(1) == 40).all()
    boot = w @ t / 40
    for r in calibration.population_marginals(pairs, weights).collect():
        assert r.predicted == pytest.approx(p[:, r.category].mean()) and r.truth == pytest.approx(t[:, r.category].mean())
        low, high = np.percentile(boot[:, r.category], [2.5, 97.5])
        assert (r.truth_low, r.truth_high) == (pytest.approx(low), pytest.approx(high))
        assert r.inside == (low <= r.predicted <= high)


def test_table_gaps(spark):
    rows = [(1, 0, 0, 1.0, 0.0), (1, 0, 1, 0.0, 1.0), (1, 1, 0, 1.0, 1.0)]
    pairs = spark.createDataFrame([(p, i, c, x, y) for p, i, c, x, y in rows], "pid long, item_id int, category int, p double, t double")
    assert calibration.cross_table_gaps(calibration.cross_tables(pairs)).first().total_variation == pytest.approx(1)


def test_equivalent_n(spark):
    curve = spark.createDataFrame([("a", 0, 1.0), ("a", 5, 0.6), ("a", 10, 0.5), ("b", 0, 1.0), ("b", 5, 1.0)], "k string, n int, value double")
    targets = spark.createDataFrame([("a", 1.2), ("a", 0.8), ("a", 0.5), ("a", 0.45), ("a", -2.5), ("b", 0.5)], "k string, target double")
    got = {(r.k, r.target): (r.equivalent_n, r.extrapolated) for r in stats.equivalent_n(curve, targets, ["k"]).collect()}
    assert got["a", 1.2] == (0.0, False) and got["a", 0.8] == (pytest.approx(2.5), False) and got["a", 0.5] == (pytest.approx(10), False)
    assert got["a", 0.45] == (pytest.approx(10.5), True) and got["a", -2.5] == (None, True) and got["b", 0.5] == (None, True)


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(8)
    s, y = rng.integers(0, 50, 400) / 50, rng.integers(0, 2, 400)
    want = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)] + [(0.5, None), (None, 1)], "s double, y int")
    assert stats.auc(df, "s", "y", buckets=8).first().auc == pytest.approx(want)
    assert stats.auc(df.where("y = 1"), "s", "y").first().auc is None
    assert stats.auc(df.limit(0), "s", "y").first().auc is None


@pytest.mark.parametrize("wrapped", [True, False])
def test_bank(spark, tmp_path, wrapped):
    items = [{"item_id": "i1", "type": "likert5", "text": "One", "options": [{"value": "1"}, {"value": "5"}]}, {"item_id": "i2", "type": "binary", "text": "Two", "options": []}]
    path = tmp_path / "bank.json"
    path.write_text(json.dumps({"version": 1, "items": items} if wrapped else items, indent=1))
    got = {r.item_id: r for r in questionnaire.read_bank(spark, str(path)).collect()}
    assert got["i1"].kind == "likert5" and got["i1"].options == ["1", "5"] and got["i2"].kind == "binary" and len(got) == 2
    items[0]["type"] = "essay"
    path.write_text(json.dumps(items))
    with pytest.raises(Exception, match="unknown type of item i1"):
        questionnaire.read_bank(spark, str(path)).collect()


def test_log_and_distributions(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    lines = [
        {"pid": "p1", "item_id": "i1", "round": "main", "answer": "2", "raw": "two"},
        {"pid": "p1", "item_id": "i1", "round": "retest", "answer": "5", "logprobs": {"5": -0.1}},
        {"pid": "p1", "item_id": "i1", "answer": 4, "logprobs": {"4": -0.2, "3": -2}},
        {"pid": "p1", "item_id": "i9", "round": "main", "answer": "1", "logprobs": {}},
        {"pid": "p2", "item_id": "i2", "round": "main", "answer": "Yes", "logprobs": {"Yes": -0.3}},
        {"pid": "p2", "item_id": "i2", "round": "main", "answer": "what"},
    ]
    path.write_text("\n\n".join(json.dumps(x) for x in lines))
    log = questionnaire.read_answer_log(spark, str(path))
    bank = spark.createDataFrame([("i1", "likert5"), ("i2", "binary")], "item_id string, kind string")
    got = {(r.pid, r.item_id): r.code for r in responses.coded_answers(log, bank).collect()}
    assert got == {("p1", "i1"): 3, ("p2", "i2"): None}
    assert [tuple(r) for r in responses.unreadable(responses.coded_answers(log, bank)).collect()] == [("i2", 1)]
    found = {(r.pid, r.item_id, r["round"]): r.logprobs for r in questionnaire.recorded_distributions(log).collect()}
    assert found == {("p1", "i1", "retest"): {"5": -0.1}, ("p1", "i1", "main"): {"4": -0.2, "3": -2.0}, ("p2", "i2", "main"): {"Yes": -0.3}}
    assert questionnaire.recorded_distributions(log, ["i2"], ["main"]).count() == 1
    assert questionnaire.read_answer_log(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_resampled_marginals_equal_weighted_sums(spark):
    import hashlib

    rng = np.random.default_rng(8)
    rows = [(f"p{i}", j, c, float(x), float(c == truth)) for i in range(25) for j in range(3) if rng.random() < 0.8 for truth in [rng.integers(0, 3)] for c, x in enumerate(rng.dirichlet(np.ones(3)))]
    df = spark.createDataFrame([*rows, ("p1", 9, 0, None, 1.0)], "pid string, item_id int, category int, p double, t double").repartition(3)
    got = {(r.item_id, r.category): r for r in calibration.resampled_marginals(df, 40, seed=2).collect()}

    def weight(pid, b):
        u = int(hashlib.sha256(f"2:{pid}:{b}".encode()).hexdigest()[:16], 16) / 2**64
        return sum(u >= c for c in np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1))) for k in range(10)]))

    assert len(got) == 9
    for (item, category), r in got.items():
        mine = [x for x in rows if x[1:3] == (item, category)]
        w = np.array([[weight(x[0], b) for b in range(1, 41)] for x in mine], float)
        for name, col in (("predicted", 3), ("truth", 4)):
            x = np.array([m[col] for m in mine])
            assert r[name] == pytest.approx(x.mean())
            assert (r[f"{name}_low"], r[f"{name}_high"]) == pytest.approx(tuple(np.quantile((w * x[:, None]).sum(0) / w.sum(0), [0.025, 0.975])))
    fit = calibration.marginal_fit(calibration.resampled_marginals(df, 40, seed=2)).first()
    a, b = np.array([[r.predicted, r.truth] for r in got.values()]).T
    assert (fit.cells, fit.corr, fit.rmse) == (9, pytest.approx(np.corrcoef(a, b)[0, 1]), pytest.approx(np.sqrt(((a - b) ** 2).mean())))
    assert fit.mean_variation == pytest.approx(np.abs(a - b).sum() / 6)


def test_held_out_people_are_nobodys_neighbours(spark):
    cells = spark.createDataFrame([(i, j, ((i * 7 + j * 3) % 5) / 4) for i in range(30) for j in range(4)], "pid long, item_id int, x double")
    train = spark.createDataFrame([(i,) for i in range(20)], "pid long")
    near = neighbours.nearest_neighbours(cells, 4, train=train, people_a_block=8).collect()
    assert {r.target for r in near} == set(range(30)) and {r.neighbour for r in near} <= set(range(20)) and all(r.target != r.neighbour for r in near)
    alone = neighbours.nearest_neighbours(cells.where("pid < 20"), 4).collect()
    assert sorted((r.target, r.neighbour, r["rank"]) for r in near if r.target < 20) == sorted((r.target, r.neighbour, r["rank"]) for r in alone)


def test_pairs_agree_in_blocks_as_they_do_one_by_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i, j, None if rng.random() < 0.1 else f"x{rng.integers(0, 3)}") for i in range(23) for j in range(5) if rng.random() < 0.5]
    cells = spark.createDataFrame([*rows, (None, 1, "x0")], "pid long, item_id int, answer string").repartition(3)
    of = {}
    for i, j, a in rows:
        of.setdefault(i, {})[j] = a
    want = {}
    for a in sorted(of):
        for b in sorted(of):
            if a < b:
                met = of[a].keys() & of[b].keys()
                want[a, b] = (len(met), sum(of[a][j] is not None and of[a][j] == of[b][j] for j in met), len(of[a]), len(of[b]))
    for size in (4, 256):
        got = {(r.pid_a, r.pid_b): tuple(r)[2:] for r in neighbours.pair_agreement(cells, unmet=True, people_a_block=size).collect()}
        assert got == want
        assert {(r.pid_a, r.pid_b) for r in neighbours.pair_agreement(cells, people_a_block=size).collect()} == {k for k, v in want.items() if v[0]}
    assert neighbours.pair_agreement(cells.limit(0)).collect() == []


def test_strict_codes_fail_on_unreadable_answers(spark):
    df = spark.createDataFrame([("likert5", "\t3\n"), ("binary", None)], "kind string, answer string")
    code = responses.answer_code(F.col("answer"), F.col("kind"), strict=True)
    assert [r.c for r in df.select(code.alias("c")).collect()] == [2, None]
    with pytest.raises(Exception, match="unreadable answer"):
        df.union(spark.createDataFrame([("likert5", "nine")], "kind string, answer string")).select(code.alias("c")).collect()


def test_rounds_as_they_were_read(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in [{"pid": "a", "item_id": "i", "answer": "1"}, {"pid": "b", "item_id": "i", "round": "", "answer": "2"}, {"pid": "c", "item_id": "i", "round": "main", "answer": "3"}, {"pid": "d", "item_id": "i", "round": "retest", "answer": "4"}]))
    log, bank = questionnaire.read_answer_log(spark, str(path), default_round=None), spark.createDataFrame([("i", "likert5")], "item_id string, kind string")
    assert {r.pid: r["round"] for r in log.collect()} == {"a": None, "b": "", "c": "main", "d": "retest"}
    assert {r.pid for r in responses.coded_answers(log, bank).collect()} == {"c"}
    assert {r.pid for r in responses.coded_answers(log, bank, missing_counts=True).collect()} == {"a", "b", "c"}
    assert responses.coded_answers(log, bank, round_name=None).count() == 4


def test_transcripts_of_another_script_are_found_or_refused(spark):
    rows = [(i, n, item) for i in range(4) for n, item in enumerate(["q1", "q2", "q3"])] + [(7, 1, "q3"), (7, 0, "q1"), (7, 2, "q2"), (8, 0, "q1"), (8, 1, "q2")]
    turns = spark.createDataFrame([(c, n, "user", "t", item) for c, n, item in rows], "conv_id int, turn int, role string, text string, item_id string")
    nested = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "item_id"))).alias("turns"))
    got = {r.example: (r.conversations, r.first) for r in answers.scripted_order(nested).collect()}
    assert got == {0: (4, None), 7: (1, "q3"), 8: (1, "q3")}
    assert answers.scripted_order(nested.where("conv_id < 4"), strict=True).count() == 1
    with pytest.raises(Exception, match="scripts differ"):
        answers.scripted_order(nested, strict=True).collect()

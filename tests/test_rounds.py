"""Redrawn rounds, JSON in free texts, shares, and the versioned sink of answers."""

import hashlib
import json
import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sondage.functions import noise, text
from sondage.operators import rounds
from sondage.sources import versions


def uniform(*parts):
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16], 16) / 2**64


def redraw(rows, name, a, b, temperature, seed):
    """The plain round: (pid, item): (answer, reason, event)."""
    out = {}
    for pid, item, kind, answer, logs, wobble in rows:
        reason = "unknown_item" if kind is None else "no_logprobs" if not logs else "no_wobble" if wobble is None else None
        if reason:
            out[pid, item] = (answer, reason, False)
            continue
        valid = ["1", "2", "3", "4", "5"] if kind == "likert5" else ["no", "yes"]
        floor = min(logs.values()) - 2
        weight = {v: math.exp(logs[v] if v in logs else floor) for v in valid}
        p = {v: w / sum(weight.values()) for v, w in weight.items()}
        chance = min(max(wobble * (a + b * (1 - max(p.values()))), 0), 0.95)
        event = uniform(seed, pid, item, name, "event") < chance
        if event:
            flat = {v: x ** (1 / temperature) for v, x in p.items()}
            u, total = uniform(seed, pid, item, name, "draw"), 0.0
            for v in sorted(flat):
                total += flat[v] / sum(flat.values())
                if u < total:
                    break
            answer = v
        out[pid, item] = (answer, None, event)
    return out


def cells_of(spark):
    rows = []
    for i in range(60):
        for j, kind in enumerate(("likert5", "binary", None)):
            logs = {"1": -0.2, "2": -2.0, "4": -3.0} if kind == "likert5" else {"yes": -0.3, "no": -1.5}
            logs = None if i % 9 == 4 else {} if i % 9 == 5 else logs
            rows.append((f"p{i}", f"q{j}", kind, "1" if kind == "likert5" else "yes", logs, None if i % 10 == 7 else 0.4 + i / 100))
    return rows, spark.createDataFrame([(*r, 0) for r in rows], "pid string, item_id string, kind string, answer string, logprobs map<string,double>, wobble double, position int").repartition(3)


def test_a_round_is_drawn_like_a_plain_one_and_counted_in_the_same_pass(spark):
    rows, cells = cells_of(spark)
    p = F.when(F.col("kind") == "likert5", noise.answer_distribution(F.col("logprobs"), ["1", "2", "3", "4", "5"])).otherwise(noise.answer_distribution(F.col("logprobs"), ["no", "yes"]))
    for name in ("retest", "interview"):
        seen = Observation()
        got = rounds.counting(rounds.redrawn(cells, p, name, a=0.3, b=0.8, temperature=2.0, seed=5), seen).collect()
        want = redraw(rows, name, 0.3, 0.8, 2.0, 5)
        assert {(r.pid, r.item_id): (r.answer, r.skipped, r.event) for r in got} == want
        assert all(r.changed == (r.answer != r.before) for r in got) and any(r.changed for r in got)
        counts = seen.get
        assert counts["answers"] == len(rows) and counts["events"] == sum(e for *_, e in want.values())
        assert all(counts[k] == sum(x[1] == k for x in want.values()) for k in rounds.REASONS)
        assert counts["eligible"] == sum(x[1] is None for x in want.values())
    table = rounds.rates(rounds.redrawn(cells, p, "retest", a=0.3, b=0.8, temperature=2.0, seed=5), [[], ["kind"], ["pid"]])
    levels = table.collect()
    assert sum(r.cells for r in levels if r.level == 1) == [r.cells for r in levels if r.level == 0][0] == sum(r.cells for r in levels if r.level == 2)
    assert {r.kind for r in levels if r.level == 1} == {"likert5", "binary"}


def test_a_scripted_round_has_its_items_and_places(spark):
    _, cells = cells_of(spark)
    order = spark.createDataFrame([("q1", 0), ("q0", 1)], "item_id string, place int")
    assert {(r.item_id, r.position) for r in rounds.in_order(cells, order).collect()} == {("q1", 0), ("q0", 1)}


def test_draw_takes_the_last_key_beyond_the_sum(spark):
    df = spark.createDataFrame([({"b": 0.5, "a": 0.5}, 0.2), ({"b": 0.5, "a": 0.5}, 0.5), ({"a": 0.3, "b": 0.3}, 0.9)], "p map<string,double>, u double")
    assert [r.x for r in df.select(noise.drawn(F.col("p"), F.col("u")).alias("x")).collect()] == ["a", "b", "b"]


JSON_CASES = [
    ('{"a": 1}', '{"a": 1}'),
    ('Sure {not json} then ```json\n{"a": {"b": "}"}, "c": [1, {"d": 2}]}\n``` end }', '{"a": {"b": "}"}, "c": [1, {"d": 2}]}'),
    (r'x {"quote": "she said \"{\" and \\"} y', r'{"quote": "she said \"{\" and \\"}'),
    ('{"open": 1', None),
    ('{{"inner": 2}', '{"inner": 2}'),
    ('{a {"deep": {"x": null}} b} {"later": 1}', '{"deep": {"x": null}}'),
    ("no braces", None),
    ("", None),
    (None, None),
    ("{}", "{}"),
    ('[1, {"in": "list"}]', '{"in": "list"}'),
    ("é😀 {\"k\": \"é😀\"} " + "x" * 3000, '{"k": "é😀"}'),
]


def test_first_json_object(spark):
    df = spark.createDataFrame(JSON_CASES, "t string, want string")
    for r in df.select("t", "want", text.first_json_object(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_distributions_of_named_categories(spark):
    cases = [("yes: 0.7, no: 0.3", {"yes": 0.7, "no": 0.3}), ("Yes = 66\nNO: 22 %", {"yes": 0.75, "no": 0.25}), ("yes:.6 no:.6", {"yes": 0.5, "no": 0.5}), ('{"Yes": 70, "No": 30}', None), ("yes: 0.7, no: 0.3, maybe: 0", None), ("yes: 0.7", None), ("yes: 1, yes: 0, no: 0", None), ("yes: -1, no: 2", None), ("yes: 5, no: 3", None), ("yes: 0, no: 0", None), ("", None), (None, None)]
    df = spark.createDataFrame(cases, "t string, want map<string,double>")
    for r in df.select("t", "want", text.parse_distribution(F.col("t"), ["Yes", "No"]).alias("got")).collect():
        assert (r.got is None) == (r.want is None) and (r.want is None or r.got == pytest.approx(r.want)), r.t


def lines(spark, rows):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x), i) for i, x in enumerate(rows)], "line string, position int").repartition(2)


def cell(pid, item, completion, round_="main"):
    return {"pid": pid, "item_id": item, "round": round_, "completion": completion}


def stored(spark, path):
    answers = sorted(tuple(r) for r in versions.read_version(spark, path, "answers", versions.ANSWERS).select("pid", "item_id", "round", "answer").collect())
    rejects = {(r.pid, r.item_id, r.round): r.reason for r in versions.read_version(spark, path, "rejects", versions.REJECTS).collect()}
    return answers, rejects


def test_batches_are_ingested_once(spark, tmp_path):
    path, bank = str(tmp_path / "run"), spark.createDataFrame([("q1", "likert5"), ("q2", "binary")], "item_id string, kind string")
    assert stored(spark, path) == ([], {})
    batch = [cell("a", "q1", "5."), "{broken", "not json", "", cell("a", "q1", "4"), cell("a", "q2", "perhaps"), cell("a", "q2", "Yes!"), cell("b", "q1", "15"), cell("b", "q9", "1"), {"pid": "c", "item_id": "q2", "completion": "no"}]
    assert versions.ingest(spark, path, lines(spark, batch), bank) == {"kept": 3, "rejected": 5, "duplicates": 1, "outstanding": 3}
    answers, rejects = stored(spark, path)
    assert answers == [("a", "q1", "main", "5"), ("a", "q2", "main", "yes"), ("c", "q2", "main", "no")]
    assert rejects == {(None, None, None): "not JSON", ("b", "q1", "main"): "none", ("b", "q9", "main"): "item not in bank"}
    # the same batch again: only what was refused is refused again
    again = versions.ingest(spark, path, lines(spark, batch), bank)
    assert again["kept"] == 0 and again["outstanding"] == 3 and stored(spark, path) == (answers, rejects)
    answered = [cell("a", "q1", "1"), cell("a", "q2", "no"), cell("c", "q2", "no")]
    before = versions.published(spark, path)
    assert versions.ingest(spark, path, lines(spark, answered), bank) == {"kept": 0, "rejected": 0, "duplicates": 3, "outstanding": 3}
    assert versions.published(spark, path) == before
    # an answer takes its key off the rejects, a new refusal replaces the old one
    assert versions.ingest(spark, path, lines(spark, [cell("b", "q1", "3"), cell("b", "q9", "2")]), bank)["outstanding"] == 2
    answers, rejects = stored(spark, path)
    assert ("b", "q1", "main", "3") in answers and len(answers) == 4 and set(rejects) == {(None, None, None), ("b", "q9", "main")}


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "v")
    good = spark.createDataFrame([(1,)], "x int")
    versions.commit(spark, path, {"t": good})
    bad = good.select(F.raise_error(F.lit("broken")).cast("int").alias("x"))
    with pytest.raises(Exception, match="broken"):
        versions.commit(spark, path, {"t": good.select(F.lit(2).alias("x")), "u": bad})
    assert versions.published(spark, path) == [1] and versions.read_version(spark, path, "t", "x int").collect()[0].x == 1
    for x in (3, 4, 5):
        versions.commit(spark, path, {"t": good.select(F.lit(x).alias("x"))})
    assert versions.published(spark, path) == [3, 4] and versions.read_version(spark, path, "t", "x int").collect()[0].x == 5

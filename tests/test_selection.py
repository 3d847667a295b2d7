"""Quota samples against a plain draw, and the stored selection."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sondage.operators import selection

POOL = [f"i{k:02d}" for k in range(30)]
FIXED = {"a": POOL[:9], "b": POOL[9:10], "c": []}
CLASSES = {"cross": POOL[10:20], "weak": POOL[20:24], "odd": ["elsewhere"]}


def plain(pid, n_items, each, seed):
    u = lambda i: int(hashlib.sha256(f"{seed}:{pid}:{i}".encode()).hexdigest()[:16], 16)
    chosen = [i for s in FIXED.values() for i in sorted(s, key=u)[:each]]
    quotas = selection.proportional_quotas({k: len([i for i in v if i in POOL]) for k, v in CLASSES.items()}, n_items - len(chosen))
    chosen += [i for k, v in CLASSES.items() for i in sorted([i for i in v if i in POOL], key=u)[: quotas[k]]]
    chosen = chosen[:n_items]
    chosen += sorted([i for i in POOL if i not in chosen], key=u)[: n_items - len(chosen)]
    return [i for i in POOL if i in chosen]


@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 20)), st.integers(-2, 60))
def test_quotas_add_up_and_stay_near_their_share(sizes, total):
    quotas = selection.proportional_quotas(sizes, total)
    pool = sum(sizes.values())
    want = min(max(0, total), pool)
    assert sum(quotas.values()) == want and all(0 <= quotas[k] <= n for k, n in sizes.items())
    assert all(abs(quotas[k] - want * n / pool) < 1 for k, n in sizes.items() if pool)


def test_quotas_of_equal_remainders_go_to_the_first():
    assert selection.proportional_quotas({"x": 1, "y": 1, "z": 1}, 2) == {"x": 1, "y": 1, "z": 0}


@pytest.mark.parametrize("n_items,each", [(8, 2), (20, 3), (28, 1), (40, 2), (2, 3), (0, 0)])
def test_samples_equal_a_plain_draw(spark, n_items, each):
    people = spark.createDataFrame([(f"p{k}",) for k in range(12)], "pid string")
    got = {}
    for r in selection.quota_sample(people, POOL, FIXED, each, CLASSES, n_items, seed=4).collect():
        got.setdefault(r.pid, []).append((r.place, r.item_id))
    for k in range(12):
        assert [i for _, i in sorted(got.get(f"p{k}", []))] == plain(f"p{k}", n_items, each, 4)


def test_a_stored_selection_stays(spark, tmp_path):
    path, people = str(tmp_path / "s"), spark.createDataFrame([("p0",), ("p1",), ("p1",), (None,)], "pid string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    first = rows(selection.stored_selection(spark, path, people, POOL, FIXED, 2, CLASSES, 8, seed=4))
    assert {r[0] for r in first} == {"p0", "p1"}
    more = spark.createDataFrame([("p1",), ("p2",)], "pid string")
    later = rows(selection.stored_selection(spark, path, more, POOL[:25], FIXED, 1, CLASSES, 6, seed=9))
    assert [r for r in later if r[0] != "p2"] == first and len([r for r in later if r[0] == "p2"]) == 6
    assert rows(selection.stored_selection(spark, path, people, POOL, FIXED, 2, CLASSES, 8)) == later

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import jaccard_join as jj


def word_list(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return low.encode().split()


def brute(rows, size=4, num=85, den=100):
    """{row number: (n_shingles, component)} by an inverted index over all shingles."""
    sets = []
    for _, text in rows:
        w = word_list(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g])
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in s:
            where[g].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def edited(rng, words, share):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"w{rng.integers(10**6)}"
    return out


def near_copies(rng):
    base = [f"w{rng.integers(3000)}" for _ in range(400)]
    rows = []
    for length in (3, 4, 6, 8, 9, 10, 12, 15, 20, 30, 60, 120, 400):
        for copy in range(14):
            words = edited(rng, base[:length], rng.choice([0, 0.005, 0.02, 0.04, 0.06]))
            cut = rng.integers(0, max(length // 8, 2))
            rows.append(" ".join(words[: length - cut] if copy % 3 else words[cut:]))
    return rows


def test_near_copies_of_all_sizes(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", " \n ", "A b", "a B", "a b c", *near_copies(rng), *near_copies(rng)]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(7, texts[60]), (60, texts[60])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, component_id string").repartition(5)
    assert got(jj.join_documents(docs)) == brute(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(jj.join_documents(docs.repartition(6))) == brute(rows)


def test_other_sizes_and_thresholds(spark):
    rng = np.random.default_rng(5)
    rows = list(enumerate(near_copies(rng)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jj.join_documents(docs, size=5, threshold=(80, 100))) == brute(rows, 5, 80)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jj.join_documents(docs).count() == 0
    assert got(jj.join_documents(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string"))) == [("1", 0, "1"), ("2", 0, "2")]


def test_components_of_a_path(spark):
    n = 40
    order = np.random.default_rng(0).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (102, 101)], "a long, b long")
    found = {r.node: r.label for r in jj.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, n)}, 101: 100, 102: 100}


@pytest.mark.parametrize("threshold", [(85, 100), (80, 100), (1, 2)])
def test_linked_sets_share_a_signature(threshold):
    rng = np.random.default_rng(1)
    classes = jj.SizeClasses(threshold)
    tried = 0
    for _ in range(600):
        a = int(rng.choice([1, 2, 5, 6, 7, 11, 25, 60, 200, 700]))
        pool = np.unique(rng.integers(0, 2**64, 3 * a + 4, dtype=np.uint64))
        rng.shuffle(pool)
        x = set(pool[:a].tolist())
        drop, add = rng.integers(0, a // 5 + 2), rng.integers(0, a // 5 + 2)
        y = set(list(x)[drop:]) | set(pool[a : a + add].tolist())
        if not y or x == y or threshold[1] * len(x & y) < threshold[0] * len(x | y):
            continue
        tried += 1
        sx, sy = (classes.signatures(np.array(sorted(s), np.uint64)) for s in (x, y))
        assert set(sx.tolist()) & set(sy.tolist())
    assert tried > 50


@pytest.mark.parametrize("size, num", [(4, 85), (5, 80)])
def test_all_links_between_different_sets(spark, size, num):
    rng = np.random.default_rng(6)
    rows = list(enumerate([None, "", "A b", "a B", *near_copies(rng)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links, membership = jj.link_documents(docs, size=size, threshold=(num, 100))
    members = membership.collect()
    sets = {}
    for i, text in rows:
        w = word_list(text)
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    assert sorted((r.doc_id, r.n_shingles) for r in members) == sorted((i, len(s)) for i, s in sets.items())
    by_key = defaultdict(set)
    for r in members:
        by_key[r.key].add(sets[r.doc_id])
    assert all(len(s) == 1 for s in by_key.values()) and len(by_key) == len(set(sets.values()))
    distinct = [s for s in set(sets.values()) if s]
    expected = {frozenset((a, b)) for a in distinct for b in distinct if a != b and 100 * len(a & b) >= num * len(a | b)}
    got_links = [frozenset((*by_key[r.key], *by_key[r.center])) for r in links.collect()]
    assert len(got_links) == len(set(got_links)) and set(got_links) == expected
    components = len({c for *_, c in brute([(i, t) for i, t in rows if sets[i]], size, num)})
    assert len(expected) > len(distinct) - components  # more links than a forest of the components has


@pytest.mark.parametrize("threshold", [(85, 100), (80, 100), (1, 2)])
def test_linked_sets_keep_a_signature_without_what_they_spare(threshold):
    rng = np.random.default_rng(8)
    classes = jj.SizeClasses(threshold)
    tried = spared = 0
    for _ in range(400):
        a = int(rng.choice([6, 11, 25, 60, 200, 700]))
        pool = np.unique(rng.integers(0, 2**64, 3 * a + 4, dtype=np.uint64))
        rng.shuffle(pool)
        drop, add = rng.integers(0, a // 5 + 2), rng.integers(0, a // 5 + 2)
        x, y = set(pool[:a].tolist()), set(pool[drop : a + add].tolist())
        if not y or threshold[1] * len(x & y) < threshold[0] * len(x | y):
            continue
        tried += 1
        sides = []
        for s in (x, y):
            left = set()
            for _, sigs, spare in classes.parts(np.array(sorted(s), np.uint64)):
                left |= set(sorted(sigs.tolist(), key=lambda g: g * 0x9E3779B97F4A7C15 % 2**64)[spare:])  # any order that both have
                spared += spare
            sides.append(left)
        assert sides[0] & sides[1]
    assert tried > 50 and spared > (1000 if threshold[1] == 100 else 0)




def test_only_blocks_with_more_pairs_meet_again(spark, monkeypatch):
    asked = []
    near_blocks = jj.near_blocks

    def counted(met, labels, most, only=None):
        asked.append(None if only is None else only.distinct().count())
        return near_blocks(met, labels, most, only)

    monkeypatch.setattr(jj, "near_blocks", counted)
    monkeypatch.setattr(jj, "PAIRS_OF_COMPONENTS", 1)
    monkeypatch.setattr(jj, "BLOCK_BYTES", 1 << 9)
    rng = np.random.default_rng(10)
    rows = list(enumerate([*near_copies(rng), *near_copies(rng)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jj.join_documents(docs)) == brute(rows)
    assert asked[0] is None and all(n is not None for n in asked[1:])

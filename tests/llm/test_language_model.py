import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import language_model as lm

SF = "/root/testdata/sf0.001/documents.parquet"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*low.encode().split(), None]


def brute(rows):
    train = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    out = {}
    for i, x in rows:
        ts = tokens(x)
        out[i] = (len(ts), sum(t in train for t in ts), n, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts))
    return out


@pytest.mark.parametrize("head", [0, 50, 10_000])
def test_base_is_exact(spark, head):
    docs = spark.read.parquet(SF).select("doc_id", "text", F.lit(1).alias("score"))
    held = lm.is_fold("doc_id", 7, 2)
    model = lm.train(docs.where(~held), filter_bytes=1 << 20, head_words=head)
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = lm.score(docs, model, held).collect()
    assert len(got) == len(expected)
    for r in got:
        n, known, total, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score < 0


def test_filter_holds_quantised_counts(spark):
    text = " ".join(["a b"] * 9 + ["c"])
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    model = lm.train(docs, filter_bytes=1 << 16, n_probes=6)
    assert (model.scorer.tokens, model.scorer.vocabulary) == (22, 4)
    tokens, place = lm.flat_tokens([lm.WordHashes().of("a b c zz"), lm.WordHashes().of("")])
    assert place.tolist() == [0, 1, 2, 3, 4, 5, 0, 1]
    one, two = model.scorer.counts(tokens, place)
    assert one.tolist() == [2.5, 11.5, 11.5, 1.0, 0.0, 2.5, 2.5, 2.5]
    assert two.tolist() == [0.0, 1.0, 11.5, 1.0, 0.0, 0.0, 0.0, 2.5]
    counts = np.array([1, 2, 3, 4, 7, 8])
    assert lm.quantised(counts).tolist() == [1, 2, 2, 3, 3, 4]


def test_probabilities_sum_to_one_and_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = lm.is_fold("doc_id", 7, 2)
    model = lm.train(docs.where(~held))
    got = lm.score(docs.where(held), model, held).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    assert model.false_hits < 0.01


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = lm.train(docs, filter_bytes=1 << 16)
    assert lm.score(docs, model, F.lit(False)).count() == 0
    one = spark.createDataFrame([(None, None), (5, "x y")], "doc_id long, text string")
    assert sorted(r.base_score for r in lm.score(one, model, F.lit(False)).collect()) == [0.0, 0.0]


@pytest.mark.parametrize("head", [50, 10_000])
def test_filter_above_the_broadcast_bound_gives_the_same_scores(spark, head):
    docs = spark.read.parquet(SF).select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (-1, "")], "doc_id long, text string")).repartition(3)
    held = lm.is_fold("doc_id", 7, 2)
    small = lm.train(docs.where(~held), head_words=head)
    joined = lm.train(docs.where(~held), filter_bytes=1 << 10, head_words=head)
    assert small.scorer.bloom is not None and joined.scorer.bloom is None
    assert joined.mu == small.mu
    assert joined.false_hits == small.false_hits < 0.01
    expected, got = ({r.doc_id: r for r in lm.score(docs, m, held).collect()} for m in (small, joined))
    assert len(got) == len(expected) == docs.count()
    for i, r in expected.items():
        assert tuple(got[i])[:5] == tuple(r)[:5]
        assert tuple(got[i])[5:] == pytest.approx(tuple(r)[5:], rel=1e-9)


def test_probability_is_at_most_one(spark):
    docs = spark.createDataFrame([(1, "a " * 1024)], "doc_id long, text string")
    model = lm.train(docs)
    scored = spark.createDataFrame([(1, "a"), (2, "a a")], "doc_id long, text string")
    assert all(r.score <= 0 for r in lm.score(scored, model, F.lit(False)).collect())
    tokens, place = lm.flat_tokens([lm.WordHashes().of("a a")])
    counts = model.scorer.counts(tokens, place)
    assert all((model.scorer.log10(counts, place, mu) <= 0).all() for mu in lm.MU_GRID)


def test_mass_after_contexts_of_a_large_vocabulary_is_one_at_most(spark):
    rng = np.random.default_rng(11)
    weights = 1 / np.arange(1, 60_001)
    draws = rng.choice(60_000, 900_000, p=weights / weights.sum())
    texts = [(i, " ".join(f"w{k}" for k in draws[i * 300 : (i + 1) * 300])) for i in range(3000)]
    texts.append((3000, " ".join(f"w{k}" for k in range(60_000))))
    model = lm.train(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    scorer = model.scorer
    assert scorer.vocabulary == 60_001 and 0.001 < scorer.false_hits < 0.02  # false hits alone would be many words
    words = np.concatenate([lm.WordHashes().of(" ".join(f"w{k}" for k in range(60_000))), [lm.END]])
    exact, which = lm.exact_counts(words, model.head)
    for context in (0, 1, 5, 40, 300, 2000, 20_000, 59_999):
        tokens = np.stack([np.full(len(words), words[context]), words], 1).ravel()
        place = np.tile([1, 2], len(words))
        known = np.stack([np.full(len(words), exact[which[context]]), exact[which]], 1).ravel()
        counts = scorer.counts(tokens, place)
        for mu in (3.0, model.mu):
            assert (10 ** scorer.log10(counts, place, mu, known)[1::2]).sum() < 1.02, (context, mu)


def plain_score(model, tokens, exact):
    """log10 probability of one text, token by token: the documented formula over the filter's levels."""
    f, v, bloom = model.scorer.false_hits, model.scorer.vocabulary, model.scorer.bloom

    def level(gram):
        n = 0
        while n < 63 and bloom.contains(bloom.key(np.array([gram], np.uint64)), n + 1)[0]:
            n += 1
        return n

    raised = f / (1 - 2 * f)
    total, before = 0.0, lm.BEGIN
    for t in tokens:
        one = level(t)
        p = ((1.5 * 2 ** (one - 1) - 0.5 if one else 0.0) + 1) / (model.scorer.level_tokens * (1 + raised) + v + 1)
        two = level(lm.mixed(np.array([before], np.uint64), np.array([t], np.uint64))[0])
        h = exact.get(int(before)) or (2 ** level(before) - 1 if level(before) else 0)
        c = min(2 ** (two - 1) if two else 0, h)
        worth = h / (h * (1 + raised) + v * f * (1 + raised)) if h else 0.0
        p = (worth * c + model.mu * p) / (h + model.mu)
        total += math.log10(p)
        before = t
    return total


def test_scores_follow_the_formula(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text")
    held = lm.is_fold("doc_id", 7, 2)
    model = lm.train(docs.where(~held), head_words=300)
    exact = dict(zip(model.head[0].tolist(), model.head[1].tolist()))
    some = sorted(docs.collect(), key=lambda r: len(r.text or ""))[20:26]
    got = {r.doc_id: r.score for r in lm.score(docs, model, held).collect()}
    for r in some:
        tokens = [*lm.WordHashes().of(r.text), lm.END]
        assert got[r.doc_id] == pytest.approx(plain_score(model, tokens, exact), rel=1e-9)

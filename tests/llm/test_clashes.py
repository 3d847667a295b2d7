"""Columns whose names differ by case or look internal, and the mass of the language model."""

import numpy as np
from pyspark.sql import functions as F

from sondage.llm import language_model as lm
from sondage.llm import quality_classifier, quality_rules


def clashing(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id long, text string")
    return docs.withColumns({c: F.lit("mine") for c in ("N_Words", "__text", "__words", "__lines", "Posterior", "F_words")})


def test_rules_and_features_carry_other_columns(spark):
    docs = clashing(spark)
    for got in (quality_rules.judge_documents(docs), quality_classifier.with_features(docs)):
        rows = got.collect()
        assert len(rows) == 2 and all(r["__text"] == r["__words"] == r["__lines"] == "mine" for r in rows)


def test_windows_of_a_text_beyond_the_short_keys(spark):
    words = [f"w{i}" for i in range(quality_rules.LONG_WORDS + 10)]
    docs = spark.createDataFrame([(" ".join([*words, *words[:4]]),)], "text string")
    assert quality_rules.with_stats(docs).first()["n_repeat_words"] == 8


def test_mass_after_a_context_is_at_most_one(spark):
    rng = np.random.default_rng(3)
    text = " ".join(f"v{min(int(x), 60)}" for x in rng.zipf(1.4, 4000))
    model = lm.train(spark.createDataFrame([(text,)], "text string"))
    vocabulary = sorted(set(text.split()))
    hashes = lm.WordHashes()
    for context in vocabulary[:8]:
        tokens, place = lm.flat_tokens([hashes.of(f"{context} {w}") for w in vocabulary] + [hashes.of(context)])
        exact, which = lm.exact_counts(tokens, model.head)
        logs = model.scorer.log10(model.scorer.counts(tokens, place), place, model.mu, exact[which])
        after = np.append((place == 2)[:-3], [False, False, True])  # the words after the context, and the end after it alone
        assert 0.3 < (10 ** logs[after]).sum() <= 1.02

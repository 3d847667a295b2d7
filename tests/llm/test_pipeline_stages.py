import numpy as np

import corpus_pipeline
from sondage.llm import registry
from sondage.llm._common import written
from tests.llm.test_jaccard_join import brute, near_copies


def test_near_copies_are_those_of_five_words_and_four_fifths(spark):
    rows = list(enumerate(near_copies(np.random.default_rng(5))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    linked = brute(rows, 5, 80)
    assert len({c for *_, c in linked}) < len({c for *_, c in brute(rows)})
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == len({c for *_, c in linked})


def test_cut_copy_between_the_two_thresholds_goes(spark):
    words = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:86]))]  # 82 of 100 shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 1


SF = "/root/testdata/sf0.01"


def test_rules_stage_keeps_clean_short_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = {r.doc_id: len((r.text or "").split()) for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.keep_by_rules(spark, docs, SF).collect()}
    short = [i for i, n in clean.items() if n < 50]
    assert len(short) > 5
    assert sum(i in kept for i in short) >= 0.9 * len(short)
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_rules_stage_drops_texts_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    assert corpus_pipeline.keep_by_rules(spark, docs, SF).count() == 0


def test_op7_keeps_no_document_that_fails_the_base_rules(spark):
    rows = registry.op7_quality_rules(spark, SF).collect()
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed and r.posterior >= 0.5)


def test_documents_are_not_shuffled_for_a_large_surplus(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(5000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    placed = corpus_pipeline._placed(spark.read.parquet(str(tmp_path / "docs")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        surplus = written(placed.where("__doc.doc_id % 3 = 0").select("row"), "surplus")
        left = corpus_pipeline._without(placed, surplus)
        assert sorted(r[0] for r in left.select("__doc.doc_id").collect()) == [i for i, _ in rows if i % 3]
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

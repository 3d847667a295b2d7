import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sondage.llm import decontamination, quality_classifier, quality_rules
from tests.llm.test_bpe import whole
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.written(stage(spark, docs, SF), name)
        out.append((name, docs, got))
        docs = got
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, steps):
    by_name = {name: (before, after) for name, before, after in steps}
    for name, (before, after) in by_name.items():
        if name != "bpe":
            assert after.schema == before.schema
            assert after.exceptAll(before).count() == 0
    before, after = by_name["quality_rules"]
    assert ids(after) == ids(quality_rules.judge_documents(before).where("kept"))
    before, after = by_name["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = set(ids(after))
    clean = [r.doc_id for r in before.join(labels, "doc_id").where("quality = 1").collect()]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert set(quality_classifier.FEATURES).isdisjoint(after.columns)
    before, after = by_name["jaccard_join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert after.count() == len({component for *_, component in brute(rows, 5, 80)})
    before, after = by_name["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontamination.build_index(items)
    dirty = {r.doc_id for r in before.collect() if list(decontamination.find(index, [r.text]))}
    assert ids(after) == sorted(set(ids(before)) - dirty)
    plain = [decontamination.normalised(t) for _, t in items]
    assert not any(p in decontamination.normalised(r.text) for r in after.collect() for p in plain)
    before, after = by_name["bpe"]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()) == sorted((r.doc_id, *whole(r.text)) for r in before.collect())


def test_run_is_the_stages(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[-1][2].collect()))


def test_clashing_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.withColumn("text", F.lit(None).cast("string")).limit(2))
    odd = odd.withColumns({c: F.lit(1) for c in ("kept", "n_words", "quality", "key", "component_id")})
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns, name
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.drop_near_copies(spark, odd, SF).count() <= 32

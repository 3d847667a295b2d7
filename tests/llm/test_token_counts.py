import pytest
import sentencepiece
from pyspark.sql import functions as F

from sondage.llm import token_counts as tc

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def test_counts_are_the_librarys(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("n_tokens", F.lit("x"))
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = tc.count_tokens(docs, tc.Tokenizer(PATH), str(tmp_path / "cache"), limit=500)
    expected = {r.doc_id: (len(r.text.encode()), len(model.encode(r.text))) for r in docs.collect()}
    rows = out.collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == expected and len(rows) == len(expected)
    assert all(r.over_limit == (r.n_tokens > 500) for r in rows)


def test_only_distinct_misses_are_encoded(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    rows = [(None, None), (1, ""), (2, "some text"), (2, "some text"), (3, "x " * 30_000), (4, " <s> ab</s>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenizer = tc.Tokenizer(PATH)
    seen = []
    encode = tc.encode_misses
    monkeypatch.setattr(tc, "encode_misses", lambda texts, t: (seen.append(sorted(r.text for r in texts.collect())), encode(texts, t))[1])
    first = tc.count_tokens(docs, tokenizer, cache)
    assert seen[0] == sorted({t or "" for _, t in rows})
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_tokens) for r in first.collect()), key=key) == sorted(((i, len(model.encode(t or ""))) for i, t in rows), key=key)
    again = tc.count_tokens(docs.union(spark.createDataFrame([(9, "new")], docs.schema)), tokenizer, cache)
    assert seen[1] == ["new"] and again.count() == 7
    other = tc.count_tokens(docs, tc.Tokenizer("/opt/tokenizers/byte_bpe_50k.json"), cache)
    assert len(seen[2]) == 4 and other.count() == 6


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tc.count_tokens(docs, tc.Tokenizer(PATH), str(tmp_path / "cache")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_versions_differ(name):
    assert len(tc.Tokenizer(f"/opt/tokenizers/{name}").version()) == 64

import hashlib
import random

import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sondage.llm import piece_bpe
from sondage.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "▁", "a", "b", "th", "e", "\n", "\t", "é", "漢", "😀", "①", "\x00", "he", "in", "0", "1", " " * 21, "the", "aa", "́", ".", "--", "==", "<s>", "<unk>", "�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(st.characters(exclude_categories=["Cs"]), max_size=3)), max_size=40))
def test_ids_and_decoding_equal_the_library(parts):
    text, library = "".join(parts), sentencepiece.SentencePieceProcessor(model_file=PATH)
    bpe = piece_bpe.loaded(PATH)
    (ids,) = bpe.encode([text])
    assert ids.tolist() == library.encode(text)
    assert bpe.decode(ids) == library.decode(ids.tolist())


def test_long_words_and_runs(library):
    texts = [" " * n for n in (1, 2, 15, 16, 17, 33, 5000, 100_001)] + ["a" * 999, "ab" * 3000, "-" * 1500, "=" * 3001, "the" * 20_000, "漢字" * 5000, " ab" * 4000, "x" * 50_000 + " y"]
    got = piece_bpe.loaded(PATH).encode(texts)
    assert [g.tolist() for g in got] == library.encode(texts)


def test_decoding_of_any_ids(library):
    bpe, rng = piece_bpe.loaded(PATH), random.Random(5)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 198, 200, 229, 148, 163, 243, 162, 259, 264, 28705, 28708, 29000, rng.randrange(32000)]) for _ in range(rng.randrange(10))]
        assert bpe.decode(ids) == library.decode(ids)


def test_query_equals_the_library_on_the_whole_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_piece_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, docs[r.doc_id])


def test_nulls_repeats_clashes_and_empty_tables(spark, library):
    rows = [(1, None, "x"), (1, "", None), (None, "Fine  day.\n", "y"), (2, "Fine  day.\n", "z"), (3, "word " * 60_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_bpe.encode_documents(docs, PATH).collect())
    assert got == sorted((str(d), *expected(library, t)) for d, t, _ in rows)
    with_ids = {str(r.doc_id): r for r in piece_bpe.encode_documents(docs.where("doc_id = 2 or doc_id is null"), PATH, with_ids=True).collect()}
    assert with_ids["2"].ids == library.encode("Fine  day.\n") and with_ids["None"].decoded == "Fine  day.\n"
    assert piece_bpe.encode_documents(docs.limit(0), PATH).collect() == []


def test_words_leave_and_come_back():
    bpe = piece_bpe.PieceBpe(PATH)
    kept = piece_bpe._Words(bpe, kept=3)
    for words in ({"▁a", "▁b"}, {"▁c", "▁d"}, {"▁a", "▁e"}, {"▁b", "▁" + "long" * 30}, {"▁a", "▁" + "long" * 30}):
        of = kept.of(words)
        assert all(of[w] == ",".join(map(str, bpe.encode([w[1:]])[0])) for w in words)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.PieceBpe(str(tmp_path / "m.model"))

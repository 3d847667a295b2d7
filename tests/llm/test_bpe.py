import functools
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sondage.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def model():
    return bpe.ByteBpe(PATH)


@functools.cache
def second_model():
    return bpe.ByteBpe(PATH, second=True)


def whole(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    decoded = Tokenizer.from_file(PATH).decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sé漢😀1. <|", max_size=12), max_size=12), st.data())
def test_joined_pieces_equal_the_whole_text(model, words, data):
    text = " ".join(words).encode()
    cuts = sorted({0, len(text), *data.draw(st.lists(st.integers(0, len(text)), max_size=5))})
    cuts = [c for c in cuts if c == len(text) or text[c] & 0xC0 != 0x80]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    got = bpe.joined(model, list(zip(parts, model.encode(parts))))
    assert got.tolist() == model.encode([text])[0].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\xa0abBesSé'ÀÖȿ😀漢1234.,<|endoftx>###aaa", max_size=60))
def test_second_encoder_agrees(model, text):
    assert second_model().encode([text.encode()])[0].tolist() == model.encode([text.encode()])[0].tolist()


def test_second_encoder_agrees_on_documents(model):
    import pyarrow.parquet as pq

    texts = [x.encode() for x in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    assert model.ranks_suffice()
    for a, b in zip(bpe.ByteBpe(PATH, second=True).encode(texts), model.encode(texts), strict=True):
        assert a.tolist() == b.tolist()


def test_chunks_join_to_the_text():
    raw = ("Füße über alles — 漢字 " * 900).encode()
    assert b"".join(bpe.chunks(raw)) == raw
    assert all(x.decode() is not None for x in bpe.chunks(raw))


def test_documents_like_the_library(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "bêta", "l'été", "x", "###", "3141", "<|endoftext|>", "漢字", "\n\n", "  "]
    long = [" ".join(rng.choice(words, 900)) for _ in range(6)]
    texts = [None, "", " ", long[0], long[0], long[0][:3000] + long[1], long[2] + long[0][500:], "x" * 9000, "漢" * 5000, *long]
    rows = [(i if i % 5 else None, t, "en") for i, t in enumerate(texts)] + [(3, long[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode_documents(docs, PATH)
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()), key=key)
    assert got == sorted(((i, *whole(t)) for i, t, _ in rows), key=key)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0

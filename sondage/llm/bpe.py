"""Operator 8, byte-level BPE by content-defined chunk reuse, and its decoding.

A rolling hash over UTF-8 bytes cuts texts where their content says so, hence equal passages give
equal chunks wherever they stand. Chunks that occur once are encoded in place. A chunk that occurs
again is encoded once for the whole corpus, and its ids are joined to all its places. Where two pieces
meet, the text around the joint is encoded again in growing windows until the window's ids
agree exactly with those on both sides.

Why agreement there is agreement with the whole text: pre-tokens of a byte-level BPE never reach
from a visible ASCII character over the white space after it, and none looks back past such a place.
Windows start and end there, and one word more on either side must come out as it stood.

Defined results: a null text counts as the empty text, which has no ids; repeated rows are encoded by
themselves and get equal results; texts without any such place, however long, are encoded whole;
extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written
from .bloom import SegmentedBloom, build_bloom

WINDOW = 16
MEAN_BITS = 11
MIN_CHUNK = 512
BLOOM_BYTES = 1 << 23
_FLUSH = 200_000
_CUT = re.compile(rb"[\x21-\x7e][\x20\x09-\x0d]")
_POWERS = [pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64) for i in range(5)]


#: The split of a byte-level pre-tokenizer, and the highest first byte of the characters
#: that every Unicode version splits alike (below U+0240).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN_BYTE = 0xC8


class ByteBpe:
    """The vocabulary file's encoder, and its decoder as bytes of each id.

    Latin texts go through a second, faster encoder of the same vocabulary, if `second` is set; it merges by the
    rank of a pair's joined bytes, which is the same where ids follow the order of merges and every token
    encodes to itself (`ranks_suffice`).
    """

    def __init__(self, path: str, second: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        byte_of = {}
        spare = 256
        for b in range(256):  # visible bytes stand for themselves, the others for 256, 257, ...
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                byte_of[chr(b)] = b
            else:
                byte_of[chr(spare)] = b
                spare += 1
        vocab = self.library.get_vocab(with_added_tokens=False)
        added = self.library.get_added_tokens_decoder()
        size = max([*vocab.values(), *added]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            if i not in added:
                self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for i, token in added.items():
            self.token_bytes[i] = token.content.encode()
        self.lengths = np.array([len(x) for x in self.token_bytes], np.int64)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.second = None
        if second:
            import tiktoken

            special = {token.content: i for i, token in added.items()}
            ranks = {self.token_bytes[i]: i for token, i in vocab.items() if i not in added}
            self.second = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ranks_suffice(self) -> bool:
        """Whether the second encoder is sure to agree with the library on Latin texts."""
        spec = json.loads(self.library.to_str())
        split, vocab, added = spec["pre_tokenizer"], spec["model"]["vocab"], spec["added_tokens"]
        plain = spec["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        plain = plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if not plain or any(a >= b for a, b in zip(merged, merged[1:])) or spec["model"].get("ignore_merges"):
            return False
        model = self.library.model
        return all(len(model.tokenize(token)) == 1 for token, i in vocab.items() if i < len(merged) + 256)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.second is None:
            return self._by_library(texts)
        out: list = [None] * len(texts)
        rest = []
        for i, raw in enumerate(texts):
            if raw and np.frombuffer(raw, np.uint8).max() > LATIN_BYTE:
                rest.append(i)
            else:
                out[i] = self.second.encode_to_numpy(raw.decode(), allowed_special="all")
        for i, ids in zip(rest, self._by_library([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = ids
        return out

    def _by_library(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        """n_tokens, ids_sha256 and decoded_sha256."""
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def chunks(raw: bytes) -> list[bytes]:
    """`raw` cut after windows whose rolling hash ends in zeros, never inside a code point."""
    if len(raw) < 2 * MIN_CHUNK:
        return [raw]
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(WINDOW.bit_length() - 1):
            step = 1 << i
            h = h[:-step] * np.uint64(_POWERS[i]) + h[step:]
        h *= np.uint64(0xD6E8FEB86659FD93)
    ends = np.flatnonzero(h >> np.uint64(64 - MEAN_BITS) == 0) + WINDOW
    out, start = [], 0
    for end in ends.tolist():
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        if end - start >= MIN_CHUNK and len(raw) - end >= MIN_CHUNK:
            out.append(raw[start:end])
            start = end
    out.append(raw[start:])
    return out


Piece = tuple[bytes, np.ndarray]


def repaired(bpe: ByteBpe, left: Piece, right: Piece) -> tuple[Piece, Piece] | None:
    """Both pieces with the ids around their joint as the whole text has them; None without agreement."""
    before = [m.start() + 1 for m in _CUT.finditer(left[0])]
    after = [m.start() + 1 for m in _CUT.finditer(right[0])]
    left_ends, right_ends = np.cumsum(bpe.lengths[left[1]]), np.cumsum(bpe.lengths[right[1]])

    def place(ends: np.ndarray, offset: int) -> int | None:
        """Number of ids that fill `offset` bytes exactly."""
        i = int(np.searchsorted(ends, offset)) + 1
        return i if i <= len(ends) and ends[i - 1] == offset else None

    wide = 1
    while wide + 1 <= len(before) and wide + 1 <= len(after):
        a0, a1, b1, b0 = before[-wide - 1], before[-wide], after[wide - 1], after[wide]
        (ids,) = bpe.encode([left[0][a0:] + right[0][:b0]])
        ends = np.cumsum(bpe.lengths[ids])
        marks = [place(left_ends, a0), place(left_ends, a1), place(right_ends, b1), place(right_ends, b0), place(ends, a1 - a0), place(ends, len(left[0]) - a0 + b1)]
        if None not in marks:
            i0, i1, j1, j0, i, j = marks
            if np.array_equal(ids[:i], left[1][i0:i1]) and np.array_equal(ids[j:], right[1][j1:j0]):
                return (left[0][:a0], left[1][:i0]), (left[0][a0:] + right[0], np.concatenate([ids, right[1][j0:]]))
        wide *= 2
    return None


def joined(bpe: ByteBpe, pieces: list[Piece]) -> np.ndarray:
    """Ids of the pieces' whole text. Pieces without agreement are encoded again as one."""
    done: list[Piece] = []
    for right in pieces:
        while done:
            left = done.pop()
            got = repaired(bpe, left, right)
            if got:
                done.append(got[0])
                right = got[1]
                break
            text = left[0] + right[0]
            right = (text, bpe.encode([text])[0])
        done.append(right)
    return np.concatenate([ids for _, ids in done]) if done else np.empty(0, np.uint32)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").to_pylist()


def chunk_counts(texts: DataFrame) -> DataFrame:
    """(h, n): 64-bit digests of chunks and how often each occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.fromiter(seen, np.uint64, len(seen)).view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["h", "n"])
            seen.clear()
            return out

        for batch in batches:
            for raw in _texts(batch):
                seen.update(map(xxhash.xxh3_64_intdigest, chunks(raw)))
                if len(seen) > _FLUSH:
                    yield rows()
        yield rows()

    return texts.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


DONE, STORE, SHARED, OWN = 0, 1, 2, 3


def _pieces(texts: DataFrame, path: str, second: bool, bloom: SegmentedBloom, id_type: str) -> DataFrame:
    """Finished documents (DONE), repeated chunks (STORE, once a task) and the pieces of unfinished documents."""
    shared = texts.sparkSession.sparkContext.broadcast(bloom)
    names = ["kind", "row", "doc_id", "seq", "digest", "payload", "n_tokens", "ids_sha256", "decoded_sha256"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bloom, pack = ByteBpe(path, second), shared.value, zstandard.ZstdCompressor(level=3)
        row, stored = TaskContext.get().partitionId() << 33, set()
        for batch in batches:
            out: list[tuple] = []
            ready: list[tuple[int, object, bytes]] = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                row += 1
                parts = chunks(raw)
                again = bloom.contains(np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)))
                if not again.any():
                    ready.append((row, doc_id, raw))
                    continue
                own = b""
                for seq, (part, repeated) in enumerate(zip(parts, again.tolist(), strict=True)):
                    if repeated and own:
                        out.append((OWN, row, doc_id, seq - 1, None, pack.compress(own), None, None, None))
                        own = b""
                    if not repeated:
                        own += part
                        continue
                    digest = hashlib.blake2b(part, digest_size=16).digest()
                    if digest not in stored:
                        out.append((STORE, None, None, None, digest, pack.compress(part), None, None, None))
                        stored.add(digest)
                        if len(stored) > _FLUSH:
                            stored.clear()
                    out.append((SHARED, row, doc_id, seq, digest, None, None, None, None))
                if own:
                    out.append((OWN, row, doc_id, len(parts), None, pack.compress(own), None, None, None))
            for start in range(0, len(ready), 256):
                some = ready[start : start + 256]
                for (r, doc_id, _), ids in zip(some, bpe.encode([x[2] for x in some]), strict=True):
                    out.append((DONE, r, doc_id, None, None, None, *bpe.digests(ids)))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            kinds = [pa.int32(), pa.int64(), batch.schema.field("doc_id").type, pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = f"kind int, row long, doc_id {id_type}, seq int, digest binary, payload binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts.mapInArrow(cut, schema)


def _encode_store(store: DataFrame, path: str, second: bool) -> DataFrame:
    """(digest, payload) to (digest, ids): each repeated chunk is encoded here, once."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pack, unpack = ByteBpe(path, second), zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            payloads, out = batch.column("payload").to_pylist(), []
            for start in range(0, len(payloads), 256):
                found = bpe.encode([unpack.decompress(x) for x in payloads[start : start + 256]])
                out += [pack.compress(ids.astype(bpe.kind).tobytes()) for ids in found]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.binary())], ["digest", "ids"])

    return store.mapInArrow(encoded, "digest binary, ids binary")


def _assemble(pieces: DataFrame, path: str, second: bool, id_type: str) -> DataFrame:
    """(row, doc_id, seq, payload, ids), sorted by row and seq, to one row for each document."""

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, unpack = ByteBpe(path, second), zstandard.ZstdDecompressor()
        row, doc_id, parts = None, None, []

        def finish(kind: pa.DataType) -> pa.RecordBatch:
            n, ids_hash, text_hash = bpe.digests(joined(bpe, parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([doc_id], kind), pa.array([n], pa.int64()), pa.array([ids_hash]), pa.array([text_hash])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for r, d, payload, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "payload", "ids")), strict=True):
                if r != row and parts:
                    yield finish(kind)
                    parts = []
                row, doc_id = r, d
                if ids is None:
                    text = unpack.decompress(payload)
                    parts.append((text, bpe.encode([text])[0]))
                else:
                    got = np.frombuffer(unpack.decompress(ids), bpe.kind).astype(np.uint32)
                    parts.append((bpe.decode(got), got))
        if parts:
            yield finish(kind)

    return pieces.mapInArrow(assembled, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", bloom_bytes: int = BLOOM_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of `docs`.

    The digests of repeated chunks are broadcast as a Bloom filter of `bloom_bytes`, whatever the
    corpus: a false hit only sends a chunk through the shared store although it occurs once.
    """
    id_type = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    again = chunk_counts(texts.select("text")).where("n > 1").select("h")
    second = ByteBpe(path).ranks_suffice()
    pieces = written(_pieces(texts, path, second, build_bloom(again, bloom_bytes), id_type), "bpe-pieces")
    store = pieces.where(F.col("kind") == STORE).groupBy("digest").agg(F.min("payload").alias("payload"))
    ids = _encode_store(store, path, second)
    shared = pieces.where(F.col("kind") == SHARED).join(ids, "digest").select("row", "doc_id", "seq", "payload", "ids")
    own = pieces.where(F.col("kind") == OWN).select("row", "doc_id", "seq", "payload", F.lit(None).cast("binary").alias("ids"))
    placed = shared.unionByName(own).repartition("row").sortWithinPartitions("row", "seq")
    done = pieces.where(F.col("kind") == DONE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return done.unionByName(_assemble(placed, path, second, id_type))

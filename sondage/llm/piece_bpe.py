"""Operator 11, SentencePiece BPE by vectorised merge rounds, and its decoding.

The distinct words of some texts lie one behind another in flat numpy arrays of symbols. A round takes
the least pair rank of every word at once (a segmented minimum), merges the leftmost pairs of that rank in all words, closes
the gaps and looks up only the pairs that changed; words without a pair are done and leave the arrays.
Rounds go on until no word is left. Texts are joined from their words' ids.

Why words can be taken by themselves: a piece never reaches over a pair of characters that no piece of the vocabulary
contains, so texts are cut there. Why pairs of equal rank in a word can merge in one round: if no piece that
extends a merged piece ranks as high as it does, no merge makes a pair that should have gone first;
words where that does not hold merge their leftmost pair only, or in long words go through one sweep
from the left. Every document is encoded where it is read: nothing is shuffled.

Defined results: a null text counts as the empty text, which has no ids; repeated rows get equal results, each its own row;
texts are never cut short, whatever their length; equal ranks go to the leftmost pair; an empty table gives an
empty result; only `id_col` and `text_col` are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import values

SPACE = "▁"
NONE = np.iinfo(np.int32).max  # the rank of no pair
_GROUP_CHARS = 1 << 22
_KEPT_WORDS = 150_000
_KEPT_LENGTH = 64
_LONG = 256  # symbols of a word from which a sweep is cheaper than single merges


class PieceBpe:
    """Encoder and decoder of a SentencePiece BPE model with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        trainer, rules, kind = model.trainer_spec, model.normalizer_spec, proto.ModelProto.SentencePiece
        kinds = {p.type for p in model.pieces}
        if (
            trainer.model_type != proto.TrainerSpec.BPE
            or not trainer.byte_fallback
            or trainer.treat_whitespace_as_suffix
            or rules.precompiled_charsmap
            or not rules.add_dummy_prefix
            or rules.remove_extra_whitespaces
            or not rules.escape_whitespaces
            or kinds & {kind.USER_DEFINED, kind.UNUSED}
        ):
            raise ValueError("a BPE model with byte fallback, a dummy prefix, identity normalisation and no user-defined pieces is needed")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.n_pieces = len(model.pieces)
        self.byte_ids = [0] * 256
        self.surface, self.is_byte = [], np.zeros(self.n_pieces, bool)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                b = int(p.piece[3:-1], 16)
                self.byte_ids[b], self.is_byte[i] = i, True
                self.surface.append(bytes([b]))
            elif p.type == kind.NORMAL:
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.surface.append(trainer.unk_surface.encode() if p.type == kind.UNKNOWN else b"")
        self.decimal = [str(i) for i in range(self.n_pieces)]
        self.starts_with_space = {i for p, i in normal.items() if p.startswith(SPACE)}

        # symbols are pieces, or characters of pieces that are none themselves
        symbols = dict(normal)
        for piece in normal:
            for c in piece:
                symbols.setdefault(c, self.n_pieces + len(symbols))
        self.n_symbols = max(symbols.values()) + 1
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i

        scores = np.array([p.score for p in model.pieces])
        _, ranks = np.unique(-scores, return_inverse=True)
        pairs, bigrams = {}, set()
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                bigrams.add(ord(piece[k - 1]) << 21 | ord(piece[k]))
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * self.n_symbols + right] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.pair_rank = ranks[self.pair_piece].astype(np.int32)
        self.bigrams = np.array(sorted(bigrams), np.int64)
        # a piece is safe if all that extend it rank behind it
        self.safe = np.ones(self.n_symbols, bool)
        rank_of = np.full(self.n_symbols, -1, np.int64)
        rank_of[: self.n_pieces] = ranks
        for side in (self.pair_keys // self.n_symbols, self.pair_keys % self.n_symbols):
            self.safe[side[self.pair_rank <= rank_of[side]]] = False

        whole = {c for piece in normal for c in piece}
        spaced = any(SPACE in piece.lstrip(SPACE) for piece in normal)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in whole)
        word = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")
        #: Cuts a text into words over whose ends no piece reaches.
        self.word = re.compile("(?s).+" if spaced else word)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols, and the pieces that they make."""
        keys = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0) if len(keys) else np.zeros(0, bool)
        return np.where(found, self.pair_rank[at], NONE).astype(np.int32), np.where(found, self.pair_piece[at], -1).astype(np.int32)

    def _sweep(self, symbols: list[int], rank: int) -> list[int]:
        """Merges of pairs of one rank, the least there is, from the left; it ends before a pair of a lesser rank."""
        out: list[int] = []

        def joint(a: int, b: int) -> tuple[int, int]:
            key = a * self.n_symbols + b
            at = int(np.searchsorted(self.pair_keys, key))
            if a < 0 or b < 0 or at == len(self.pair_keys) or self.pair_keys[at] != key:
                return NONE, -1
            return int(self.pair_rank[at]), int(self.pair_piece[at])

        for k, symbol in enumerate(symbols):
            out.append(symbol)
            while len(out) > 1:
                r, piece = joint(out[-2], out[-1])
                if r < rank:
                    return out + symbols[k + 1 :]
                if r > rank:
                    break
                out[-2:] = [piece]
                if k + 1 < len(symbols) and joint(piece, symbols[k + 1])[0] < rank:
                    # a pair on the left that ranks as high or higher would go first; the next round sees all
                    return out + symbols[k + 1 :]
        return out

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in order, and where each word's begin. Symbols that are no pieces are left as ~character."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        sym = self.char_symbol[points]
        n = len(sym)
        last = np.zeros(n, bool)
        last[starts[1:] - 1] = True
        if n > 1 and len(self.bigrams):
            keys = points[:-1] << 21 | points[1:]
            at = np.minimum(np.searchsorted(self.bigrams, keys), len(self.bigrams) - 1)
            last[:-1] |= self.bigrams[at] != keys
        place = np.arange(n)
        rank, piece = np.full(n, NONE, np.int32), np.full(n, -1, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner], piece[inner] = self._pair(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
            lengths = np.diff(np.concatenate([first, [len(sym)]]))
            least = np.minimum.reduceat(rank, first)
            if (ended := least == NONE).any():
                out = np.repeat(ended, lengths)
                done.append((place[out], sym[out]))
                sym, last, place, rank, piece = (x[~out] for x in (sym, last, place, rank, piece))
                first, lengths, least = None, lengths[~ended], least[~ended]
                if not len(sym):
                    break
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            # of overlapping pairs the leftmost merges, then the next that is left
            run = np.concatenate([[True], np.diff(hit) != 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            segment = np.searchsorted(first, hit, "right") - 1
            unsafe = np.zeros(len(first), bool)
            unsafe[segment[~self.safe[piece[hit]]]] = True
            keep, changed = np.ones(len(sym), bool), np.zeros(len(sym), bool)
            if unsafe.any():
                head = np.concatenate([[True], np.diff(segment) != 0])
                several = np.bincount(segment, minlength=len(first)) > 1
                long = unsafe & several & (lengths > _LONG)
                for s in np.flatnonzero(long).tolist():
                    a, b = int(first[s]), int(first[s] + lengths[s])
                    new = self._sweep(sym[a:b].tolist(), int(least[s]))
                    # places only order the symbols of a word, so the first ones serve
                    sym[a : a + len(new)], keep[a + len(new) : b], changed[a : a + len(new)] = new, False, True
                    last[a:b] = False
                    last[a + len(new) - 1] = True
                hit = hit[~long[segment] & (head | ~unsafe[segment])]
            sym[hit], last[hit], keep[hit + 1] = piece[hit], last[hit + 1], False
            changed[hit] = True
            before = hit[hit > 0] - 1
            changed[before[~last[before]]] = True
            sym, last, place, rank, piece, changed = (x[keep] for x in (sym, last, place, rank, piece, changed))
            again = np.flatnonzero(changed)
            rank[again], piece[again] = NONE, -1
            again = again[~last[again]]
            rank[again], piece[again] = self._pair(sym[again], sym[again + 1])
        if not done:
            return np.empty(0, np.int64), starts
        place, sym = np.concatenate([p for p, _ in done]), np.concatenate([s for _, s in done]).astype(np.int64)
        order = np.argsort(place)
        place, sym = place[order], sym[order]
        odd = (sym < 0) | (sym >= self.n_pieces)
        sym[odd] = ~points[place[odd]]
        return sym, np.searchsorted(place, starts)

    def word_ids(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of words, each taken by itself, one behind another, and where each word's begin."""
        sym, starts = self.merged(words)
        odd = sym < 0
        if odd.any():
            in_bytes = [chr(~x).encode() for x in sym[odd].tolist()]
            counts = np.ones(len(sym), np.int64)
            counts[odd] = [len(x) for x in in_bytes]
            starts = np.concatenate([[0], np.cumsum(counts)])[starts]
            sym, odd = np.repeat(sym, counts), np.repeat(odd, counts)
            sym[odd] = np.array(self.byte_ids)[np.frombuffer(b"".join(in_bytes), np.uint8)]
        return sym.tolist(), starts.tolist()

    def words(self, text: str) -> list[str]:
        return self.word.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cut = [self.words(t) for t in texts]
        distinct = list(dict.fromkeys(w for words in cut for w in words))
        flat, at = self.word_ids(distinct)
        of = {w: flat[a:b] for w, a, b in zip(distinct, at, at[1:])}
        return [np.array([i for w in words for i in of[w]], np.uint32) for words in cut]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of any ids: one leading space goes, bytes that are no UTF-8 become U+FFFD each."""
        ids = list(map(int, ids))
        out, run, begun = [], b"", False
        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
                begun = True
                continue
            if run:
                out.append(_utf8(run))
                run = b""
            text = self.surface[i].decode()
            out.append(text[1:] if not begun and i in self.starts_with_space else text)
            begun |= bool(text)  # control pieces have none
        return "".join(out) + _utf8(run)


def _utf8(run: bytes) -> str:
    """`run` as UTF-8; each byte that belongs to no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[i : i + size].decode())
            except UnicodeDecodeError:
                continue
            i += size
            break
        else:
            out.append("�")
            i += 1
    return "".join(out)


@functools.cache
def loaded(path: str) -> PieceBpe:
    """The model of a file, once for each process."""
    return PieceBpe(path)


class _Words:
    """Words that were needed lately, each encoded once: their ids in decimal, joined by commas."""

    def __init__(self, bpe: PieceBpe, kept: int = _KEPT_WORDS):
        self.bpe, self.kept = bpe, kept
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def of(self, words: set[str]) -> dict[str, str]:
        """A map that holds all `words` until the next call."""
        if len(self.new) > self.kept:
            self.old, self.new = {w: ids for w, ids in self.new.items() if len(w) <= _KEPT_LENGTH}, {}
        missing = words - self.new.keys()
        again = missing & self.old.keys()
        for w in again:
            self.new[w] = self.old[w]
        missing = list(missing - again)
        flat, at = self.bpe.word_ids(missing)
        if b"".join(map(self.bpe.surface.__getitem__, flat)) != "".join(missing).replace(SPACE, " ").encode():
            raise AssertionError("the ids of some words do not decode to them")
        flat = list(map(self.bpe.decimal.__getitem__, flat))
        self.new.update(zip(missing, [",".join(flat[a:b]) for a, b in zip(at, at[1:])]))
        return self.new


def _groups(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts a few at a time, by their characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > _GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of `docs`; `with_ids` adds ids (array of int) and decoded (string)."""
    id_type = dict(docs.dtypes)[id_col]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.string()] if with_ids else [])]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        kept = _Words(bpe)
        for batch in batches:
            at = 0
            for group in _groups(values(batch.column("text"))):
                cut = [bpe.words(t) for t in group]
                of, rows = kept.of(set().union(*cut)), []
                for words in cut:
                    line = ",".join([of[w] for w in words])
                    # the ids of each word were decoded when it was encoded, and gave it back
                    plain = "".join(words)[1:].replace(SPACE, " ")
                    row = (line.count(",") + 1 if line else 0, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())
                    rows.append((*row, [int(i) for i in line.split(",")] if line else [], plain) if with_ids else row)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(group)), *columns], names)
                at += len(group)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    more = ", ids array<int>, decoded string" if with_ids else ""
    return texts.mapInArrow(encoded, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")

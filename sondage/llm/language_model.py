"""Operator 3, language-model scoring with a log-frequency Bloom filter.

Counts of n-grams are quantised to powers of two; a Bloom filter holds each n-gram once for every
level up to its own, so that membership probes at rising levels, until the first miss, give its
level back. Probabilities are smoothed from order to order: p(w | h) = (g c(h w) + mu * p(w | shorter h)) / (c(h) + mu), down to an
add-one estimate of single tokens. There c(h w) is the least count of its level and c(h) the exact count of the
context, or the greatest of its level where the context is not among the broadcast words. The counts of a context's continuations add up
to that of the context at most; but each of the V words that never followed it is taken for seen with the chance f of a false hit, which
would add F = V (f + f^2 + 2 f^3 + ...) more. So g = c(h) / (c(h) (1 + f + ...) + F): what a hit is worth, given how many hits
are to be expected. With it the probabilities of all tokens after a context are expected to add up to 1 at most, at any size of the vocabulary
(single draws of the filter spread around that by the root of F); what is missing to 1 is what the levels round off. f is the filter's own, `LanguageModel.false_hits`.

mu follows from all training rows: it is the number of MU_GRID nearest to the mu that gives continuations unseen
so far, over all contexts, the share of mass which n-grams seen once have in the training tokens.

Counts are of all training rows. They leave the map side as one packed block for each segment of the
hash space, so no key is hot and each segment is counted, quantised and turned to bits by one group.
The number of segments follows the input, as does the number of bits by which hashes are told apart (two different n-grams are
taken for one with a chance of about 1 in 4,000), and each segment has BITS_AN_ENTRY for each n-gram and level that was
counted in it, so the share of false hits is the same at any size. A filter of
`filter_bytes` or less is broadcast. A larger one stays in the shared folder: texts are cut into blocks, the distinct
n-grams of a block are probed where their segments are, and the levels return to the block. Both ways
probe the same bits and give the same scores.

The base score is exact. Words that are frequent enough to be among `HEAD_WORDS` are broadcast;
the others, each rare, are joined.

Defined results: null and empty texts have one token, their end; a null id is learned from; an empty
training set gives every token the probability 1 / (0 + 1 * (0 + 1)) in the base; an empty scored table gives an empty result; very long texts are
scored whole, one such text being a block of its own; texts that are equal have equal scores; repeated rows
count as often as they stand there and each get their score; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, mixed, values, written
from .bloom import SizedBloom

BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
#: A filter of up to this size is broadcast: each Python worker holds it once.
FILTER_BYTES = 1 << 28
BITS_AN_ENTRY = 13
HEAD_WORDS = 400_000
MU_GRID = (3.0, 30.0, 300.0, 3_000.0, 30_000.0, 300_000.0)
ORDER = 2
_TOKENS_A_BLOCK = 1_000_000
_TOKENS_A_GROUP = 300_000
_TOKENS_A_PROBE_BLOCK = 1_000_000
_TOKENS_A_SEGMENT = 2_000_000
_LEAST_BITS, _BITS_OVER_INPUT = 40, 12


def kept_bits(n_grams: int) -> int:
    """By how many bits of their hashes so many n-grams are told apart."""
    return min(64, max(_LEAST_BITS, n_grams.bit_length() + _BITS_OVER_INPUT))


def flat_tokens(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Begin, words and end of all texts in one array, and each token's place in its text."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    tokens = np.concatenate([x for w in words for x in ([BEGIN], w, [END])]) if words else np.empty(0, np.uint64)
    return tokens, np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)


def gram_hashes(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1-grams, 2-grams, ... that end at each token; the first order - 1 wrap round."""
    out = [tokens]
    for _ in range(order - 1):
        out.append(mixed(np.roll(out[-1], 1), tokens))
    return out


def _pack(h: np.ndarray, n: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Sorted hashes as differences, by byte planes, and counts."""
    steps = np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return len(h).to_bytes(8, "little") + pack.compress(steps.tobytes() + n.astype("<u4").tobytes())


def _unpack(data: bytes, unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    size, raw = int.from_bytes(data[:8], "little"), unpack.decompress(data[8:])
    planes = np.frombuffer(raw, np.uint8, 8 * size).reshape(8, size).T
    steps = np.ascontiguousarray(planes).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, "<u4", size, 8 * size)


def _counted(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes and their summed counts."""
    if not len(h):
        return h, np.empty(0, np.int64)
    if n is None:
        h = np.sort(h)
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[starts], np.diff(np.append(starts, len(h)))
    order = np.argsort(h)
    h = h[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[starts], np.add.reduceat(n[order].astype(np.int64), starts)


WORDS, GRAMS = 0, 1


def count_blocks(texts: DataFrame, order: int, shape: SizedBloom) -> DataFrame:
    """(segment, kind, block): counts of words and ends, and of longer n-grams, from each task."""
    n_segments, shift, dropped = shape.n_segments, np.uint64(shape.shift), shape.dropped

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack = WordHashes(), zstandard.ZstdCompressor(level=1)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens, place = flat_tokens(held)
            held.clear()
            rows = []
            for kind in (WORDS, GRAMS):
                if kind == WORDS:
                    h, n = _counted(tokens[place > 0])
                else:
                    longer = [g[place >= m + 1] for m, g in enumerate(gram_hashes(tokens, order)[1:])]
                    h, n = _counted(np.concatenate([shape.key(x) for x in [tokens[place == 0], *longer]]))
                edges = np.searchsorted(h >> shift, np.arange(n_segments + 1, dtype=np.uint64))
                pairs = enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                rows += [(s, kind, _pack(h[a:b] if kind == WORDS else h[a:b] >> dropped, n[a:b], pack)) for s, (a, b) in pairs if b > a]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["segment", "kind", "block"])

        size = 0
        for batch in batches:
            for text in values(batch.column("text")):
                held.append(hashes.of(text))
                size += len(held[-1]) + 2
                if size > _TOKENS_A_BLOCK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return texts.mapInArrow(blocks, "segment int, kind int, block binary")


def quantised(n: np.ndarray) -> np.ndarray:
    """Level of a count: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.frexp(n.astype(np.float64))[1]


def level_counts(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for level 0."""
    low = np.exp2(np.maximum(levels, 1) - 1.0)
    return np.where(levels > 0, 1.5 * low - 0.5, 0.0)


def merged_counts(blocks: DataFrame, shape: SizedBloom) -> DataFrame:
    """One group a segment merges its blocks: exact counts as (word, n) rows, and the segment's bits as a row, n being those set and `once` the longer n-grams seen once.

    Each n-gram is held at the levels 1 to its own.
    """
    dropped = shape.dropped

    def build(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, parts = zstandard.ZstdDecompressor(), {WORDS: [], GRAMS: []}
        for g in groups:
            for kind, block in zip(g.column("kind").to_pylist(), g.column("block").to_pylist(), strict=True):
                parts[kind].append(_unpack(block, unpack))
        words, grams = (_counted(*(np.concatenate(x) for x in zip(*parts[k], strict=True))) if parts[k] else _counted(np.empty(0, np.uint64)) for k in (WORDS, GRAMS))
        parts.clear()
        kept = [(shape.key(words[0]), quantised(words[1])), (grams[0] << dropped, quantised(grams[1]))]
        most = max(int(level.max(initial=0)) for _, level in kept)
        n_bits = BITS_AN_ENTRY * sum(int(level.sum()) for _, level in kept)
        data = shape.segment_bytes(n_bits, ((h[level >= i], i) for h, level in kept for i in range(1, most + 1)))
        names, segment = ["segment", "bits", "word", "n", "once"], [key[0].as_py()]
        filled = int(np.bitwise_count(np.frombuffer(data, np.uint8)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array([data], pa.binary()), pa.nulls(1, pa.int64()), pa.array([filled], pa.int64()), pa.array([int((grams[1] == 1).sum())], pa.int64())], names)
        for i in range(0, len(words[0]), 100_000):
            h, n = words[0][i : i + 100_000], words[1][i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary()), pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.nulls(len(h), pa.int64())], names)

    return blocks.groupBy("segment").applyInArrow(build, "segment int, bits binary, word long, n long, once long")


def probe_levels(bloom: SizedBloom, h: np.ndarray) -> np.ndarray:
    """Levels as the filter has them: probes at rising levels until the first miss."""
    levels, left, level = np.zeros(len(h), np.int64), np.arange(len(h)), 1
    while len(left) and level < 64:
        left = left[bloom.contains(h[left], level)]
        levels[left] = level
        level += 1
    return levels


def distinct_grams(tokens: np.ndarray, place: np.ndarray, order: int, shape: SizedBloom) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct n-grams of some texts, sorted, and for each order which of them end at the tokens that have one."""
    inside = [shape.key(g[place >= m]) for m, g in enumerate(gram_hashes(tokens, order))]
    distinct, which = np.unique(np.concatenate(inside), return_inverse=True)
    return distinct, np.split(which, np.cumsum([len(x) for x in inside])[:-1])


def spread_counts(levels: np.ndarray, which: list[np.ndarray], place: np.ndarray) -> list[np.ndarray]:
    """Quantised counts of the 1-grams, 2-grams, ... that end at each token, from the levels of the distinct ones."""
    counts, out = level_counts(levels), []
    for m, w in enumerate(which):
        out.append(np.zeros(len(place)))
        out[m][place >= m] = counts[w]
    return out


def least_counts(middles: np.ndarray) -> np.ndarray:
    """The least count of the level whose middle is given."""
    return np.where(middles > 0, (middles + 0.5) / 1.5, 0.0)


@dataclass
class Scorer:
    """What a worker needs: the totals, and the filter if it is small enough to be broadcast."""

    bloom: SizedBloom | None
    order: int
    tokens: int
    vocabulary: int
    level_tokens: float  # the middles of the levels of all words, summed up
    false_hits: float = 0.0  # the chance that a probe of one level hits without cause

    @property
    def _raised(self) -> float:
        """The expected growth of a count by false hits at the levels above its own: f + 2 f^2 + 4 f^3 + ..."""
        return self.false_hits / max(1 - 2 * self.false_hits, 1e-9)

    @property
    def false_mass(self) -> float:
        """The expected sum of the least counts of all words that never followed a context."""
        return self.vocabulary * self.false_hits * (1 + self._raised)

    def counts(self, tokens: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """Quantised counts of the 1-grams, 2-grams, ... that end at each token; each distinct one is probed once."""
        distinct, which = distinct_grams(tokens, place, self.order, self.bloom)
        return spread_counts(probe_levels(self.bloom, distinct), which, place)

    def log10(self, counts: list[np.ndarray], place: np.ndarray, mu: float, exact: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each token, 0 of begins. `exact`: the exact count of each token, 0 where it is not known."""
        p = (counts[0] + 1) / max(self.level_tokens * (1 + self._raised) + self.vocabulary + 1, 1)
        for m in range(1, self.order):
            most = np.maximum(2 * least_counts(counts[m - 1]) - 1, 0)
            if m == 1 and exact is not None:
                most = np.where(exact > 0, exact, most)
            c, h = least_counts(counts[m]), np.roll(most, 1)
            worth = h / np.maximum(h * (1 + self._raised) + self.false_mass, 1e-9)
            p = np.where(place >= m, (worth * np.minimum(c, h) + mu * p) / (h + mu), p)
        out = np.log10(p)
        out[place == 0] = 0.0
        return out


def probe_rows(block: int, tokens: np.ndarray, place: np.ndarray, shape: SizedBloom, order: int, pack: zstandard.ZstdCompressor) -> list[tuple[int, int, bytes]]:
    """(block, segment, data): the distinct n-grams by segment; under the segment -1 the tokens, as places in a list by frequency."""
    words, which, n = np.unique(tokens, return_inverse=True, return_counts=True)
    order_of_words = np.argsort(-n, kind="stable")
    ranks = np.empty(len(words), "<u4")
    ranks[order_of_words] = np.arange(len(words))
    sizes = np.diff(np.append(np.flatnonzero(place == 0), len(tokens)))
    raw = sizes.astype("<u4").tobytes() + words[order_of_words].tobytes() + ranks[which].view(np.uint8).reshape(-1, 4).T.tobytes()
    rows = [(block, -1, len(sizes).to_bytes(8, "little") + len(words).to_bytes(8, "little") + pack.compress(raw))]
    distinct, _ = distinct_grams(tokens, place, order, shape)
    segments = shape.segment(distinct)
    starts = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(distinct)], strict=True):
        rows.append((block, int(segments[a]), _pack(distinct[a:b] >> shape.dropped, np.zeros(b - a, np.int64), pack)))
    return rows


def probed_levels(rows: DataFrame, bits: DataFrame, shape: SizedBloom) -> DataFrame:
    """`rows` with the level of each n-gram, one byte each, in place of the n-grams; rows of segments below 0 as they are.

    A group holds a segment and its probes; there are as many segments as the input asks for, so both stay small.
    """
    docs_type = rows.schema["docs"].dataType.simpleString()
    dropped = shape.dropped

    def run(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack, asked, segment = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), [], key[0].as_py()
        if segment < 0:
            yield from groups
            return
        own = shape.empty()
        for g in groups:
            kind = g.schema.field("docs").type
            for block, data in zip(g.column("block").to_pylist(), g.column("data").to_pylist(), strict=True):
                if block is None:
                    own.load({segment: data})
                else:
                    asked.append((block, data))
        for block, data in asked:
            levels = probe_levels(own, _unpack(data, unpack)[0] << dropped)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([segment], pa.int32()), pa.array([pack.compress(levels.astype(np.uint8).tobytes())], pa.binary()), pa.nulls(1, kind)], ["block", "segment", "data", "docs"])

    held = bits.select(F.lit(None).cast("long").alias("block"), "segment", F.col("bits").alias("data"), F.lit(None).cast(docs_type).alias("docs"))
    return rows.unionByName(held).groupBy("segment").applyInArrow(run, f"block long, segment int, data binary, docs {docs_type}")


def block_counts(rows: list[tuple[int, bytes]], order: int, shape: SizedBloom) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Counts of a block's tokens, the tokens and their places, from its row below 0 and the levels of all its segments."""
    unpack = zstandard.ZstdDecompressor()
    rows = sorted(rows)
    first = rows[0][1]
    n_texts, n_words, raw = int.from_bytes(first[:8], "little"), int.from_bytes(first[8:16], "little"), unpack.decompress(first[16:])
    sizes = np.frombuffer(raw, "<u4", n_texts).astype(np.int64)
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    ranks = np.ascontiguousarray(np.frombuffer(raw, np.uint8, -1, 4 * n_texts + 8 * n_words).reshape(4, -1).T).view("<u4").ravel()
    tokens = np.frombuffer(raw, np.uint64, n_words, 4 * n_texts)[ranks]
    _, which = distinct_grams(tokens, place, order, shape)
    levels = np.concatenate([np.frombuffer(unpack.decompress(x), np.uint8) for _, x in rows[1:]])
    return spread_counts(levels.astype(np.int64), which, place), tokens, place


@dataclass
class LanguageModel:
    scorer: Scorer
    shared: Broadcast  # of the scorer
    mu: float
    words: DataFrame  # (word, n): exact counts
    head: tuple[np.ndarray, np.ndarray]  # sorted hashes and counts of the frequent words

    shape: SizedBloom  # without bits
    bits: DataFrame  # (segment, bits, n): the filter, n being the bits set

    @property
    def false_hits(self) -> float:
        """Share of absent n-grams that the filter takes for seen ones."""
        return self.scorer.false_hits


def _head(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words at least as frequent as the lowest count that fewer than `most` words reach."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = sorted(((r["step"], r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for at, count in sizes:
        if total + count > most:
            break
        total, least = total + count, at
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    table = words.where(step >= least).toArrow()  # `most` rows at most
    h, n = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _groups(texts: Iterable[str | None], hashes: WordHashes, most: int = _TOKENS_A_GROUP) -> Iterator[list[np.ndarray]]:
    """Word hashes of whole texts, in groups of about `most` tokens."""
    held, size = [], 0
    for text in texts:
        held.append(hashes.of(text))
        size += len(held[-1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _mu(words: DataFrame, once: int, tokens: int) -> float:
    """The mu of the grid for which contexts, weighed by their counts, leave to shorter ones the share of n-grams seen once."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 4)
    found = [(r["mean"], r["n"]) for r in words.groupBy(step.alias("step")).agg(F.avg("n").alias("mean"), F.sum("n").alias("n")).collect()]  # one row for each quarter of a power of two
    if not found:
        return MU_GRID[-1]
    share = min(once / tokens, 1.0)
    left = lambda mu: sum(n * mu / (mean + mu) for mean, n in found) / sum(n for _, n in found)
    low, high = math.log(1e-3), math.log(1e9)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if left(math.exp(middle)) < share else (low, middle)
    return min(MU_GRID, key=lambda mu: abs(math.log(mu) - low))


def exact_counts(tokens: np.ndarray, head: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens' counts as the broadcast words have them, else 0, and which of them each token is."""
    distinct, which = np.unique(tokens, return_inverse=True)
    if not len(head[0]):
        return np.zeros(len(distinct), np.int64), which
    at = np.minimum(np.searchsorted(head[0], distinct), len(head[0]) - 1)
    return np.where(head[0][at] == distinct, head[1][at], 0), which


def train(docs: DataFrame, *, text_col: str = "text", order: int = ORDER, filter_bytes: int = FILTER_BYTES, n_probes: int = 3, head_words: int = HEAD_WORDS) -> LanguageModel:
    """Count all rows of `docs` and build the model. A filter of more than `filter_bytes` is not broadcast but joined."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_segments = 64
    while n_segments * _TOKENS_A_SEGMENT < n_bytes * order // 5:
        n_segments *= 2
    shape = SizedBloom(n_segments, n_probes, 64 - kept_bits(n_bytes * order // 4))
    merged = written(merged_counts(count_blocks(texts, order, shape), shape), "lm-counts")
    words, bits = merged.where("word IS NOT NULL").select("word", "n"), merged.where("word IS NULL").select("segment", "bits", "n", "once")
    middle = 1.5 * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double")))) - 0.5
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("vocabulary"), F.coalesce(F.sum(middle), F.lit(0.0)).alias("level_tokens")).first()
    hit = F.pow(F.col("n") / (8.0 * F.octet_length("bits")), float(n_probes))
    filled = bits.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("once"), F.lit(0)).alias("once"), F.coalesce(F.sum(hit), F.lit(0.0)).alias("hit")).first()
    bloom = None
    if filled["bytes"] <= filter_bytes:
        bloom = shape.empty()
        bloom.load({row["segment"]: row["bits"] for row in bits.select("segment", "bits").toLocalIterator()})  # filter_bytes at most
    scorer = Scorer(bloom, order, totals["tokens"], totals["vocabulary"], totals["level_tokens"], filled["hit"] / n_segments)
    shared = spark.sparkContext.broadcast(scorer)
    return LanguageModel(scorer, shared, _mu(words, filled["once"], max(totals["tokens"], 1)), words, _head(words, head_words), shape, bits.drop("once"))


def score(docs: DataFrame, model: LanguageModel, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark, id_type = docs.sparkSession, dict(docs.dtypes)[id_col]
    shared, frequent, mu = model.shared, spark.sparkContext.broadcast(model.head), model.mu
    train_tokens, vocabulary = model.scorer.tokens, model.scorer.vocabulary
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    shape, joined, order = model.shape, model.scorer.bloom is None, model.scorer.order
    fields = ["doc_id", "held_out", "n_tokens", "head_log", "head_known", "tail"]
    types = f"doc_id {id_type}, held_out boolean, n_tokens long, head_log double, head_known long, tail array<long>"

    def looked_up(part: pa.RecordBatch, words: list[np.ndarray], tokens: np.ndarray, place: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
        """The columns of `types` for some texts, and the exact counts of their tokens."""
        first, real = np.flatnonzero(place == 0), place > 0
        counts, which = exact_counts(tokens, frequent.value)
        exact = counts[which]
        seen, rare = (exact > 0) & real, (exact == 0) & real
        logs = np.log10(counts + 1.0)[which]
        tail = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.add.reduceat(rare, first, dtype=np.int64))), pa.int32()), pa.array(tokens[rare].view(np.int64)))
        columns = [part["doc_id"], part["held_out"], pa.array([len(w) + 1 for w in words], pa.int64()), pa.array(np.add.reduceat(np.where(seen, logs, 0.0), first)), pa.array(np.add.reduceat(seen, first, dtype=np.int64)), tail]
        return columns, exact

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row = WordHashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            start = 0
            for words in _groups(values(batch.column("text")), hashes):
                tokens, place = flat_tokens(words)
                columns, exact = looked_up(batch.slice(start, len(words)), words, tokens, place)
                logs = shared.value.log10(shared.value.counts(tokens, place), place, mu, exact)
                sums = pa.array(np.add.reduceat(logs, np.flatnonzero(place == 0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words)) + row), *columns, sums], ["row", *fields, "score"])
                start += len(words)
                row += len(words)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row, pack = WordHashes(), TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            start = 0
            for words in _groups(values(batch.column("text")), hashes, _TOKENS_A_PROBE_BLOCK):
                tokens, place = flat_tokens(words)
                columns, _ = looked_up(batch.slice(start, len(words)), words, tokens, place)
                own = pa.StructArray.from_arrays(columns, fields)
                rows = probe_rows(row, tokens, place, shape, order, pack)
                cols = list(zip(*rows, strict=True))
                # the tokens' row comes first, and passes by the segments under a number below 0 that spreads such rows
                segment = pa.array([-1 - (row >> 33) * 31 % 4096 - (row & 0xFFFFFFFF) % 61, *cols[1][1:]], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array([0, *[len(words)] * len(rows)], pa.int32()), own, mask=pa.array([False, *[True] * (len(rows) - 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), segment, pa.array(cols[2], pa.binary()), lists], ["block", "segment", "data", "docs"])
                start += len(words)
                row += len(words)

    def block_scores(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own = [], None
        for g in groups:
            rows += zip(g.column("segment").to_pylist(), g.column("data").to_pylist(), strict=True)
            docs = g.column("docs").drop_null()
            own = docs.flatten() if len(docs) else own
        counts, tokens, place = block_counts(rows, order, shape)
        known, which = exact_counts(tokens, frequent.value)
        sums = np.add.reduceat(shared.value.log10(counts, place, mu, known[which]), np.flatnonzero(place == 0))
        # a block has the number of its first row
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)) + key[0].as_py()), *[own.field(c) for c in fields], pa.array(sums)], ["row", *fields, "score"])

    schema = f"row long, {types}, score double"
    if joined:
        rows = texts.mapInArrow(asked, f"block long, segment int, data binary, docs array<struct<{types.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>")
        table = probed_levels(rows, model.bits, shape).groupBy("block").applyInArrow(block_scores, schema)
    else:
        table = texts.mapInArrow(scored, schema)
    table = written(table, "lm-scored")
    for sent in (shared, frequent):
        sent.unpersist()
    tail = table.select("row", F.explode("tail").alias("word")).join(model.words, "word")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("tail_log"), F.count("*").alias("tail_known"))
    each = math.log10(train_tokens + vocabulary + 1)
    return table.drop("tail").join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        "score",
    )


def is_fold(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo `folds`, is `fold`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))

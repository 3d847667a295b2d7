"""Operator 10, benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased and reduced to words and single blanks. An occurrence of an item
of m characters with at most k = floor(max_edits * m) edits shares at least m + 1 - q - k * q
q-grams with it, all within k + 1 neighbouring diagonals. Shared q-grams are counted in diagonal bands
twice as wide that overlap by half, so one band holds them all; bands that reach the bound are
kept, and a banded alignment decides each. Texts are searched whole, each row where it lies: only the
index of the benchmark moves. It is broadcast in blocks of at most `block_chars` characters, so a
benchmark of any size is searched in as many rounds as it needs.

Defined results: null or empty texts and items match nothing; items too short for the bound (for the
defaults under about 50 characters) match only without edits, as whole words; a text with an item in
several places reports the place with fewest edits, of these the first; repeated rows and items each
report; empty tables give an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 10
MAX_EDITS = 0.08
BLOCK_CHARS = 4_000_000
_BATCH_CHARS = 500_000
_TABLE_BITS = 22
_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normalised(text: str | None) -> str:
    """Lower case; ASCII marks and white space become single blanks."""
    if not text:
        return ""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()).decode("utf-8", "surrogatepass")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    h, size, out, taken = codes.astype(np.uint64), 1, None, 0
    power = 0x9E3779B97F4A7C15
    n = len(codes) - q + 1
    with np.errstate(over="ignore"):
        while taken < q:  # the binary digits of q, from the lowest
            if q & size:
                part = h[taken : taken + n]
                out = part.copy() if out is None else out * np.uint64(pow(power, size, 1 << 64)) + part
                taken += size
            if taken < q:
                h = h[:-size] * np.uint64(pow(power, size, 1 << 64)) + h[size:]
                size *= 2
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


@dataclass
class QGramIndex:
    """Sorted q-grams of a block of items, with the item and place of each."""

    items: list[tuple[object, np.ndarray, int, int]]  # id, code points, edit budget, bound (0: exact only)
    grams: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray
    q: int


def build_index(items: list[tuple[object, str | None]], q: int = Q, max_edits: float = MAX_EDITS) -> QGramIndex:
    kept, grams, owner, place = [], [], [], []
    for item_id, text in items:
        codes = code_points(normalised(text))
        if not len(codes):
            continue
        budget = int(max_edits * len(codes))
        bound = len(codes) + 1 - q - budget * q
        if bound < 1:
            budget, bound = 0, max(len(codes) + 1 - q, 0)  # no q-grams at all: looked up one by one
        h = qgrams(codes, q)
        grams.append(h)
        owner.append(np.full(len(h), len(kept)))
        place.append(np.arange(len(h)))
        kept.append((item_id, codes, budget, bound))
    g = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    order = np.argsort(g, kind="stable")
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    pick = lambda parts: (np.concatenate(parts) if parts else np.empty(0, np.int64))[order].astype(np.int64)
    return QGramIndex(kept, g[order], pick(owner), pick(place), table, q)


def banded_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int] | None:
    """Fewest edits that turn `item` into a stretch of `text`, and the stretch's end; None beyond the budget.

    Only cells on the diagonals low..high (place in text minus place in item) count.
    """
    width = high - low + 1
    far = len(item) + len(text) + 1
    d = np.arange(width)
    cost = np.where((d + low >= 0) & (d + low <= len(text)), 0, far)  # an occurrence may start on any diagonal
    padded = np.concatenate([np.full(max(-low, 0) + 1, 0xFFFFFFFF, np.uint32), text, np.full(width + len(item) + 1, 0xFFFFFFFF, np.uint32)])
    shift = max(-low, 0) + 1
    for i in range(len(item)):
        start = i + low + shift
        if start < 0 or start > len(padded) - width:
            return None
        step = cost + (padded[start : start + width] != item[i])
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(step - d) + d
        ends = d + low + i + 1
        cost[(ends < 0) | (ends > len(text))] = far
        if cost.min() > budget:
            return None
    best = int(cost.argmin())
    return int(cost[best]), best + low + len(item)


def _stands_alone(codes: np.ndarray, start: int, end: int) -> bool:
    """Whether whole words stand there."""
    return (start <= 0 or codes[start - 1] == 32) and (end >= len(codes) or codes[end] == 32)


def find(index: QGramIndex, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of every text and item of the index that match."""
    codes = [code_points(normalised(t)) for t in texts]
    q, gap = index.q, np.zeros(index.q, np.uint32)
    starts = np.cumsum([0, *[len(c) + q for c in codes]])
    whole = np.concatenate([x for c in codes for x in (c, gap)]) if codes else np.empty(0, np.uint32)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def keep(text: int, item: int, edits: int, start: int, end: int) -> None:
        if (text, item) not in best or (edits, start) < best[text, item][:2]:
            best[text, item] = (edits, start, end)

    for item, (_, pattern, _, bound) in enumerate(index.items):
        if not bound:
            needle = f" {''.join(map(chr, pattern.tolist()))} "
            for text, c in enumerate(codes):
                at = f" {''.join(map(chr, c.tolist()))} ".find(needle) if len(c) >= len(pattern) else -1
                if at >= 0:
                    keep(text, item, 0, at, at + len(pattern))

    h = qgrams(whole, q)
    hits = np.flatnonzero(index.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    first, last = np.searchsorted(index.grams, h[hits]), np.searchsorted(index.grams, h[hits], side="right")
    many = last - first
    at = np.repeat(hits, many)
    entry = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    if not len(entry):
        for key in sorted(best):
            yield (*key, *best[key])
        return
    text = np.searchsorted(starts, at, side="right") - 1
    item = index.owner[entry]
    budgets = np.array([x[2] for x in index.items])
    bounds = np.array([x[3] for x in index.items])
    diagonal = at - starts[text] - index.place[entry]
    step = budgets[item] + 1
    band = diagonal // step
    # band b covers the diagonals from b * step to (b + 2) * step - 1: each lies in two bands
    text, item, band = np.concatenate([text, text]), np.concatenate([item, item]), np.concatenate([band, band - 1])
    order = np.lexsort((band, item, text))
    text, item, band = text[order], item[order], band[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)]))
    count = np.diff(np.append(new, len(text)))
    for i in new[count >= np.maximum(bounds[item[new]], 1)].tolist():
        t, j, b = int(text[i]), int(item[i]), int(band[i])
        _, pattern, budget, _ = index.items[j]
        low, high = b * (budget + 1) - budget, (b + 2) * (budget + 1) - 1 + budget
        a = max(low, 0)
        stretch = codes[t][a : max(high + len(pattern), 0)]
        found = banded_alignment(pattern, stretch, low - a, high - a, budget)
        if found and (budget or _stands_alone(codes[t], a + found[1] - len(pattern), a + found[1])):
            edits, end = found
            keep(t, j, edits, a + max(end - len(pattern), 0), a + end)
    for key in sorted(best):
        yield (*key, *best[key])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks that fit a broadcast; only one is held at a time."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-total // block_chars)
    for i in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, max_edits: float = MAX_EDITS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row for each row of `docs` and item that match: doc_id, item_id, edits, and the place in the normalised text."""
    spark, doc_type, item_type = docs.sparkSession, dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {doc_type}, item_id {item_type}, edits int, match_start long, match_end long"
    out = spark.createDataFrame([], schema)
    arrow_item = benchmark.select(F.col(item_col).alias("item_id")).limit(0).toArrow().schema.field("item_id").type
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(build_index(block, q, max_edits))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
                rows, start = [], 0
                while start < len(texts):
                    end, size = start, 0
                    while end < len(texts) and (size < _BATCH_CHARS or end == start):
                        size += len(texts[end] or "")
                        end += 1
                    rows += [(start + t, *rest) for t, *rest in find(index, texts[start:end])]
                    start = end
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())), pa.array([index.items[j][0] for j in cols[1]], arrow_item), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    ["doc_id", "item_id", "edits", "match_start", "match_end"],
                )

        out = out.unionByName(texts.mapInArrow(search, schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_text_col: str = "text", q: int = Q, max_edits: float = MAX_EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, all columns, in which no item occurs. Nothing is shuffled."""
    spark = docs.sparkSession
    for block in _blocks(benchmark, benchmark.columns[0], item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(build_index(block, q, max_edits))

        @F.pandas_udf("boolean")
        def matches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = shared.value
            for texts in parts:
                flags = np.zeros(len(texts), bool)
                for start in range(0, len(texts), 128):
                    for t, *_ in find(index, texts.iloc[start : start + 128].tolist()):
                        flags[start + t] = True
                yield pd.Series(flags)

        docs = docs.where(~matches(F.col(text_col)))
    return docs

"""Operator 9, n-gram Jaccard join by vertical partitioning.

All shingles have one global order, that of their hashes. It is cut into fragments, ranges of the order,
and a document's set falls apart into one segment for each fragment.

Candidates: two sets that link differ in at most H shingles, H following from their sizes. With
more than H fragments, at least one fragment holds the same segment of both. So sets of a size class are cut into
H + 2 and some more fragments, and only sets with an equal segment in a fragment are candidates.
Linked sets have more equal segments than one, so each set leaves out as many of its most frequent segments as it can
without losing the rarest one of any link: segments of a common passage make no candidates then.

Filter: each set has a bit map, about four bits a shingle, in which every shingle turns one bit over. Two maps differ in
at most as many bits as the sets in shingles, so pairs whose maps differ in more bits than H are no links.

Overlaps: for each pair that is left, the partial overlap is counted in each of a few coarse fragments by itself,
and the counts are summed for each pair.

Copies of a set are one set from the first step on. Of the sets that share a segment, each is first
paired with the smallest key only. What these links have not connected is compared in blocks: sets are dealt to
the center that most sets share, each center's sets are cut into blocks of a bounded size, and two blocks that share a
segment meet in one task, which compares their bit maps and returns only pairs of different components that
may link, the most alike for each two components. Where there were more, the step is repeated with what is then known, so
no link between components is lost. Sets whose links are all within a component cost no further rows, and no row is written
for a pair of sets that are only candidates. This is `join_documents`, whose result is the components.
`link_documents` takes all pairs that pass the bit maps and gives every link between two different sets and each document's set;
its rows grow with the links.

Defined results: texts without words, or null, have an empty set and link with nothing; null ids
take part and do not count as smallest (a component of null ids only has a null id); repeated rows and ids are copies;
ties cannot occur, as a link holds or not; very long texts are taken whole, their sets and bit maps growing with them;
other columns are not read, whatever their names; an
empty table gives an empty result. Shingles are 64-bit hashes, and sets are told apart by a 64-bit hash of
theirs; at a billion different sets one false match is expected with a chance of a few per cent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WordHashes, drop_written, mixed, values, written
from .bloom import SegmentedBloom, build_bloom

SHINGLE_WORDS = 4
THRESHOLD = (85, 100)
GROWTH = 1.5
COARSE = 4
#: Bounds of the filter that names the texts to read again: two bytes for each, so far as the upper bound allows.
BLOOM_BYTES = (1 << 16, 1 << 26)
#: Bytes of bit maps in a block of sets.
BLOCK_BYTES = 1 << 17
#: Bytes of bit maps that a block meets at once.
CHUNK_BYTES = 1 << 20
#: Pairs returned for each two components by one comparison of a block: few the first time, which joins most components that link at
#: all, more at each repetition.
PAIRS_OF_COMPONENTS = 4
MORE_PAIRS = 250
HOT_COPIES = 1_000
_FLUSH = 500_000
_SIGS_A_BUCKET = 250_000
#: The lowest bits of a signature are its size class.
CLASS_BITS = 7
DOC, BLOCK, LOCAL, SET = 0, 1, 2, 3


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, the one hash of the sequence."""
    if not len(words):
        return words
    if len(words) < size:
        h = np.array([len(words)], np.uint64)
        for w in words:
            h = mixed(h, np.array([w], np.uint64))
        return h
    h = words[: len(words) - size + 1]
    for i in range(1, size):
        h = mixed(h, words[i : len(words) - size + 1 + i])
    return np.unique(h)


class SizeClasses:
    """Classes of set sizes, each with its number of fragments."""

    def __init__(self, threshold: tuple[int, int], growth: float = GROWTH):
        self.num, self.den = threshold
        self.tops = [1]
        while self.tops[-1] < 1 << 40:
            self.tops.append(int(self.tops[-1] * growth) + 1)

    def differences(self, a: int, b: int) -> int:
        """The most shingles in one of two linked sets of a and b shingles and not in the other."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest_partner(self, size: int) -> int:
        return size * self.den // self.num

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.tops, size))

    def fragments(self, c: int) -> int:
        h = self.differences(self.tops[c], self.tops[c])
        return h + 2 + h // 32

    def signatures(self, h: np.ndarray) -> np.ndarray:
        """One hash for each segment that a linked set may have equal."""
        return np.concatenate([np.empty(0, np.uint64), *[sigs for _, sigs, _ in self.parts(h)]])

    def parts(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """For each size class the signatures, and how many of the most frequent ones may be left out.

        A linked set has all segments of this one that are not empty but as many as shingles may differ. Of these, the rarest one
        is left in by both if neither leaves out all but one of them.
        """
        size = len(h)
        partner = self.largest_partner(size)
        if self.differences(size, partner) < 1:
            return  # only equal sets link
        content = mixed(h, np.full(1, 0x51ED27, np.uint64))
        low = np.uint64((1 << CLASS_BITS) - 1)
        for c in range(self.of(size), self.of(partner) + 1):
            n = self.fragments(c)
            fragment = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(content, starts)
            out = [mixed(sums, fragment[starts] + np.uint64(c << 40))]
            most = self.differences(size, min(partner, self.tops[c]))
            if len(starts) <= most:  # equal segments may all be empty ones
                empty = np.setdiff1d(np.arange(n, dtype=np.uint64), fragment[starts])
                out.append(mixed(np.zeros(len(empty), np.uint64), empty + np.uint64(c << 40)))
            yield c, (np.concatenate(out) & ~low) | np.uint64(c), max(0, len(starts) - most - 1)


def _sorted_pairs(sigs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, key) in order, and where each sig starts."""
    order = np.lexsort((keys, sigs))
    sigs, keys = sigs[order], keys[order]
    fresh = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (keys[1:] != keys[:-1])]) if len(sigs) else np.empty(0, bool)
    sigs, keys = sigs[fresh], keys[fresh]
    starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.empty(0, np.int64)
    return sigs, keys, starts


def _pack(sigs: np.ndarray, keys: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Sorted sigs as differences, by byte planes; keys as places in a list of the distinct ones."""
    steps = np.diff(sigs, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    distinct, place = np.unique(keys, return_inverse=True)
    places = place.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(sigs).to_bytes(8, "little") + pack.compress(steps.tobytes() + places.tobytes() + distinct.tobytes())


def _unpack(data: bytes, unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    n, raw = int.from_bytes(data[:8], "little"), unpack.decompress(data[8:])
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel()
    places = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8 * n).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, np.uint64, -1, 12 * n)[places]


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a, np.uint64).view(np.int64), pa.int64())


def bit_map(h: np.ndarray) -> bytes:
    """A power of two of bits, 64 and 2 for each shingle at least; every shingle turns one over."""
    n_bits = max(64, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Maps (rows of 64-bit words) at a smaller width: what turns a bit over there is what does so here, modulo the width."""
    while maps.shape[-1] > width:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def bits_apart(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    width = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Whether sets of n and m shingles whose maps differ in `apart` bits can link."""
    num, den = threshold
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & ((den + num) * apart <= (den - num) * (n + m))


def blocks_apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many bits each map of `left` differs from each of `right`."""
    out = np.empty((len(left), len(right)), np.int64)
    widths = [np.array([len(x) // 8 for x in side]) for side in (left, right)]
    for u in np.unique(widths[0]):
        rows = np.flatnonzero(widths[0] == u)
        x = np.frombuffer(b"".join(left[i] for i in rows), np.uint64).reshape(len(rows), u)
        for v in np.unique(widths[1]):
            cols = np.flatnonzero(widths[1] == v)
            y = np.frombuffer(b"".join(right[i] for i in cols), np.uint64).reshape(len(cols), v)
            width = min(u, v)
            a, b = folded(x, width), folded(y, width)
            step = max(1, 1_000_000 // (len(cols) * int(width)))
            for i in range(0, len(rows), step):
                out[np.ix_(rows[i : i + step], cols)] = np.bitwise_count(a[i : i + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def set_signatures(texts: DataFrame, id_type: str, size: int, threshold: tuple[int, int], n_buckets: int) -> DataFrame:
    """Each document's set key, size and text digest in `sig` (DOC), packed signatures (BLOCK), sets that met in one task (LOCAL), and bit maps (SET)."""
    names = ["kind", "doc_id", "n", "key", "sig", "center", "bucket", "block", "spare"]
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes, pack = WordHashes(), SizeClasses(threshold), zstandard.ZstdCompressor(level=1)
        held_sigs: list[np.ndarray] = []
        held_keys: list[int] = []
        held_maps: list[tuple[int, bytes, list[tuple[int, int]]]] = []
        seen: set[int] = set()
        texts_seen: dict[int, tuple[int, int]] = {}
        id_kind, spare_kind = None, pa.list_(pa.struct([("c", pa.int32()), ("d", pa.int32())]))

        def rows(kind: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {"doc_id": id_kind, "n": pa.int64(), "key": pa.int64(), "sig": pa.int64(), "center": pa.int64(), "bucket": pa.int32(), "block": pa.binary(), "spare": spare_kind}
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *[columns.get(c, pa.nulls(size, kinds[c])) for c in names[1:]]], names)

        def flush() -> Iterator[pa.RecordBatch]:
            sizes, maps, spares = zip(*held_maps, strict=True)
            yield rows(SET, len(maps), key=_i64(np.array(held_keys, np.uint64)), n=pa.array(sizes, pa.int64()), block=pa.array(maps, pa.binary()), spare=pa.array(spares, spare_kind))
            sigs, keys, starts = _sorted_pairs(np.concatenate(held_sigs), np.repeat(np.array(held_keys, np.uint64), [len(s) for s in held_sigs]))
            held_sigs.clear()
            held_keys.clear()
            held_maps.clear()
            sizes = np.diff(np.append(starts, len(sigs)))
            met = np.repeat(sizes > 1, sizes)
            if met.any():
                center = np.repeat(keys[starts], sizes)[met]
                yield rows(LOCAL, int(met.sum()), sig=_i64(sigs[met]), key=_i64(keys[met]), center=_i64(center))
            sigs, keys = sigs[starts], keys[starts]
            edges = np.searchsorted(sigs >> shift, np.arange(n_buckets + 1, dtype=np.uint64))
            blocks = [(b, _pack(sigs[i:j], keys[i:j], pack)) for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if j > i]
            yield rows(BLOCK, len(blocks), bucket=pa.array([b for b, _ in blocks], pa.int32()), block=pa.array([x for _, x in blocks], pa.binary()))

        total = 0
        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            ns, keys = [], []
            for text, digest in zip(values(batch.column("text")), values(batch.column("digest")), strict=True):
                if digest in texts_seen:
                    n, key = texts_seen[digest]
                    ns.append(n)
                    keys.append(key)
                    continue
                h = shingles(hashes.of(text), size)
                key = xxhash.xxh3_64_intdigest(h.tobytes())
                ns.append(len(h))
                keys.append(key)
                texts_seen[digest] = (len(h), key)
                if len(h) and key not in seen:
                    seen.add(key)
                    parts = list(classes.parts(h))
                    if parts:
                        sigs = np.concatenate([x for _, x, _ in parts])
                        held_sigs.append(sigs)
                        held_keys.append(key)
                        held_maps.append((len(h), bit_map(h), [(c, d) for c, _, d in parts if d]))
                        total += len(sigs)
                if total > _FLUSH:
                    yield from flush()
                    seen.clear()
                    texts_seen.clear()
                    total = 0
            yield rows(DOC, len(ns), doc_id=batch.column("doc_id"), n=pa.array(ns, pa.int64()), key=_i64(np.array(keys, np.uint64)), sig=batch.column("digest"))
        if held_sigs:
            yield from flush()

    return texts.mapInArrow(run, f"kind int, doc_id {id_type}, n long, key long, sig long, center long, bucket int, block binary, spare array<struct<c:int,d:int>>")


def without_spare(members: DataFrame, spare: DataFrame) -> DataFrame:
    """(sig, key): `members` without the most frequent signatures of each set and size class, as many as `spare` (key, c, d) allows."""
    frequent = members.groupBy("sig").agg(F.count("*").alias("times"))  # the same order for all sets
    rows = members.select("sig", "key").join(frequent, "sig").withColumn("c", F.col("sig").bitwiseAND((1 << CLASS_BITS) - 1).cast("int"))
    place = F.dense_rank().over(Window.partitionBy("key", "c").orderBy(F.desc("times"), F.desc("sig")))
    ranked = rows.join(spare, ["key", "c"], "left").select("sig", "key", "d", place.alias("place"))
    return ranked.where("place > coalesce(d, 0)").select("sig", "key").distinct()


def meetings(blocks: DataFrame) -> DataFrame:
    """(sig, key, center) of all keys whose sig has several; the center is the smallest key."""

    def run(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        parts = [_unpack(x, unpack) for g in groups for x in g.column("block").to_pylist()]
        sigs, keys, starts = _sorted_pairs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        sizes = np.diff(np.append(starts, len(sigs)))
        met = np.repeat(sizes > 1, sizes)
        center = np.repeat(keys[starts], sizes)[met]
        yield pa.RecordBatch.from_arrays([_i64(sigs[met]), _i64(keys[met]), _i64(center)], ["sig", "key", "center"])

    return blocks.select("bucket", "block").groupBy("bucket").applyInArrow(run, "sig long, key long, center long")


def candidate_sets(texts: DataFrame, wanted: SegmentedBloom, size: int) -> DataFrame:
    """(key, fragment, segment): the sets of the texts whose digest the filter has, in COARSE ranges of the order."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            digests = batch.column("digest").to_numpy().view(np.uint64)
            found = []
            for i in np.flatnonzero(shared.value.contains(digests)).tolist():
                if digests[i] in seen:
                    continue
                seen.add(digests[i])
                h = shingles(hashes.of(batch.column("text")[i].as_py()), size)
                if not len(h):
                    continue
                key = xxhash.xxh3_64_intdigest(h.tobytes())
                edges = np.searchsorted(h >> np.uint64(62), np.arange(COARSE + 1, dtype=np.uint64)).tolist()
                found += [(key, j, h[a:b].tobytes()) for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            if found:
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([_i64(np.array(cols[0], np.uint64)), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["key", "fragment", "segment"])

    rows = texts.select("digest", "text").mapInArrow(run, "key long, fragment int, segment binary")
    return rows.groupBy("key", "fragment").agg(F.max("segment").alias("segment"))


def verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (key, center) that link: partial overlaps by fragment, summed for each pair."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("segment").to_pylist(), batch.column("other").to_pylist(), strict=True)
            n = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in both]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("center"), pa.array(n, pa.int64())], ["key", "center", "overlap"])

    other = sets.select(F.col("key").alias("center"), "fragment", F.col("segment").alias("other"))
    each = pairs.join(sets, "key").join(other, ["center", "fragment"]).select("key", "center", "segment", "other")
    counted = each.mapInArrow(overlaps, "key long, center long, overlap long").groupBy("key", "center").agg(F.sum("overlap").alias("overlap"))
    sized = counted.join(sizes.select("key", "n"), "key").join(sizes.select(F.col("key").alias("center"), F.col("n").alias("m")), "center")
    num, den = threshold
    return sized.where(den * F.col("overlap") >= num * (F.col("n") + F.col("m") - F.col("overlap"))).select("key", "center")


def are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each v is the smallest node of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that edges (a, b) connect each node with.

    Alternates large-star and small-star until all components are stars; every round is written out.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "jaccard-edges")
    while not are_stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "jaccard-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "jaccard-small")
    return current.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _labelled(table: DataFrame, labels: DataFrame | None, column: str, out: str) -> DataFrame:
    """`table` with the label of `column`, the node itself where it has none."""
    if labels is None:
        return table.withColumn(out, F.col(column))
    names = labels.select(F.col("node").alias(column), F.col("label").alias("__label"))
    return table.join(names, column, "left").withColumn(out, F.coalesce("__label", column)).drop("__label")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after further links; only components are joined, not their members."""
    edges = _labelled(_labelled(links, labels, "key", "a"), labels, "center", "b").select("a", "b").where("a <> b")
    new = components(edges)
    if labels is None:
        return new
    old = _labelled(labels.select("node", F.col("label").alias("mid")), new, "mid", "label").select("node", "label")
    return written(old.unionByName(new.join(labels.select("node"), "node", "left_anti")), "jaccard-labels")


@dataclass
class Met:
    """What both joins start from."""

    texts: DataFrame  # (doc_id, text, digest) of every row
    documents: DataFrame  # (doc_id, n, key) of every row
    by_key: DataFrame  # (key, first_id, n, digest, copies) of all sets that are not empty
    members: DataFrame  # (sig, key): sets that share a segment with another, without the segments that they can spare
    stars: DataFrame  # (key, center): each of them with the smallest keys that it shares segments with, and with its leader
    placed: DataFrame  # (key, n, bits, block) of each of them
    size: int
    threshold: tuple[int, int]


def _met(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: tuple[int, int]) -> Met:
    id_type = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    texts = texts.withColumn("digest", F.xxhash64("text"))
    n_buckets = 16
    while n_buckets * _SIGS_A_BUCKET < total // 16:
        n_buckets *= 2
    first = written(set_signatures(texts, id_type, size, threshold, n_buckets), "jaccard-signatures")
    documents = written(first.where(F.col("kind") == DOC).select("doc_id", "n", "key", F.col("sig").alias("digest")), "jaccard-documents")
    by_key = documents.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.min("digest").alias("digest"), F.count("*").alias("copies"))
    by_key = written(by_key, "jaccard-keys")
    local = first.where(F.col("kind") == LOCAL).select("sig", "key", "center")
    members = written(meetings(first.where(F.col("kind") == BLOCK)).unionByName(local), "jaccard-members")
    stars = written(members.where("key <> center").select("key", "center").distinct(), "jaccard-stars")
    # every set goes to the center that most sets share, and a center's sets to blocks of a bounded size
    followers = stars.groupBy("center").agg(F.count("*").alias("followers"))
    choices = stars.join(followers, "center").unionByName(followers.withColumn("key", F.col("center")))
    leaders = choices.groupBy("key").agg(F.max(F.struct("followers", "center")).alias("c")).select("key", F.col("c.center").alias("leader"))
    leaders = written(leaders, "jaccard-leaders")
    for step in ("second", "third"):  # a center that was the smallest key of one task only goes on to its own
        leaders = leaders.join(leaders.select(F.col("key").alias("leader"), F.col("leader").alias(step)), "leader").select("key", F.col(step).alias("leader"))
    maps = first.where(F.col("kind") == SET).select("key", "n", F.col("block").alias("bits"), "spare")
    greatest = [F.max(c).alias(c) for c in ("n", "bits", "leader", "spare")]  # of equal ones
    led = written(maps.join(leaders, "key").groupBy("key").agg(*greatest), "jaccard-led")
    drop_written(first)  # the signatures are most of what the join stores
    few = written(without_spare(members, led.select("key", F.explode("spare").alias("s")).select("key", "s.*")), "jaccard-members")
    drop_written(members)
    parts = led.groupBy("leader").agg(F.ceil(F.sum(F.octet_length("bits") + 24) / BLOCK_BYTES).alias("parts"))
    block = F.xxhash64("leader", F.pmod(F.xxhash64("key"), F.col("parts")))
    placed = written(led.join(parts, "leader").select("key", "n", "bits", block.alias("block")), "jaccard-placed")
    stars = stars.unionByName(led.where("key <> leader").select("key", F.col("leader").alias("center"))).distinct()
    return Met(texts, documents.drop("digest"), by_key, few, stars, placed, size, threshold)


def near_stars(met: Met) -> DataFrame:
    """The pairs (key, center) of `stars` that pass the bit maps."""
    threshold = met.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [bits_apart(a, b) for a, b in zip(batch.column("bits").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            fits = may_link(batch.column("n").to_numpy(), batch.column("m").to_numpy(), np.array(apart, np.int64), threshold)
            yield batch.select(["key", "center"]).filter(pa.array(fits, pa.bool_()))

    other = met.placed.select(F.col("key").alias("center"), F.col("n").alias("m"), F.col("bits").alias("other"))
    num, den = threshold
    both = met.stars.join(met.placed.select("key", "n", "bits"), "key").join(other, "center").where(den * F.least("n", "m") >= num * F.greatest("n", "m"))
    return both.select("key", "center", "n", "m", "bits", "other").mapInArrow(run, "key long, center long")


def near_blocks(met: Met, labels: DataFrame | None, most: int | None, only: DataFrame | None = None) -> DataFrame:
    """(key, center, more): pairs of different labels whose blocks share a segment, or are a pair of `only`, and that pass the bit maps.

    Of more than `most` pairs of the same two labels in two blocks, only those with the fewest bits apart are returned, and `more` is true.
    """
    threshold = met.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("left", "right"):
                flat = batch.column(name).flatten()
                sides.append((batch.column(name).offsets.to_numpy(), *[flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "label", "n")], flat.field("bits")))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for row in range(batch.num_rows):
                (keys, names, n, bits), (others, other_names, m, other_bits) = ([x[o[row] - o[0] : o[row + 1] - o[0]] for x in columns] for o, *columns in sides)
                apart = blocks_apart(bits.to_pylist(), other_bits.to_pylist())
                fits = may_link(n[:, None], m[None, :], apart, threshold) & (names[:, None] != other_names[None, :])
                i, j = np.nonzero(fits)
                if not len(i):
                    continue
                low, high = np.minimum(names[i], other_names[j]), np.maximum(names[i], other_names[j])
                order = np.lexsort((apart[i, j], high, low))
                i, j, low, high = i[order], j[order], low[order], high[order]
                starts = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
                sizes = np.diff(np.append(starts, len(i)))
                rank = np.arange(len(i)) - np.repeat(starts, sizes)
                kept, more = (rank < most, np.repeat(sizes > most, sizes)) if most else (np.ones(len(i), bool), np.zeros(len(i), bool))
                a, b = keys[i[kept]], others[j[kept]]
                found.append((np.maximum(a, b), np.minimum(a, b), more[kept]))
            if found:
                key, center, more = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(center), pa.array(more)], ["key", "center", "more"])

    own = _labelled(met.placed, labels, "key", "label")
    if only is None:
        at = met.members.join(own.select("key", "block", "label"), "key").groupBy("sig")
        at = at.agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sort_array(F.collect_set("block")).alias("blocks"))
        only = at.where("low <> high").select("blocks").distinct().select(F.posexplode("blocks").alias("place", "first"), "blocks")
        only = only.select("first", F.explode(F.expr("slice(blocks, place + 1, size(blocks))")).alias("second"))
    pairs = written(only.distinct(), "jaccard-block-pairs")
    needed = pairs.select(F.explode(F.array("first", "second")).alias("block")).distinct()
    packed = own.join(needed, "block", "left_semi").groupBy("block")
    packed = packed.agg(F.collect_list(F.struct("key", "label", "n", "bits")).alias("sets"), F.sum(F.octet_length("bits") + 24).alias("bytes"))
    packed = written(packed, "jaccard-blocks")
    # of two blocks the smaller one travels; what travels to one block comes in chunks of a bounded size
    sizes = packed.select("block", F.struct("bytes", "block").alias("of"))
    sized = pairs.join(sizes.withColumnsRenamed({"block": "first", "of": "a"}), "first").join(sizes.withColumnsRenamed({"block": "second", "of": "b"}), "second")
    sized = sized.select(F.greatest("a", "b").alias("large"), F.least("a", "b").alias("small"))
    sized = written(sized.select(F.col("large.block").alias("large"), F.col("small.block").alias("block"), F.col("small.bytes").alias("bytes")), "jaccard-block-pairs")
    chunks = sized.groupBy("large").agg(F.ceil(F.sum("bytes") / CHUNK_BYTES).alias("chunks"))
    travels = sized.drop("bytes").join(chunks, "large").join(packed.select("block", "sets"), "block")
    travels = travels.groupBy("large", F.pmod(F.xxhash64("block"), F.col("chunks")).alias("chunk")).agg(F.flatten(F.collect_list("sets")).alias("right"))
    both = travels.join(packed.select(F.col("block").alias("large"), F.col("sets").alias("left")), "large")
    found = both.select("left", "right").mapInArrow(run, "key long, center long, more boolean")
    return found.groupBy("key", "center").agg(F.max("more").alias("more"))


def exact_sets(met: Met, pairs: DataFrame, have: DataFrame | None) -> DataFrame:
    """(key, fragment, segment) of all sets of `pairs`, read from their texts where `have` does not have them."""
    keys = pairs.select(F.explode(F.array("key", "center")).alias("key")).distinct()
    if have is not None:
        keys = keys.join(have.select("key").distinct(), "key", "left_anti")
    digests = written(keys.join(met.by_key, "key").select(F.col("digest").alias("h")), "jaccard-wanted")
    n_bytes, count = BLOOM_BYTES[0], digests.count()
    while n_bytes < min(BLOOM_BYTES[1], 2 * count):
        n_bytes *= 2
    new = candidate_sets(met.texts, build_bloom(digests, n_bytes), met.size)
    if have is None:
        return written(new, "jaccard-sets")
    return have.unionByName(written(new.join(have.select("key").distinct(), "key", "left_anti"), "jaccard-sets"))


def link_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All links (key, center) between two different sets, each once with key > center, and (doc_id, n_shingles, key) of every row.

    Documents of one key are copies of each other; a row with n_shingles = 0 links with nothing.
    """
    met = _met(docs, id_col, text_col, size, threshold)
    pairs = written(near_blocks(met, None, None).select("key", "center"), "jaccard-pairs")
    links = written(verified(pairs, exact_sets(met, pairs, None), met.by_key, threshold), "jaccard-links")
    return links, met.documents.select("doc_id", F.col("n").alias("n_shingles"), "key")


def connected(met: Met) -> DataFrame | None:
    """(node, label) of all sets that link with another, the label being the smallest key of the component; None if there are none."""
    pairs = written(near_stars(met), "jaccard-pairs")
    if met.stars.isEmpty():
        return None
    sets = exact_sets(met, pairs, None)
    labels, done = _merged(None, written(verified(pairs, sets, met.by_key, met.threshold), "jaccard-links")), pairs
    most, again = PAIRS_OF_COMPONENTS, None
    at = met.placed.select("key", "block")
    while True:
        found = near_blocks(met, labels, most, again)
        for sides in (("key", "center"), ("center", "key")):
            known = done.select(F.col("key").alias(sides[0]), F.col("center").alias(sides[1]), F.lit(True).alias(f"known_{sides[0]}"))
            found = found.join(known, ["key", "center"], "left")
        found = written(found.select("key", "center", "more", F.coalesce("known_key", "known_center", F.lit(False)).alias("known")), "jaccard-pairs")
        pairs = found.where("NOT known").select("key", "center")
        if not pairs.isEmpty():
            sets = exact_sets(met, pairs, sets)
            labels = _merged(labels, written(verified(pairs, sets, met.by_key, met.threshold), "jaccard-links"))
            done = done.unionByName(pairs)
        open_pairs = _labelled(_labelled(found.where("more"), labels, "key", "a"), labels, "center", "b").where("a <> b")
        if open_pairs.isEmpty():
            return labels
        # only blocks that had more pairs of components still apart meet again
        ends = open_pairs.join(at.withColumnRenamed("block", "x"), "key").join(at.withColumnsRenamed({"key": "center", "block": "y"}), "center")
        again, most = ends.select(F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second")), most * MORE_PAIRS


def join_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`. Links within a component are not all looked for."""
    met = _met(docs, id_col, text_col, size, threshold)
    named = _labelled(met.by_key.select("key", "first_id", "copies"), connected(met), "key", "label")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component"), F.sum("copies").alias("total"))
    component = written(named.join(smallest, "label").select("key", "copies", "component"), "jaccard-components")
    # keys of so many copies that a join would gather them in one task: at most 4,096 of them
    rows = component.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = component.where(F.col("copies") >= max(HOT_COPIES, rows // 4096)).select("key", "component")
    named = met.documents.where("n > 0").join(F.broadcast(hot.withColumnRenamed("component", "hot")), "key", "left")
    parts = [
        named.where("hot IS NOT NULL").withColumnRenamed("hot", "component"),
        named.where("hot IS NULL").drop("hot").join(component.select("key", "component"), "key"),
    ]
    linked = parts[0].unionByName(parts[1]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = met.documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)

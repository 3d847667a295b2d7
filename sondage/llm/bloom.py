"""A Bloom filter in segments, built where Spark has shuffled its hashes to.

The high bits of a hash name its segment, so each segment is built by one group of a shuffle and
only finished bits reach the driver: `n_bytes` in all, whatever the input. A key can be held at
several levels; each level of a key has its own bits in the key's segment.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mixed


class SegmentedBloom:
    def __init__(self, n_bytes: int, n_segments: int, n_probes: int):
        """`n_bytes` and `n_segments` are powers of two."""
        self.n_segments, self.n_probes = n_segments, n_probes
        self.segment_bits = n_bytes * 8 // n_segments
        self.shift = 64 - (n_segments.bit_length() - 1)
        self.bits = np.zeros(n_bytes, np.uint8)

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(self.shift)).astype(np.int64) if self.n_segments > 1 else np.zeros(len(h), np.int64)

    def _places(self, h: np.ndarray, level: int) -> Iterator[np.ndarray]:
        a = mixed(h, np.full(1, level, np.uint64))
        b = (a >> np.uint64(32)) | np.uint64(1)
        for i in range(self.n_probes):
            with np.errstate(over="ignore"):
                yield ((a + np.uint64(i) * b) & np.uint64(self.segment_bits - 1)).astype(np.int64)

    def segment_bytes(self, keys: Iterable[tuple[np.ndarray, int]]) -> bytes:
        """One segment's bits from (hashes, level) pairs."""
        flags = np.zeros(self.segment_bits, bool)
        for h, level in keys:
            for places in self._places(h, level):
                flags[places] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def fill(self, segment: int, data: bytes) -> None:
        size = self.segment_bits // 8
        self.bits[segment * size : (segment + 1) * size] = np.frombuffer(data, np.uint8)

    def contains(self, h: np.ndarray, level: int = 0) -> np.ndarray:
        out = np.ones(len(h), bool)
        left, start = np.arange(len(h)), self.segment(h) * self.segment_bits
        for places in self._places(h, level):
            at = start[left] + places[left]
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[left[~hit]] = False
            left = left[hit]
        return out


class SizedBloom:
    """A filter whose segments each have the size that their own keys ask for; a segment without keys has no bits."""

    LEAST_BITS = 1024

    def __init__(self, n_segments: int, n_probes: int, dropped: int = 0):
        """`n_segments` is a power of two; the lowest `dropped` bits of hashes are not told apart."""
        self.n_segments, self.n_probes, self.dropped = n_segments, n_probes, np.uint64(dropped)
        self.shift = 64 - (n_segments.bit_length() - 1)
        self.load({})

    def key(self, h: np.ndarray) -> np.ndarray:
        """What the filter knows of a hash."""
        return (h >> self.dropped) << self.dropped

    def empty(self) -> SizedBloom:
        return SizedBloom(self.n_segments, self.n_probes, int(self.dropped))

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(self.shift)).astype(np.int64) if self.n_segments > 1 else np.zeros(len(h), np.int64)

    def load(self, segments: dict[int, bytes]) -> None:
        """Hold these segments and no others."""
        self.starts, self.sizes = np.zeros(self.n_segments, np.int64), np.zeros(self.n_segments, np.uint64)
        at, parts = 8, [b"\0"]  # the first byte is that of all segments without bits
        for i, data in segments.items():
            self.starts[i], self.sizes[i] = at, 8 * len(data)
            at += 8 * len(data)
            parts.append(data)
        self.bits = np.frombuffer(b"".join(parts), np.uint8)

    def _places(self, h: np.ndarray, level: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
        a = mixed(h, np.full(1, level, np.uint64))
        b = (a >> np.uint64(32)) | np.uint64(1)
        for i in range(self.n_probes):
            with np.errstate(over="ignore"):
                yield ((((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * sizes) >> np.uint64(32)).astype(np.int64)

    def segment_bytes(self, n_bits: int, keys: Iterable[tuple[np.ndarray, int]]) -> bytes:
        """One segment's bits, `n_bits` or a few more, from (hashes, level) pairs."""
        flags = np.zeros((max(n_bits, self.LEAST_BITS) + 7) // 8 * 8, bool)
        for h, level in keys:
            for places in self._places(h, level, np.full(1, len(flags), np.uint64)):
                flags[places] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def contains(self, h: np.ndarray, level: int = 0) -> np.ndarray:
        out, segments = np.ones(len(h), bool), self.segment(h)
        left, start = np.arange(len(h)), self.starts[segments]
        for places in self._places(h, level, self.sizes[segments]):
            at = start[left] + places[left]
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[left[~hit]] = False
            left = left[hit]
        return out


def build_bloom(hashes: DataFrame, n_bytes: int, *, n_segments: int = 64, n_probes: int = 4) -> SegmentedBloom:
    """A filter of the column `h` (long) of `hashes`. Each segment needs n_bytes / n_segments of memory."""
    bloom = SegmentedBloom(n_bytes, n_segments, n_probes)

    def bits(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = bloom.segment_bytes((g.column("h").to_numpy(zero_copy_only=False).view(np.uint64), 0) for g in groups)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([data], pa.binary())], ["segment", "bits"])

    empty, bloom.bits = bloom.bits, np.empty(0, np.uint8)  # the closure needs no bits
    keyed = hashes.select("h", F.shiftrightunsigned("h", bloom.shift).cast("int").alias("segment") if n_segments > 1 else F.lit(0).alias("segment"))
    rows = keyed.groupBy("segment").applyInArrow(bits, "segment int, bits binary").collect()  # n_bytes in all
    bloom.bits = empty
    for row in rows:
        bloom.fill(row["segment"], row["bits"])
    return bloom

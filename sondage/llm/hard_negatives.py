"""Operator 12, hard-negative mining by dual-tree search.

Rows are routed to cells by a tree of median splits and stored in blocks, each the rows of one cell in the order of
its own tree; a cell with many rows gives many blocks. Anchors are stored in blocks of the same kind. A
pair of nodes, one of each tree, bounds all inner products between their rows by centres and
radii: <a, c> within r_a |c| + r_c |a| + r_a r_c. Pairs that cannot reach what an anchor still
needs are dropped whole, first for blocks before anything is sent, then down both trees; pairs of leaves that are left are
scored exactly. Positives are looked for in the nearest shard of blocks first, then, with the scores found there as
bounds, in the others; negatives between the bounds that positives set.

The routing tree is fitted on at most `sample_rows` rows; it only decides which rows lie together, so results
are exact whatever it is. All rows are stored and searched, and no partner is capped.

Defined results: rows with a null id, label or vector, another number of components than `dims`, or a null
or non-finite component take no part; repeated ids are rows of their own (an anchor is no other row to itself only);
equal scores go by the smaller id; anchors without positives, and positives without negatives, give no row; an empty
table gives an empty result; only the id, label and vector columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop_written, written
from .vectors import matrix, packed_vectors

LEAST, MOST = -(1 << 62), 1 << 62
BLOCK_ROWS, ANCHOR_ROWS = 1024, 256
LEAF_ROWS, ANCHOR_LEAF = 64, 16
SHARD_BYTES = 1 << 26
MOST_NODES = 1 << 14  # summaries that each task holds, at about 600 bytes
_FOUND = "anchor long, slot int, id long, score long"


# Rows of a block: ids, row numbers, labels and components, one array behind another.


def _packed(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray) -> bytes:
    return b"".join([a.astype("<i8").tobytes() for a in (ids, rows, labels)] + [x.astype("<i4").tobytes()])


def _unpacked(data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // (24 + 4 * dims)
    ids, rows, labels = np.frombuffer(data, "<i8", 3 * n).reshape(3, n)
    return ids, rows, labels, np.frombuffer(data, "<i4", n * dims, 24 * n).reshape(n, dims)


def _ranges(n: int, leaf: int) -> list[tuple[int, int, int]]:
    """The balanced tree over n rows as (start, end, number of the first child or -1); children are neighbours."""
    out: list[tuple[int, int, int]] = [(0, n, -1)]
    for i, (a, b, _) in enumerate(out):  # grows while it is read
        if b - a > leaf:
            out[i] = (a, b, len(out))
            out += [(a, (a + b) // 2, -1), ((a + b) // 2, b, -1)]
    return out


def _in_tree_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """The order of rows in which every node halves along its widest component."""
    order = np.arange(len(x))
    for a, b, child in _ranges(len(x), leaf):
        if child >= 0:
            part = x[order[a:b]]
            wide = int(np.argmax(part.var(0)))
            order[a:b] = order[a:b][np.argsort(part[:, wide], kind="stable")]
    return order


def _mask(labels: np.ndarray) -> int:
    """A set of labels as bits; labels that share a bit are taken for one another, which prunes less but never too much."""
    return int(np.bitwise_or.reduce(np.uint64(1) << (labels % 64).astype(np.uint64))) if len(labels) else 0


class _Tree:
    """A block with the centre, radius, norm and labels of each node."""

    def __init__(self, data: bytes, dims: int, leaf: int):
        self.ids, self.rows, self.labels, x = _unpacked(data, dims)
        top = int(np.abs(x).max()) if len(x) else 0
        # products are exact: sums stay below 2^24 in single and 2^53 in double precision
        self.exact = np.float32 if dims * top * top < 1 << 24 else np.float64 if dims * top * top < 1 << 53 else np.int64
        self.x = x.astype(self.exact)
        nodes = _ranges(len(x), leaf)
        self.start, self.end, self.child = np.array(nodes).T
        wide = x.astype(np.float64)
        norms = np.sqrt((wide * wide).sum(1))
        self.centre = np.stack([wide[a:b].mean(0) for a, b, _ in nodes])
        self.radius = np.array([np.sqrt(((wide[a:b] - c) ** 2).sum(1).max()) for (a, b, _), c in zip(nodes, self.centre)])
        self.centre_norm = np.sqrt((self.centre**2).sum(1))
        self.norm = np.array([norms[a:b].max() for a, b, _ in nodes])
        self.mask = np.array([_mask(self.labels[a:b]) for a, b, _ in nodes], np.uint64)
        same = [len(np.unique(self.labels[a:b])) == 1 for a, b, _ in nodes]
        self.only = np.where(same, self.labels[self.start], MOST)  # the label of a node that has one only


def _spread(a: _Tree, i: np.ndarray, c: _Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that rows of the nodes i of a and j of c can have."""
    mid = np.einsum("nd,nd->n", a.centre[i], c.centre[j])
    off = a.radius[i] * c.centre_norm[j] + c.radius[j] * a.centre_norm[i] + a.radius[i] * c.radius[j]
    most = a.norm[i] * c.norm[j]
    slack = 1 + 1e-9 * most  # for the rounding of the bounds themselves
    return np.maximum(mid - off, -most) - slack, np.minimum(mid + off, most) + slack


def _products(a: _Tree, rows: np.ndarray, c: _Tree, some: np.ndarray) -> np.ndarray:
    x, y = a.x[rows], c.x[some]
    if a.exact is np.int64 or c.exact is np.int64:
        x, y = x.astype(np.int64), y.astype(np.int64)
    return (x @ y.T).astype(np.int64)


class _Best:
    """The k best (score, id) of each anchor and slot with lo <= score <= hi."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int):
        """lo and hi: anchors x slots."""
        self.lo, self.hi, self.k = lo, hi, k
        self.scores = np.full((*lo.shape, k), LEAST, np.int64)
        self.ids = np.full((*lo.shape, k), MOST, np.int64)

    def need(self) -> np.ndarray:
        """For each anchor the least score that still counts in one of its slots."""
        open_ = np.maximum(self.lo, self.scores[:, :, -1])
        return np.where(self.lo <= self.hi, open_, MOST).min(1)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """`scores` and `fits`: rows x ids."""
        slots, k = self.lo.shape[1], self.k
        lo, hi = self.lo[rows][:, :, None], self.hi[rows][:, :, None]
        new = np.where(fits[:, None] & (scores[:, None] >= lo) & (scores[:, None] <= hi), scores[:, None], LEAST)
        all_scores = np.concatenate([self.scores[rows], new], 2).reshape(len(rows) * slots, -1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, new.shape)], 2).reshape(len(rows) * slots, -1)
        least = np.partition(all_scores, -k, axis=1)[:, -k:].min(1)
        at, col = np.nonzero((all_scores >= least[:, None]) & (all_scores > LEAST))
        s, i = all_scores[at, col], all_ids[at, col]
        order = np.lexsort((i, -s, at))
        at, s, i = at[order], s[order], i[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = place < k
        flat_scores, flat_ids = np.full((len(rows) * slots, k), LEAST, np.int64), np.full((len(rows) * slots, k), MOST, np.int64)
        flat_scores[at[top], place[top]], flat_ids[at[top], place[top]] = s[top], i[top]
        self.scores[rows], self.ids[rows] = flat_scores.reshape(-1, slots, k), flat_ids.reshape(-1, slots, k)


def search(a: _Tree, blocks: list[_Tree], best: _Best, same: bool) -> int:
    """Fills `best` with rows of the blocks that have the label of an anchor (`same`) or another one; the number of products taken."""
    zero, taken = np.zeros(len(blocks), np.int64), 0
    tops = [_spread(a, zero[:1], c, zero[:1])[1][0] for c in blocks]
    for c in (blocks[i] for i in np.argsort(tops)[::-1].tolist()):
        need = best.need()
        of_node = np.array([need[s:e].min() for s, e in zip(a.start, a.end)])
        most = np.where(best.lo <= best.hi, best.hi, LEAST).max(1)
        most_of_node = np.array([most[s:e].max() for s, e in zip(a.start, a.end)])
        i, j = zero[:1], zero[:1]
        leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(i):
            low, high = _spread(a, i, c, j)
            labels = (a.mask[i] & c.mask[j] != 0) if same else (a.only[i] != c.only[j]) | (a.only[i] == MOST)
            keep = labels & (high >= of_node[i]) & (low <= most_of_node[i])
            i, j, high = i[keep], j[keep], high[keep]
            leaf = (a.child[i] < 0) & (c.child[j] < 0)
            leaves.append((i[leaf], j[leaf], high[leaf]))
            i, j = i[~leaf], j[~leaf]
            # children of both sides; a leaf stays as it is
            ai, cj = a.child[i], c.child[j]
            sides = [(np.where(ai < 0, i, ai + p), np.where(cj < 0, j, cj + q), ((ai >= 0) | (p == 0)) & ((cj >= 0) | (q == 0))) for p in (0, 1) for q in (0, 1)]
            i, j = (np.concatenate([s[k][s[2]] for s in sides]) for k in (0, 1))
        i, j, high = (np.concatenate([x[k] for x in leaves]) for k in range(3))
        order = np.lexsort((-high, i))
        i, j, high = i[order], j[order], high[order]
        for node in np.unique(i).tolist():
            rows = np.arange(a.start[node], a.end[node])
            mine, tops, step = j[i == node], high[i == node], 2
            while len(mine):  # the best leaves first: what they give may rule out the others
                some = np.concatenate([np.arange(c.start[n], c.end[n]) for n in mine[:step].tolist()])
                alike = a.labels[rows][:, None] == c.labels[some]
                fits = (alike & (a.rows[rows][:, None] != c.rows[some])) if same else ~alike
                best.add(rows, _products(a, rows, c, some), c.ids[some], fits)
                taken += len(rows) * len(some)
                left = tops[step:] >= best.need()[rows].min()
                mine, tops, step = mine[step:][left], tops[step:][left], 2 * step
    return taken


class _Router:
    """A tree of median splits; a row's cell is the number of its leaf, 0 to 2^depth - 1."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        groups = {1: sample.astype(np.float64)}
        for node in range(1, 1 << depth):
            rows = groups.pop(node)
            if len(rows):
                axis = int(np.argmax(rows.var(0)))
                self.axis[node], self.cut[node] = axis, np.median(rows[:, axis])
            right = rows[:, self.axis[node]] > self.cut[node]
            groups[2 * node], groups[2 * node + 1] = rows[~right], rows[right]

    def cells(self, x: np.ndarray) -> np.ndarray:
        node, all_rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[all_rows, self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


def _with_cells(rows: DataFrame, router: _Router, dims: int, first: np.ndarray | None = None, parts: np.ndarray | None = None) -> DataFrame:
    """`rows` with their cells; with `first` and `parts`, the rows of each cell dealt over its blocks in turn."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.full(1 << router.depth, TaskContext.get().partitionId(), np.int64)
        for batch in batches:
            cell = router.cells(matrix(batch.column("x"), dims))
            if first is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])
                continue
            order = np.argsort(cell, kind="stable")
            place = np.empty(len(cell), np.int64)
            place[order] = np.arange(len(cell)) - np.searchsorted(cell[order], cell[order])
            block = first[cell] + (turn[cell] + place) % parts[cell]
            turn += np.bincount(cell, minlength=len(turn))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int32())], [*batch.schema.names, "block"])

    kept = rows.select("id", "row", "label", "anchor", "x")
    return kept.mapInArrow(routed, f"id long, row long, label long, anchor boolean, x binary, {'cell' if first is None else 'block'} int")


def _dealt(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First block and number of blocks of each cell, and of all."""
    parts = -(-counts // size)
    return np.cumsum(parts) - parts, np.maximum(1, parts), int(parts.sum())


def _built(rows: DataFrame, dims: int, leaf: int) -> DataFrame:
    """One row for each block: its packed rows in tree order, and the summary of its root."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        x = matrix(group.column("x").combine_chunks(), dims)
        ids, at, labels = (group.column(c).to_numpy() for c in ("id", "row", "label"))
        order = _in_tree_order(x, leaf)
        data = _packed(ids[order], at[order], labels[order], x[order])
        centre = x.mean(0)
        radius, norm = np.sqrt(((x - centre) ** 2).sum(1).max()), np.sqrt((x.astype(np.float64) ** 2).sum(1).max())
        only = int(labels[0]) if (labels == labels[0]).all() else MOST
        mask = np.array([_mask(labels)], np.uint64).view(np.int64)
        columns = [[key[0].as_py()], [len(x)], [data], [centre.astype("<f8").tobytes()], [radius], [norm], mask, [only]]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "n", "data", "centre", "radius", "norm", "mask", "only"])

    schema = "block int, n long, data binary, centre binary, radius double, norm double, mask long, only long"
    return rows.groupBy("block").applyInArrow(build, schema)


class _Summary:
    """Roots of blocks, or of runs of neighbouring blocks where there are more than MOST_NODES, with their shards."""

    def __init__(self, blocks: DataFrame, n_blocks: int, n_shards: int):
        def merged(key: tuple, group: pa.Table) -> pa.Table:
            centres = np.stack([np.frombuffer(c.as_py(), "<f8") for c in group.column("centre")])
            n, radius, only = (group.column(c).to_numpy() for c in ("n", "radius", "only"))
            centre = (centres * n[:, None]).sum(0) / n.sum()
            reach = (np.sqrt(((centres - centre) ** 2).sum(1)) + radius).max()
            shards = group.column("shard").to_numpy()
            columns = [[centre.tobytes()], [reach], [group.column("norm").to_numpy().max()], [np.bitwise_or.reduce(group.column("mask").to_numpy())], [only[0] if (only == only[0]).all() else MOST], [shards.min()], [shards.max()]]
            kinds = [pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["centre", "radius", "norm", "mask", "only", "first", "last"])

        node = F.floor(F.col("block").cast("long") * min(n_blocks, MOST_NODES) / n_blocks)
        roots = blocks.select("n", "centre", "radius", "norm", "mask", "only", "shard", node.alias("node"))
        rows = roots.groupBy("node").applyInArrow(merged, "centre binary, radius double, norm double, mask long, only long, first int, last int").collect()  # MOST_NODES at most
        self.centre = np.stack([np.frombuffer(r["centre"], "<f8") for r in rows])
        self.radius, self.norm = np.array([r["radius"] for r in rows]), np.array([r["norm"] for r in rows])
        self.centre_norm = np.sqrt((self.centre**2).sum(1))
        self.mask = np.array([r["mask"] for r in rows], np.int64).view(np.uint64)
        self.only = np.array([r["only"] for r in rows], np.int64)
        self.first, self.last = np.array([r["first"] for r in rows]), np.array([r["last"] for r in rows])
        self.n_shards = n_shards

    def _marked(self, nodes: np.ndarray) -> np.ndarray:
        steps = np.zeros(self.n_shards + 1, np.int64)
        np.add.at(steps, self.first[nodes], 1)
        np.add.at(steps, self.last[nodes] + 1, -1)
        return np.flatnonzero(np.cumsum(steps[:-1]) > 0)

    def nearest(self, a: _Tree) -> int:
        """The shard whose blocks lie nearest to an anchor block."""
        return int(self.first[int(((self.centre - a.centre[0]) ** 2).sum(1).argmin())])

    def shards(self, a: _Tree, best: _Best, same: bool) -> np.ndarray:
        """Shards that may hold what a block of anchors still needs."""
        root, nodes = np.zeros(len(self.radius), np.int64), np.arange(len(self.radius))
        low, high = _spread(a, root, self, nodes)
        labels = (a.mask[root] & self.mask != 0) if same else (a.only[root] != self.only) | (a.only[root] == MOST)
        most = np.where(best.lo <= best.hi, best.hi, LEAST).max()
        return self._marked(nodes[labels & (high >= best.need().min()) & (low <= most)])


def _bounds(batch: pa.RecordBatch, i: int, n: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """lo and hi of each anchor and slot, from the column `bounds` of (place, slot, lo, hi)."""
    given = batch.column("bounds")[i].as_py()
    lo, hi = np.full((n, slots), LEAST if given is None else MOST, np.int64), np.full((n, slots), MOST if given is None else LEAST, np.int64)
    for b in given or []:
        lo[b["place"], b["slot"]], hi[b["place"], b["slot"]] = b["lo"], b["hi"]
    return lo, hi


_BOUNDS = "array<struct<place:int,slot:int,lo:long,hi:long>>"


def _sent(anchors: DataFrame, summary: _Summary, dims: int, slots: int, same: bool, nearest: bool | None) -> DataFrame:
    """Anchor blocks, once for each shard that they must visit: the nearest only (True), the others (False), or all (None)."""
    shared = anchors.sparkSession.sparkContext.broadcast(summary)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = []
            for i in range(batch.num_rows):
                a = _Tree(batch.column("data")[i].as_py(), dims, ANCHOR_LEAF)
                near = shared.value.nearest(a)
                all_ = [near] if nearest else shared.value.shards(a, _Best(*_bounds(batch, i, len(a.ids), slots), 1), same).tolist()
                shards.append([s for s in all_ if nearest is not False or s != near])
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("data"), batch.column("bounds"), pa.array(shards, pa.list_(pa.int32()))], ["block", "data", "bounds", "shards"])

    picked = anchors.mapInArrow(chosen, f"block int, data binary, bounds {_BOUNDS}, shards array<int>")
    return picked.select(F.explode("shards").alias("shard"), F.lit(1).alias("kind"), "block", "data", "bounds")


def _searched(blocks: DataFrame, sent: DataFrame, dims: int, slots: int, k: int, same: bool, n_shards: int) -> DataFrame:
    """The k best of every anchor and slot within each shard."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trees = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                here, kind = batch.column("shard")[i].as_py(), batch.column("kind")[i].as_py()
                if here != shard:
                    shard, trees = here, []
                data = batch.column("data")[i].as_py()
                if kind == 0:
                    trees.append(_Tree(data, dims, LEAF_ROWS))
                    continue
                a = _Tree(data, dims, ANCHOR_LEAF)
                best = _Best(*_bounds(batch, i, len(a.ids), slots), k)
                search(a, trees, best, same)
                at, slot, place = np.nonzero(best.scores > LEAST)
                anchor = (batch.column("block")[i].as_py() << 16) + at
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(slot, pa.int32()), pa.array(best.ids[at, slot, place]), pa.array(best.scores[at, slot, place])], ["anchor", "slot", "id", "score"])

    stored = blocks.select("shard", F.lit(0).alias("kind"), "block", "data", F.lit(None).cast(_BOUNDS).alias("bounds"))
    both = stored.unionByName(sent).repartition(n_shards, "shard").sortWithinPartitions("shard", "kind", "block")
    return both.mapInArrow(found, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot over all shards; each task keeps k of a group before they are shuffled."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_bounds(anchors: DataFrame, bounds: DataFrame) -> DataFrame:
    """Anchor blocks with their bounds; `bounds` has anchor, slot, lo and hi. Blocks without any keep an empty list."""
    row = F.struct(F.col("anchor").bitwiseAND(0xFFFF).cast("int").alias("place"), "slot", "lo", "hi")
    lists = bounds.groupBy(F.shiftright("anchor", 16).cast("int").alias("block")).agg(F.collect_list(row).alias("bounds"))  # ANCHOR_ROWS x slots at most
    return anchors.select("block", "data").join(lists, "block", "left").withColumn("bounds", F.coalesce("bounds", F.array().cast(_BOUNDS)))


def _places(anchors: DataFrame, dims: int) -> DataFrame:
    """The number and id of every anchor."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                ids = _unpacked(data.as_py(), dims)[0]
                yield pa.RecordBatch.from_arrays([pa.array((block << 16) + np.arange(len(ids))), pa.array(ids)], ["anchor", "anchor_id"])

    return anchors.select("block", "data").mapInArrow(named, "anchor long, anchor_id long")


def mine(
    docs: DataFrame,
    is_anchor: Column,
    label: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    dims: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 1 << 15,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Positives of an anchor are its best rows of the same label; negatives of both the best rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score. `anchor_rows` is 65,536 at most.
    """
    spark = docs.sparkSession
    keep = [F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")]
    usable = docs.where(F.col(id_col).isNotNull() & label.isNotNull())
    packed = packed_vectors(usable, keep, vector_col, scale, dims)
    rows = written(packed.withColumn("row", F.monotonically_increasing_id()), "mining-rows")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("anchor").cast("long")), F.lit(0)).alias("anchors")).first()
    if not total["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = rows.select("x", F.xxhash64("row").alias("h")).orderBy("h").limit(sample_rows).collect()
    sample_x = np.frombuffer(b"".join(r["x"] for r in sample), "<i4").reshape(-1, dims)
    depth = max(0, int(min(total["n"] / block_rows, len(sample) / 16)).bit_length() - 1)
    router = _Router(sample_x, depth)

    per_cell = _with_cells(rows, router, dims).groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors")).collect()
    counts, anchor_counts = np.zeros(1 << depth, np.int64), np.zeros(1 << depth, np.int64)
    for r in per_cell:
        counts[r["cell"]], anchor_counts[r["cell"]] = r["n"], r["anchors"]
    first, parts, n_blocks = _dealt(counts, block_rows)
    size = total["n"] * (24 + 4 * dims)
    n_shards = min(n_blocks, max(2 * spark.sparkContext.defaultParallelism, -(-size // shard_bytes)))
    shard = F.floor(F.col("block").cast("long") * n_shards / n_blocks).cast("int")
    blocks = written(_built(_with_cells(rows, router, dims, first, parts), dims, LEAF_ROWS).withColumn("shard", shard), "mining-blocks")
    # anchors are few: neighbouring cells share a block
    up = min(depth, max(0, int(anchor_rows * 2**depth / total["anchors"]).bit_length() - 1))
    coarse = anchor_counts.reshape(-1, 1 << up).sum(1)
    a_first, a_parts, _ = _dealt(coarse, anchor_rows)
    fine = np.arange(1 << depth) >> up
    chosen = _with_cells(rows.where("anchor"), router, dims, a_first[fine], a_parts[fine])
    anchors = written(_built(chosen, dims, ANCHOR_LEAF).select("block", "data", F.lit(None).cast(_BOUNDS).alias("bounds")), "mining-anchors")
    drop_written(rows)
    summary = _Summary(blocks, n_blocks, n_shards)

    near = written(_searched(blocks, _sent(anchors, summary, dims, 1, True, True), dims, 1, positives, True, n_shards), "mining-near")
    enough = _top(near, positives).groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    lo = F.when(F.col("n") >= positives, F.col("least")).otherwise(F.lit(LEAST))
    # anchors that found nothing near are open on both sides
    ids = _places(anchors, dims)
    every = ids.select("anchor", F.lit(0).alias("slot"))
    bounds = every.join(enough, ["anchor", "slot"], "left").select("anchor", "slot", F.coalesce(lo, F.lit(LEAST)).alias("lo"), F.lit(MOST).alias("hi"))
    others = _sent(_with_bounds(anchors, bounds), summary, dims, 1, True, False)
    rest = _searched(blocks, others, dims, 1, positives, True, n_shards)
    best = written(_top(near.unionByName(rest), positives), "mining-positives")

    per_slot = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    lo, hi = f"{-low} * positive_score", f"{high} * positive_score"  # exact: the ceiling of a / 100 is -floor(-a / 100)
    wanted = per_slot.select("anchor", "slot", F.expr(f"-(({lo} - pmod({lo}, 100L)) div 100)").alias("lo"), F.expr(f"({hi} - pmod({hi}, 100L)) div 100").alias("hi"))
    asked = _sent(_with_bounds(anchors, wanted), summary, dims, positives, False, None)
    hard = _top(_searched(blocks, asked, dims, positives, negatives, False, n_shards), negatives)
    out = hard.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(per_slot, ["anchor", "slot"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

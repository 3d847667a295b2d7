"""Operator 13, centroid clustering by delta Lloyd.

Assignments are persisted with their vectors, and so are the sums of all clusters. A round compares each
vector only with the centroids that the last round changed, and with all centroids where the vector's own
one has moved away; vectors that change their owner are added to the new cluster and taken from the old one
as signed integers, summed within tasks and then over them. All arithmetic is on integers and exact.

Defined results: rows with a null vector, another number of components than `dims`, or a null or non-finite component take no part;
a row with a null id is clustered but is no first centroid; repeated rows and ids are clustered row by row, and
among equal hashes the first centroids go by their components; equal distances go to the smaller number;
with fewer vectors than clusters there are as many clusters as vectors; an empty table gives an empty result;
only `id_col` and `vector_col` are read, so other columns may have any name. Components beyond 2^27 after
scaling, and inertias that no long holds, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_written, written
from .vectors import matrix, packed_vectors

_ROWS = 1 << 14
_STATE = "id {id}, x binary, was int, owner int, distance long"


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number first, and the squared distance."""
    if len(x) and len(centroids) and x.shape[1] * (2 * max(np.abs(x).max(), np.abs(centroids).max(), 1)) ** 2 < 1 << 53:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    owner = d.argmin(1)
    return owner, d[np.arange(len(x)), owner]


def _reassigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray, dims: int, id_type: str) -> DataFrame:
    """The state after one assignment. `changed` marks centroids that differ from those of the last one."""
    moved = np.flatnonzero(changed)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, _ROWS):
                batch = big.slice(start, _ROWS)
                x = matrix(batch.column("x"), dims)
                was = batch.column("owner").to_numpy(zero_copy_only=False)
                owner, distance = was.copy(), batch.column("distance").to_numpy(zero_copy_only=False).copy()
                anew = (was < 0) | changed[was]  # an owner that moved: all centroids count
                if anew.any():
                    owner[anew], distance[anew] = _nearest(x[anew], centroids)
                rest = ~anew
                if rest.any() and len(moved):  # else the changed centroids only
                    near, d = _nearest(x[rest], centroids[moved])
                    near = moved[near]
                    better = (d < distance[rest]) | (d == distance[rest]) & (near < owner[rest])
                    owner[rest], distance[rest] = np.where(better, near, owner[rest]), np.where(better, d, distance[rest])
                columns = [batch.column("id"), batch.column("x"), pa.array(was, pa.int32()), pa.array(owner, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "x", "was", "owner", "distance"])

    return state.mapInArrow(assigned, _STATE.format(id=id_type))


def _transfers(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What each cluster's number and sums gain: k rows, whatever the input."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            for column, sign in (("was", -1), ("owner", 1)):
                at = batch.column(column).to_numpy(zero_copy_only=False)
                rows = at >= 0
                np.add.at(n, at[rows], sign)
                np.add.at(sums, at[rows], sign * x[rows])
        some = np.flatnonzero((n != 0) | (sums != 0).any(1))
        lists = pa.array(list(sums[some]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), lists], ["cluster", "n", "sums"])

    moved = state.where("was <> owner").select("x", "was", "owner").mapInArrow(signed, "cluster int, n long, sums array<long>")
    rows = moved.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect()
    n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for row in rows:
        n[row["cluster"]], sums[row["cluster"]] = row["n"], row["sums"]
    return n, sums


def cluster_vectors(
    docs: DataFrame, *, clusters: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    The driver holds `clusters` x `dims` integers. Each round reads the state once, writes the next one to
    the shared folder and drops the one before. No vector is shuffled: only sums are.
    """
    id_type = dict(docs.dtypes)[id_col]
    vectors = packed_vectors(docs, [F.col(id_col).alias("id")], vector_col, scale, dims)
    state = written(vectors.select("id", "x", F.lit(-1).alias("was"), F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance")), "clusters")
    first = state.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "x")
    centroids = np.array([np.frombuffer(r["x"], "<i4") for r in first.orderBy("h", "x").limit(clusters).collect()], np.int64).reshape(-1, dims)
    k = len(centroids)
    if k == 0:  # rows with null ids only, or none
        state = state.limit(0)
    changed, n, sums = np.ones(k, bool), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for i in range(rounds + 1 if k else 0):
        before, state = state, written(_reassigned(state, centroids, changed, dims, id_type), "clusters")
        drop_written(before)
        if i == rounds:
            break
        dn, dsums = _transfers(state, k, dims)
        n, sums = n + dn, sums + dsums
        new = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)  # // of integers is the exact floor
        changed, centroids = (new != centroids).any(1), new
    spark = docs.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per_cluster = state.groupBy("owner").agg(F.sum("distance").alias("cluster_inertia"))
    per_cluster = per_cluster.withColumn("inertia", F.sum("cluster_inertia").over(_all_clusters())).withColumnRenamed("owner", "cluster")
    reports = F.broadcast(per_cluster.join(names, "cluster"))  # a row for each cluster
    assigned = state.select(F.col("id").alias("vec_id"), F.col("owner").alias("cluster"), "distance")
    return assigned.join(reports, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _all_clusters():
    from pyspark.sql import Window

    return Window.partitionBy()  # over a row for each cluster

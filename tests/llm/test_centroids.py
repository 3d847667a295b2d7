import hashlib

import numpy as np
import pytest

from sondage.llm import centroids
from sondage.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, distance string"


def brute(rows, k=16, rounds=3, dims=64):
    """Plain Lloyd over Python integers: (vec_id, cluster, distance, cluster_inertia, inertia, digest)."""
    ok = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in ok if i is not None)
    x, c = np.array([v for _, v in ok], np.int64).reshape(-1, dims), np.array([v for *_, v in named[:k]], np.int64)

    def assigned():
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        owner, _ = assigned()
        c = np.array([[sum(col) // len(col) for col in zip(*x[owner == j].tolist())] if (owner == j).any() else c[j].tolist() for j in range(len(c))], np.int64)
    owner, d = assigned()
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return sorted((str(i), int(o), int(e), int(d[owner == o].sum()), int(d.sum()), digests[o]) for (i, _), o, e in zip(ok, owner, d))


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_query_equals_plain_lloyd(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(QUERIES["op13_centroids"](spark, SF)) == brute(rows)


def odd_rows():
    rng = np.random.default_rng(2)
    rows = [(i, [float(a) for a in rng.normal(size=64).astype(np.float32)], i % 3, None) for i in range(300)]
    rows += [(i, rows[7][1], 1, "copy") for i in range(300, 450)] + [(7, rows[7][1], 1, "again"), (7, rows[9][1], 1, "same id"), (None, rows[3][1], 1, "")]
    return rows + [(500, None, 1, ""), (501, [1.0] * 63, 1, ""), (502, [float("nan")] * 64, 1, ""), (503, [float("-inf")] * 64, 1, ""), (504, [None] * 64, None, "")]


@pytest.mark.parametrize("rounds", [0, 1, 5, 12])
def test_odd_rows_and_many_rounds(spark, rounds):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(centroids.cluster_vectors(df, rounds=rounds)) == brute([r[:2] for r in rows], rounds=rounds)


def test_few_rows_and_empty_tables(spark):
    rows = odd_rows()[:5]
    assert got(centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA))) == brute([r[:2] for r in rows])
    assert got(centroids.cluster_vectors(spark.createDataFrame([], SCHEMA))) == []
    assert got(centroids.cluster_vectors(spark.createDataFrame([(None, [1.0] * 64, 1, "")], SCHEMA))) == []


def test_equal_vectors_leave_empty_clusters(spark):
    rows = [(i, [0.5] * 64, 1, None) for i in range(40)] + [(i, [0.25] * 64, 1, None) for i in range(40, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(centroids.cluster_vectors(df)) == brute([r[:2] for r in rows])


def test_large_components_are_exact_or_refused(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a) for a in rng.integers(-150_000, 150_000, 64)], 1, None) for i in range(60)]
    assert got(centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA))) == brute([r[:2] for r in rows])
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64, 1, "")], SCHEMA)).collect()


def test_a_round_looks_at_changed_centroids_only(spark, monkeypatch):
    x = np.arange(24, dtype=np.int64).reshape(6, 4)
    c = np.array([[0, 1, 2, 3], [8, 9, 10, 11], [20, 21, 22, 23]])
    owner, distance = centroids._nearest(x, c)
    state = spark.createDataFrame([(i, v.astype("<i4").tobytes(), -1, int(o), int(d)) for i, (v, o, d) in enumerate(zip(x, owner, distance))], "id long, x binary, was int, owner int, distance long")
    moved = c.copy()
    moved[2] -= 3
    rows = sorted(tuple(r) for r in centroids._reassigned(state, moved, np.array([False, False, True]), 4, "bigint").select("id", "was", "owner", "distance").collect())
    want, far = centroids._nearest(x, moved)
    assert rows == [(i, int(owner[i]), int(want[i]), int(far[i])) for i in range(6)]

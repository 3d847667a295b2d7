import numpy as np
from pyspark.sql import functions as F

from sondage.llm import hard_negatives as hn
from sondage.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, dims=64):
    """All results by comparing every anchor with every row."""
    ok = [(i, (y + 1) % 10 if i % 7 == 0 else y, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v, y in rows if i is not None and y is not None and v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for n, (i, y, v) in enumerate(ok):
        if i % 100:
            continue
        others = sorted((-int(v @ w), j, z) for m, (j, z, w) in enumerate(ok) if m != n)
        for s, j, _ in [o for o in others if o[2] == y][:5]:
            fit = [o for o in others if o[2] != y and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            out += [(i, j, r + 1, o[1], -s, -o[0]) for r, o in enumerate(fit)]
    return sorted(out)


def mined(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 100 == 0, label, **options).collect())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, SF).collect()) == brute(rows)


def clustered(n, seed, dims=64, centres=6):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    x = (c[rng.integers(0, centres, n)] + 0.1 * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, [float(a) for a in v], int(rng.integers(0, 3)), None) for i, v in enumerate(x)]


def test_blocks_shards_ties_repeats_and_odd_rows(spark):
    rows = clustered(700, 1)
    rows += [(i, rows[300][1], i % 4, "same") for i in range(700, 1100)]  # copies of one vector, a third of all
    rows += [(100, rows[5][1], 1, "twice"), (100, rows[5][1], 1, "twice"), (5, None, 1, ""), (6, rows[6][1], None, ""), (None, rows[6][1], 1, "")]
    rows += [(200, [float("nan")] + [0.0] * 63, 1, ""), (300, [float("inf")] * 64, 1, ""), (400, [1.0] * 3, 1, ""), (500, [None] * 64, 2, ""), (2000, [0.0] * 64, 1, ""), (2100, [-1.0] * 64, 7, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute([r[:3] for r in rows])
    assert len(want) > 100
    assert mined(df, block_rows=64, anchor_rows=2, sample_rows=200, shard_bytes=40_000) == want
    assert mined(df) == want


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in rng.integers(-400_000, 400_000, 64)], int(i % 3), None) for i in range(260)]
    rows += [(i, [float(a) for a in rng.integers(-30, 30, 64)], int(i % 3), None) for i in range(260, 320)]
    assert mined(spark.createDataFrame(rows, SCHEMA), block_rows=50) == brute([r[:3] for r in rows])


def test_empty_tables_and_no_partners(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mined(df) == []
    assert mined(spark.createDataFrame(clustered(1, 1), SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0] * 64, 1, None)], SCHEMA)) == []


def test_node_pairs_are_pruned():
    rng = np.random.default_rng(7)
    centres = 200 * rng.normal(size=(40, 64))
    x = np.floor(np.repeat(centres, 128, 0) + 3 * rng.normal(size=(5120, 64))).astype(np.int64)
    labels = rng.integers(0, 3, len(x))

    def tree(rows, leaf):
        rows = rows[hn._in_tree_order(x[rows], leaf)]
        return hn._Tree(hn._packed(rows, rows, labels[rows], x[rows]), 64, leaf)

    a = tree(np.arange(128, 144), hn.ANCHOR_LEAF)
    blocks = [tree(np.arange(i, i + 512), hn.LEAF_ROWS) for i in range(0, 5120, 512)]
    best = hn._Best(np.full((16, 1), hn.LEAST), np.full((16, 1), hn.MOST), 5)
    taken = hn.search(a, blocks, best, True)
    assert taken <= 16 * 5120 / 16
    for n, i in enumerate(a.ids.tolist()):
        s = x @ x[i]
        want = sorted((-int(s[j]), j) for j in range(5120) if j != i and labels[j] == labels[i])[:5]
        assert [(-s, i) for s, i in zip(best.scores[n, 0].tolist(), best.ids[n, 0].tolist())] == want

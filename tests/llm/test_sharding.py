import zlib
from collections import Counter

from sondage.llm import sharding


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(docs, 8).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all(r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    load, places = Counter(), {}
    for r in rows:
        load[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert set(load) == set(range(8)) and max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_edges_and_stored_maps(spark, tmp_path):
    rows = [(None, None), (1, ""), (1, ""), (2, "é" * 50_000), (None, "x"), (3, None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, size int")
    path = str(tmp_path / "map")
    out = sharding.shard_documents(docs, 8, map_path=path).collect()
    assert sorted(r["size"] for r in out) == [1, 1, 1, 1, 2, 100_001]
    assert sharding.shard_documents(docs.limit(0), 8).count() == 0
    first = [tuple(r) for r in sharding.read_map(spark, path, 1).collect()]
    second = sharding.edited_map(first, 9)
    sharding.write_map(spark, path, second)
    assert {r.version for r in sharding.read_map(spark, path, 2).collect()} == {2}
    assert sharding.read_map(spark, path, 1).count() == len(first)


def test_edits_move_little():
    slots = [(i, 1000 + i * 7 % 90, 10) for i in range(4096)]
    first = sharding.first_map(slots, 8)
    more = sharding.edited_map(first, 9)
    moved = sum(a[2] != b[2] for a, b in zip(sorted(first, key=lambda x: x[1]), sorted(more, key=lambda x: x[1])))
    load = Counter()
    for _, _, shard, size, _ in more:
        load[shard] += size
    assert moved <= 4096 / 9 * 1.05 and max(load.values()) < 1.01 * min(load.values())
    fewer = sharding.edited_map(more, 8)
    assert {x[2] for x in fewer} == set(range(8)) and fewer[0][0] == 3

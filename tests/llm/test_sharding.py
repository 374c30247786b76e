import zlib

from quarry.llm import sharding


def test_shards_slots_and_places(make, empty, odd_texts):
    texts = odd_texts * 5
    rows = sharding.shard(make(texts), shards=24).collect()
    n = len(texts)
    assert sorted(r.row_number for r in rows) == list(range(n))
    by = {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "rows", None)
        assert (r.shard, r.slot) == sharding.place(r.row_number, n)
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(24)) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shard(make(texts).repartition(7), shards=24).collect()))
    assert sharding.shard(empty).count() == 0


def test_sizes_around_squares_and_null_ids(spark):
    for n in (1, 2, 3, 5, 10, 17):
        docs = spark.range(n).selectExpr("if(id % 3 = 0, null, id) as doc_id", "'x' as text")
        places = {(r.shard, r.slot) for r in sharding.shard(docs, shards=4).collect()}
        assert len(places) == n


def test_no_python_on_the_path(make):
    assert "Python" not in sharding.shard(make(["a"]))._jdf.queryExecution().executedPlan().toString()

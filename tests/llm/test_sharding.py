import zlib
from collections import defaultdict

from lotlens.llm import queries, sharding


def check(rows, found, shards):
    """The law ``bytes``, gapless slots and contiguous ranges, over all rows."""
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == want
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in found)
    members = defaultdict(list)
    for r in found:
        members[r.shard].append(r)
    total, largest = sum(r.size for r in found), max(r.size for r in found)
    for held in members.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert abs(sum(r.size for r in held) - total / shards) <= largest
    start = 0
    for r in sorted(found, key=lambda r: (r.shard, r.slot)):
        assert r.start == start
        start += r.size


def test_query_against_the_law(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op6_sharding(spark, sf).collect()
    check(rows, found, 40)
    ordered = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)


def test_edges(spark):
    rows = [(1, "é", 3), (1, "é", 3), (None, None, 4), (2, "", 5), (3, None, 6), (4, "long " * 60_000, 7)] + [(i, "same", 8) for i in range(5, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    for shards in (1, 3, 40, 500):
        check(rows, sharding.shard(docs, shards).collect(), shards)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, slot int")
    assert sharding.shard(docs).count() == 0

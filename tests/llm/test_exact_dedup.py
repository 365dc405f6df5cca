import hashlib
from collections import defaultdict

from lotlens.llm import exact_dedup, queries

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())
ROWS = [
    (1, "Same text", "a"), (9, "sAME TEXT", "b"), (9, "same text", "b"), (4, None, "c"), (5, "", None), (None, "same text", "d"),
    (6, "Ünder", "e"), (7, "ünder", "e"), (8, "İ", "f"), (10, "i̇", "f"), (11, "x" * 300_000, "g"), (12, "X" * 300_000, "g"),
    (13, "a b", "h"), (14, "a  b", "h"), (None, "only without an id", "i"), (15, "tail ", "j"), (16, "tail", "j"),
]
SCHEMA = "doc_id long, text string, keep_id string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(FOLD)].append(doc_id)
    found = []
    for text, ids in groups.items():
        stays = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        seen = False
        for i in ids:
            kept = i == stays and not seen
            seen = seen or kept
            found.append((i, stays, len(ids), kept, sha))
    return sorted(found, key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_groups_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert shown(exact_dedup.group_copies(docs)) == brute(ROWS)
    assert shown(exact_dedup.group_copies(docs, capacity=1, max_depth=4)) == brute(ROWS)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert shown(queries.op10_exact_dedup(spark, sf)) == brute(rows)


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    wanted = sorted(((i, sha) for i, _, _, k, sha in brute(ROWS) if k), key=str)
    got = [(r.doc_id, hashlib.sha256((r.text or "").translate(FOLD).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=str) == wanted


def test_overfull_buckets_split(spark):
    keys = spark.range(4000).selectExpr("xxhash64(id) AS key")
    cells = exact_dedup.directory(keys, capacity=100, max_depth=10)
    held = keys.selectExpr("shiftrightunsigned(key, 54) AS cell").join(cells, "cell").groupBy("bucket_depth", "bucket").count().collect()
    assert sum(r["count"] for r in held) == 4000
    assert len(held) > 1 and max(r["count"] for r in held) <= 100


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.group_copies(docs).count() == 0
    assert exact_dedup.deduplicate(docs).count() == 0


def test_directory_places_and_finds(spark):
    rows = [(i, f"text {i // 3}", None) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = exact_dedup.group_copies(docs, capacity=20, max_depth=3)
    assert shown(found) == brute(rows)
    buckets = found.groupBy("bucket_depth", "bucket").agg({"text_sha256": "count"}).collect()
    distinct = found.select("bucket_depth", "bucket", "text_sha256").distinct().groupBy("bucket_depth", "bucket").count().collect()
    assert sum(r["count"] for r in distinct) == 300 and max(r["count"] for r in distinct) <= 20
    assert max(r.bucket_depth for r in buckets) > 3  # beyond what one level resolves
    index, levels = exact_dedup.build_index(docs, 20, 3)
    assert len(levels) > 1 and index.filter("chain > 0").count() == 0
    inside = "shiftrightunsigned(key, 64 - bucket_depth) = bucket"
    assert index.filter(inside).count() == 300


def test_texts_that_share_a_key_form_a_chain(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: exact_dedup.F.lit(7).cast("long"))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = exact_dedup.group_copies(docs, capacity=1, max_depth=16)
    assert shown(found) == brute(ROWS)
    assert {r.chain for r in found.collect()} == set(range(len({r[-1] for r in brute(ROWS)})))


def test_own_names_do_not_clash(spark):
    names = ["row", "id", "key", "sha", "_id", "_text", "keep_id", "text_sha256", "_sha", "_keep", "bucket", "low", "n"]
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    docs = docs.selectExpr("*", *(f"'{n}' AS {n}" for n in names))
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["_sha"], r["row"]) for r in kept.collect()) == [(2, "_sha", "row"), (3, "_sha", "row")]
    assert exact_dedup.group_copies(docs).count() == 3

import random
from collections import defaultdict
from itertools import combinations

from lotlens.llm import packing, queries


def padding(cells, bounds):
    return sum(min(b for b in bounds if b >= top) * n - s for top, n, s in cells)


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        tops = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        cells = [(t, n, t * n - rng.randint(0, 2)) for t in tops for n in [rng.randint(1, 20)]]
        for k in (1, 2, 3, 20):
            got = packing.best_boundaries(cells, k)
            assert len(got) <= k and got[-1] == tops[-1]
            best = min(padding(cells, [*c, tops[-1]]) for r in range(min(k, len(tops))) for c in combinations(tops[:-1], r))
            assert padding(cells, got) == best


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    lengths = {r.doc_id: len(r.text.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op1_packing(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in found} == lengths
    assert len({(r.bucket, r.batch, r.slot) for r in found}) == len(found)
    batches = defaultdict(list)
    for r in found:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for rows in batches.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) * rows[0].bucket_tokens <= packing.BUDGET or len(rows) == 1


def test_operator_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (None, "", "y"), (4, "w " * 50_000, "z"), (5, " \n a ", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = packing.pack(docs, 2, 100).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, 3), (1, 3), (2, 0), (4, 50_000), (5, 1)]
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == 6
    assert packing.pack(docs.limit(0)).count() == 0
    assert {r.n_tokens for r in packing.pack(docs.filter("doc_id = 2")).collect()} == {0}


def test_coarse_histogram_stays_within_its_bound(spark, monkeypatch):
    rng = random.Random(2)
    lengths = [int(4000 * 2 ** (rng.random() * 6)) for _ in range(3000)]
    rows = spark.createDataFrame([(n,) for n in lengths], "_n long")
    exact = packing.histogram(rows)
    assert len(exact) == len(set(lengths)) and sum(n for _, n, _ in exact) == 3000
    coarse = packing.histogram(rows, most=100)
    assert len(coarse) < len(exact) and sum(s for _, _, s in coarse) == sum(lengths)
    for k in (2, 5, 16):
        best = padding(exact, packing.best_boundaries(exact, k)) + sum(lengths)
        near = padding(exact, packing.best_boundaries(coarse, k)) + sum(lengths)
        assert best <= near <= best * 2 ** (1 / packing.STEPS)


def test_columns_are_carried_and_batches_filled(spark):
    rows = [(1, [5, 6, 7], "x"), (2, None, "y"), (3, [], None), (4, list(range(40)), "z"), (5, [9], "w"), (5, [9], "w")]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>, slot string")
    got = packing.pack(docs, 2, 8, packing.F.size("ids"), carry=True)
    assert got.columns == [*packing.PACKED, "ids", "slot_in"]
    assert {(r.doc_id, r.slot_in) for r in got.collect()} == {(1, "x"), (2, "y"), (3, None), (4, "z"), (5, "w")}
    batches = packing.padded_batches(docs, "ids", -1, 3, 8).collect()
    tokens = {}
    for b in batches:
        assert all(len(t) == b.bucket_tokens for t in b.tokens)
        assert len(b.tokens) * b.bucket_tokens <= 8 or len(b.tokens) == 1
        for i, t in zip(b.doc_ids, b.tokens):
            tokens.setdefault(i, []).append([x for x in t if x != -1])
    assert tokens == {1: [[5, 6, 7]], 2: [[]], 3: [[]], 4: [list(range(40))], 5: [[9], [9]]}

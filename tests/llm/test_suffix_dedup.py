import hashlib
import random

import numpy as np
import pytest

from lotlens.llm import queries, suffix_dedup


def brute(rows, length=50):
    """(doc_id, n_bytes, spans, sha) by a table of all windows."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, raw in raws:
        for at in range(len(raw) - length + 1) if i is not None else ():
            w = raw[at : at + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1) if i is not None else ():
            if least[raw[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        spans, at = [], 0
        while at < len(raw):
            end = at
            while end < len(raw) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), tuple(spans), hashlib.sha256(kept).hexdigest(), kept))
    return out


def rows_of(found):
    return sorted((str(r.doc_id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), r.kept_sha256) for r in found.collect())


def want(rows, length=50):
    return sorted((str(w[0]), *w[1:4]) for w in brute(rows, length))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = sorted((i, n, sum(b - a for a, b in s), len(s), sha) for i, n, s, sha, _ in brute(rows))
    assert sorted(tuple(r) for r in queries.op13_suffix_dedup(spark, sf).collect()) == expected
    assert sum(e[2] for e in expected) > 1000


def planted():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, exact, short = prose(30), prose(40).encode()[:50].decode(errors="ignore").ljust(50, "x")[:48], prose(40)[:47]
    while len(exact.encode()) < 50:
        exact += "z"
    exact = exact.encode()[:50].decode(errors="ignore")
    rows = [(i, f"{prose(9)} {shared} {prose(7)}") for i in range(40, 60)]
    rows += [(7, prose(5) + exact + prose(5)), (3, "q" + exact + prose(4)), (9, prose(4) + short + prose(4)), (8, prose(4) + short + prose(4))]
    rows += [(70, "a" * 400), (71, "b" + "a" * 60), (72, "ab" * 100), (73, "ba" * 30), (74, "a" * 49), (75, "a" * 50)]
    rows += [(80, shared), (80, shared), (80, prose(30)), (81, shared), (None, shared), (None, None), (82, None), (83, ""), (84, "é" * 40), (85, "xé" + "é" * 30)]
    rows += [(90, shared[:120] + shared[60:]), (20, "tail " + shared[40:]), (91, "z" * 300 + shared), (92, "y" * 20 + "z" * 300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [None, 1])
def test_planted_and_edges(spark, hot):
    rows = planted()
    docs = spark.createDataFrame([(i, t, 1, "u") for i, t in rows], "doc_id long, text string, ref int, keep string").repartition(4)
    assert rows_of(suffix_dedup.find_repeats(docs, hot_holders=hot)) == want(rows)


def test_other_lengths_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(8)
    long = "".join(rng.choice("abcd ") for _ in range(30_000))
    rows = [(1, long), (2, "new " + long[777:9000] + " end"), (3, long[::-1]), (4, long[100:140])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup.find_repeats(docs)) == want(rows)
    assert rows_of(suffix_dedup.find_repeats(docs, length=30, gram=16)) == want(rows, 30)
    with pytest.raises(ValueError):
        suffix_dedup.find_repeats(docs, length=30, gram=31)


def test_remove_repeats(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, n, "o") for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int, kept string")
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "n", "kept_in", "kept"]
    got = {r.n: bytes(r.kept) for r in out.collect()}
    assert got == {n: w[4] for n, w in enumerate(brute(rows))}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.find_repeats(docs).collect() == []


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(1)
    raws = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 10, 49, 50, 51, 500, 77)]
    text, first, last, anchor = suffix_dedup.runs(raws)
    seen = sorted((t, s) for t, a, b in zip(text.tolist(), first.tolist(), last.tolist()) for s in range(a, b + 1))
    assert seen == [(t, s) for t, raw in enumerate(raws) for s in range(len(raw) - 49)]
    by_window = {}
    for t, a, b, h in zip(text.tolist(), first.tolist(), last.tolist(), anchor.tolist()):
        for s in range(a, b + 1):
            assert by_window.setdefault(raws[t][s : s + 50], h) == h


def test_previous_factors_against_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(30):
        raw = rng.integers(0, 2, 300).astype(np.uint8)
        starts = np.arange(0, 250)
        rank = rng.integers(0, 6, 250)
        found = suffix_dedup.previous_factors(raw, starts, rank, 12)
        strings = [raw[s : s + 12].tobytes() for s in starts]
        least = {}
        for w, r in zip(strings, rank):
            least[w] = min(least.get(w, r), r)
        assert found.tolist() == [least[w] < r for w, r in zip(strings, rank)]

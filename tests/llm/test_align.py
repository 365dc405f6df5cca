import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lotlens.llm import align, bpe, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """(doc_id, text) rows aligned by sets of ends, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    values = {c: x for x, c in bpe.byte_letters().items()}
    found, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text)
        bytes_a = [bytes(values[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        want = (" " + text).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([0, *map(len, bytes_a)])[1:].tolist(), np.cumsum([0, *map(len, bytes_b)])[1:].tolist()
        at = dict(zip(ends_b, ids_b))
        links = [(x, at[e]) for x, e in zip(ids_a, ends_a) if e in at]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for cut in cuts:
            x, y = i, j
            while i < len(ends_a) and ends_a[i] <= cut:
                i += 1
            while j < len(ends_b) and ends_b[j] <= cut:
                j += 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
        counts.update(links)
        found.append((doc_id, len(ids_a), len(ids_b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return sorted(
        (d, na, nb, ng, len(k), sum(counts[p] == highest[p[1]] for p in k), sum(counts[p] for p in k), sha) for d, na, nb, ng, k, sha in found
    )


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op12_alignment(spark, sf).select(COLUMNS).collect())
    assert got == brute(rows)
    assert sum(r[4] for r in got) > 10_000


def test_edges(spark):
    texts = [
        None, "", " ", "a", "  two  spaces\n\ttabs ", "<s>plain</s> <|endoftext|>", "▁lower block", "naïve 🙂 mañana", "x\x00y", "né" * 40_000,
        "same", "same", "  wide", "ﬁ ligature Å", "a" * 200_000, "\n" * 3000, "\U0001f9d1‍\U0001f680",
    ]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(11, "same", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int").repartition(3)
    found = align.align(docs, A, B)
    assert sorted(tuple(r) for r in found.select(COLUMNS).collect()) == brute([r[:2] for r in rows])
    for r in found.collect():
        assert sum(p.times for p in r.pairs) == r.n_links
    assert align.align(docs.limit(0), A, B).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in align.align(nothing, A, B).select(COLUMNS).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_bits():
    rng = np.random.default_rng(5)
    for size in (1, 63, 64, 65, 1000):
        places = np.nonzero(rng.random(size) < 0.3)[0]
        bits = align.Bits.at(places, size)
        assert bits.select().tolist() == places.tolist()
        every = np.arange(size)
        assert bits.rank(every).tolist() == [int((places < p).sum()) for p in every]


def test_pairs_are_bounded_by_the_vocabularies():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        assert 50_000 < align.most_pairs(align.Pair(f.read(), g.read())) < 1_000_000

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from lotlens.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Coder(f.read())


def test_matches_library_on_odd_texts(coder, library):
    rng = random.Random(7)
    letters = [*"aA z'sS\n\t\r\x1c\x1f\x85​　 é²½Ⅷ中文😀ßİ_1२-.,<|>", "<|endoftext|>", "'ll", " the"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["", "a" * 5000, "ab" * 3000, " " * 2000, "<|endoftext|>"]
    for text, ids in zip(texts, coder.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_both_trees_agree(coder):
    words = ["unbelievable", "aaaaaaaaaaaaaaaa", "thththth", "é中"]
    for word in words:
        packed = coder.merge_alike([word.encode()], 64)[0]
        assert list(coder.merge(word)) == list(memoryview(packed).cast("I"))


def test_operator_edges(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, None), (3, "", None), (None, "é" * 3000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, r.ids, r.decoded) for r in bpe.encode(docs, PATH, decode=True).collect()))
    assert [x[2] for x in got] == ["é" * 3000, "Hello world", "Hello world", "", ""]
    assert got[1][1] == library.encode("Hello world").ids and got[3][1] == []
    again = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(r.decoded for r in again) == sorted(x[2] for x in got)
    assert bpe.encode(docs.limit(0), PATH, decode=True).count() == 0


def test_query_matches_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in queries.op8_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_trees_agree_on_random_words(coder):
    rng = random.Random(17)
    for alphabet in ("ab", "the ", "aeiounrst", "é中😀x"):
        words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 64))) for _ in range(120)]
        for word in [w for w in words if len(w.encode()) <= 64]:
            packed = coder.merge_alike([word.encode()], 64)[0]
            assert list(coder.merge(word)) == list(memoryview(packed).cast("I")), word


def test_unknown_ids_and_other_tokenizers(coder):
    assert coder.decode([10**9]) == "" and coder.decode([coder.byte_ids[65], 10**9, coder.byte_ids[66]]) == "AB"
    with pytest.raises(ValueError):
        bpe.Coder('{"model": {"vocab": {}, "merges": []}, "pre_tokenizer": {"type": "Whitespace"}}')

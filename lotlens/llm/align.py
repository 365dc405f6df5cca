"""Cross-tokenizer alignment: packed bitsets of token ends, their AND, rank and select, links and their counts.

Tokenizer A is a byte-level BPE file, B a sentencepiece model; both read one space before the text.
Bit i of a tokenizer's bitset says that a token ends at byte i.  The AND of two bitsets marks the cuts that both
have, and the rank of a cut in either bitset is the token that ends there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Coder
from .common import materialise, small_batches

COUNTED = ("n_a", "n_b", "n_groups", "n_links")
_SPAN = 1 << 32  # an id pair as one number: a * _SPAN + b
_readers: dict[int, "Pair"] = {}


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.below = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        """Ones at ``places`` of ``size`` bits."""
        flags = np.zeros(-(-max(size, 1) // 64) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many ones stand before each of ``places``."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.below[word] + np.bitwise_count(self.words[word] & mask)

    def select(self) -> np.ndarray:
        """The places of all ones."""
        return np.nonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))[0]


class Pair:
    """The two tokenizers, the bytes of their entries and the decimal digits of ids."""

    def __init__(self, definition: str, model: bytes):
        self.a = Coder(definition)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a = [self.a.pieces.get(i, b"") for i in range(max(self.a.pieces) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = (np.array(list(map(len, side)), np.int64) for side in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(side), np.uint8) for side in (self.bytes_a, self.bytes_b))
        self.from_a, self.from_b = (np.cumsum(sizes) - sizes for sizes in (self.size_a, self.size_b))
        self.width = len(str(max(len(self.bytes_a), len(self.bytes_b)))) + 1
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.digits = np.frombuffer("".join(str(i).ljust(self.width) for i in range(most)).encode(), np.uint8).reshape(most, self.width)
        self.long = np.array([len(str(i)) for i in range(most)], np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids under A and B; texts whose joined bytes differ from the text's after a space have none in either."""
        coded_a = self.a.encode_batch([" " + t for t in texts], special=False)
        coded_b = [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)] if texts else []
        wanted = [(b" " + t.encode()) if t else b"" for t in texts]
        told = self._told(coded_a, self.size_a, self.flat_a, self.from_a, wanted) & self._told(coded_b, self.size_b, self.flat_b, self.from_b, wanted)
        for k in np.nonzero(~told | (np.array(list(map(len, wanted)), np.int64) == 0))[0].tolist():
            coded_a[k] = coded_b[k] = np.zeros(0, np.int64)
        return [a.astype(np.int64) for a in coded_a], coded_b

    @staticmethod
    def _told(coded: list[np.ndarray], sizes: np.ndarray, flat: np.ndarray, start: np.ndarray, wanted: list[bytes]) -> np.ndarray:
        """Whether the joined bytes of each text's ids are the wanted ones."""
        ids = np.concatenate([*coded, np.zeros(0, np.int64)]).astype(np.int64)
        size = sizes[ids]
        ends = np.cumsum(size)
        raw = flat[np.repeat(start[ids] - (ends - size), size) + np.arange(int(size.sum()))].tobytes()
        places = np.concatenate([[0], ends])[np.cumsum([0, *(len(c) for c in coded)])].tolist()
        return np.array([raw[a:b] == w for a, b, w in zip(places[:-1], places[1:], wanted)], bool)

    def written(self, ids: np.ndarray, after: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The decimals of ``ids``, each followed by its byte of ``after``, and where each one ends."""
        long = self.long[ids]
        table = self.digits[ids].copy()
        table[np.arange(len(ids)), long] = after
        return table[np.arange(self.width) <= long[:, None]].tobytes(), np.cumsum(long + 1)


def _align(pair: Pair, texts: list[str]) -> dict[str, list | np.ndarray]:
    """Counts, digest and linked id pairs (ascending, with multiplicity) of each text, all texts as one byte string."""
    coded_a, coded_b = pair.encode(texts)
    n_a, n_b = (np.fromiter(map(len, c), np.int64, len(c)) for c in (coded_a, coded_b))
    a, b = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in (coded_a, coded_b))
    size_a, size_b = pair.size_a[a], pair.size_b[b]
    end_a, end_b = np.cumsum(size_a) - 1, np.cumsum(size_b) - 1
    total = int(size_a.sum())
    bits_a, bits_b = Bits.at(end_a[size_a > 0], total), Bits.at(end_b[size_b > 0], total)
    cuts = (bits_a & bits_b).select()  # every text's last byte is among them
    # entries of no bytes end where the one before does: a cut's last token is found among those that have bytes
    solid_a, solid_b = np.nonzero(size_a > 0)[0], np.nonzero(size_b > 0)[0]
    last_a, last_b = solid_a[bits_a.rank(cuts)], solid_b[bits_b.rank(cuts)]
    first_a, first_b = (np.concatenate([[0], x[:-1] + 1]).astype(np.int64) for x in (last_a, last_b))
    texts_a = np.cumsum(n_a)
    held = np.searchsorted(last_a, texts_a - 1, side="right")  # cuts up to each text's end
    held[texts_a == 0] = 0
    start = np.concatenate([[0], held[:-1]]).astype(np.int64)
    # written order: the A tokens of a group, then its B tokens
    group_a = np.repeat(np.arange(len(cuts)), last_a - first_a + 1)
    group_b = np.repeat(np.arange(len(cuts)), last_b - first_b + 1)
    place_a, place_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + last_a[group_b] + 1
    ids, after = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    after[place_a[last_a]], after[place_b[last_b]] = ord("|"), ord(";")
    said, ends = pair.written(ids, after)
    until = np.concatenate([[0], ends])[np.cumsum(n_a + n_b)].tolist()
    shas = ["" if x == y else hashlib.sha256(said[x : y - 1]).hexdigest() for x, y in zip([0, *until[:-1]], until)]
    linked = a[last_a] * _SPAN + b[last_b]
    pairs, times = [], []
    for x, y in zip(start.tolist(), held.tolist()):
        found, count = np.unique(linked[x:y], return_counts=True)
        pairs.append(found)
        times.append(count)
    groups = held - start
    return {"n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": groups, "groups_sha256": shas, "pairs": pairs, "times": times}


def _lists(values: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*values, np.zeros(0, np.int64)]).astype(kind))


def most_pairs(pair: Pair) -> int:
    """How many id pairs can ever be linked: of tokens that end together one's bytes end with the other's."""
    a, b = set(filter(None, pair.bytes_a)), set(filter(None, pair.bytes_b))
    same_a, same_b = ({t: 0 for t in side} for side in (a, b))
    for t in pair.bytes_a:
        if t:
            same_a[t] += 1
    for t in pair.bytes_b:
        if t:
            same_b[t] += 1
    ends = sum(n * sum(same_b.get(t[k:], 0) for k in range(len(t))) for t, n in same_a.items())
    return ends + sum(n * sum(same_a.get(t[k:], 0) for k in range(1, len(t))) for t, n in same_b.items())


def align(docs: DataFrame, byte_bpe_path: str, piece_path: str) -> DataFrame:
    """How the two tokenizers' tokens of every whole ``text`` meet, with corpus-wide counts of the linked id pairs.

    Columns: doc_id, n_a, n_b (tokens), n_groups (runs of tokens between cuts that both have), n_links (pairs of tokens that
    end at the same byte), n_best (links whose count is the highest of their B id, ties included), count_sum (of all links'
    counts; a pair's count is the number of links in the corpus that hold it), groups_sha256 of ``a1,a2|b1;a3|b2,b3``, and
    ``pairs``, the different linked pairs (a, b, times).  Texts that are null, empty, or not given back by one of the tokenizers
    have zeros and an empty digest.  Repeated rows count as often as they occur; an empty table gives no rows; other columns
    are ignored.

    Both files (some MB whatever the data) are broadcast.  So are the pair counts: a pair can be linked only if one token's
    bytes end with the other's, which bounds their number by the vocabularies (``most_pairs``, checked).
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(byte_bpe_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))

    def pair_of() -> Pair:
        key = hash(files.value)
        if key not in _readers:
            _readers[key] = Pair(*files.value)
        return _readers[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of()
        for batch in batches:
            found = _align(pair, [t or "" for t in batch.column("_text").to_pylist()])
            columns = [batch.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in COUNTED), pa.array(found["groups_sha256"], pa.string())]
            columns += [_lists(found["pairs"], np.int64), _lists(found["times"], np.int32)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTED, "groups_sha256", "keys", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in COUNTED)
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    coded = rows.mapInArrow(run, f"doc_id {kind}, {longs}, groups_sha256 string, keys array<long>, times array<int>")
    coded = materialise(coded, "aligned")
    each = coded.select(F.explode(F.arrays_zip("keys", "times")).alias("link"))
    counts = each.groupBy(F.col("link.keys").alias("key")).agg(F.sum("link.times").alias("n")).toArrow()
    if len(counts) > most_pairs(Pair(*files.value)):
        raise RuntimeError("more linked id pairs than the vocabularies allow")
    key, n = counts["key"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    highest = np.zeros(int((key % _SPAN).max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, key % _SPAN, n)
    counted = spark.sparkContext.broadcast((key, n, n == highest[key % _SPAN]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = counted.value
        for batch in batches:
            lists = batch.column("keys")
            flat, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(keys, flat)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times * best[at], times * counts[at])]
            n_best, count_sum = (s[ends] - s[np.concatenate([[0], ends[:-1]])] for s in sums)
            one = np.stack([flat // _SPAN, flat % _SPAN, times], 1)
            pairs = pa.ListArray.from_arrays(
                np.concatenate([[0], ends]).astype(np.int32),
                pa.StructArray.from_arrays([pa.array(one[:, k].astype(np.int32)) for k in range(3)], ["a", "b", "times"]),
            )
            kept = [batch.column(c) for c in ("doc_id", *COUNTED)]
            columns = [*kept, pa.array(n_best), pa.array(count_sum), batch.column("groups_sha256"), pairs]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTED, "n_best", "count_sum", "groups_sha256", "pairs"])

    return coded.mapInArrow(
        count, f"doc_id {kind}, {longs}, n_best long, count_sum long, groups_sha256 string, pairs array<struct<a: int, b: int, times: int>>"
    )

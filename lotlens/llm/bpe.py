"""Byte-level BPE encoding and decoding; merges are chosen by a segment tree over adjacent pair ranks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed value: the pre-tokenising pattern of byte-level tokenizer files.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 400_000
_NONE = 1 << 62
_WIDE = 1 << 21
_coders: dict[str, "Coder"] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Coder:
    """A tokenizer file's vocabulary and merges, ready to encode and decode."""

    def __init__(self, definition: str):
        made = json.loads(definition)
        before = made.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or made.get("normalizer"):
            raise ValueError("only byte-level tokenizer files with the standard pattern and no normaliser are supported")
        vocab, merges = made["model"]["vocab"], made["model"]["merges"]
        letters = byte_letters()
        values = {c: b for b, c in letters.items()}
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        self.pieces = {i: bytes(values[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        pairs = np.array([a * _WIDE + b for a, b in self.ranks], np.int64)
        by_key = np.argsort(pairs)
        found = np.array(list(self.ranks.values()), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = pairs[by_key], found[by_key, 0]
        self.made_by = np.zeros(len(merges), np.int64)
        self.made_by[found[:, 0]] = found[:, 1]
        self.byte_lookup = np.array(self.byte_ids, np.int64)
        self.known: dict[str, bytes] = {}

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word of any length.

        Leaf i of the tree holds rank * width + i of the pair that starts at symbol i, so the root
        is the leftmost pair of lowest rank; a merge changes three leaves.
        """
        ids = [self.byte_ids[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        ranks, width = self.ranks, 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            found = ranks.get((ids[i], ids[i + 1]))
            if found:
                tree[width + i] = found[0] * width + i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                best = a if a < b else b
                if tree[i] == best:
                    break
                tree[i] = best

        def pair(i: int, j: int) -> int:
            found = ranks.get((ids[i], ids[j]))
            return found[0] * width + i if found else _NONE

        while tree[1] != _NONE:
            i = tree[1] % width
            j = after[i]
            ids[i] = ranks[ids[i], ids[j]][1]
            k = after[j]
            after[i] = k
            put(j, _NONE)
            if k < n:
                before[k] = i
            put(i, pair(i, k) if k < n else _NONE)
            h = before[i]
            if h >= 0:
                put(h, pair(h, i))
            ids[j] = -1
        return tuple(x for x in ids if x >= 0)

    def _pair_leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaf values of the pairs (left, right) that start at symbol ``at``; -1 is no symbol."""
        keys = np.where((left < 0) | (right < 0), -1, left * _WIDE + right)
        slot = np.searchsorted(self.pair_keys, keys)
        slot[slot == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[slot] == keys, self.pair_ranks[slot] * width + at, _NONE)

    def merge_alike(self, words: list[bytes], width: int) -> list[bytes]:
        """``merge`` for many words of at most ``width`` bytes at once: one tree per row of a matrix."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(np.arange(width) < sizes[:, None], self.byte_lookup[raw], -1)
        tree = np.full((n, 2 * width), _NONE, np.int64)
        spots = np.broadcast_to(np.arange(width), (n, width))
        tree[:, width:] = self._pair_leaves(ids[:, :width], ids[:, 1:], spots, width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        flat_ids, flat_tree, flat_after, flat_before = ids.ravel(), tree.ravel(), after.ravel(), before.ravel()
        rows = np.nonzero(tree[:, 1] != _NONE)[0]
        while len(rows):
            base, root = rows * (width + 1), tree[rows, 1]
            i = root % width
            j = flat_after[base + i]
            k = np.minimum(flat_after[base + j], width)
            made = self.made_by[root // width]
            flat_ids[base + i], flat_ids[base + j] = made, -1
            flat_after[base + i], flat_before[base + k] = k, i
            h = flat_before[base + i]
            h = np.where(h < 0, i, h)
            trunk = rows * (2 * width)
            flat_tree[trunk + width + j] = _NONE
            flat_tree[trunk + width + i] = self._pair_leaves(made, flat_ids[base + k], i, width)
            first = h == i
            left = np.where(first, made, flat_ids[base + h])
            right = np.where(first, flat_ids[base + k], made)
            flat_tree[trunk + width + h] = self._pair_leaves(left, right, h, width)
            paths = [(x + width) for x in (j, i, h)]
            for _ in range(width.bit_length() - 1):
                paths = [x >> 1 for x in paths]
                for x in paths:
                    below = trunk + 2 * x
                    flat_tree[trunk + x] = np.minimum(flat_tree[below], flat_tree[below + 1])
            rows = rows[tree[rows, 1] != _NONE]
        held = ids >= 0
        ends = np.cumsum(held.sum(1)) * 4
        packed = ids[held].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, words: set[str]) -> None:
        """Add the ids of ``words`` to the known ones, alike words together."""
        groups: dict[int, list[str]] = {}
        for word in words:
            size = len(word.encode())
            groups.setdefault(1 << max(1, (size - 1).bit_length()), []).append(word)
        for width, alike in groups.items():
            if width <= 64:
                for at in range(0, len(alike), 8192):
                    part = alike[at : at + 8192]
                    self.known.update(zip(part, self.merge_alike([w.encode() for w in part], width)))
            else:
                for word in alike:
                    self.known[word] = np.array(self.merge(word), "<u4").tobytes()

    def encode_batch(self, texts: list[str], special: bool = True) -> list[np.ndarray]:
        """Ids of each text; with ``special``, strings of special tokens stand for those tokens."""
        split: list[list[str]] = []
        for text in texts:
            if special and self.split and any(s in text for s in self.special):
                words: list[str] = []
                for part in self.split.split(text):
                    words += [part] if part in self.special else self.words.findall(part)
                split.append(words)
            else:
                split.append(self.words.findall(text))
        wanted = set(chain.from_iterable(split))
        new = wanted - self.known.keys()
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = wanted
        if special:
            self.learn(new - self.special.keys())
            self.known.update({s: np.array([i], "<u4").tobytes() for s, i in self.special.items()})
        else:  # no match of the pattern is such a string as a whole
            self.learn(new)
        found = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4") for words in split]
        for word in [w for w in new if len(w) > 64]:  # long words recur too seldom to keep
            self.known.pop(word, None)
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; an id outside the vocabulary stands for nothing."""
        pieces = self.pieces
        return b"".join([pieces.get(i, b"") for i in ids]).decode("utf-8", "replace")


def _coder(definition: str) -> Coder:
    key = str(hash(definition))
    if key not in _coders:
        _coders[key] = Coder(definition)
    return _coders[key]


def encode(docs: DataFrame, tokenizer_path: str, decode: bool = False) -> DataFrame:
    """``ids`` (array of int) of every whole ``text`` under the tokenizer file, with its doc_id.

    ``decode`` adds ``decoded``, read back from the ids.  The file (a few MB, whatever the data) is
    read once by the driver and broadcast.  Null and empty texts have no ids and decode to the
    empty text; a run of any length is merged in n log n steps; repeated rows are encoded alike; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(definition.value)
        for batch in batches:
            lists = coder.encode_batch([t or "" for t in batch.column("_text").to_pylist()])
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.concatenate([*lists, np.zeros(0, "<u4")]).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(offsets, flat)}
            if decode:
                columns["decoded"] = pa.array([coder.decode(x.tolist()) for x in lists], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    return rows.mapInArrow(run, schema + (", decoded string" if decode else ""))


def decode(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """``rows`` (doc_id, ids) with ``decoded``: the ids' bytes as UTF-8, broken sequences replaced.

    Null ids decode to the empty text.
    """
    spark = rows.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(definition.value)
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "decoded": pa.array(texts, pa.string())}
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")

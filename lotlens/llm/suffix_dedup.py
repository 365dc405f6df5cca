"""Suffix-array deduplication: later copies of byte strings of a least length go, the first one stays.

Windows of ``length`` bytes are the prefixes by which suffixes are ordered.  A window's anchor is its gram of least
hash, so equal windows have equal anchors, and consecutive windows share one.  Runs of windows whose anchor several
texts have meet in buckets; there their suffixes are sorted, and the previous and next smaller documents in that
order give each suffix's longest previous factor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent_limit, join_frequent, materialise, set_aside, small_batches, unpacked, whole_row
from .part_enum import mix

LENGTH = 50
GRAM = 20
PIECE = 1 << 20  # bytes handled at once
BUCKET_ANCHORS = 4_000_000
BUCKET_BYTES = 4 << 20
HELD_ANCHORS = 400_000
HOT_TEXTS = 1000
MOST_HOT = 1_000_000
SEEDS = 20
_U = np.uint64


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of ``raw`` on, as big-endian numbers; zeros follow the end."""
    x = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << _U(8 * step)) | x[step:]
    return x[: len(raw)]


def _grams(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (16 to 24) from each place on."""
    n = len(words) - gram + 1
    return mix(words[:n] ^ mix(words[8 : 8 + n] + mix(words[gram - 8 : gram - 8 + n])))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def runs(raws: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor hash) of the runs of windows that share an anchor.

    The runs of a text cover each of its windows once.  Texts are laid end to end; very long ones are cut.
    """
    out: list[tuple[np.ndarray, ...]] = []
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal part, size
        buffer = np.frombuffer(b"".join([p[2] for p in part]), np.uint8)
        sizes = np.array([len(p[2]) for p in part])
        starts = np.cumsum(sizes) - sizes
        hashes = _grams(_words(buffer), gram)
        keys = (hashes >> _U(24) << _U(24)) | np.arange(len(hashes), dtype=np.uint64)
        place = (_least(keys, length - gram + 1) & _U((1 << 24) - 1)).astype(np.int64)
        inside = np.zeros(len(buffer) + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + sizes - length + 1, -1)
        valid = np.cumsum(inside)[: len(place)] > 0
        before = np.concatenate([[-1], place[:-1]])
        fresh = valid & ((place != before) | ~np.concatenate([[False], valid[:-1]]))
        fresh[starts[starts < len(place)]] = True
        first = np.nonzero(fresh)[0]
        text = np.searchsorted(starts, first, side="right") - 1
        ends = np.minimum(np.concatenate([first[1:], [len(buffer)]]) - 1, starts[text] + sizes[text] - length)
        base = np.array([p[1] for p in part])[text] - starts[text]
        out.append((np.array([p[0] for p in part])[text], first + base, ends + base, hashes[place[first]]))
        part, size = [], 0

    for i, raw in enumerate(raws):
        for at in range(0, len(raw) - length + 1, PIECE):
            piece = raw[at : at + PIECE + length - 1]
            if part and size + len(piece) > 2 * PIECE:
                flush()
            part.append((i, at, piece))
            size += len(piece)
    if part:
        flush()
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*out)) if out else empty


def _smaller_before(rank: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, the common prefix with the nearest one before it in suffix order of smaller rank.

    ``lcp``: common prefix with the suffix right before, at most ``length``.  A place's link always skips
    places of no smaller rank only, so it may jump along the links of others; a place whose common prefix has fallen
    below ``length`` is left there.
    """
    link, common = np.arange(len(rank)) - 1, lcp.copy()
    common[:1] = 0
    open_ = np.nonzero(common >= length)[0]
    while len(open_):
        open_ = open_[rank[link[open_]] >= rank[open_]]
        jump = link[open_]
        link[open_], common[open_] = link[jump], np.minimum(common[open_], common[jump])
        open_ = open_[(common[open_] >= length) & (link[open_] >= 0)]
    return common


def previous_factors(raw: np.ndarray, starts: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the suffix at each of ``starts`` shares ``length`` bytes with a suffix of a smaller rank.

    Suffixes are sorted by their first ``length`` bytes; the longest previous factor is the larger of the
    common prefixes with the previous and the next smaller rank in that order.
    """
    words = _words(raw)
    offsets = sorted({*range(0, length - 7, 8), length - 8})
    columns = [words[starts + o] for o in offsets]
    order = np.lexsort(columns[::-1])
    lcp = np.zeros(len(order), np.int64)
    alike = np.ones(max(len(order) - 1, 0), bool)
    for o, column in zip(offsets, columns):
        ordered = column[order]
        apart = ordered[1:] ^ ordered[:-1]
        now = alike & (apart != 0)
        lcp[1:][now] = o + (63 - np.minimum(np.log2(apart[now].astype(np.float64)), 63).astype(np.int64)) // 8
        alike &= apart == 0
    lcp[1:][alike] = length
    ordered_rank = rank[order]
    back = _smaller_before(ordered_rank, lcp, length)
    ahead = _smaller_before(ordered_rank[::-1], np.concatenate([[0], lcp[1:][::-1]]), length)[::-1]
    found = np.zeros(len(order), bool)
    found[order] = np.maximum(back, ahead) >= length
    return found


def _code(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 more bits) of anchor hashes."""
    return (anchor % _U(buckets)).astype(np.int64), (anchor >> _U(32)).astype(np.uint32)


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("_text").to_pylist()]


def _cut(order_by: np.ndarray) -> tuple[list[int], list[int]]:
    at = np.nonzero(np.diff(order_by, prepend=-1))[0].tolist()
    return at, [*at[1:], len(order_by)]


def _shared(texts: DataFrame, hot: dict[int, int], buckets: int, hot_limit: int, length: int, gram: int) -> DataFrame:
    """(ref, codes): anchors of each text that some other text has too; those of very many texts under a null ref.

    Workers deal packed anchors to buckets.  A bucket's task reads them as a stream and keeps one text and a count
    per different anchor, never an anchor's holders.  ``hot``: texts with most copies, of which one row alone takes part.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs, ids = batch.column("_ref").to_pylist(), batch.column("_id").to_pylist()
            raws, keep = _raws(batch), {}
            for i, ref in enumerate(refs):
                if hot.get(ref, ids[i]) == ids[i]:
                    keep.setdefault(ref, i)
            chosen = list(keep.values())
            text, _, _, anchor = runs([raws[i] for i in chosen], length, gram)
            bucket, code = _code(anchor, buckets)
            order = np.lexsort((text, bucket))
            bucket, code, text = bucket[order], code[order], text[order]
            at, ends = _cut(bucket)
            own = np.array([refs[i] for i in chosen], np.int64)
            who, times = [], []
            for a, b in zip(at, ends):
                t, n = np.unique(text[a:b], return_counts=True)
                who.append(own[t].tobytes())
                times.append(n.astype(np.int32).tobytes())
            columns = [pa.array(bucket[at], pa.int64()), pa.array([code[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(who, pa.binary()), pa.array(times, pa.binary())], names=["bucket", "codes", "refs", "times"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, firsts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        held, told = np.zeros(0, np.int64), np.zeros(0, bool)
        place = None

        def rows(who: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((code, who))
            who, code = who[order], code[order].astype(np.int64) | (place << 32)
            at = np.nonzero(np.concatenate([np.ones(min(1, len(who)), bool), who[1:] != who[:-1]]))[0]
            lists = pa.ListArray.from_arrays(np.append(at, len(who)).astype(np.int32), code)
            return pa.RecordBatch.from_arrays([pa.array(who[at]), lists], names=["ref", "codes"])

        def step(codes: list[bytes], refs: list[bytes], times: list[bytes]) -> pa.RecordBatch:
            nonlocal seen, firsts, held, told
            code = np.frombuffer(b"".join(codes), np.uint32)
            who = np.repeat(np.frombuffer(b"".join(refs), np.int64), np.frombuffer(b"".join(times), np.int32))
            order = np.lexsort((who, code))
            code, who = code[order], who[order]
            once = np.concatenate([[True], (code[1:] != code[:-1]) | (who[1:] != who[:-1])])
            code, who = code[once], who[once]
            new = np.concatenate([[True], code[1:] != code[:-1]])
            group, kinds = np.cumsum(new) - 1, code[new]
            at = np.searchsorted(seen, kinds)
            known = np.zeros(len(kinds), bool)
            known[at < len(seen)] = seen[at[at < len(seen)]] == kinds[at < len(seen)]
            lead = who[new].copy()
            lead[known] = firsts[at[known]]
            other = who != lead[group]
            others = np.bincount(group[other], minlength=len(kinds))
            old_told, old_held = np.zeros(len(kinds), bool), np.ones(len(kinds), np.int64)
            old_told[known], old_held[known] = told[at[known]], held[at[known]]
            first_too = (others > 0) & ~old_told
            told[at[known]], held[at[known]] = (old_told | (others > 0))[known], (old_held + others)[known]
            fresh = ~known
            seen, firsts = np.insert(seen, at[fresh], kinds[fresh]), np.insert(firsts, at[fresh], lead[fresh])
            told, held = np.insert(told, at[fresh], others[fresh] > 0), np.insert(held, at[fresh], 1 + others[fresh])
            return rows(np.concatenate([who[other], lead[first_too]]), np.concatenate([code[other], kinds[first_too]]))

        codes, refs, times, size = [], [], [], 0
        for batch in batches:
            place = batch.column("bucket")[0].as_py() if place is None and batch.num_rows else place
            for kept, name in ((codes, "codes"), (refs, "refs"), (times, "times")):
                kept += batch.column(name).to_pylist()
            size += sum(map(len, codes[-batch.num_rows :])) // 4
            if size >= HELD_ANCHORS:
                yield step(codes, refs, times)
                codes, refs, times, size = [], [], [], 0
        if codes:
            yield step(codes, refs, times)
        often = seen[held > hot_limit].astype(np.int64) | ((place or 0) << 32)
        if len(often):
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([often.tolist()], pa.list_(pa.int64()))], names=["ref", "codes"])

    signed = texts.mapInArrow(sign, "bucket long, codes binary, refs binary, times binary")
    return signed.groupBy("bucket").applyInArrow(meet, "ref long, codes array<long>")


def _chosen(batch: pa.RecordBatch, buckets: int, length: int, gram: int, hot: np.ndarray, of_hot: bool):
    """(texts, row, first, last, code) of the runs whose anchor others have; of very frequent anchors, or of the others."""
    raws = _raws(batch)
    row, first, last, anchor = runs(raws, length, gram)
    bucket, code = _code(anchor, buckets)
    code = code.astype(np.int64) | (bucket << 32)
    lists = batch.column("codes")
    sizes = np.diff(lists.offsets.to_numpy())
    flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, owner))
    flat, starts = flat[order], np.concatenate([[0], np.cumsum(sizes)])
    kept = np.zeros(len(row), bool)
    at, ends = _cut(row)
    for a, b in zip(at, ends):
        own = flat[starts[row[a]] : starts[row[a] + 1]]
        if len(own):
            slot = np.minimum(np.searchsorted(own, code[a:b]), len(own) - 1)
            kept[a:b] = own[slot] == code[a:b]
    if len(hot):
        slot = np.minimum(np.searchsorted(hot, code), len(hot) - 1)
        often = hot[slot] == code
    else:
        often = np.zeros(len(code), bool)
    kept &= often if of_hot else ~often
    return raws, row[kept], first[kept], last[kept], code[kept]


def _found_in_buckets(texts: DataFrame, hot, buckets: int, meeting: int, length: int, gram: int) -> DataFrame:
    """(ref, first, last): runs of windows that some text of a smaller id has, from suffix arrays of shared anchors."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, row, first, last, code = _chosen(batch, buckets, length, gram, hot.value, False)
            bucket = (mix(code.view(np.uint64)) % _U(meeting)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, row, first, last = bucket[order], row[order], first[order], last[order]
            refs, ids = (batch.column(c).to_numpy()[row] for c in ("_ref", "_id"))
            at, ends = _cut(bucket)
            r, f, until = row.tolist(), first.tolist(), (last + length).tolist()
            out: dict[str, list[bytes]] = {c: [] for c in ("bytes", "sizes", "which", "refs", "ids", "firsts")}
            for a, b in zip(at, ends):
                index: dict[bytes, int] = {}  # equal contexts go once
                which = [index.setdefault(raws[r[k]][f[k] : until[k]], len(index)) for k in range(a, b)]
                out["bytes"].append(b"".join(index))
                out["sizes"].append(np.array(list(map(len, index)), np.int32).tobytes())
                out["which"].append(np.array(which, np.int32).tobytes())
                for name, values in (("refs", refs), ("ids", ids), ("firsts", first)):
                    out[name].append(values[a:b].astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), *(pa.array(v, pa.binary()) for v in out.values())], names=["bucket", *out])

    def compare(table: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        parts = []
        for held, sizes, which in zip(*(table[c].to_pylist() for c in ("bytes", "sizes", "which"))):
            ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
            own = [index.setdefault(held[a:b], len(index)) for a, b in zip([0, *ends[:-1]], ends)]
            parts.append(np.array(own, np.int64)[np.frombuffer(which, np.int32)])
        which = np.concatenate(parts)
        refs, ids, firsts = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("refs", "ids", "firsts"))
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        raw, sizes = np.frombuffer(b"".join(index), np.uint8), np.array(list(map(len, index)), np.int64)
        windows = sizes - length + 1
        context = np.repeat(np.arange(len(sizes)), windows)
        inside = np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
        found = previous_factors(raw, (np.cumsum(sizes) - sizes)[context] + inside, least[context], length)
        edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
        new_context = inside == 0
        begin = np.nonzero(found & (new_context | (edge[:-1] == 1)))[0]
        end = np.nonzero(found & (np.concatenate([new_context[1:], [True]]) | (edge[1:] == -1)))[0]
        # the least holder of a context loses what the suffix array found, every later one the whole
        later = ids > least[which]
        runs_of = np.bincount(context[begin], minlength=len(sizes))
        at = np.cumsum(runs_of) - runs_of
        own = np.nonzero(~later)[0]
        holder = np.repeat(own, runs_of[which[own]])
        run = np.arange(len(holder)) - np.repeat(np.cumsum(runs_of[which[own]]) - runs_of[which[own]], runs_of[which[own]]) + at[which[holder]]
        columns = [
            np.concatenate([refs[holder], refs[later]]),
            np.concatenate([firsts[holder] + inside[begin[run]], firsts[later]]),
            np.concatenate([firsts[holder] + inside[end[run]], firsts[later] + windows[which[later]] - 1]),
        ]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("ref", "first", "last"), columns)})

    dealt = texts.mapInArrow(deal, "bucket long, bytes binary, sizes binary, which binary, refs binary, ids binary, firsts binary")
    return dealt.groupBy("bucket").applyInArrow(compare, "ref long, first long, last long")


def _found_by_window(texts: DataFrame, hot, buckets: int, length: int, gram: int) -> DataFrame:
    """The same for the windows of very frequent anchors: each window's least id is combined before the shuffle."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, row, first, last, _ = _chosen(batch, buckets, length, gram, hot.value, True)
            refs, ids = (batch.column(c).to_numpy() for c in ("_ref", "_id"))
            for r in np.unique(row).tolist():
                mine = row == r
                at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[mine].tolist(), last[mine].tolist())])
                raw = raws[r]
                digests = [hashlib.blake2b(raw[a : a + length], digest_size=16).digest() for a in at.tolist()]
                columns = [pa.array(digests, pa.binary()), *(pa.array(np.full(len(at), v[r])) for v in (refs, ids)), pa.array(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["window", "ref", "id", "at"])

    rows = materialise(texts.mapInArrow(windows, "window binary, ref long, id long, at long"), "suffix-windows")
    least = rows.groupBy("window").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    often = least.filter(F.col("n") > frequent_limit(rows.count())).select("window")
    return join_frequent(rows, least.drop("n"), "window", often).filter("id > least").select("ref", F.col("at").alias("first"), F.col("at").alias("last"))


def _merge(firsts: np.ndarray, lasts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows first..last."""
    order = np.argsort(firsts, kind="stable")
    a, b = firsts[order], np.maximum.accumulate(lasts[order] + length)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    at = np.nonzero(new)[0]
    return list(zip(a[at].tolist(), b[np.concatenate([at[1:], [len(a)]]) - 1].tolist()))


def _named(docs: DataFrame) -> DataFrame:
    """_id, _text, _ref and _sha of every row; different texts have different refs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(text, 256)
    for seed in range(SEEDS):
        ref = F.xxhash64(text) if not seed else F.xxhash64(F.lit(seed), text)
        kinds = docs.select(ref.alias("_ref"), sha.alias("_sha")).distinct()
        if kinds.groupBy("_ref").count().filter("count > 1").isEmpty():
            return docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_text"), ref.alias("_ref"), sha.alias("_sha"))
    raise RuntimeError("texts share hashes under every seed")


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_holders: int | None = None) -> DataFrame:
    """Bytes of each text that a string of ``length`` bytes covers which also starts in a text of a smaller doc_id.

    Columns: doc_id, n_bytes, spans (array of start, end in UTF-8 bytes: maximal runs to remove), kept_sha256 (of the remaining
    bytes).  Strings are judged on the input and never cross texts.  Null and empty texts have no bytes; a row without an id neither
    loses bytes nor makes others lose any; rows with one id never take from each other; of equal texts the least id is
    judged against other texts, and the others lose all, if they have ``length`` bytes.  Ids are integers.  An empty
    table gives no rows; other columns are ignored.  ``gram``: bytes of an anchor, 16 to 24, at most ``length``.

    No task holds an anchor's holders beyond ``hot_holders`` (those that fill a bucket, or a millionth of all anchors): the
    windows of more frequent ones are counted one by one.
    """
    if not 16 <= gram <= min(24, length):
        raise ValueError("an anchor has 16 to 24 bytes, and no more than the least length")
    spark = docs.sparkSession
    small_batches(spark)
    named = _named(docs)
    known = named.filter(F.col("_id").isNotNull())
    classes = materialise(
        known.groupBy("_ref").agg(F.min("_id").alias("keep"), F.count("*").alias("copies"), F.max(F.octet_length("_text")).alias("bytes")), "suffix-classes"
    )
    size = classes.agg(F.sum("bytes").alias("bytes"), F.sum("copies").alias("rows")).first()
    anchors = (size["bytes"] or 0) * 2 // (length - gram + 2)
    buckets = max(64, anchors // BUCKET_ANCHORS)
    met = (length - gram + 2 + 2 * length) // 2  # bytes of the windows that share an anchor
    hot_limit = max(hot_holders or BUCKET_BYTES // met, anchors // MOST_HOT)
    many = {r["_ref"]: r["keep"] for r in classes.filter("copies > 1").orderBy(F.desc("copies"), "_ref").limit(HOT_TEXTS).collect()}
    shared = materialise(_shared(known.select("_ref", "_id", "_text"), many, buckets, hot_limit, length, gram), "suffix-shared")
    often = sorted(c for r in shared.filter("ref is null").collect() for c in r["codes"])  # at most MOST_HOT
    hot = spark.sparkContext.broadcast(np.array(often, np.int64))
    codes = shared.filter("ref is not null").groupBy("ref").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))
    wanted = codes.join(classes.select("_ref", "keep"), F.col("ref") == F.col("_ref")).select("ref", "keep", "codes")
    one = known.groupBy("_ref", "_id").agg(F.first("_text").alias("_text"))
    texts = one.join(wanted, (F.col("_ref") == F.col("ref")) & (F.col("_id") == F.col("keep"))).select("_ref", "_id", "_text", "codes")
    held = shared.filter("ref is not null").agg(F.sum(F.size("codes"))).first()[0] or 0
    meeting = max(64, held * met // BUCKET_BYTES)
    found = _found_in_buckets(texts, hot, buckets, meeting, length, gram)
    if often:
        found = found.unionByName(_found_by_window(texts, hot, buckets, length, gram))
    found = materialise(found, "suffix-found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, shas = [], []
            for raw, firsts, lasts in zip(_raws(batch), batch.column("firsts"), batch.column("lasts")):
                merged = _merge(firsts.values.to_numpy(), lasts.values.to_numpy(), length)
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                spans.append([{"start": a, "end": b} for a, b in merged])
                shas.append(digest.hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("_ref"), pa.array(spans, kind), pa.array(shas, pa.string())], names=["ref", "spans", "sha"])

    gone = found.groupBy("ref").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    gone = gone.join(classes.select("_ref", "keep"), F.col("ref") == F.col("_ref")).drop("_ref")
    losing = one.join(gone, (F.col("_ref") == F.col("ref")) & (F.col("_id") == F.col("keep"))).select("_ref", "_text", "firsts", "lasts")
    spans = losing.mapInArrow(cut, "ref long, spans array<struct<start: long, end: long>>, sha string")
    spans = materialise(spans, "suffix-spans")
    info = classes.join(spans, F.col("_ref") == F.col("ref"), "left").select("_ref", "keep", "spans", "sha")
    frequent = classes.filter(F.col("copies") > frequent_limit(size["rows"] or 0)).select("_ref")
    rows = named.select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), "_ref", "_sha")
    later = (F.col("_id") > F.col("keep")) & (F.col("n_bytes") >= length)
    lost = F.col("sha").isNotNull() & (F.col("_id") == F.col("keep"))
    span = "array<struct<start: bigint, end: bigint>>"
    return join_frequent(rows, info, "_ref", frequent, "left").select(
        F.col("_id").alias("doc_id"),
        "n_bytes",
        F.when(later, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))))
        .when(lost, F.col("spans"))
        .otherwise(F.expr(f"cast(array() AS {span})"))
        .alias("spans"),
        F.when(later, F.sha2(F.lit(""), 256)).when(lost, F.col("sha")).otherwise(F.col("_sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``kept``, the bytes that remain of each text; other columns unchanged (one named ``kept`` is set aside)."""
    found = find_repeats(docs, length, gram).groupBy("doc_id", "n_bytes", "kept_sha256").agg(F.first("spans").alias("spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_text"), whole_row(docs))
    parts = F.expr(
        "transform(sequence(0, size(spans)), k -> struct(if(k = 0, 0, spans[k - 1].end) AS a, if(k = size(spans), n_bytes, spans[k].start) AS b))"
    )
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.octet_length("_text") == F.col("n_bytes")))
    kept = F.expr("to_binary(array_join(transform(_parts, p -> hex(substring(encode(_text, 'UTF-8'), int(p.a) + 1, int(p.b - p.a)))), ''), 'hex')")
    cut = joined.withColumn("_parts", parts).withColumn("_kept", kept).filter(F.sha2("_kept", 256) == F.col("kept_sha256"))
    return cut.select(*unpacked(docs, ["kept"]), F.col("_kept").alias("kept"))

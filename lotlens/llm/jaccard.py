"""N-gram Jaccard join: PartEnum signatures find candidates, blocks of sets settle them.

Sets are compared as sorted 64-bit hashes of their shingles: within one pair of sets two different
shingles would have to share a hash for a count to be off by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import part_enum
from .common import frequent_limit, join_frequent, materialise, number_rows, small_batches, whole_row
from .components import connected

BLOCK_ELEMENTS = 131_072
BLOCK_SETS = 1024
TILE_BLOCKS = 8
BUCKET_BLOCKS = 32  # blocks, or small clusters, that one task takes at a time
BUCKET_SIGNATURES = 1_000_000
HELD_SIGNATURES = 200_000
HOT_SETS = 1000
BUILT_BYTES = 8 << 20
HELD_MEMBERS = 100_000
SHORT = 5  # bytes of a signature beside its bucket: two that agree in these by chance give candidates, which are checked
TILE = 1024  # holders of a signature whose sketches one task compares with as many others at a time
HELD_ROWS = 2_000_000  # members of signatures that a bucket keeps to tell equal groups
SHIPPED = 2  # times that a set is shipped for each signature: packed, then met
SPLIT_FROM = 1.0  # a component is split where comparing it whole costs this many times as much


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))


def _measure(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a key that equal sets share (null without shingles) and a sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = part_enum.shingle_sets(batch.column("_text").to_pylist(), words)
            keys = [part_enum.set_key(s) if len(s) else None for s in sets]
            sizes, sketches = [len(s) for s in sets], part_enum.sketches(sets)
            columns = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names=["doc_id", "n_shingles", "set_key", "sketch"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def _candidates(docs: DataFrame, hot: dict[bytes, int], buckets: int, least: int, words: int) -> DataFrame:
    """(signature, u, v): each document u with one v that shares the signature, v the same for all of them.

    Holders of a signature are cut where their sizes rule out links (``part_enum.cut_by_size``), and those left alone go.

    Workers deal packed arrays of signatures to ``buckets`` by the signature's value, so a shuffled
    row holds many.  A bucket's task reads them as a stream and keeps one document per different
    signature, never the members of a frequent one.  Rows out are one per member but the first, never pairs.
    Near copies share most signatures: signatures of the same documents become one, named by a hash of
    those (two groups under one name are one larger group, which loses no link).  A bucket with more
    than HELD_ROWS members of shared signatures gives them uncut under their own names.
    ``hot`` maps the keys of the most frequent sets to their representatives, which alone sign.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            sets = part_enum.shingle_sets(batch.column("_text").to_pylist(), words)
            keep: dict[bytes, int] = {}
            for i, s in enumerate(sets):
                if ids[i] is not None and len(s):
                    key = part_enum.set_key(s)
                    if hot.get(key, ids[i]) == ids[i]:
                        keep.setdefault(key, i)
            chosen = list(keep.values())
            owner, signature, side = part_enum.sided_signatures([sets[i] for i in chosen], least)
            who = np.array([ids[i] for i in chosen], np.int64)[owner]
            size = np.array([len(sets[i]) for i in chosen], np.int64)[owner] * 4 + side
            bucket = (signature % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((size, who, bucket))
            bucket, signature, who, size = bucket[order], signature[order], who[order], size[order]
            at = np.nonzero(np.diff(bucket, prepend=-1))[0].tolist()
            ends = [*at[1:], len(bucket)]
            ids_, sizes, times = [], [], []
            for a, b in zip(at, ends):
                new = np.nonzero(np.concatenate([[True], (who[a + 1 : b] != who[a : b - 1]) | (size[a + 1 : b] != size[a : b - 1])]))[0]
                ids_.append(who[a:b][new].tobytes())
                sizes.append(size[a:b][new].astype(np.int32).tobytes())
                times.append(np.diff(new, append=b - a).astype(np.int32).tobytes())
            short = np.ascontiguousarray((signature >> np.uint64(64 - 8 * SHORT)).view(np.uint8).reshape(-1, 8)[:, :SHORT])
            columns = [[short[a:b].tobytes() for a, b in zip(at, ends)], ids_, sizes, times]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[at], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "signatures", "ids", "sizes", "times"]
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, firsts, widths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.uint64(0)
        held: list[np.ndarray] = []
        large = False

        def step(signatures: list[bytes], ids: list[bytes], sizes: list[bytes], times: list[bytes]) -> np.ndarray:
            """(signature, u, v, size of u) as rows of an array, for all holders of a signature but its first."""
            nonlocal seen, firsts, widths
            short = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, SHORT)
            signature = np.zeros((len(short), 8), np.uint8)
            signature[:, :SHORT] = short
            signature = signature.view(np.uint64)[:, 0]
            repeats = np.frombuffer(b"".join(times), np.int32)
            who = np.repeat(np.frombuffer(b"".join(ids), np.int64), repeats)
            size = np.repeat(np.frombuffer(b"".join(sizes), np.int32), repeats)
            order = np.lexsort((size, who, signature))
            signature, who, size = signature[order], who[order], size[order].astype(np.int64)
            once = np.concatenate([[True], (signature[1:] != signature[:-1]) | (who[1:] != who[:-1]) | (size[1:] != size[:-1])])
            signature, who, size = signature[once], who[once], size[once]
            new = np.concatenate([[True], signature[1:] != signature[:-1]])
            kinds = signature[new]
            at = np.searchsorted(seen, kinds)
            known = np.zeros(len(kinds), bool)
            inside = at < len(seen)
            known[inside] = seen[at[inside]] == kinds[inside]
            lead, width = who[new], size[new]
            lead[known], width[known] = firsts[at[known]], widths[at[known]]
            of = np.cumsum(new) - 1
            other = (who != lead[of]) | (size != width[of])
            fresh = ~known
            seen, firsts = np.insert(seen, at[fresh], kinds[fresh]), np.insert(firsts, at[fresh], lead[fresh])
            widths = np.insert(widths, at[fresh], width[fresh])
            return np.stack([signature[other].view(np.int64), who[other], lead[of][other], size[other]])

        def batch_of(name: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((v, u, name))
            rows = np.stack([name[order], u[order], v[order]])
            once = np.concatenate([np.ones(min(1, len(u)), bool), (np.diff(rows, axis=1) != 0).any(0)])
            return pa.RecordBatch.from_arrays([pa.array(r[once], pa.int64()) for r in rows], names=["signature", "u", "v"])

        def named(rows: np.ndarray) -> pa.RecordBatch:
            """Rows of a part of the bucket, under names of their signatures' own."""
            signature, u, v, _ = rows[:, rows[1] != rows[2]]
            order = np.argsort(signature, kind="stable")
            signature, u, v = signature[order], u[order], v[order]
            at = np.nonzero(np.concatenate([np.ones(min(1, len(u)), bool), signature[1:] != signature[:-1]]))[0]
            if len(at):  # the least member leads
                lead = np.repeat(np.minimum(np.minimum.reduceat(u, at), v[at]), np.diff([*at.tolist(), len(u)]))
                u, v = np.where(u == lead, v, u), lead
            return batch_of(part_enum.mix(part_enum.mix(signature.view(np.uint64)) + place).view(np.int64), u, v)

        def grouped(rows: np.ndarray) -> pa.RecordBatch:
            """Rows of the whole bucket, cut by size, under names of their groups."""
            kinds = np.unique(rows[0].view(np.uint64))
            at = np.searchsorted(seen, kinds)
            size = np.concatenate([rows[3], widths[at]])
            order, group = part_enum.cut_by_size(np.concatenate([rows[0].view(np.uint64), kinds]), size >> 2, size & 3, least)
            who = np.concatenate([rows[1], firsts[at]])[order]
            order = np.lexsort((who, group))
            group, who = group[order], who[order]
            once = np.concatenate([np.ones(min(1, len(who)), bool), (group[1:] != group[:-1]) | (who[1:] != who[:-1])])
            group, who = group[once], who[once]
            new = np.concatenate([np.ones(min(1, len(who)), bool), group[1:] != group[:-1]])
            if not new.any():
                return batch_of(*(np.zeros(0, np.int64) for _ in range(3)))
            at, of = np.nonzero(new)[0], np.cumsum(new) - 1
            name = part_enum.mix(np.add.reduceat(part_enum.mix(who.view(np.uint64)), at)).view(np.int64)
            return batch_of(name[of][~new], who[~new], who[at][of][~new])  # the least member leads

        lists: tuple[list[bytes], ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            if batch.num_rows:
                place = np.uint64(batch.column("bucket")[0].as_py() + 1)
            for kept, name in zip(lists, ("signatures", "ids", "sizes", "times")):
                kept += batch.column(name).to_pylist()
            size += sum(map(len, lists[0][-batch.num_rows :])) // SHORT
            if size >= HELD_SIGNATURES:
                held.append(step(*lists))
                lists, size = ([], [], [], []), 0
                if large or sum(r.shape[1] for r in held) > HELD_ROWS:
                    large = True
                    yield named(np.concatenate(held, 1))
                    held = []
        if lists[0]:
            held.append(step(*lists))
        if held:
            yield (named if large else grouped)(np.concatenate(held, 1))

    signed = _rows(docs).mapInArrow(sign, "bucket long, signatures binary, ids binary, sizes binary, times binary")
    return signed.groupBy("bucket").applyInArrow(meet, "signature long, u long, v long")


def _plausible(candidates: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """``candidates`` with those pairs of documents only that sketches do not rule out, through any holder.

    ``sets``: doc_id, n_shingles and sketch, one row per id (no sketch: nothing is ruled out).  Each pair (u, v) is judged
    once.  Members that this rules out, in a signature of three or more, are compared with all holders of the
    signature, TILE by TILE; ``v`` is then the least document that they reach there.  No linked pair is ruled out.
    """
    # hints: the same plan at every size, so that what small tables shuffle tells what large ones will
    side = lambda s: sets.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}")).hint("shuffle_hash")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(c).to_pylist() if c[0] == "s" else batch.column(c).to_numpy() for c in ("s_u", "n_u", "s_v", "n_v")]
            near = part_enum.pairs_may_link(*held, least)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(near)], names=["u", "v", "near"])

    pairs = materialise(candidates.select("u", "v").distinct(), "pairs")
    hot = pairs.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > frequent_limit(pairs.count())).select("v")
    both = join_frequent(pairs.join(side("u"), "u"), side("v"), "v", hot).select("u", "v", "n_u", "n_v", "s_u", "s_v")
    judged = both.mapInArrow(judge, "u long, v long, near boolean")
    rows = materialise(candidates.join(judged.hint("shuffle_hash"), ["u", "v"]), "judged")
    holders = rows.groupBy("signature").agg(
        F.count("*").alias("held"), F.count_if(~F.col("near")).alias("far"), F.min("v").alias("first")
    )
    open_ = materialise(holders.filter("far > 0 and held > 1").withColumn("tiles", F.expr(f"held div {TILE} + 1")), "open")
    members = rows.join(open_.select("signature").hint("shuffle_hash"), "signature", "left_semi").select("signature", F.col("u").alias("doc_id"))
    members = members.unionByName(open_.select("signature", F.col("first").alias("doc_id"))).distinct()
    numbered = number_rows(members, [F.col("doc_id")], {"_before": F.lit(1)}, ["signature"], "holders").withColumn("tile", F.expr(f"_before div {TILE}"))
    met = numbered.join(open_.select("signature", "tiles").hint("shuffle_hash"), "signature").withColumn("_other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    met = met.select("signature", "doc_id", F.least("tile", "_other").alias("a"), F.greatest("tile", "_other").alias("b"))
    total = open_.agg(F.sum(F.expr("(held + 1) * tiles"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("signature", "a", "b"), F.lit(max(1, total // HELD_MEMBERS + 1)))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("signature", "a", "b", "doc_id")])
        signature, a_, b_, ids, sizes = (table[c].to_numpy() for c in ("signature", "a", "b", "doc_id", "n_shingles"))
        sketch = table["sketch"].to_pylist()
        cuts = (np.nonzero((np.diff(signature) != 0) | (np.diff(a_) != 0) | (np.diff(b_) != 0))[0] + 1).tolist()
        found = []
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            label = np.arange(b - a)
            links = part_enum.may_link(sketch[a:b], sizes[a:b], sketch[a:b], sizes[a:b], least)
            while True:  # the least holder that each reaches
                after = np.minimum(label, np.where(links, label, b - a).min(1))
                after = after[after]
                if (after == label).all():
                    break
                label = after
            other = np.nonzero(label != np.arange(b - a))[0]
            found.append(np.stack([signature[a + other], ids[a + other], ids[a + label[other]]], 1))
        rows = np.concatenate([*found, np.zeros((0, 3), np.int64)])
        return pa.table({c: pa.array(rows[:, k], pa.int64()) for k, c in enumerate(("signature", "u", "v"))})

    told = met.join(sets.hint("shuffle_hash"), "doc_id").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(compare, "signature long, u long, v long")
    kept = rows.filter("near").join(open_.select("signature").hint("shuffle_hash"), "signature", "left_anti")
    return kept.select("signature", "u", "v").unionByName(told)


def _clusters(candidates: DataFrame, copies: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """doc_id, n_shingles, copies, set_key and ``cluster``: linked sets share a cluster at least.

    A cluster is a whole component of candidates, or the holders of one signature.  A whole component
    ships each block of sets once for each block of like sizes; by signature it ships each set
    some times for each shared signature.  It is taken the second way where that ships and
    compares less (unlike texts that common passages chain together), else whole (copies of one
    text, which share most signatures).  So the work stays within that for the pairs that share a
    signature, and a set has at most as many rows as it has signatures.
    """
    labels = connected(candidates.select("u", "v").unionByName(copies))
    sets = classes.join(labels, F.col("rep") == F.col("node")).select(
        F.col("rep").alias("doc_id"), "n_shingles", "copies", "set_key", "label"
    )
    sets = materialise(sets, "sets")
    whole = sets.withColumnRenamed("label", "cluster")
    weight = F.greatest(F.col("n_shingles"), F.lit(BLOCK_ELEMENTS // BLOCK_SETS))
    band = F.floor(F.log(weight.cast("double")) / math.log(100 / least)).alias("band")
    banded = sets.groupBy("label", band).agg(F.count("*").cast("double").alias("n"), F.sum(weight).alias("w"))
    after = F.coalesce(F.lead("w").over(Window.partitionBy("label").orderBy("band")), F.lit(0))
    met = F.col("w") + (F.col("w") * F.col("w") + 2 * F.col("w") * after) / (BLOCK_ELEMENTS * TILE_BLOCKS)  # a band meets itself and the next
    large = (
        banded.withColumn("met", met)
        .groupBy("label")
        .agg(F.sum("n").alias("n"), F.sum("w").cast("double").alias("w"), F.sum("met").alias("met"))
        .filter(F.col("w") > BLOCK_ELEMENTS)
    )
    if large.isEmpty():
        return whole
    holders = candidates.groupBy("signature").agg((F.count("*") + 1).cast("double").alias("m"), F.min("u").alias("one"))
    cost = (
        holders.join(labels, F.col("one") == F.col("node"))
        .groupBy("label")
        .agg(F.sum("m").alias("held"), F.sum(F.col("m") * F.col("m")).alias("pairs"))
    )
    both = large.join(cost, "label").filter(f"n * n > {SPLIT_FROM} * pairs and met > {SPLIT_FROM} * {SHIPPED} * held * w / n")
    sparse = materialise(both.select("label"), "sparse")
    if sparse.isEmpty():
        return whole
    ends = candidates.select("signature", F.col("u").alias("id")).unionByName(candidates.select("signature", F.col("v").alias("id")))
    named = copies.groupBy(F.col("u").alias("id")).agg(F.collect_set("v").alias("reps"))
    members = (
        ends.distinct()
        .join(named, "id", "left")
        .select("signature", F.explode(F.coalesce("reps", F.array("id"))).alias("rep"))
        .distinct()
    )
    split = sets.join(sparse, "label", "left_semi").join(members, F.col("doc_id") == F.col("rep")).select(
        "doc_id", "n_shingles", "copies", "set_key", F.col("signature").alias("cluster")
    )
    return whole.join(sparse.withColumnRenamed("label", "cluster"), "cluster", "left_anti").select(split.columns).unionByName(split)


_PACKED = ("ids", "sizes", "weights", "elements", "spread", "clusters")


class _Block:
    """The sets of a packed block: ids, weights, elements, and the clusters that each set is in."""

    def __init__(self, packed: dict[str, bytes]):
        whole = {c: np.frombuffer(packed[c], np.uint64 if c == "elements" else np.int64) for c in _PACKED}
        self.ids, self.weights = whole["ids"], whole["weights"]
        self.sets = np.split(whole["elements"], np.cumsum(whole["sizes"])[:-1])
        self.clusters = np.split(whole["clusters"], np.cumsum(whole["spread"])[:-1])
        self.low, self.high = int(whole["sizes"].min()), int(whole["sizes"].max())

    def before(self, cluster: int) -> list[np.ndarray]:
        return [c[c < cluster] for c in self.clusters]


def _compare(a: _Block, b: _Block, cluster: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, links): each linked set of two blocks, its least mate in them and its links' weight.

    A pair of sets that shares several clusters counts in the first of them alone.
    """
    same = a is b
    common = part_enum.common_counts(a.sets, b.sets)
    union = np.array([len(s) for s in a.sets])[:, None] + np.array([len(s) for s in b.sets]) - common
    link = 100 * common >= least * union
    if max(map(len, a.clusters)) > 1 and max(map(len, b.clusters)) > 1 and link.any():
        link &= part_enum.common_counts(a.before(cluster), b.before(cluster)) == 0
    if same:
        np.fill_diagonal(link, False)
        near, nodes, weight = link, a.ids, a.weights
    else:
        none_a, none_b = (np.zeros((len(x.ids), len(x.ids)), bool) for x in (a, b))
        near = np.block([[none_a, link], [link.T, none_b]])
        nodes, weight = np.concatenate([a.ids, b.ids]), np.concatenate([a.weights, b.weights])
    links = near.astype(np.float64) @ weight
    label = np.arange(len(nodes))
    while True:  # the least index that each node reaches inside this pair of blocks
        after = np.minimum(label, np.where(near, label, len(nodes)).min(1, initial=len(nodes)))
        after = after[after]
        if (after == label).all():
            break
        label = after
    found = np.nonzero(near.any(1))[0]
    return nodes[found], nodes[label[found]], links[found].astype(np.int64)


def _tile_compare(least: int):
    """Compares the blocks of the tiles of a bucket, block against block, where their sizes allow a link."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("cluster", "tile_a", "tile_b", "block")])
        where = np.stack([table[c].to_numpy() for c in ("cluster", "tile_a", "tile_b")])
        cuts = (np.nonzero((np.diff(where, axis=1) != 0).any(0))[0] + 1).tolist()
        packed = {c: table[c].combine_chunks() for c in ("block", *_PACKED)}
        found = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        for start, end in zip([0, *cuts], [*cuts, table.num_rows]):
            cluster, tile_a, tile_b = where[:, start].tolist()
            blocks = []
            for row in range(start, end):
                at = packed["block"][row].as_py()
                blocks.append((at, _Block({c: packed[c][row].as_py() for c in _PACKED})))
            for i, (at_a, a) in enumerate(blocks):
                for at_b, b in blocks[i:]:
                    if at_a // TILE_BLOCKS == tile_a and at_b // TILE_BLOCKS == tile_b and 100 * a.high >= least * b.low:
                        found.append(_compare(a, b, cluster, least))
        return pa.table({n: pa.array(np.concatenate([f[k] for f in found])) for k, n in enumerate(("u", "v", "links"))})

    return run


def _verify(docs: DataFrame, members: DataFrame, least: int, words: int) -> DataFrame:
    """(u, v, links) from comparing all sets of each cluster, block against block.

    ``members``: doc_id, n_shingles, copies, set_key, cluster; one row per different set and cluster.
    Sets of a cluster are ordered by size and cut into blocks of bounded size; only blocks whose sizes
    allow a link meet.  A tile is TILE_BLOCKS blocks against as many others, so a block is shipped once for
    each tile of its cluster.  A pair of blocks gives at most one row per set that has a link.
    """
    weight = F.greatest(F.col("n_shingles"), F.lit(BLOCK_ELEMENTS // BLOCK_SETS))
    order = [F.col("n_shingles"), F.col("doc_id")]
    placed = number_rows(members, order, {"_before": weight}, ["cluster"], "members")
    placed = materialise(placed.withColumn("block", F.expr(f"_before div {BLOCK_ELEMENTS}")), "blocks")
    stats = placed.groupBy("cluster", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    a, b = (stats.select(F.col("cluster"), *(F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high"))) for s in "ab")
    pairs = a.join(b, "cluster").filter(f"block_a <= block_b and 100 * high_a >= {least} * low_b")
    pairs = pairs.select("cluster", "block_a", "block_b")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cluster", "block", "id", "copies", "elements", "clusters"]
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)

        for batch in batches:
            sets = part_enum.shingle_sets(batch.column("_text").to_pylist(), words)
            columns = [batch.column(c).to_pylist() for c in ("_id", "copies", "set_key", "places")]
            rows, size = [], 0
            for elements, i, copies, key, places in zip(sets, *columns):
                if len(elements) and key == part_enum.set_key(elements):
                    inside = np.unique(np.array([p["cluster"] for p in places], np.int64)).tobytes()
                    for p in places:
                        rows.append((p["cluster"], p["block"], i, copies, elements.tobytes(), inside))
                        size += elements.nbytes + len(inside)
                        if size > BUILT_BYTES:
                            yield packed(rows)
                            rows, size = [], 0
            yield packed(rows)

    def gather(table: pa.Table) -> pa.Table:
        once = {(i, e): n for n, (i, e) in enumerate(zip(table["id"].to_pylist(), table["elements"].to_pylist()))}
        table = table.take(list(once.values()))  # repeated rows are one set
        elements, clusters = table["elements"].to_pylist(), table["clusters"].to_pylist()
        packed = {
            "ids": np.array(table["id"].to_pylist(), np.int64).tobytes(),
            "sizes": np.array([len(e) // 8 for e in elements], np.int64).tobytes(),
            "weights": np.array(table["copies"].to_pylist(), np.int64).tobytes(),
            "elements": b"".join(elements),
            "spread": np.array([len(c) // 8 for c in clusters], np.int64).tobytes(),
            "clusters": b"".join(clusters),
        }
        where = {"cluster": table["cluster"][:1], "block": table["block"][:1]}
        schema = pa.schema([*((c, pa.int64()) for c in where), *((c, pa.binary()) for c in _PACKED)])
        return pa.table(where | {c: [packed[c]] for c in _PACKED}, schema=schema)

    at = placed.groupBy(F.col("doc_id").alias("_member"), "set_key", "copies").agg(
        F.collect_list(F.struct("cluster", "block")).alias("places")  # as many as the set has signatures at most
    )
    texts = _rows(docs).join(at.hint("shuffle_hash"), F.col("_id") == F.col("_member"))  # one plan at every size, see _plausible
    columns = ", ".join(f"{c} binary" for c in _PACKED)
    packed = (
        texts.mapInArrow(build, "cluster long, block long, id long, copies long, elements binary, clusters binary")
        .groupBy("cluster", "block")
        .applyInArrow(gather, f"cluster long, block long, {columns}")
    )
    packed = materialise(packed, "packed")
    tile = lambda c: F.expr(f"{c} div {TILE_BLOCKS}")
    tiles = pairs.select("cluster", tile("block_a").alias("tile_a"), tile("block_b").alias("tile_b"), F.explode(F.array("block_a", "block_b")).alias("block"))
    wanted = materialise(tiles.distinct(), "tiles")
    bucket = F.pmod(F.xxhash64("cluster", "tile_a", "tile_b"), F.lit(wanted.count() // BUCKET_BLOCKS + 1))
    met = wanted.join(packed, ["cluster", "block"]).withColumn("bucket", bucket)
    return met.groupBy("bucket").applyInArrow(_tile_compare(least), "u long, v long, links long")


def group_similar(docs: DataFrame, least: int = part_enum.LEAST, words: int = part_enum.WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of ``docs``.

    Two documents link when 100 * intersection >= ``least`` * union of their sets of shingles
    of ``words`` words; component_id is the least id reachable by links, n_links the number of linked
    documents.  Equal sets are one set with that many copies; no pair of documents is ever a row.
    Texts without words have an empty set and link with nothing.  Ids are integers; rows with the
    same id and set count as copies, and other rows with the same id share a component; a null id
    has no component and no links.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    measured = materialise(_measure(docs, words), "measured")
    known = measured.filter("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles")
    )
    classes = materialise(classes, "classes")
    hot = {bytes(r["set_key"]): r["rep"] for r in classes.filter("copies > 1").orderBy(F.desc("copies"), "set_key").limit(HOT_SETS).collect()}
    size = known.agg(F.sum("n_shingles").alias("shingles"), F.count("*").alias("rows")).first()
    buckets = max(64, (size["shingles"] or 0) * 5 * (100 - least) // (100 + least) // BUCKET_SIGNATURES)
    frequent = classes.filter(F.col("copies") > frequent_limit(size["rows"])).select("set_key")
    copied = classes.filter("copies > 1").select("set_key", "rep")
    copies = join_frequent(known, copied, "set_key", frequent).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    copies = materialise(copies.filter("u <> v").distinct(), "copies")
    candidates = materialise(_candidates(docs, hot, buckets, least, words).distinct(), "candidates")
    texts = known.groupBy("doc_id").agg(F.min("set_key").alias("_least"), F.max("set_key").alias("_most"))
    several = F.col("_least") != F.col("_most")  # an id of several texts has no sketch of its own
    sketched = known.groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    sketched = sketched.join(texts, "doc_id").select("doc_id", "n_shingles", F.when(~several, F.col("sketch")).alias("sketch"))
    candidates = materialise(_plausible(candidates, sketched, least), "plausible")
    found = materialise(_verify(docs, _clusters(candidates, copies, classes, least), least, words).repartition("u"), "links")
    parts = connected(found.select("u", "v").unionByName(copies))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    sets = classes.join(links, F.col("rep") == F.col("u"), "left").select(
        "set_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return (
        join_frequent(measured, sets, "set_key", frequent, "left")
        .join(parts, F.col("doc_id") == F.col("node"), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("label", "doc_id").alias("component_id"),
            F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        )
    )


def keep_one(docs: DataFrame, least: int = part_enum.LEAST, words: int = part_enum.WORDS) -> DataFrame:
    """``docs`` without the rows that link, directly or not, to one of a smaller id; columns unchanged."""
    groups = group_similar(docs, least, words)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole_row(docs))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")

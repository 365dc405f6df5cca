"""Exact deduplication through an extendible-hash index on shared files (DataFrame functions only).

A text's 64-bit hash is its pseudo-key.  The directory maps the first bits of a key to a bucket; a
bucket with too many keys splits by the next bit, and the directory doubles.  Rows are dealt to
buckets through the directory, an owner combines the rows of its buckets text by text (so bytes
are compared), and rows find their group again in their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frequent_limit, join_frequent, lower_ascii, materialise, whole_row

CAPACITY = 50_000
MAX_DEPTH = 16  # bits that one level of the directory resolves; overfull cells get a level below
KEY_BITS = 64


def normal_form(text: Column) -> Column:
    """Texts are equal when these bytes are: A-Z lower-cased, null as empty."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def prefix_of(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, above: int = 0) -> DataFrame:
    """One level of the directory over ``entries``' ``key``: a row per cell of ``above`` + ``max_depth`` bits.

    A bucket of depth d holds the keys that share their first d bits.  Where it has more than
    ``capacity`` entries the directory doubles and the bucket splits; so a cell's bucket is its
    shallowest prefix below ``above`` that fits, or the cell itself.  ``overfull`` marks cells that
    hold more than ``capacity`` even so: the next level splits them.  At most 2**max_depth rows for
    each overfull cell of the level before, so at most 2**max_depth on the first level.
    """
    end = min(above + max_depth, KEY_BITS)
    cells = entries.groupBy(prefix_of(F.col("key"), end).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.select("n", "cell", F.explode(F.sequence(F.lit(above), F.lit(end))).alias("depth"))
    held = levels.groupBy("depth", F.expr(f"shiftrightunsigned(cell, {end} - depth)").alias("prefix")).agg(F.sum("n").alias("held"))
    split = held.filter(F.col("held") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_above"))
    # a bucket stands where splitting ends: it fits or is a whole cell, and what it came from did not fit
    born = held.withColumn("_above", F.shiftrightunsigned("prefix", 1)).join(split, ["depth", "_above"], "left_semi")
    root = held.filter(F.col("depth") == above)
    buckets = root.unionByName(born.select(root.columns)).filter((F.col("held") <= capacity) | (F.col("depth") == end))
    inside = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {end} - depth) - 1")))
    return buckets.withColumn("_at", inside).select(
        F.expr(f"shiftleft(prefix, {end} - depth) + _at").alias("cell"),
        F.col("depth").alias("bucket_depth"),
        F.col("prefix").alias("bucket"),
        (F.col("held") > capacity).alias("overfull"),
    )


def build_directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[tuple[int, DataFrame]]:
    """The levels (bits of a cell, cells) of the directory over distinct ``key``s; every bucket fits at last.

    Different keys differ in some bit, so splitting ends: a bucket of 64 bits holds one key.
    """
    levels: list[tuple[int, DataFrame]] = []
    above, held = 0, keys
    while True:
        end = min(above + max_depth, KEY_BITS)
        cells = materialise(directory(held, capacity, max_depth, above), "exact-directory")
        levels.append((end, cells))
        over = cells.filter("overfull").select("cell")
        if end == KEY_BITS or over.isEmpty():
            return levels
        held = held.withColumn("cell", prefix_of(F.col("key"), end)).join(over, "cell", "left_semi").drop("cell")
        above = end


def place(rows: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` (with ``key``) with ``bucket_depth`` and ``bucket``, looked up in the directory.

    The first level has at most 2**max_depth cells whatever the data, and is broadcast; the levels
    below, which exist beyond capacity * 2**max_depth texts only, are joined as Spark chooses.
    """
    for n, (bits, cells) in enumerate(levels):
        named = cells.select(
            F.col("cell").alias(f"_cell{n}"), F.struct("bucket_depth", "bucket").alias(f"_b{n}"), F.col("overfull").alias(f"_o{n}")
        )
        cell = prefix_of(F.col("key"), bits)
        if n == 0:
            rows = rows.join(F.broadcast(named), cell == F.col("_cell0"), "left")
        else:
            rows = rows.join(named, (cell == F.col(f"_cell{n}")) & F.col(f"_o{n - 1}"), "left")
    found = F.coalesce(*(F.when(~F.col(f"_o{n}"), F.col(f"_b{n}")) for n in range(len(levels))), F.col(f"_b{len(levels) - 1}"))
    inner = [f"_{k}{n}" for n in range(len(levels)) for k in ("cell", "b", "o")]
    return rows.withColumns({"bucket_depth": found["bucket_depth"], "bucket": found["bucket"]}).drop(*inner)


def build_index(
    docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH
) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The index of the distinct texts of ``docs``, written to the shared folder, and its directory.

    The directory comes from the keys alone.  Each row's bucket is looked up before its text
    moves; grouping by (bucket, key, text) compares bytes, first inside each map task (so a group of
    copies reaches its owner as one row per task, however large it is), then at the owner.  The
    entries go to index files by ranges of the key space (``low``: a bucket's least key), and there
    texts that share a key form a chain, numbered by ``chain``.
    Columns: low, bucket, bucket_depth, key, chain, text_sha256, keep_id (largest doc_id), group_size.
    """
    text = normal_form(F.col("text"))
    keys = materialise(docs.select(F.xxhash64(text).alias("key")).distinct(), "exact-keys")
    levels = build_directory(keys, capacity, max_depth)
    rows = docs.select(F.col("doc_id").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("key"))
    groups = (
        place(rows, levels)
        .groupBy("bucket", "bucket_depth", "key", "_text")
        .agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    entries = materialise(
        groups.select(
            F.expr(f"if(bucket_depth = 0, 0, shiftleft(bucket, {KEY_BITS} - bucket_depth))").cast("long").alias("low"),
            "bucket", "bucket_depth", "key", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size",
        ),
        "exact-entries",
    )
    order = Window.partitionBy("low", "bucket_depth", "key").orderBy("text_sha256")
    owned = entries.repartitionByRange("low").withColumn("chain", (F.row_number().over(order) - 1).cast("int"))
    return materialise(owned, "exact-index"), levels


def _find(rows: DataFrame, index: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` (key, text_sha256) beside their index entry, found in their bucket's chain."""
    total = index.agg(F.sum("group_size")).first()[0] or 0
    large = index.filter(F.col("group_size") > frequent_limit(total)).select("text_sha256")
    return join_frequent(place(rows, levels), index, "text_sha256", large, also=("bucket_depth", "bucket", "key"))


def group_copies(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    The largest doc_id stays (null below all others).  Of repeated rows, equal in doc_id and text,
    exactly one is kept.  Null and empty texts are equal; an empty table gives no rows; other
    columns are ignored.
    """
    index, levels = build_index(docs, capacity, max_depth)
    text = normal_form(F.col("text"))
    rows = (
        docs.select("doc_id", F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256"))
        .groupBy("doc_id", "key", "text_sha256")
        .agg(F.count("*").alias("_same"))
    )
    return (
        _find(rows, index, levels)
        .withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("_same"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_at") == 1)).alias("kept"),
            "text_sha256",
            "bucket",
            "bucket_depth",
            "chain",
        )
    )


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged, whatever their names.

    The largest doc_id stays; of rows equal in doc_id and text, which may differ in other columns, one.
    """
    index, _ = build_index(docs, capacity)
    text = normal_form(F.col("text"))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("sha"), whole_row(docs)
    )
    stays = index.select("keep_id", F.col("key").alias("_key"), "text_sha256")
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("_key")) & (F.col("sha") == F.col("text_sha256"))
    return rows.join(stays, same, "left_semi").dropDuplicates(["id", "key", "sha"]).select("row.*")

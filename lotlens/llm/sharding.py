"""Balanced contiguous shards from global byte-size prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_rows

ROW_OVERHEAD = 16


def shard(docs: DataFrame, shards: int = 40, overhead: int = ROW_OVERHEAD) -> DataFrame:
    """Cut ``docs`` (``doc_id``, ``text``) into ``shards`` contiguous runs of nearly equal bytes.

    Rows are ordered by (doc_id, crc32 of the text, size), nulls first.  Each row belongs to the
    shard that holds the middle of its byte range, so a shard's bytes differ from total/shards by
    less than one row at either end.  Per-partition totals give the global offsets (see
    ``number_rows``): nothing but ``shards`` first rows and one total reaches the driver.

    A null text has ``overhead`` bytes and the crc32 of the empty text; null ids come first;
    repeated rows get slots of their own; an empty table gives no rows; with fewer rows than shards
    some shards stay empty; other columns are ignored.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``),
    start (first byte of the row in the global order).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = number_rows(rows, order, {"start": F.col("size"), "_row": F.lit(1)}, [], "shards")
    total = placed.agg(F.sum("size")).first()[0] or 1
    middle = F.expr(f"(2 * start + size) * {shards} div (2 * {total}L)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int"))
    first = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("_row").alias("_first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_shard")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "start",
    )

"""What the operators of this subpackage share: bounded batches, frequent keys, global numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
FREQUENT_SHARE = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers, as single texts may be very long.

    Only lowers the session's two settings, always to the same values, so that it does not matter
    which operator asked last before a plan runs.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(name).lower().removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(name, str(most))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct ``row``: the caller's names cannot clash with an operator's own."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row")


def text_beside_row(docs: DataFrame) -> tuple[DataFrame, T.StructType, str]:
    """(rows, schema, name): ``text`` as Spark resolves it, as ``_text`` beside the ``whole_row``; the schema of
    both; and the text column's own name, which may differ in case."""
    rows = docs.select(F.col("text").alias("_text"), whole_row(docs))
    name = "text" if "text" in docs.columns else next(c for c in docs.columns if c.lower() == "text")
    return rows, rows.schema, name


def set_aside(docs: DataFrame, own: list[str]) -> dict[str, str]:
    """New names for the columns of ``docs`` whose names an operator's result has itself: ``_in`` is appended."""
    taken = {c.lower() for c in [*docs.columns, *own]}
    named: dict[str, str] = {}
    for column in docs.columns:
        if column.lower() in {o.lower() for o in own}:
            name = f"{column}_in"
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
            named[column] = name
    return named


def unpacked(docs: DataFrame, own: list[str]) -> list[Column]:
    """The columns of a ``whole_row`` struct, renamed by ``set_aside``."""
    named = set_aside(docs, own)
    return [F.col("row")[c].alias(named.get(c, c)) for c in docs.columns]


def frequent_limit(rows: int) -> int:
    """Rows of a key from which it counts as frequent: at most FREQUENT_SHARE keys have so many."""
    return max(FREQUENT_SHARE, rows // FREQUENT_SHARE)


def join_frequent(
    left: DataFrame, right: DataFrame, key: str, frequent: DataFrame, how: str = "inner", also: tuple[str, ...] = ()
) -> DataFrame:
    """``left`` joined to ``right`` (one row per key) on ``key`` and ``also``, frequent and null keys without a shuffle.

    ``frequent`` (column ``key``, of at most some FREQUENT_SHARE rows, see ``frequent_limit``) lists the keys that
    many rows of ``left`` have.  Their rows meet a broadcast of ``right``'s rows for these keys
    alone, whose number is bounded likewise; only the others are shuffled, none of them in a large
    group.  ``how``: inner or left.
    """
    few = frequent.select(F.col(key).alias("_frequent")).distinct()
    marked = left.join(F.broadcast(few), F.col(key) == F.col("_frequent"), "left")
    often = F.col("_frequent").isNotNull() | F.col(key).isNull()
    short = right.join(F.broadcast(few), F.col(key) == F.col("_frequent"), "left_semi")
    a = marked.filter(often).drop("_frequent").join(F.broadcast(short), [key, *also], how)
    b = marked.filter(~often).drop("_frequent").join(right, [key, *also], how)
    return a.unionByName(b)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts take the byte-wise ``lower``."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower()))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def number_rows(df: DataFrame, order: list[Column], sums: dict[str, Column], within: list[str], name: str) -> DataFrame:
    """Exclusive running totals of ``sums`` over all rows in ``order``, inside each group ``within``.

    Rows are range-partitioned by (``within``, ``order``) and written once with their partition
    number; totals per (group, partition) give each partition's offset, and a window inside the
    partition adds the rest.  No group is gathered in one task, however many rows it has.  Only the
    totals (groups x partitions rows) are joined back.  Adds one long column per key of ``sums``.
    """
    keys = [F.col(c) for c in within]
    placed = materialise(
        df.withColumns({f"_{k}": c.cast("long") for k, c in sums.items()})
        .repartitionByRange(*keys, *order)
        .withColumn("_part", F.spark_partition_id()),
        name,
    )
    totals = placed.groupBy(*within, "_part").agg(*(F.sum(f"_{k}").alias(f"_t_{k}") for k in sums))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(c).alias(f"_g_{c}") for c in within),
        F.col("_part").alias("_g_part"),
        *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums),
    )
    inside = Window.partitionBy(*within, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
    on = F.col("_part") == F.col("_g_part")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = local.join(offsets, on)
    return joined.select(*df.columns, *((F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums))


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)

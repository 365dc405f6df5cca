"""How listings and observations lie on disk: clustered for lookups, bucketed for histories, and mapped to rows and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise

ROW_GROUP_BYTES = 8 << 20
BUCKETS = 32
PAYLOAD = (
    "make", "model", "model_year", "generation", "trim", "engine_code", "displacement_l", "fuel", "transmission", "drivetrain", "body", "horsepower",
    "import_status",
)


def write_clustered(rows: DataFrame, path: str, cluster: str, also: Sequence[str] = (), different: int = 1_000_000, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write ``rows`` in ranges of ``cluster``, with Bloom filters of that column and of ``also``.

    A lookup by ``cluster`` reads the row groups whose range holds the key, one by a column of ``also`` those whose
    Bloom filter does.  ``different``: about how many values a file has.
    """
    writer = rows.repartitionByRange(cluster).sortWithinPartitions(cluster).write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    for column in (cluster, *also):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", different)
    writer.parquet(path)


def lookup(spark: SparkSession, path: str, column: str, values: Sequence) -> DataFrame:
    """The rows of a clustered table that have one of some values: a filter that reaches the Parquet reader.

    For as many values as a request names; a table of keys is joined instead.
    """
    return spark.read.parquet(path).filter(F.col(column).isin(*values) if values else F.lit(False))


def write_bucketed(rows: DataFrame, name: str, path: str, key: str = "listing_id", order: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Write ``rows`` as table ``name``, bucketed by ``key`` and sorted inside buckets; tables of as many buckets meet without an exchange."""
    dealt = rows.repartition(buckets, key)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name)
    return rows.sparkSession.table(name)


def with_history(listings: DataFrame, observations: DataFrame) -> DataFrame:
    """``listings`` with ``price_history``: structs of observed_at and price in order of (observed_at, seq), empty without any.

    Both sides bucketed by listing_id (``write_bucketed``) are neither exchanged for the aggregation nor for the join.
    """
    point = F.struct("observed_at", "seq", "price")
    held = observations.groupBy("listing_id").agg(F.array_sort(F.collect_list(point)).alias("_points"))
    points = F.transform("_points", lambda p: F.struct(p["observed_at"].alias("observed_at"), p["price"].alias("price")))
    joined = listings.join(held, "listing_id", "left").withColumn("_points", points)
    none = F.array().cast(joined.schema["_points"].dataType)
    return joined.withColumn("price_history", F.coalesce("_points", none)).drop("_points")


def to_row_values(listings: DataFrame, source_id: int) -> DataFrame:
    """The columns under which a normalised listing is kept.

    Keys only where make and model are known; the configuration as read goes into ``raw_payload`` as JSON, unknown fields
    left out.  Columns that ``listings`` lacks are null, or UNKNOWN for categories.
    """
    has = lambda c: F.col(c) if c in listings.columns else F.lit(None).cast("string")
    category = lambda c: F.coalesce(has(c), F.lit("UNKNOWN"))
    fields = {c: F.col(c) for c in PAYLOAD if c in listings.columns}
    keys = normalise.identity(fields)
    known = ~normalise.blank(F.col("make")) & ~normalise.blank(F.col("model"))
    kept = lambda key: F.when(known, keys[key]).alias(key)
    money = F.col("price").cast("decimal(14, 2)")
    payload = F.to_json(F.struct(*(category(c).alias(c) if c in normalise.CATEGORIES else has(c).alias(c) for c in PAYLOAD)))
    return listings.select(
        F.lit(source_id).alias("source_id"), F.col("listing_id").cast("string").alias("external_id"), "source_url",
        kept("config_id"), kept("model_key"), kept("generation_key"), kept("powertrain_key"),
        money.alias("price_amount"), F.lit("AZN").alias("price_currency"), money.alias("price_azn"), "mileage_km", "city", "region",
        category("seller_type").alias("seller_type"), category("condition").alias("condition"),
        has("damage").cast("boolean").alias("has_damage_disclosure"), has("repaint").cast("boolean").alias("has_repaint_disclosure"),
        has("description").alias("description"), category("status").alias("status"),
        F.col("first_seen").alias("first_seen_at"), F.col("last_seen").alias("last_seen_at"), payload.alias("raw_payload"),
    )


def from_row_values(rows: DataFrame) -> DataFrame:
    """Listings out of their kept columns: what ``to_row_values`` wrote, read back."""
    numbers = {"model_year": "int", "displacement_l": "double", "horsepower": "int"}
    payload = F.from_json("raw_payload", ", ".join(f"{c} {numbers.get(c, 'string')}" for c in PAYLOAD))
    read = rows.withColumn("_p", payload)
    field: Column = F.col("_p")
    return read.select(
        F.col("external_id").alias("listing_id"), "source_url", *(field[c].alias(c) for c in PAYLOAD), F.col("price_azn").cast("double").alias("price"),
        "mileage_km", "city", "region", "seller_type", "condition", F.col("has_damage_disclosure").alias("damage"),
        F.col("has_repaint_disclosure").alias("repaint"), "description", "status", F.col("first_seen_at").alias("first_seen"),
        F.col("last_seen_at").alias("last_seen"),
    )

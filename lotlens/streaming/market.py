"""The market's stateful work as streams: upserts by micro-batch, price alerts, request limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..session import drop


def latest_in_batch(batch: DataFrame) -> DataFrame:
    """One row per listing: the last observed, ties by sequence, as the upsert takes one row per key."""
    order = Window.partitionBy("listing_id").orderBy(F.desc("observed_at"), F.desc("seq"))
    return batch.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def upsert_stream(
    rows: DataFrame, state_dir: str, log_dir: str, checkpoint: str, empty_state: DataFrame
) -> StreamingQuery:
    """Fold a stream of listing rows into a small state, rewritten whole per micro-batch, each row at its own time.

    ``state_table`` keeps a large state in partitions.

    The state of batch n is written to ``state_dir``/v=n+1 and read by the next batch, so a batch
    that is run again overwrites its own version and nothing else; its transitions go to
    ``log_dir``/batch=n in the same way.
    """

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(empty_state.schema).parquet(f"{state_dir}/v={n}") if n else empty_state
        upserted = state.upsert(before, latest_in_batch(batch))
        upserted.write.mode("overwrite").parquet(f"{state_dir}/v={n + 1}")
        done = spark.read.parquet(f"{state_dir}/v={n + 1}")
        state.transitions(done, F.col("last_seen")).write.mode("overwrite").parquet(f"{log_dir}/batch={n}")
        if n > 1:
            drop(spark, f"{state_dir}/v={n - 1}")  # batch n may run again and needs v=n; nothing needs what was before

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def price_drop_stream(observations: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Price changes as they arrive: the checkpoint, not a clock window, decides what is new."""
    changes = observations.filter(F.col("change_kind") == "PRICE_CHANGE")
    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_counts(requests: DataFrame, lateness: str = "2 minutes") -> DataFrame:
    """Requests per key and sliding minute (columns at, key), for a limiter that reads the counts."""
    return (
        requests.withWatermark("at", lateness)
        .groupBy(F.window("at", "60 seconds", "10 seconds"), "key")
        .agg(F.count("*").alias("requests"))
    )


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

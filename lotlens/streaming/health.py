"""A stream of parsed pages that stops where extraction health fails, and keeps what it had committed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.state import CRITICAL, HEALTH_AFTER, MIN_FIELD_RATE, MIN_SUCCESS

METRICS = "extraction_health"


class Unhealthy(RuntimeError):
    """The run had stopped at an earlier batch."""


def _counts(failed: Column, fields: Sequence[str]) -> dict[str, Column]:
    parsed = ~F.coalesce(failed, F.lit(False))
    held = {f"with_{f}": (parsed & F.col(f).isNotNull()).cast("long") for f in fields}
    return {"pages": F.lit(1).cast("long"), "failures": (~parsed).cast("long")} | held


def unhealthy(fields: Sequence[str] = CRITICAL) -> Column:
    """Whether running counts (pages, failures, with_<field>) say that a run must stop: from 25 pages, under half
    parsed, or a critical field in under 60 % of the parsed ones."""
    pages, parsed = F.col("pages"), F.col("pages") - F.col("failures")
    lost = F.lit(False)
    for f in fields:
        lost = lost | ((parsed > 0) & (F.col(f"with_{f}") < MIN_FIELD_RATE * parsed))
    return (pages >= HEALTH_AFTER) & ((parsed < MIN_SUCCESS * pages) | lost)


def healthy_prefix(rows: DataFrame, before: dict[str, int], failed: Column, order: Sequence[str], fields: Sequence[str] = CRITICAL) -> DataFrame:
    """``rows`` in ``order`` with running counts from ``before`` on and ``stops``, true from the first row at which the run must
    stop on; for one micro-batch, whose size bounds the window."""
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumns({f"_{k}": c for k, c in _counts(failed, fields).items()})
    running = counted.withColumns({k: F.sum(f"_{k}").over(so_far) + before.get(k, 0) for k in _counts(failed, fields)})
    return running.withColumn("_bad", unhealthy(fields).cast("int")).withColumn("stops", F.max("_bad").over(so_far) == 1).drop(
        "_bad", *(f"_{k}" for k in _counts(failed, fields))
    )


class StopWhenUnhealthy(StreamingQueryListener):
    """Adds up a query's observed counts and stops it once they say so; ``totals`` holds them per query."""

    def __init__(self, spark: SparkSession, fields: Sequence[str] = CRITICAL):
        self.spark, self.fields = spark, fields
        self.totals: dict[str, dict[str, int]] = {}
        self.stopped: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.totals[str(event.id)] = {}

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(METRICS)
        if seen is None:
            return
        held = self.totals.setdefault(str(event.progress.id), {})
        for name, n in seen.asDict().items():
            held[name] = held.get(name, 0) + (n or 0)
        pages, parsed = held.get("pages", 0), held.get("pages", 0) - held.get("failures", 0)
        lost = parsed > 0 and any(held.get(f"with_{f}", 0) < MIN_FIELD_RATE * parsed for f in self.fields)
        if pages >= HEALTH_AFTER and (parsed < MIN_SUCCESS * pages or lost):
            self.stopped.add(str(event.progress.id))
            query = self.spark.streams.get(str(event.progress.id))
            if query is not None:
                query.stop()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def guarded_stream(
    pages: DataFrame, failed: Column, commit: Callable[[DataFrame, int], None], totals_dir: str, checkpoint: str,
    order: Sequence[str] = ("seq",), fields: Sequence[str] = CRITICAL,
) -> StreamingQuery:
    """Commit parsed pages in order of arrival up to the page at which the run must stop, that one included.

    Running counts of batch n are kept in ``totals_dir``/v=n, so a restarted query goes on counting, and a
    batch that runs again gives the same prefix.  A ``StopWhenUnhealthy`` listener stops the query by the counts that it
    observes; should a next batch begin before, it commits nothing and fails.
    """
    observed = pages.observe(METRICS, *(F.sum(c).alias(k) for k, c in _counts(failed, fields).items()))

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{totals_dir}/v={n - 1}").first().asDict() if n else {}
        if before.get("stopped"):
            raise Unhealthy(f"the run stopped after {before['pages']} pages")
        told = healthy_prefix(batch, before, failed, order, fields).persist()
        names = list(_counts(failed, fields))
        first_bad = told.filter("stops").agg(F.min("pages")).first()[0]
        kept = told if first_bad is None else told.filter(F.col("pages") <= first_bad)
        commit(kept.drop("stops", *names), n)
        last = kept.agg(*(F.max(k).alias(k) for k in names)).first().asDict()
        now = {k: last[k] if last[k] is not None else before.get(k, 0) for k in names}
        row = spark.createDataFrame([(*now.values(), first_bad is not None)], f"{', '.join(f'{k} long' for k in names)}, stopped boolean")
        row.coalesce(1).write.mode("overwrite").parquet(f"{totals_dir}/v={n}")
        told.unpersist()

    return observed.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

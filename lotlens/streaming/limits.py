"""A request limiter over a sliding window: only allowed requests count.

``limiter_stream`` keeps each key's allowed hits of the last window as state and clears it by a timer;
``allowed`` gives the same verdict per row over a table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PER_MINUTE, WINDOW_SECONDS = 60, 60.0


def allowed(requests: DataFrame, limit: int = PER_MINUTE, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """``requests`` (key, at, seq) with ``allowed``: whether fewer than ``limit`` allowed requests of the key lie in the window.

    A hit exactly ``seconds`` old still counts.  Requests of a key go by (at, seq); null keys are a key, a
    null time is never allowed and never counts.  Each verdict needs the ones before, so a key's requests are
    sorted into one task; they stream through it in batches, and only the last ``limit`` hits are held.
    """
    width = int(seconds * 1_000_000)
    timed = requests.withColumn("_at", F.unix_micros(F.col("at").cast("timestamp"))).filter("_at is not null")
    inside = timed.repartition("key").sortWithinPartitions("key", "_at", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hits = object(), deque(maxlen=limit)
        for batch in batches:
            told = []
            for key, at in zip(batch["key"].to_pylist(), batch["_at"].to_pylist()):
                if key != current:
                    current, hits = key, deque(maxlen=limit)
                free = limit > 0 and (len(hits) < limit or hits[0] < at - width)
                told.append(free)
                if free:
                    hits.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.bool_())], [*batch.schema.names, "allowed"])

    schema = StructType([*timed.schema.fields, StructField("allowed", BooleanType())])
    each = inside.mapInArrow(fold, schema).drop("_at")
    return each.unionByName(requests.filter(F.col("at").isNull()).withColumn("allowed", F.lit(False)))


class _Limiter(StatefulProcessor):
    """Per key the times of allowed hits inside the window, in order."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.width = limit, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["micros", "seq"], kind="stable")
        held = [h[0] for h in self.hits.get()] if self.hits.exists() else []
        verdicts = []
        for at in batch["micros"].tolist():
            held = [h for h in held if h >= at - self.width]
            free = len(held) < self.limit
            verdicts.append(free)
            if free:
                held.append(at)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if held:
            self.hits.put([(h,) for h in held])
            self.handle.registerTimer((held[-1] + self.width) // 1000 + 1)
        else:
            self.hits.clear()
        yield pd.DataFrame({"key": batch["key"], "seq": batch["seq"], "allowed": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        return iter([])

    def close(self) -> None:
        pass


def limiter_stream(requests: DataFrame, limit: int = PER_MINUTE, seconds: float = WINDOW_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """A verdict (key, seq, allowed) for each request of a stream (key, at, seq), exactly as ``allowed`` gives it.

    State is at most ``limit`` times per key and goes when the watermark is a window past the last hit.
    Requests must reach the stream in order of time, up to ``lateness``; within a micro-batch
    they are sorted.  Needs the RocksDB state store (``STATE_STORE``).
    """
    timed = requests.withColumn("at", F.col("at").cast("timestamp")).withColumn("micros", F.unix_micros("at"))
    kind = requests.schema["key"].dataType.simpleString()
    seq = requests.schema["seq"].dataType.simpleString()
    return (
        timed.withWatermark("at", lateness)
        .groupBy("key")
        .transformWithStateInPandas(
            _Limiter(limit, seconds), f"key {kind}, seq {seq}, allowed boolean", outputMode="Append", timeMode="EventTime"
        )
    )

"""Listings that a source no longer shows, marked by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import REMOVED_AFTER_DAYS

_DAY = 86_400_000_000


class _Presence(StatefulProcessor):
    """Per listing the last sighting with its price; a timer ends it."""

    def __init__(self, days: int):
        self.wait = days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen long, price double, mileage_km long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["micros", "seq"], kind="stable")
        latest = batch.iloc[-1]
        if self.last.exists() and self.last.get()[0] > int(latest["micros"]):
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        known = lambda v, kind: None if pd.isna(v) else kind(v)
        self.last.update((int(latest["micros"]), known(latest["price"], float), known(latest["mileage_km"], int)))
        self.handle.registerTimer((int(latest["micros"]) + self.wait) // 1000 + 1)
        return
        yield  # a generator without rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, price, mileage = self.last.get()
        self.last.clear()
        yield pd.DataFrame(
            {"listing_id": [key[0]], "price": [price], "mileage_km": pd.array([mileage], "Int64"), "status": ["REMOVED"], "change_kind": ["STATUS_CHANGE"],
             "last_seen_micros": [seen], "due_micros": [seen + self.wait]}
        )

    def close(self) -> None:
        pass


def removal_stream(sightings: DataFrame, days: int = REMOVED_AFTER_DAYS, lateness: str = "0 seconds") -> DataFrame:
    """A STATUS_CHANGE row for each listing that was not seen for ``days``, when event time has passed that.

    ``sightings``: listing_id, observed_at, seq, price, mileage_km.  A listing seen again later starts anew.  State is one row per
    listing shown in the last ``days``.  Columns: listing_id, price, mileage_km, status, change_kind, last_seen, due_at.
    Needs the RocksDB state store (``limits.STATE_STORE``).
    """
    kind = sightings.schema["listing_id"].dataType.simpleString()
    timed = sightings.withColumn("observed_at", F.col("observed_at").cast("timestamp")).select(
        "listing_id", "observed_at", F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"),
        F.col("mileage_km").cast("long").alias("mileage_km"), F.unix_micros("observed_at").alias("micros"),
    )
    schema = f"listing_id {kind}, price double, mileage_km long, status string, change_kind string, last_seen_micros long, due_micros long"
    gone = timed.withWatermark("observed_at", lateness).groupBy("listing_id").transformWithStateInPandas(
        _Presence(days), schema, outputMode="Append", timeMode="EventTime"
    )
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return gone.select(
        "listing_id", "price", "mileage_km", "status", "change_kind", at("last_seen_micros").alias("last_seen"), at("due_micros").alias("due_at")
    )

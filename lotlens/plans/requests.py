"""Batch forms of the stateful streams over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import limits

_LIMIT, _SECONDS = 3, 3600  # the events of a type are some minutes apart


def limited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of their type, at most three allowed ones in an hour."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return limits.allowed(events, _LIMIT, _SECONDS).select("key", "seq", "allowed")


LIMITED_SQL = f"""
WITH asked AS (
  SELECT event_type, list(epoch_us(ts) ORDER BY ts, event_id) AS times, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY 1
), folded AS (
  SELECT event_type, times, ids, list_reduce(list_transform(times, lambda t: [t]), lambda hits, t:
    CASE WHEN len(list_filter(hits[-{_LIMIT}:], lambda h: h >= t[1] - {_SECONDS * 1_000_000})) < {_LIMIT} THEN list_append(hits, t[1]) ELSE hits END) AS hits
  FROM asked
), each AS (
  SELECT event_type, unnest(times) AS t_at, unnest(ids) AS id FROM asked
), hit AS (
  SELECT event_type, t_at, count(*) AS n FROM (SELECT event_type, unnest(hits) AS t_at FROM folded) GROUP BY 1, 2
)
SELECT each.event_type AS key, each.id AS seq,
  row_number() OVER (PARTITION BY each.event_type, each.t_at ORDER BY each.id) <= coalesce(hit.n, 0) AS allowed
FROM each LEFT JOIN hit ON each.event_type = hit.event_type AND each.t_at = hit.t_at
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"limited_requests": limited_requests}
ORACLE_SQL: dict[str, str] = {"limited_requests": LIMITED_SQL}

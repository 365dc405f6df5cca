"""Lookups, assembled histories, kept rows and issue details over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..session import shared_dir
from ..sources import market, store
from .ingestion import IDENTITIES_SQL
from .statistics import STRETCHED_SQL, _twin, stretched

_L, _O = market.LISTINGS_SQL, market.OBSERVATIONS_SQL


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def listing_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest listing of each make (ties: the least id), looked up by its address, and the dearest, by its id."""
    rows = market.listings(spark, sf_dir)
    path = _fresh(spark, "clustered")
    store.write_clustered(rows, path, "source_url", ["listing_id"])
    ends = rows.groupBy("make").agg(
        F.min_by("source_url", F.struct("price", "listing_id")).alias("url"), F.max_by("listing_id", F.struct("price", "listing_id")).alias("id")
    )
    wanted = ends.collect()  # one row for each make
    shown = ("listing_id", "source_url", "make", "price")
    by_url = store.lookup(spark, path, "source_url", [r.url for r in wanted]).select(F.lit("url").alias("by"), *shown)
    by_id = store.lookup(spark, path, "listing_id", [r.id for r in wanted]).select(F.lit("id").alias("by"), *shown)
    return by_url.unionByName(by_id)


LOOKUPS_SQL = """
SELECT 'url' AS by, listing_id, source_url, make, price FROM (
  SELECT *, row_number() OVER (PARTITION BY make ORDER BY price, listing_id) AS rn FROM listings) WHERE rn = 1
UNION ALL SELECT 'id' AS by, listing_id, source_url, make, price FROM (
  SELECT *, row_number() OVER (PARTITION BY make ORDER BY price DESC, listing_id DESC) AS rn FROM listings) WHERE rn = 1
"""


def listing_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with its observed prices in order, from two bucketed tables."""
    sides = []
    for name, rows, order in (("listings", market.listings(spark, sf_dir), ()), ("observations", market.observations(spark, sf_dir), ("observed_at", "seq"))):
        table = f"lotlens_{name}_{uuid.uuid4().hex}"
        sides.append(store.write_bucketed(rows, table, _fresh(spark, f"bucketed-{name}"), order=order))
    points = F.transform("price_history", lambda p: F.concat_ws(" ", F.date_format(p["observed_at"], "yyyy-MM-dd HH:mm:ss"), F.round(p["price"] * 100).cast("long").cast("string")))
    return store.with_history(*sides).select("listing_id", F.size("price_history").alias("points"), F.array_join(points, ",").alias("history"))


HISTORIES_SQL = """
, p AS (
  SELECT listing_id, CAST(count(*) AS INTEGER) AS points,
    string_agg(strftime(observed_at, '%Y-%m-%d %H:%M:%S') || ' ' || CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY observed_at, seq) AS history
  FROM observations GROUP BY 1
)
SELECT l.listing_id, coalesce(points, 0) AS points, coalesce(history, '') AS history FROM listings l LEFT JOIN p ON l.listing_id = p.listing_id
"""


def row_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as they are kept, and out of their kept columns again."""
    kept = store.to_row_values(market.listings(spark, sf_dir), 1)
    back = store.from_row_values(kept).select(
        F.col("listing_id").cast("long").alias("external"), F.col("model_year").alias("year_back"), F.col("displacement_l").alias("litres_back"), F.col("fuel").alias("fuel_back")
    )
    rows = kept.select(
        F.col("external_id").cast("long").alias("external"), "config_id", "powertrain_key", F.col("price_azn").cast("double").alias("price_azn"), "seller_type", "status",
        "has_damage_disclosure", F.size(F.json_object_keys("raw_payload")).alias("payload_fields"),
    )
    return rows.join(back, "external")


ROW_VALUES_SQL = f"""
, ids AS ({IDENTITIES_SQL.strip()})
SELECT l.listing_id AS external, config_id, powertrain_key, CAST(round(price, 2) AS DOUBLE) AS price_azn, 'UNKNOWN' AS seller_type, status,
  damage AS has_damage_disclosure, CAST(10 + CAST(displacement_l IS NOT NULL AS INTEGER) AS INTEGER) AS payload_fields,
  CAST(model_year AS INTEGER) AS year_back, displacement_l AS litres_back, fuel AS fuel_back
FROM listings l JOIN ids ON l.listing_id = ids.listing_id
"""


def quality_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is implausible about each stretched listing, in words."""
    rows = stretched(market.listings(spark, sf_dir))
    return rows.select("listing_id", F.explode(state.issue_details(F.year("last_seen"))).alias("i")).select("listing_id", "i.issue", "i.detail")


DETAILS_SQL = """
SELECT listing_id, f.issue AS issue, f.detail AS detail FROM (SELECT listing_id, unnest([
  CASE WHEN price < 300 THEN {'issue': 'IMPLAUSIBLE_PRICE', 'detail': format('{:,}', CAST(round_even(price, 0) AS BIGINT)) || ' is too low a price'} END,
  CASE WHEN price > 3000000 THEN {'issue': 'IMPLAUSIBLE_PRICE', 'detail': format('{:,}', CAST(round_even(price, 0) AS BIGINT)) || ' is too high a price'} END,
  CASE WHEN km > 1500000 THEN {'issue': 'IMPLAUSIBLE_MILEAGE', 'detail': format('{:,}', CAST(km AS BIGINT)) || ' km, perhaps another unit'} END,
  CASE WHEN y < 1950 THEN {'issue': 'IMPLAUSIBLE_YEAR', 'detail': 'year ' || y || ' is too early'} END,
  CASE WHEN y > now + 2 THEN {'issue': 'IMPLAUSIBLE_YEAR', 'detail': 'year ' || y || ' is yet to come'} END,
  CASE WHEN model IS NULL THEN {'issue': 'UNRESOLVABLE', 'detail': 'make or model is not known, so there is nothing to compare with'} END]) AS f FROM stretched)
WHERE f IS NOT NULL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "listing_lookups": listing_lookups,
    "listing_histories": listing_histories,
    "row_values": row_values,
    "quality_details": quality_details,
}
ORACLE_SQL: dict[str, str] = {
    "listing_lookups": _twin(LOOKUPS_SQL, _L),
    "listing_histories": _twin(HISTORIES_SQL, _L, _O),
    "row_values": _twin(ROW_VALUES_SQL, _L),
    "quality_details": _twin(DETAILS_SQL, _L, STRETCHED_SQL),
}

"""Inspection plans, bundles, report checks, saved items, dated snapshots, contexts and listing pages over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise, vocabulary
from ..operators import comparables, context, evidence, inspection, judgement, provenance, saved, snapshots, state, stats
from ..session import materialise, shared_dir, table
from ..sources import listing_pages, market, pages
from . import appraisal, ingestion
from .statistics import _AT, SNAPSHOTS_SQL, _twin, rounded

_ALL = (*appraisal._ALL, appraisal.RATED_SQL)
_WHOLE_ALL = (*appraisal._WHOLE_ALL, appraisal.RATED_SQL)


# Appraised rows: inspection, bundle, narrative, report checks


def _rated(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return judgement.rate(judgement.assess_risk(appraisal._facts(spark, sf_dir, whole)[0]))


def _keys(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["rank"].cast("string"), e["trigger"])), ",")


def inspection_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inspection.plan(_rated(spark, sf_dir, True), market.as_of())
    return rows.select(
        "subject_id", _keys(F.col("questions")).alias("questions"), _keys(F.col("inspection")).alias("items"),
        F.size(inspection.by_priority(F.col("inspection"), "high")).alias("high_items"),
    )


def _rules_sql(rules: list[tuple[str, str, int, str]]) -> str:
    """Struct literals (key, rank, trigger, on) of rules given as (condition, key, rank, trigger)."""
    return ", ".join(f"{{'k': '{k}', 'p': {p}, 't': '{t}', 'ok': {on}}}" for on, k, p, t in rules)


_SYSTEM = {k: s for k, (_, s) in inspection.BASELINE.items()} | inspection.FURTHER
_SYSTEM_SQL = ", ".join(f"('{k}', '{s}', '{inspection.CHECKS[k].replace(chr(39), chr(39) * 2)}')" for k, s in _SYSTEM.items())
_ITEM_RULES = [("true", k, inspection.PRIORITIES.index(p), "ALWAYS") for k, (p, _) in inspection.BASELINE.items()] + [
    ("h_damage", "structure", 0, "DAMAGE"), ("h_damage", "paint", 0, "DAMAGE"), ("h_damage", "alignment", 0, "DAMAGE"),
    ("h_mileage", "major_service", 0, "MILEAGE_ANOMALY"), ("h_mileage", "compression", 1, "MILEAGE_ANOMALY"),
    ("h_conflict", "documents", 0, "INCONSISTENCY"), ("h_price", "structure", 0, "PRICE_ANOMALY"), ("h_price", "diagnostic", 0, "PRICE_ANOMALY"),
    ("s_mileage_km >= 150000", "major_service", 0, "HIGH_MILEAGE"), ("s_mileage_km >= 150000", "transmission", 0, "HIGH_MILEAGE"),
    ("s_mileage_km >= 220000", "compression", 0, "VERY_HIGH_MILEAGE"), ("old", "rust", 1, "AGE"), ("old", "suspension", 1, "AGE"),
    ("NOT has_records", "fluids", 0, "NO_RECORDS"),
]
_QUESTION_RULES = [
    ("NOT has_records", "SERVICE_RECORDS", 0, "NO_RECORDS"), ("subject_id % 5 = 0", "PREVIOUS_OWNERS", 1, "NO_OWNERS"),
    ("subject_id % 3 = 0", "SHARE_VIN", 0, "NO_VIN"), ("coalesce(rp, false)", "REPAINTED_PANELS", 0, "REPAINT"),
    ("days_listed >= 45", "INSPECTED_BEFORE", 1, "LONG_LISTED"), ("s_mileage_km >= 150000", "SERVICES_DONE", 0, "HIGH_MILEAGE"),
    ("with_mileage >= 5 AND s_mileage_km > 0 AND s_mileage_km < median_mileage_km * 6e-1", "ODOMETER_PROOF", 0, "LOW_MILEAGE"),
    ("true", "INDEPENDENT_INSPECTION", 0, "ALWAYS"),
]
INSPECTION_SQL = f"""
, has AS (
  SELECT subject_id, bool_or(kind = 'DAMAGE') AS h_damage, bool_or(kind = 'MILEAGE_ANOMALY') AS h_mileage,
    bool_or(kind = 'INCONSISTENCY') AS h_conflict, bool_or(kind = 'PRICE_ANOMALY' AND rank >= 2) AS h_price FROM weighed GROUP BY 1
), look AS (
  SELECT r.*, coalesce(h_damage, false) AS h_damage, coalesce(h_mileage, false) AS h_mileage, coalesce(h_conflict, false) AS h_conflict,
    coalesce(h_price, false) AS h_price, greatest(0, year({_AT}) - s_model_year) >= 8 AS old
  FROM rated r LEFT JOIN has ON r.subject_id = has.subject_id
), item_rules AS (
  SELECT subject_id, r.k AS k, r.p AS p, r.t AS t, seq FROM (
    SELECT subject_id, unnest([{_rules_sql(_ITEM_RULES)}]) AS r, unnest(range({len(_ITEM_RULES)})) AS seq FROM look) WHERE r.ok
), items AS (
  SELECT subject_id, string_agg(k || ':' || p || ':' || t, ',' ORDER BY p, s, i) AS items, count(*) FILTER (p = 0) AS high_items
  FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, k ORDER BY p, seq) AS rn FROM item_rules)
  JOIN (VALUES {_SYSTEM_SQL}) v(key, s, i) ON k = key WHERE rn = 1 GROUP BY 1
), asked AS (
  SELECT subject_id, 'REASON_FOR_PRICE' AS k, 0 AS p, 'PRICE_GAP' AS t, 0 AS seq FROM look WHERE difference < 0 AND material_unexplained
  UNION ALL SELECT subject_id, 'ABOUT_' || kind, CASE WHEN rank >= 3 THEN 0 ELSE 1 END, kind,
    row_number() OVER (PARTITION BY subject_id ORDER BY rank DESC, conf DESC, kind) FROM weighed
    WHERE kind IN ({", ".join(f"'{k}'" for k in inspection.ASKED_OF_SIGNALS)})
  UNION ALL SELECT subject_id, r.k, r.p, r.t, seq FROM (
    SELECT subject_id, unnest([{_rules_sql(_QUESTION_RULES)}]) AS r, unnest(range(100, {100 + len(_QUESTION_RULES)})) AS seq FROM look) WHERE r.ok
)
SELECT i.subject_id, questions, items, CAST(high_items AS INTEGER) AS high_items FROM items i JOIN (
  SELECT subject_id, string_agg(k || ':' || p || ':' || t, ',' ORDER BY p, seq) AS questions FROM asked GROUP BY 1) q ON i.subject_id = q.subject_id
"""


def _unknown() -> Column:
    return normalise.unknown_fields({n: F.col(f"s_{n}") for n in normalise.SPECIFICITY if n != "engine_code"})


def _appraised(facts: DataFrame, moves: DataFrame) -> DataFrame:
    rows = judgement.confidence(judgement.negotiate(judgement.rate(judgement.assess_risk(facts)), moves))
    rows = inspection.plan(rows, market.as_of()).withColumn("explanations", judgement.explanations())
    return rows.withColumn("limitations", evidence.limitations())


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bundle of each subject holds, read back from its JSON."""
    _, chosen, _, _ = appraisal._valued(spark, sf_dir, True)
    facts, moves = appraisal._facts(spark, sf_dir, True)
    rows = materialise(_appraised(facts, moves), "appraised")
    made = evidence.assemble(rows, chosen, market.as_of())
    at = lambda path: F.get_json_object("bundle", f"$.{path}")
    more = rows.select("subject_id", F.array_join(evidence.improvements(_unknown()), ",").alias("improvements"))
    return made.select(
        "subject_id", F.size(F.json_object_keys("bundle")).alias("n_keys"), at("price_position.rating").alias("rating"),
        at("valuation.central").cast("double").alias("central"), F.json_array_length(at("comparables")).alias("n_shown"),
        at("comparables[0].listing_id").cast("long").alias("nearest"), F.json_array_length(at("risk_signals")).alias("n_signals"),
        F.regexp_replace(at("limitations"), r'[\[\]"]', "").alias("limitations"),
    ).join(more, "subject_id")


BUNDLES_SQL = """
, shown AS (SELECT subject_id, CAST(count(*) FILTER (rank <= 10) AS INTEGER) AS n_shown, min_by(listing_id, rank) AS nearest FROM chosen GROUP BY 1),
n AS (SELECT subject_id, CAST(count(*) AS INTEGER) AS n_signals FROM weighed GROUP BY 1)
SELECT r.subject_id, 22 AS n_keys, rating, central, coalesce(n_shown, 0) AS n_shown, nearest, coalesce(n_signals, 0) AS n_signals,
  concat_ws(',', 'LISTING_DATA_ONLY', 'ASKING_PRICES', CASE WHEN r.subject_id % 3 = 0 THEN 'NO_VIN' END, 'NO_HISTORY',
    CASE WHEN widened THEN 'WIDENED' END, 'NOT_CALIBRATED') AS limitations,
  array_to_string(list_slice(list_filter([CASE WHEN s_displacement_l IS NULL THEN 'SPECIFY_DISPLACEMENT_L' END,
    CASE WHEN s_fuel = 'UNKNOWN' THEN 'SPECIFY_FUEL' END, CASE WHEN s_drivetrain = 'UNKNOWN' THEN 'SPECIFY_DRIVETRAIN' END,
    CASE WHEN s_body = 'UNKNOWN' THEN 'SPECIFY_BODY' END, 'SPECIFY_ENGINE_CODE',
    CASE WHEN outcome = 'OK' AND round(effective_size / (effective_size + 18e0), 4) < 5e-1 THEN 'WAIT_FOR_LISTINGS' END], lambda x: x IS NOT NULL), 1, 5), ',') AS improvements
FROM rated r LEFT JOIN shown s ON r.subject_id = s.subject_id LEFT JOIN n ON r.subject_id = n.subject_id
"""


def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports made from the subjects' figures with faults dealt by id, and what the check finds."""
    facts, moves = appraisal._facts(spark, sf_dir)
    rows = materialise(_appraised(facts, moves), "appraised")
    key = F.col("subject_id")
    claim = lambda text: F.array(F.struct(F.lit("risk_signals").alias("group"), F.lit("FACT").alias("kind"), text.alias("statement")))
    said = F.when(key % 6 == 0, "The car was in an accident").otherwise("The seller states an accident")
    reports = rows.select(
        "subject_id",
        F.when(key % 4 == 0, F.coalesce("central", F.lit(5000.0)) * 1.02).otherwise(F.col("central")).alias("central"),
        "low", "high", F.col("s_price").alias("asking"), "difference_pct",
        (F.round(F.col("confidence") * 100) + F.when(key % 3 == 0, 5).otherwise(0)).alias("confidence"),
        F.when(key % 5 == 0, "FAIR_VALUE").otherwise(F.col("rating")).alias("rating"),
        F.concat_ws(" ", F.lit("The estimate is"), F.col("central").cast("long"), F.when(key % 7 == 0, "not 7777777"), F.when(key % 11 == 0, "so do not buy it")).alias("prose"),
        F.when(key % 2 == 0, claim(said)).otherwise(F.array().cast("array<struct<group:string,kind:string,statement:string>>")).alias("claims"),
        F.when(key % 9 != 0, F.array(F.lit("LISTING_DATA_ONLY"))).otherwise(F.array().cast("array<string>")).alias("limitations"),
    )
    told = rows.select("subject_id", F.concat_ws(" ", F.col("central").cast("long"), F.col("low").cast("long"), F.col("high").cast("long")).alias("bundle"))
    found = evidence.validate(reports, rows, evidence.vouched(told))
    return found.select("subject_id", F.array_join("findings", ",").alias("findings"))


FINDINGS_SQL = """
SELECT subject_id, concat_ws(',',
  CASE WHEN subject_id % 4 = 0 THEN CASE WHEN central IS NULL THEN 'INVENTED_FIGURE:central' ELSE 'FIGURE_MISMATCH:central' END END,
  CASE WHEN subject_id % 3 = 0 THEN 'FIGURE_MISMATCH:confidence' END,
  CASE WHEN subject_id % 5 = 0 AND rating <> 'FAIR_VALUE' THEN 'RATING_MISMATCH' END,
  CASE WHEN subject_id % 7 = 0 THEN 'UNSUPPORTED_NUMBER' END, CASE WHEN subject_id % 6 = 0 THEN 'OVERSTATED_CLAIM' END,
  CASE WHEN n_grave > 0 AND subject_id % 2 <> 0 THEN 'OMITTED_RISK' END,
  CASE WHEN subject_id % 9 = 0 THEN 'MISSING_LIMITATIONS' END, CASE WHEN subject_id % 11 = 0 THEN 'FORBIDDEN_PHRASE' END) AS findings
FROM rated
"""


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("subject_id", evidence.narrative().alias("narrative"))


NARRATIVES_SQL = """
SELECT subject_id, CASE WHEN outcome <> 'OK' THEN format('Only {} comparable listings: no estimate.', size) ELSE
  format('Central estimate {:,.0f}, range {:,.0f} to {:,.0f}. ', central, low, high)
  || format('Asked {:,.0f}: {:,.1f} per cent against the estimate. ', s_price, difference_pct)
  || 'Rated ' || replace(lower(rating), '_', ' ') || '. Risk score ' || risk_score || '.' END AS narrative FROM rated
"""


# Saved items


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests to save a configuration."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("saved_id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("cfg_"), (key % 7).cast("string")).alias("config_id"),
        (key * 10 + 1).alias("listing_id"), F.when(key % 6 != 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise("  ").alias("label"),
        F.col("o_totalprice").alias("target_price"), F.when(key % 3 != 0, F.col("o_totalprice") / 4).alias("last_seen_price"),
        (key % 2 == 0).alias("notify_on_price_drop"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def _parted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items saved in the first years, and later requests."""
    wanted, since = _wanted(spark, sf_dir), F.lit("1998-01-01").cast("timestamp_ntz")
    first = saved.add(wanted.limit(0), wanted.filter(F.col("created_at") < since))
    return first.filter("outcome = 'added'").drop("outcome"), wanted.filter(F.col("created_at") >= since)


WANTED_SQL = """
wanted AS (
  SELECT o_orderkey AS saved_id, o_custkey AS user_id, 'cfg_' || (o_orderkey % 7) AS config_id, o_orderkey * 10 + 1 AS listing_id,
    CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS label, o_totalprice AS target_price,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 4 END AS last_seen_price, o_orderkey % 2 = 0 AS notify_on_price_drop, o_orderdate AS created_at
  FROM orders
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, config_id, created_at < TIMESTAMP '1998-01-01' ORDER BY created_at, saved_id) AS nth,
    bool_or(created_at < TIMESTAMP '1998-01-01') OVER (PARTITION BY user_id, config_id) AS early FROM wanted
), held AS (SELECT * FROM numbered WHERE created_at < TIMESTAMP '1998-01-01' AND nth = 1)"""


def saved_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, later = _parted(spark, sf_dir)
    return saved.add(held, later).select("saved_id", "user_id", "config_id", "label", "outcome")


ADDED_SQL = """
SELECT saved_id, user_id, config_id, label, 'kept' AS outcome FROM held
UNION ALL SELECT saved_id, user_id, config_id, label, CASE WHEN early OR nth > 1 THEN 'already_saved' ELSE 'added' END
FROM numbered WHERE created_at >= TIMESTAMP '1998-01-01'
"""


def saved_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _ = _parted(spark, sf_dir)
    key = F.col("saved_id")
    owner = F.when(key % 8 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))  # some patches name another user
    chosen = held.filter(key % 4 == 0)
    patches = chosen.select(
        "saved_id", owner.alias("user_id"), F.when(key % 12 == 0, " ").when(key % 12 == 4, " new ").alias("label"),
        F.when(key % 5 == 0, F.lit(1.0)).alias("target_price"),
    )
    unwanted = held.filter(key % 10 == 0).select("saved_id", owner.alias("user_id"))
    return saved.remove(saved.change(held, patches, market.as_of()), unwanted).select("saved_id", "label", "target_price", "updated_at")


CHANGED_SQL = f"""
SELECT saved_id, CASE WHEN saved_id % 8 = 4 AND saved_id % 12 = 0 THEN NULL WHEN saved_id % 8 = 4 AND saved_id % 12 = 4 THEN 'new' ELSE label END AS label,
  CASE WHEN saved_id % 8 = 4 AND saved_id % 5 = 0 THEN 1e0 ELSE target_price END AS target_price,
  CASE WHEN saved_id % 8 = 4 THEN {_AT} END AS updated_at
FROM held WHERE NOT (saved_id % 10 = 0 AND saved_id % 8 <> 0)
"""


def saved_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's list: that of the customer with the least key."""
    return saved.of_user(_parted(spark, sf_dir)[0], F.lit(1)).select("saved_id", "user_id", "config_id", "created_at")


LIST_SQL = "\nSELECT saved_id, user_id, config_id, created_at FROM held WHERE user_id = 1 ORDER BY created_at DESC, saved_id DESC\n"


def saved_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved.price_alerts(_parted(spark, sf_dir)[0], market.listings(spark, sf_dir))


ALERTS_SQL = """
SELECT saved_id, user_id, h.listing_id, target_price, last_seen_price, price, source_url FROM held h JOIN listings l ON h.listing_id = l.listing_id
WHERE notify_on_price_drop AND (last_seen_price IS NULL OR price < last_seen_price)
"""


# Dated snapshots and contexts


def _configurations(rows: DataFrame) -> DataFrame:
    return rows.select("model_key", F.concat_ws(" ", "make", "model").alias("label")).distinct()


def market_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of two days, the later written twice, and what a conversation reads of the latest day."""
    rows = market.listings(spark, sf_dir)
    path = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    for days in (30, 0, 0):
        at = snapshots.days_before(market.as_of(), days)
        built = snapshots.build(rows, at, windows=(180,), scopes=(snapshots.NATIONAL,))
        snapshots.write(snapshots.dated(built, at), path)
    stored = spark.read.parquet(path)
    return rounded(context.market(stored, _configurations(rows)))


CONTEXT_SQL = f"""
SELECT s.model_key, CAST({_AT} AS DATE) AS snapshot_date, sample_size, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75,
  median_mileage_km, label
FROM snapshots s JOIN (SELECT DISTINCT model_key, make || ' ' || model AS label FROM listings) c ON s.model_key = c.model_key
WHERE scope = 'ALL' AND window_days = 180
"""


def _with_config(rows: DataFrame) -> DataFrame:
    """Listings with a configuration each, but for some."""
    return rows.withColumn("config_id", F.when(F.col("listing_id") % 9 != 0, F.concat_ws("|", "make", "model", "generation")))


def listing_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_config(market.listings(spark, sf_dir))
    configurations = rows.select("config_id", F.col("config_id").alias("label")).filter("config_id is not null").distinct()
    return context.listing(rows, configurations)


LISTING_CONTEXT_SQL = """
SELECT make || '|' || model || '|' || generation AS config_id, listing_id, price, mileage_km, city, damage, description,
  make || '|' || model || '|' || generation AS label FROM listings WHERE listing_id % 9 <> 0
"""


def resolved_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_config(market.listings(spark, sf_dir))
    known = rows.filter("config_id is not null").select("config_id", F.lower("make").alias("make"), F.lower("model").alias("model")).distinct()
    return context.configuration(rows, known)


RESOLVED_SQL = """
SELECT listing_id, CASE WHEN listing_id % 9 <> 0 THEN lower(make) ELSE split_part(model_key, '|', 1) END AS make,
  CASE WHEN listing_id % 9 <> 0 THEN lower(model) ELSE split_part(model_key, '|', 2) END AS model, listing_id % 9 <> 0 AS resolved FROM listings
"""


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, with orders or without, by the number of their orders."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return context.profiles(users, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")))


PROFILES_SQL = """
SELECT c_custkey AS user_id, c_name AS name, coalesce(n, 0) AS analyses,
  CASE WHEN n IS NULL THEN 'none' WHEN n < 5 THEN 'some' ELSE 'knows' END AS familiarity
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey
"""


def _request_fields() -> dict[str, Column]:
    key = F.col("o_orderkey")
    vin = F.when(key % 5 == 0, F.lit(None)).otherwise(F.concat(F.lpad(key.cast("string"), 15, "W"), F.element_at(F.array(*map(F.lit, ("AA", "IQ", " b", "CCC"))), (key % 4 + 1).cast("int"))))
    return {"vin": vin, "mileage_km": key * 50 - 100, "price": F.col("o_totalprice") - 1000, "currency": F.element_at(F.array(*map(F.lit, ("AZN", "USD", "GBP"))), (key % 3 + 1).cast("int"))}


def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in _request_fields().items()))
    found = context.request_errors(*(F.col(n) for n in _request_fields()))
    code = context.member(F.col("currency"), context.CURRENCIES, "AZN")
    return rows.select("o_orderkey", F.array_join(found, ",").alias("errors"), code.alias("currency"))


REQUESTS_SQL = """
, r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN upper(trim(lpad(CAST(o_orderkey AS VARCHAR), 15, 'W') || (['AA', 'IQ', ' b', 'CCC'])[o_orderkey % 4 + 1])) END AS vin,
  o_orderkey * 50 - 100 AS km, o_totalprice - 1000 AS price, (['AZN', 'USD', 'GBP'])[o_orderkey % 3 + 1] AS currency FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN vin <> '' AND length(vin) <> 17 THEN 'VIN_LENGTH' END,
  CASE WHEN length(vin) = 17 AND NOT regexp_matches(vin, '^[A-HJ-NPR-Z0-9]{17}$') THEN 'VIN_CHARACTERS' END,
  CASE WHEN km < 0 OR km > 2000000 THEN 'MILEAGE_RANGE' WHEN km > 1500000 THEN 'MILEAGE_IMPLAUSIBLE' END,
  CASE WHEN price < 0 THEN 'PRICE_NEGATIVE' END, CASE WHEN currency NOT IN ('AZN', 'USD', 'EUR') THEN 'CURRENCY' END) AS errors,
  CASE WHEN currency IN ('AZN', 'USD', 'EUR') THEN currency ELSE 'AZN' END AS currency FROM r
"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed listings as sales at nine tenths or more of what was asked."""
    rows = market.listings(spark, sf_dir).filter("status = 'REMOVED'")
    sales = rows.select("model_key", F.col("listing_id").alias("sale_id"), F.col("last_seen").alias("sold_at"), (F.col("price") * 0.9).alias("price"), F.when(F.col("listing_id") % 8 != 0, F.col("price")).otherwise(0.0).alias("asked"))
    return rounded(context.transactions(sales, F.lit("1997-01-01").cast("timestamp_ntz"), 180, 20))


TRANSACTIONS_SQL = """
SELECT model_key, sale_id, sold_at, round(price, 4) AS price, asked, round((price - asked) / nullif(asked, 0) * 100, 4) AS discount_pct FROM (
  SELECT model_key, listing_id AS sale_id, last_seen AS sold_at, price * CAST(0.9 AS DOUBLE) AS price, CASE WHEN listing_id % 8 <> 0 THEN price ELSE 0e0 END AS asked,
    row_number() OVER (PARTITION BY model_key ORDER BY last_seen DESC, listing_id DESC) AS rn
  FROM listings WHERE status = 'REMOVED' AND last_seen >= TIMESTAMP '1997-01-01' - INTERVAL 365 DAY) WHERE rn <= 20
"""


def presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, scales and axes of a report's charts, and its adjustments by whether they apply."""
    c = F.col
    *_, valued = appraisal._valued(spark, sf_dir)
    names = ("mileage", "age", "geography", "disclosure")
    made = F.array(*(F.struct(F.lit(n).alias("name"), c(f"{n}_reason").alias("reason"), c(f"{n}_amount").alias("amount")) for n in names))
    rows = valued.filter("outcome = 'OK'").withColumns({"axis": context.axis(c("low"), c("high")), "split": context.split_adjustments(made)})
    return rounded(
        rows.select(
            "subject_id", context.position(c("central"), c("low"), c("high")).alias("position"),
            context.waterfall_scale(*(c(f"{n}_amount") for n in names)).alias("scale"),
            c("axis")["from"].alias("axis_from"), c("axis")["to"].alias("axis_to"),
            F.array_join(F.transform(c("split")["applied"], lambda a: a["name"]), ",").alias("applied"),
            F.size(c("split")["unavailable"]).alias("unavailable"),
        )
    )


PRESENTATION_SQL = """
SELECT subject_id, round(CASE WHEN high > low THEN greatest(0e0, least(100e0, (central - low) * 100 / (high - low))) ELSE 50e0 END, 4) AS position,
  greatest(1e0, abs(mileage_amount), abs(age_amount), abs(geography_amount), abs(disclosure_amount)) AS scale,
  round(greatest(0e0, low - CASE WHEN high > low THEN (high - low) * 8e-2 ELSE high * 5e-2 END), 4) AS axis_from,
  round(high + CASE WHEN high > low THEN (high - low) * 8e-2 ELSE high * 5e-2 END, 4) AS axis_to,
  concat_ws(',', CASE WHEN mileage_reason = 'APPLIED' THEN 'mileage' END, CASE WHEN age_reason = 'APPLIED' THEN 'age' END,
    CASE WHEN geography_reason = 'APPLIED' THEN 'geography' END, CASE WHEN disclosure_reason = 'APPLIED' THEN 'disclosure' END) AS applied,
  (mileage_reason <> 'APPLIED')::INT + (age_reason <> 'APPLIED')::INT + (geography_reason <> 'APPLIED')::INT + (disclosure_reason <> 'APPLIED')::INT AS unavailable
FROM valued WHERE outcome = 'OK'
"""


# Listing pages: the listings rendered as pages of the site, with raw words dealt by id

_RAW = {
    "make": ("Mersedes", "BMW", "Хендай", "Zaporozhets"),
    "model": ("5 Series", "Camry", "E 220", "Solaris salon"),
    "city": ("Bakı", "Баку", "Gəncə", "Atlantis", "Sumqayıt"),
    "engine": ("2.0 L / 249 a.g. / Benzin", "1998 sm3 / 110 a.g. / Dizel", "1.6 L / 90 a.g. / Hibrid"),
    "transmission": ("Avtomat", "Mexaniki", "Робот", "Variator"),
    "drivetrain": ("Ön", "Arxa", "Tam", "Полный"),
    "body": ("Sedan", "Offroader / SUV, 5 qapı", "SUV Kupe", "Avtobus", "Universal, 5 qapı"),
    "condition": ("Vuruğu yoxdur, rənglənməyib", "Vuruğu var, rənglənib", ""),
}
_LABELS = {"make": "Marka", "model": "Модель", "model_year": "Buraxılış ili", "mileage_km": "Yürüş", "city": "Şəhər", "engine": "Mühərrik", "transmission": "Sürətlər qutusu", "drivetrain": "Ötürücü", "body": "Ban növü", "condition": "Vəziyyəti"}


def _landed(rows: DataFrame) -> DataFrame:
    key = F.col("listing_id")
    raw = {n: F.element_at(F.array(*map(F.lit, words)), (F.floor(key / 10) % len(words) + 1).cast("int")) for n, words in _RAW.items()}
    raw |= {"model_year": F.col("model_year").cast("string"), "mileage_km": F.concat(F.format_number("mileage_km", 0), F.lit(" km"))}
    spans = [
        F.when(raw[n] != "", F.concat(F.lit(f'<span class="product-properties__i-name">{label}</span><span class="product-properties__i-value"><a href="#">'), raw[n], F.lit("</a></span>\n")))
        for n, label in _LABELS.items()
        if n != "engine"
    ]
    engine = F.concat(F.lit('<span class="product-properties__i-name">Mühərrik</span><span class="product-properties__i-value">'), raw["engine"], F.lit("</span>\n"))
    price = F.when(key % 13 != 0, F.concat(F.lit('<div class="product-price__i product-price__i--bold">'), F.format_number(F.floor("price"), 0), F.when(key % 2 == 0, " AZN").otherwise(" USD"), F.lit("</div>\n")))
    badge = F.when(key % 3 == 0, '<div class="product-shop__owner-featured">Salon</div>\n')
    text = F.concat(F.lit('<div class="product-description__content">'), "description", F.lit("</div>"))
    link = F.when(key % 7 != 0, F.concat(F.lit('<link rel="canonical" href="https://lots.example/autos/'), key.cast("string"), F.lit('-x">\n')))
    return rows.select(key.alias("page_id"), F.concat(F.lit("https://lots.example/autos/"), key.cast("string")).alias("url"), F.concat_ws("", link, price, *spans, engine, badge, text).alias("html"))


def listing_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing_pages.parse(_landed(market.listings(spark, sf_dir)))
    return rows.drop("url", "raw", "description").withColumns({c: F.array_join(c, ",") for c in ("missing", "errors", "unmapped")})


def _raw_sql(name: str) -> str:
    words = ", ".join(f"'{w}'" for w in _RAW[name])
    return f"([{words}])[(listing_id // 10) % {len(_RAW[name])} + 1]"


def _key_sql(expr: str) -> str:
    cyrillic = rf"trim(regexp_replace(regexp_replace(lower({expr}), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"CASE WHEN regexp_matches({expr}, '[А-яЁё]') THEN {cyrillic} ELSE {ingestion._FOLD.format(expr)} END"


def _map_sql(found: dict[str, object], key: str) -> str:
    pairs = ", ".join(f"'{k}': {v!r}" for k, v in found.items())
    return f"map_extract(MAP {{{pairs}}}, {key})[1]"


def _look_sql(table_of: dict[str, str], expr: str) -> str:
    return _map_sql(vocabulary.spellings(table_of), _key_sql(expr))


_MAKE_NAMES = vocabulary.spellings({m: (m.lower().replace("-", " "), *keys) for m, keys in vocabulary.MAKES.items()})
_ALIASES = {f"{m}|{key}": name for m, t in vocabulary.MODEL_ALIASES.items() for key, name in vocabulary.spellings(t).items()}
_BODY_ORDER = list(vocabulary.BODIES)
_BODY_RANKS = {k: _BODY_ORDER.index(v) + 1 for k, v in vocabulary.spellings(vocabulary.BODIES).items()}
_LITRES = "TRY_CAST(regexp_extract(raw_engine, '[0-9]+(?:[.,][0-9]+)?') AS DOUBLE)"
RAW_SQL = f"""
raws AS (
  SELECT *, listing_id % 7 = 0 AND listing_id < 1000 AS nameless, {", ".join(f"{_raw_sql(n)} AS raw_{n}" for n in _RAW)} FROM listings
), keyed AS (
  SELECT *, {_map_sql(_MAKE_NAMES, _key_sql("raw_make"))} AS k_make, {_key_sql("raw_body")} AS k_body, split_part(raw_engine, ' / ', 3) AS raw_fuel,
    trim(regexp_replace(regexp_replace({ingestion._FOLD.format("raw_model")}, '\\b({vocabulary.MODEL_NOISE})\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS bare
  FROM raws
), stated AS (
  SELECT *, {ingestion._FOLD.format("raw_condition")} AS c_folded, lower(raw_condition) AS c_low,
    {ingestion._FOLD.format("description")} AS d_folded, lower(description) AS d_low,
    coalesce({_map_sql(_ALIASES, "k_make || '|' || bare")}, upper(bare)) AS k_model,
    coalesce({_map_sql(vocabulary.spellings(vocabulary.BODIES), "k_body")},
      ([{", ".join(f"'{b}'" for b in _BODY_ORDER)}])[list_min(list_transform(string_split(k_body, ' '), lambda w: {_map_sql(_BODY_RANKS, "w")}))], 'UNKNOWN') AS k_body_name,
    {_look_sql(vocabulary.CITIES, "raw_city")} AS k_city
  FROM keyed
)"""
_READ_C, _READ_D = ingestion.readings_sql("c_folded", "c_low"), ingestion.readings_sql("d_folded", "d_low")
PAGE_SQL = f"""
SELECT listing_id AS page_id, CASE WHEN listing_id % 13 <> 0 AND NOT nameless THEN CAST(listing_id AS VARCHAR) END AS listing_id,
  CASE WHEN listing_id % 13 <> 0 THEN floor(price) END AS price,
  CASE WHEN listing_id % 13 <> 0 THEN CASE WHEN listing_id % 2 = 0 THEN 'AZN' ELSE 'USD' END END AS currency,
  mileage_km, k_city AS city, k_make AS make, k_model AS model, CAST(model_year AS INTEGER) AS model_year,
  round(CASE WHEN {_LITRES} > 100 THEN {_LITRES} / 1000 ELSE {_LITRES} END, 1) AS displacement_l,
  coalesce({_look_sql(vocabulary.TABLES["fuel"], "raw_fuel")}, 'UNKNOWN') AS fuel,
  coalesce({_look_sql(vocabulary.TABLES["transmission"], "raw_transmission")}, 'UNKNOWN') AS transmission,
  coalesce({_look_sql(vocabulary.TABLES["drivetrain"], "raw_drivetrain")}, 'UNKNOWN') AS drivetrain,
  k_body_name AS body, CASE WHEN listing_id % 3 = 0 THEN coalesce({_look_sql(vocabulary.TABLES["seller_type"], "'Salon'")}, 'UNKNOWN') ELSE 'UNKNOWN' END AS seller_type,
  coalesce({_READ_C["damage"]}, {_READ_D["damage"]}) AS damage, coalesce({_READ_C["repaint"]}, {_READ_D["repaint"]}) AS repaint,
  concat_ws(',', CASE WHEN listing_id % 7 = 0 THEN 'external_id' END, CASE WHEN listing_id % 13 = 0 THEN 'price' END,
    CASE WHEN listing_id % 3 <> 0 THEN 'seller_type' END, CASE WHEN raw_condition = '' THEN 'condition' END) AS missing,
  concat_ws(',', CASE WHEN nameless THEN 'NO_IDENTIFIER' END, CASE WHEN listing_id % 13 = 0 THEN 'NO_PRICE' END) AS errors,
  concat_ws(',', CASE WHEN k_make IS NULL THEN 'make:' || raw_make END, CASE WHEN k_city IS NULL THEN 'city:' || raw_city END) AS unmapped
FROM stated
"""


def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule finds on each page; of descriptions the length."""
    found = listing_pages.rule_matches(_landed(market.listings(spark, sf_dir)))
    value = F.when(F.col("field") == "description", F.char_length("value").cast("string")).otherwise(F.col("value"))
    return found.select("page_id", "field", value.alias("value"))


MATCHES_SQL = """
SELECT listing_id AS page_id, unnest(['external_id', 'price', 'make', 'model', 'model_year', 'mileage_km', 'city', 'fuel', 'transmission', 'drivetrain',
    'body', 'engine', 'seller_type', 'description', 'condition']) AS field,
  unnest([CASE WHEN listing_id % 7 <> 0 THEN CAST(listing_id AS VARCHAR) END,
    CASE WHEN listing_id % 13 <> 0 THEN format('{:,}', CAST(floor(price) AS BIGINT)) || CASE WHEN listing_id % 2 = 0 THEN ' AZN' ELSE ' USD' END END,
    raw_make, raw_model, CAST(model_year AS VARCHAR), format('{:,}', mileage_km) || ' km', raw_city, split_part(raw_engine, ' / ', 3), raw_transmission, raw_drivetrain,
    raw_body, raw_engine, CASE WHEN listing_id % 3 = 0 THEN 'Salon' END, CAST(nullif(length(description), 0) AS VARCHAR), nullif(raw_condition, '')]) AS value
FROM raws
"""


def payload_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations stored when bodies of several words were unknown, against what the payloads say today."""
    rows = listing_pages.parse(_landed(market.listings(spark, sf_dir)))
    known = {n: F.col(n) for n in ("make", "model", "model_year", "displacement_l", "fuel", "transmission", "drivetrain", "body")}
    once = F.when(F.element_at("raw", "body").contains(" "), "UNKNOWN").otherwise(F.col("body"))
    old = rows.withColumn("body", once).withColumn("config_id", normalise.identity(known)["config_id"])
    return listing_pages.replay_report(listing_pages.replay(old.select("page_id", "config_id", "body", "raw")))


REPLAY_SQL = """
SELECT CASE WHEN k_make IS NULL THEN 'unresolved' WHEN was = k_body_name THEN 'same' ELSE 'changed' END AS verdict, was AS body, k_body_name AS new_body, count(*) AS n
FROM (SELECT *, CASE WHEN contains(raw_body, ' ') THEN 'UNKNOWN' ELSE k_body_name END AS was FROM stated) GROUP BY 1, 2, 3
"""


def page_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages table in page order, up to the first page without a fresh link."""
    index = pages.read("pages", spark, sf_dir).select(F.col("page_id").alias("page"), "html")
    return listing_pages.discover(index, r"href=\"(/[^\"#]+)\"")


DISCOVERY_SQL = """
, f AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"#]+)"', 1))) AS link FROM pages),
g AS (SELECT link, min(page_id) AS page FROM f GROUP BY 1),
stop AS (SELECT min(page_id) AS s FROM pages WHERE page_id NOT IN (SELECT page FROM g))
SELECT link, page FROM g, stop WHERE s IS NULL OR page < s
"""


def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction rates of the rendered pages by make, and whether a run with them must stop."""
    rows = listing_pages.parse(_landed(market.listings(spark, sf_dir)))
    failures = F.avg(F.when(F.size("errors") > 0, 1.0).otherwise(0.0))
    rates = materialise(state.extraction_rates(rows, ["price", "make", "model"], also={"failures": failures}), "rates")  # a row per field
    failed = rates.agg(F.max("failures").alias("failures"))
    return rounded(state.should_abort(rates, F.col("failures")).join(failed, F.lit(True)))


HEALTH_SQL = """
SELECT count(*) AS pages, count(*) >= 25 AND (avg(CASE WHEN k_make IS NULL THEN 0e0 ELSE 1e0 END) < 6e-1
    OR avg(CASE WHEN listing_id % 13 = 0 THEN 0e0 ELSE 1e0 END) < 6e-1 OR 1 - avg(CASE WHEN nameless OR listing_id % 13 = 0 THEN 1e0 ELSE 0e0 END) < 5e-1) AS abort,
  round(avg(CASE WHEN nameless OR listing_id % 13 = 0 THEN 1e0 ELSE 0e0 END), 4) AS failures FROM stated
"""


# Smaller ones


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness and verified share of the entities whose values the events give, against five fields."""
    return rounded(provenance.completeness(ingestion.attribute_values(spark, sf_dir), 5))


COMPLETENESS_SQL = f"""
SELECT entity, count(*) / 5e0 AS completeness, round(avg(CASE WHEN status = 'VERIFIED' THEN 1e0 ELSE 0e0 END), 4) AS verified_share,
  CAST(sum(conflicts) AS BIGINT) AS conflicts FROM ({ingestion.VALUES_SQL}) GROUP BY 1
"""


def price_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each listing's price is from the median of its model: in sigmas and in per cent."""
    rows = market.listings(spark, sf_dir)
    level = stats.spread(rows, ["model_key"], "price").select("model_key", "median", "sigma")
    both = rows.select("listing_id", "model_key", "price").join(level, "model_key")
    return rounded(both.select("listing_id", stats.modified_z(F.col("price"), F.col("median"), F.col("sigma")).alias("z"), provenance.pct_difference(F.col("price"), F.col("median")).alias("pct")))


SCORES_SQL = """
, m AS (SELECT model_key, median(price) AS mid FROM listings GROUP BY 1),
d AS (SELECT l.model_key, any_value(mid) AS mid, CASE WHEN median(abs(price - mid)) > 0 THEN CAST(1.4826 AS DOUBLE) * median(abs(price - mid))
  ELSE CAST(1.2533 AS DOUBLE) * avg(abs(price - mid)) END AS sigma FROM listings l JOIN m ON l.model_key = m.model_key GROUP BY 1)
SELECT listing_id, round(CASE WHEN sigma > 0 THEN (price - mid) / sigma ELSE 0e0 END, 4) AS z, round((price - mid) / nullif(mid, 0) * 100, 4) AS pct
FROM listings l JOIN d ON l.model_key = d.model_key
"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.round(F.col("price") * 100).cast("long"), F.col("mileage_km"), F.col("city"), F.col("status"), F.col("damage")]
    return market.listings(spark, sf_dir).select("listing_id", normalise.fingerprint(parts, F.col("description")).alias("fingerprint"))


FINGERPRINTS_SQL = """
SELECT listing_id, substr(sha256(concat_ws('|', CAST(round(price * 100) AS BIGINT), mileage_km, city, status, coalesce(CAST(damage AS VARCHAR), 'None'),
  substr(sha256(description), 1, 16))), 1, 32) AS fingerprint FROM listings
"""


def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", normalise.normalise_email(F.concat(F.lit(" "), "c_name", F.lit("@Lots.Example "))).alias("email"), normalise.thousands(F.col("c_acctbal")).alias("balance"))


FORMATTED_SQL = """
SELECT c_custkey, lower(c_name) || '@lots.example' AS email, CASE WHEN round(c_acctbal) = 0 THEN '0' ELSE format('{:,}', CAST(round(c_acctbal) AS BIGINT)) END || ' AZN' AS balance FROM customer
"""


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of shipping as ingestion runs: the last one."""
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("started_at")).agg(F.count("*").alias("listings_seen"), F.max("l_orderkey").alias("run_id"))
    return state.latest_run(runs)


RUN_SQL = "SELECT l_shipdate AS started_at, count(*) AS listings_seen, max(l_orderkey) AS run_id FROM lineitem GROUP BY 1 ORDER BY 1 DESC, 3 DESC LIMIT 1"

_L = market.LISTINGS_SQL
QUERIES = {
    "inspection_plans": inspection_plans,
    "bundles": bundles,
    "report_findings": report_findings,
    "narratives": narratives,
    "saved_added": saved_added,
    "saved_changed": saved_changed,
    "saved_list": saved_list,
    "saved_alerts": saved_alerts,
    "market_context": market_context,
    "listing_context": listing_context,
    "resolved_configurations": resolved_configurations,
    "user_profiles": user_profiles,
    "request_errors": request_errors,
    "transactions": transactions,
    "presentation": presentation,
    "listing_page_fields": listing_page_fields,
    "rule_matches": rule_matches,
    "payload_replay": payload_replay,
    "page_discovery": page_discovery,
    "run_health": run_health,
    "completeness": completeness,
    "price_scores": price_scores,
    "fingerprints": fingerprints,
    "formatted": formatted,
    "latest_run": latest_run,
}
ORACLE_SQL = {
    "inspection_plans": _twin(INSPECTION_SQL, *_WHOLE_ALL),
    "bundles": _twin(BUNDLES_SQL, *_WHOLE_ALL),
    "report_findings": _twin(FINDINGS_SQL, *_ALL),
    "narratives": _twin(NARRATIVES_SQL, *_ALL),
    "saved_added": _twin(ADDED_SQL, WANTED_SQL),
    "saved_changed": _twin(CHANGED_SQL, WANTED_SQL),
    "saved_list": _twin(LIST_SQL, WANTED_SQL),
    "saved_alerts": _twin(ALERTS_SQL, WANTED_SQL, _L),
    "market_context": _twin(CONTEXT_SQL, _L, SNAPSHOTS_SQL),
    "listing_context": _twin(LISTING_CONTEXT_SQL, _L),
    "resolved_configurations": _twin(RESOLVED_SQL, _L),
    "user_profiles": PROFILES_SQL,
    "request_errors": _twin(REQUESTS_SQL, "one AS (SELECT 1)"),
    "transactions": _twin(TRANSACTIONS_SQL, _L),
    "presentation": _twin(PRESENTATION_SQL, *appraisal._BASE, appraisal.VALUED_SQL),
    "listing_page_fields": _twin(PAGE_SQL, _L, RAW_SQL),
    "rule_matches": _twin(MATCHES_SQL, _L, RAW_SQL),
    "payload_replay": _twin(REPLAY_SQL, _L, RAW_SQL),
    "page_discovery": _twin(DISCOVERY_SQL, "one AS (SELECT 1)"),
    "run_health": _twin(HEALTH_SQL, _L, RAW_SQL),
    "completeness": COMPLETENESS_SQL,
    "price_scores": _twin(SCORES_SQL, _L),
    "fingerprints": _twin(FINGERPRINTS_SQL, _L),
    "formatted": FORMATTED_SQL,
    "latest_run": RUN_SQL,
}

"""The keyed listing state with its transition log, plausibility checks, extraction health and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .snapshots import days_before

# Plausible bounds
MIN_PRICE, MAX_PRICE = 300, 3_000_000
MAX_MILEAGE = 1_500_000
MIN_YEAR, YEARS_AHEAD = 1950, 2

# When a listing counts as removed, when a run stops
REMOVED_AFTER_DAYS = 3
HEALTH_AFTER = 25
MIN_SUCCESS = 0.5
MIN_FIELD_RATE = 0.6
CRITICAL = ("price", "make", "model")


def issues(observed_year: Column) -> Column:
    """Names of what is implausible about a row (price, mileage_km, model_year, make, model)."""
    c = F.col
    found = F.array(
        F.when((c("price") < MIN_PRICE) | (c("price") > MAX_PRICE), "IMPLAUSIBLE_PRICE"),
        F.when(c("mileage_km") > MAX_MILEAGE, "IMPLAUSIBLE_MILEAGE"),
        F.when((c("model_year") < MIN_YEAR) | (c("model_year") > observed_year + YEARS_AHEAD), "IMPLAUSIBLE_YEAR"),
        F.when(F.coalesce(c("make"), F.lit("")).isin("") | F.coalesce(c("model"), F.lit("")).isin(""), "UNRESOLVABLE"),
    )
    return F.filter(found, lambda i: i.isNotNull())


def issue_details(observed_year: Column) -> Column:
    """``issues`` with what is wrong about each: structs of issue and detail."""
    c = F.col
    told = lambda text, value: F.format_string(text, value)
    pair = lambda issue, detail: F.struct(F.lit(issue).alias("issue"), detail.alias("detail"))
    price, km, year = F.format_number("price", 0), F.format_number("mileage_km", 0), c("model_year").cast("int")
    price = F.when(price == "-0", "0").otherwise(price)  # what is rounded up to nothing has no sign
    found = F.array(
        F.when(c("price") < MIN_PRICE, pair("IMPLAUSIBLE_PRICE", told("%s is too low a price", price))),
        F.when(c("price") > MAX_PRICE, pair("IMPLAUSIBLE_PRICE", told("%s is too high a price", price))),
        F.when(c("mileage_km") > MAX_MILEAGE, pair("IMPLAUSIBLE_MILEAGE", told("%s km, perhaps another unit", km))),
        F.when(year < MIN_YEAR, pair("IMPLAUSIBLE_YEAR", told("year %d is too early", year))),
        F.when(year > observed_year + YEARS_AHEAD, pair("IMPLAUSIBLE_YEAR", told("year %d is yet to come", year))),
        F.when(
            F.coalesce(c("make"), F.lit("")).isin("") | F.coalesce(c("model"), F.lit("")).isin(""),
            pair("UNRESOLVABLE", F.lit("make or model is not known, so there is nothing to compare with")),
        ),
    )
    return F.filter(found, lambda i: i.isNotNull())


def upsert(state: DataFrame, batch: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The next state and what happened to each key, from one full outer join on ``listing_id``.

    ``state``: listing_id, price, mileage_km, description, fingerprint, status, first_seen,
    last_seen.  ``batch`` (one row per key, price null where no exchange rate is known): listing_id,
    price, mileage_km, description, fingerprint, posted_at.  Adds ``outcome`` (created,
    price_changed, updated, unchanged, skipped, or unseen for keys not in the batch) and ``changes``.

    A seen listing becomes active again without an observation; an unknown mileage or an empty
    description never replaces a known one; a row without a price is skipped and not even touched.
    Without ``as_of`` each row of the batch was seen at its own ``observed_at``.
    """
    own = ("price", "mileage_km", "description", "fingerprint", "posted_at", *(("observed_at",) if as_of is None else ()))
    b = batch.select("listing_id", *(F.col(c).alias(f"n_{c}") for c in own), F.lit(True).alias("_in"))
    as_of = F.col("n_observed_at") if as_of is None else as_of
    both = state.withColumn("_old", F.lit(True)).join(b, "listing_id", "full_outer")
    c = F.col
    seen = F.coalesce(c("_in"), F.lit(False)) & c("n_price").isNotNull()
    old = F.coalesce(c("_old"), F.lit(False))
    moved = seen & old & ~c("fingerprint").eqNullSafe(c("n_fingerprint"))
    price = moved & (c("price") != c("n_price"))
    mileage = moved & c("n_mileage_km").isNotNull() & ~c("mileage_km").eqNullSafe(c("n_mileage_km"))
    told = moved & (F.coalesce(c("n_description"), F.lit("")) != "") & ~c("description").eqNullSafe(c("n_description"))
    changes = F.filter(
        F.array(
            F.when(seen & ~old, "FIRST_SEEN"), F.when(price, "PRICE_CHANGE"),
            F.when(mileage, "MILEAGE_CHANGE"), F.when(told, "DESCRIPTION_CHANGE"),
        ),
        lambda x: x.isNotNull(),
    )
    outcome = (
        F.when(F.coalesce(c("_in"), F.lit(False)) & c("n_price").isNull(), "skipped")
        .when(~seen, "unseen")
        .when(~old, "created")
        .when(~moved, "unchanged")
        .when(price, "price_changed")
        .otherwise("updated")
    )
    new = seen & ~old
    return (
        both.filter(old | seen)
        .select(
            "listing_id",
            F.when(new | price, c("n_price")).otherwise(c("price")).alias("price"),
            F.when(new | mileage, c("n_mileage_km")).otherwise(c("mileage_km")).alias("mileage_km"),
            F.when(new | told, c("n_description")).otherwise(c("description")).alias("description"),
            F.when(new | moved, c("n_fingerprint")).otherwise(c("fingerprint")).alias("fingerprint"),
            F.when(seen, "ACTIVE").otherwise(c("status")).alias("status"),
            F.when(new, F.coalesce("n_posted_at", as_of)).otherwise(c("first_seen")).alias("first_seen"),
            F.when(seen, as_of).otherwise(c("last_seen")).alias("last_seen"),
            outcome.alias("outcome"),
            changes.alias("changes"),
        )
    )


def transitions(upserted: DataFrame, as_of: Column) -> DataFrame:
    """The log rows of an upsert: one per change."""
    return upserted.select(
        "listing_id", "price", "mileage_km", "status", F.explode("changes").alias("change_kind"), as_of.alias("observed_at")
    )


def mark_removed(state: DataFrame, seen: DataFrame, as_of: Column, days: int = REMOVED_AFTER_DAYS) -> DataFrame:
    """``state`` with active listings unseen for ``days`` and absent from ``seen`` marked REMOVED (``removed``)."""
    here = seen.select("listing_id").distinct().withColumn("_here", F.lit(True))
    gone = (F.col("status") == "ACTIVE") & (F.col("last_seen") < days_before(as_of, days)) & F.col("_here").isNull()
    joined = state.join(here, "listing_id", "left").withColumn("removed", F.coalesce(gone, F.lit(False)))
    return joined.withColumn("status", F.when(F.col("removed"), "REMOVED").otherwise(F.col("status"))).drop("_here")


def removal_log(marked: DataFrame, as_of: Column) -> DataFrame:
    """The log rows of ``mark_removed``: one STATUS_CHANGE per listing that it removed."""
    rows = marked.filter("removed").select("listing_id", "price", "mileage_km", "status", F.lit("STATUS_CHANGE").alias("change_kind"))
    return rows.withColumn("observed_at", as_of)


def latest_run(runs: DataFrame) -> DataFrame:
    """The ingestion run that started last (ties: the largest id)."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def extraction_rates(parsed: DataFrame, fields: Sequence[str], by: Sequence[str] = (), also: dict[str, Column] | None = None) -> DataFrame:
    """One row per field (and group): share of rows with a value, and whether it is below 0.6.

    ``also``: further aggregates of the rows by name, taken in the same reading.
    """
    more = also or {}
    shares = parsed.groupBy(*by).agg(
        F.count("*").alias("pages"), *(c.alias(n) for n, c in more.items()),
        *(F.avg(F.when(F.col(f).isNotNull(), 1.0).otherwise(0.0)).alias(f) for f in fields),
    )
    long = shares.unpivot([*by, "pages", *more], list(fields), "field", "rate")
    return long.withColumn("degraded", F.col("rate") < MIN_FIELD_RATE)


def should_abort(rates: DataFrame, failures: Column) -> DataFrame:
    """One row: whether a run must stop (from 25 pages: under half parsed, or a critical field degraded)."""
    bad = F.count_if(F.col("degraded") & F.col("field").isin(*CRITICAL)) > 0
    return rates.agg(
        F.max("pages").alias("pages"),
        ((F.max("pages") >= HEALTH_AFTER) & (bad | (1 - F.max(failures) < MIN_SUCCESS))).alias("abort"),
    )


def price_changes(observations: DataFrame, listings: DataFrame, since: Column, kind: str = "PRICE_CHANGE", limit: int = 500) -> DataFrame:
    """Latest changes of one kind since an instant beside their listing, newest first."""
    recent = observations.filter((F.col("observed_at") > since) & (F.col("change_kind") == kind))
    held = listings.select("listing_id", F.col("price").alias("listed_price"), "model_key", "status")
    return recent.join(held, "listing_id").orderBy(F.desc("observed_at"), F.desc("seq")).limit(limit)


def price_drops(observations: DataFrame, listings: DataFrame, since: Column, limit: int = 500) -> DataFrame:
    """The price changes since an instant that lowered the price: below the observation before."""
    order = Window.partitionBy("listing_id").orderBy("observed_at", "seq")
    steps = observations.withColumn("price_before", F.lag("price").over(order)).filter(F.col("price") < F.col("price_before"))
    return price_changes(steps, listings, since, limit=limit)


def orphans(configurations: DataFrame, *referrers: DataFrame, key: str = "config_id") -> DataFrame:
    """Configurations that no referring table names."""
    used = referrers[0].select(key)
    for more in referrers[1:]:
        used = used.unionByName(more.select(key))
    return configurations.join(used.filter(F.col(key).isNotNull()), key, "left_anti")


def replay(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Counts of stored keys that a recomputation confirms, changes, or cannot resolve."""
    both = stored.select("listing_id", F.col("config_id").alias("_before")).join(fresh.select("listing_id", "config_id"), "listing_id")
    verdict = F.when(F.col("config_id").isNull(), "unresolved").when(F.col("_before").eqNullSafe(F.col("config_id")), "same").otherwise("changed")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))

"""Windowed market snapshots per key and region, and what is read from them: finds, recommendations, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import stats

# Windows in days, least sample of a snapshot, of a find; largest gap of a find
WINDOWS = (30, 90, 180)
MIN_SAMPLE = 5
MIN_FIND_SAMPLE = 8
MAX_FIND_GAP = 0.40
NATIONAL = "ALL"
MIN_MOVES = 3

# Phrases of a price that is only a deposit
DEPOSIT_PHRASES = ("ilkin ödəniş", "ilkin odenis", "первоначальный взнос")

# Budget inference
MIN_BUDGET_PRICES = 3
BUDGET_SPREAD = 0.20
ANALYSES_KEPT = 50


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole periods of 24 hours between two instants, 0 at least."""
    seconds = (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000
    return F.greatest(F.floor(seconds), F.lit(0)).cast("long")


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"interval {days} days")


def in_scopes(listings: DataFrame, as_of: Column, windows: Sequence[int] = WINDOWS, scopes: Sequence[str] = ("", NATIONAL)) -> DataFrame:
    """Each listing once per window that it was seen in and per scope ("": its region, which may be UNKNOWN)."""
    age = F.array(*(F.when(F.col("last_seen") >= days_before(as_of, w), w) for w in windows))
    seen = listings.filter((F.col("price") > 0) & (F.col("last_seen") >= days_before(as_of, max(windows))))
    named = F.array(*(F.lit(s) if s else F.coalesce("region", F.lit("UNKNOWN")) for s in scopes))
    return seen.withColumn("window_days", F.explode(F.filter(age, lambda w: w.isNotNull()))).withColumn(
        "scope", F.explode(named)
    )


def build(
    listings: DataFrame, as_of: Column, key: str = "model_key", windows: Sequence[int] = WINDOWS, scopes: Sequence[str] = ("", NATIONAL),
    large: bool = False,
) -> DataFrame:
    """One row per (key, scope, window) with at least five listings.

    Prices are trimmed of outliers first; sample_size, mean,
    quantiles and dispersion come from the trimmed prices, mileage, days on market, new and removed
    counts from all of the scope's listings.  One job for all scopes and windows.  ``large``: a group may have more
    different prices than a task can hold.

    Trimming never leaves fewer than five of the eight or more prices that it needs: of a group's deviations the
    first half and the next one are at most twice their median, which is less than three sigmas.
    """
    keys = [key, "scope", "window_days"]
    rows = in_scopes(
        listings.select(key, "listing_id", "region", "price", "mileage_km", "first_seen", "last_seen", "status"), as_of, windows, scopes
    )
    kept = stats.flag_outliers(rows, keys, "price", large=large).filter(~F.col("is_outlier"))
    kept = materialise(kept, "trimmed") if large else kept
    quantiles = stats.weighted_quantiles(kept, keys, "price", large=large).withColumnRenamed("n", "sample_size")
    level = stats.spread(kept, keys, "price", money=True, large=large).select(*keys, "mean", F.col("cv").alias("dispersion"))
    days = whole_days(F.least(F.col("last_seen"), as_of), F.col("first_seen"))
    since = as_of - F.make_dt_interval(F.col("window_days"))
    whole = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.floor(F.median("mileage_km")).alias("median_mileage_km"),
        F.median(days).alias("median_days_on_market"),
        F.count_if(F.col("first_seen") >= since).alias("new_listings"),
        F.count_if(F.col("status") == "REMOVED").alias("removed_listings"),
    )
    whole = whole.filter(F.col("_n") >= MIN_SAMPLE).drop("_n")
    return whole.join(quantiles, keys).join(level, keys)


def price_moves(observations: DataFrame, listings: DataFrame, since: Column, key: str = "model_key") -> DataFrame:
    """Moves of the asking price per key: first to last observation of each listing since ``since``.

    Rises count as well as cuts; the median needs three moves.
    """
    recent = observations.filter(F.col("observed_at") >= since)
    order = F.struct("observed_at", "seq")
    ends = recent.groupBy("listing_id").agg(F.min_by("price", order).alias("start"), F.max_by("price", order).alias("end"))
    moved = ends.filter((F.col("start") > 0) & (F.col("end") != F.col("start")))
    pct = (F.col("end") - F.col("start")) / F.col("start") * 100
    return (
        moved.join(listings.select("listing_id", key), "listing_id")
        .groupBy(key)
        .agg(F.count("*").alias("price_moves"), F.median(pct).alias("_m"))
        .withColumn("median_move_pct", F.when(F.col("price_moves") >= MIN_MOVES, F.col("_m")))
        .drop("_m")
    )


def history(observations: DataFrame) -> DataFrame:
    """Per listing: number of observations, actual moves, original and last price, total change in per cent."""
    order = Window.partitionBy("listing_id").orderBy("observed_at", "seq")
    steps = observations.withColumn("_before", F.lag("price").over(order))
    at = F.struct("observed_at", "seq")
    first, last = F.min_by("price", at), F.max_by("price", at)
    return steps.groupBy("listing_id").agg(
        F.count("*").alias("observations"),
        F.count_if(F.col("price") != F.col("_before")).alias("moves"),
        first.alias("original_price"),
        last.alias("last_price"),
        F.when((F.count("*") >= 2) & (first > 0), (last - first) / first * 100).alias("total_change_pct"),
    )


def no_deposit(text: Column) -> Column:
    """True unless the text words its price as a deposit; null texts pass."""
    lower = F.lower(text)
    named = F.lit(False)
    for phrase in DEPOSIT_PHRASES:
        named = named | (F.instr(lower, phrase) > 0)
    return text.isNull() | ~named


def finds(listings: DataFrame, snapshots: DataFrame, limit: int = 15, key: str = "model_key") -> DataFrame:
    """Active, expressly undamaged listings below the first quartile of their market, widest gap first.

    A description that words the price as a deposit disqualifies its listing.

    ``snapshots`` holds one row per key (one scope, one window), so it is small beside the listings;
    Spark chooses how to join.  Gaps above 40 % are left out as likely errors.
    """
    market = snapshots.filter(
        (F.col("sample_size") >= MIN_FIND_SAMPLE) & F.col("p50").isNotNull() & F.col("p25").isNotNull()
    ).select(key, "p25", F.col("p50").alias("median_price"), "sample_size", "median_mileage_km")
    gap = (F.col("median_price") - F.col("price")) / F.col("median_price")
    chosen = listings.filter(
        (F.col("status") == "ACTIVE") & (F.col("price") > 0) & F.col("damage").eqNullSafe(F.lit(False)) & no_deposit(F.col("description"))
    ).join(market, key)
    further = (F.col("mileage_km") - F.col("median_mileage_km")) / F.nullif(F.col("median_mileage_km"), F.lit(0)) * 100
    return (
        chosen.filter((F.col("price") < F.col("p25")) & (gap <= MAX_FIND_GAP))
        .select(
            "listing_id", key, "city", "price", "median_price", "sample_size",
            (gap * 100).alias("below_median_pct"),
            F.when(F.col("mileage_km") != 0, further).alias("mileage_vs_median_pct"),
        )
        .orderBy(F.desc("below_median_pct"), "listing_id")
        .limit(limit)
    )


def budgets(analysed: DataFrame, targets: DataFrame) -> DataFrame:
    """Budget per user from the latest 50 analysed prices and all stated targets (user_id, price).

    Three prices at least; four or more give the interpolated quartiles, fewer the median +- 20 %;
    so does a band narrower than a tenth of the median.
    """
    recent = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("seq"))
    latest = analysed.filter(F.col("price").isNotNull()).withColumn("_rn", F.row_number().over(recent)).filter(F.col("_rn") <= ANALYSES_KEPT)
    prices = latest.select("user_id", "price").unionByName(targets.select("user_id", "price")).filter("price > 0")
    found = prices.groupBy("user_id").agg(
        F.count("*").alias("observations"),
        F.median("price").alias("centre"),
        F.percentile("price", 0.25).alias("_q1"),
        F.percentile("price", 0.75).alias("_q3"),
    )
    narrow = (F.col("observations") < 4) | (F.col("_q3") - F.col("_q1") < F.col("centre") * 0.1)
    return found.filter(F.col("observations") >= MIN_BUDGET_PRICES).select(
        "user_id",
        "observations",
        "centre",
        F.when(narrow, F.col("centre") * (1 - BUDGET_SPREAD)).otherwise(F.col("_q1")).alias("low"),
        F.when(narrow, F.col("centre") * (1 + BUDGET_SPREAD)).otherwise(F.col("_q3")).alias("high"),
    )


def discover(listings: DataFrame, snapshots: DataFrame, low: float, high: float, limit: int = 20, key: str = "model_key") -> DataFrame:
    """Latest active listings inside a budget, none priced above its market's median.

    A listing whose market has no snapshot passes: the median test stands above the outer join.
    """
    market = snapshots.select(key, F.col("p50").alias("median_price"))
    return (
        listings.filter((F.col("status") == "ACTIVE") & F.col("price").between(low, high))
        .join(market, key, "left")
        .filter(F.col("median_price").isNull() | (F.col("price") <= F.col("median_price")))
        .select(
            "listing_id", key, "city", "price", "median_price", "last_seen",
            ((F.col("median_price") - F.col("price")) / F.nullif(F.col("median_price"), F.lit(0.0)) * 100).alias("vs_median_pct"),
        )
        .orderBy(F.desc("last_seen"), "listing_id")
        .limit(limit)
    )


def overview(
    listings: DataFrame, snapshots: DataFrame, observations: DataFrame, quality: DataFrame, as_of: Column, observed_to: Column
) -> DataFrame:
    """One row of counts over the market: listings, price changes of the last day, configurations, snapshots, quality.

    ``quality`` has a row per data-quality issue (observed_at); those of the last seven days count.
    """
    day = days_before(as_of, 1)
    a = listings.agg(
        F.count_if(F.col("status") == "ACTIVE").alias("active"),
        F.count_if(F.col("last_seen") >= day).alias("seen_24h"),
        F.count_if(F.col("first_seen") >= day).alias("new_24h"),
        F.count_if((F.col("status") == "REMOVED") & (F.col("last_seen") >= day)).alias("removed_24h"),
        F.count_distinct("model_key").alias("configurations"),
    )
    b = snapshots.agg(
        F.count_if((F.col("sample_size") >= MIN_SAMPLE) & (F.col("scope") == NATIONAL)).alias("usable_snapshots"),
        F.percentile("median_days_on_market", 0.5).alias("median_days_on_market"),
    )
    since = F.col("observed_at") >= days_before(observed_to, 1)
    c = observations.agg(F.count_if(since & (F.col("change_kind") == "PRICE_CHANGE")).alias("price_changes_24h"))
    d = quality.agg(F.count_if(F.col("observed_at") >= days_before(as_of, 7)).alias("quality_issues_7d"))
    return a.join(b, F.lit(True)).join(c, F.lit(True)).join(d, F.lit(True))  # four single rows


def dated(snapshots: DataFrame, as_of: Column) -> DataFrame:
    return snapshots.withColumn("snapshot_date", as_of.cast("date"))


def write(snapshots: DataFrame, path: str) -> None:
    """Add dated snapshots to a table: those of a date that is there already are replaced, others stay.

    A key, scope, date and window has one row, however often its day is run again.
    """
    snapshots.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def latest(snapshots: DataFrame, scope: str = NATIONAL, window_days: int = WINDOWS[-1]) -> DataFrame:
    """The rows of the latest date that a scope and window have."""
    rows = snapshots.filter((F.col("scope") == scope) & (F.col("window_days") == window_days))
    newest = rows.agg(F.max("snapshot_date").alias("_newest"))  # a single row
    return rows.join(F.broadcast(newest), F.col("snapshot_date") == F.col("_newest")).drop("_newest")

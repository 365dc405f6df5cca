"""Valuation of many subjects at once: trimming, fitted corrections, central estimate, range, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import market_region
from ..session import materialise
from . import stats
from .comparables import MIN_SAMPLE, busy_tasks

# Gates of the fitted corrections
MIN_SLOPE_POINTS = 8
MIN_SPAN = {"mileage": 25_000.0, "age": 2.0}
MIN_GROUP = 10
MIN_DISCLOSED = 8
MAX_FACTOR_SHARE = 0.30

# Guards and range
MIN_SHARE, MAX_SHARE = 0.45, 2.00
RANGE_QUANTILES = {"low_q": 0.17, "high_q": 0.83}
MIN_HALF_WIDTH, MAX_HALF_WIDTH = 0.025, 0.35
MIN_TRANSACTIONS = 8

_X = {"mileage": ("mileage_km", "s_mileage_km"), "age": ("model_year", "s_model_year")}


def slope_confidence(points: Column) -> Column:
    """Confidence in an effect fitted on so many points, to three decimals."""
    return F.when(points <= 0, 0.0).otherwise(F.round(F.least(F.lit(0.95), points / (points + 20.0) * 1.6), 3))


def clamp_abs(value: Column, cap: Column) -> Column:
    return F.when(cap <= 0, 0.0).otherwise(stats.clamp(value, -cap, cap))


def guard(value: Column, raw: Column) -> Column:
    """``value`` kept between 0.45 and 2 times the raw median."""
    return F.least(F.greatest(value, raw * MIN_SHARE), raw * MAX_SHARE)


def trim(chosen: DataFrame) -> DataFrame:
    """Comparables without price outliers; all of them where fewer than five would stay."""
    flagged = stats.flag_outliers(chosen, ["subject_id"], "price")
    counts = flagged.groupBy("subject_id").agg(
        F.count_if(~F.col("is_outlier")).alias("_stay"), F.count("*").alias("_all")
    )
    kept = flagged.join(counts, "subject_id").filter(~F.col("is_outlier") | (F.col("_stay") < MIN_SAMPLE))
    removed = F.when(F.col("_stay") < MIN_SAMPLE, 0).otherwise(F.col("_all") - F.col("_stay"))
    return kept.withColumn("outliers_removed", removed).drop("is_outlier", "_stay", "_all")


def corrections(kept: DataFrame, name: str) -> DataFrame:
    """Per subject the fitted slope of price on ``name`` (mileage or age) and why it was (not) applied.

    Columns: {name}_slope (null unless applied), {name}_reason, {name}_points.
    """
    x, subject_x = _X[name]
    dealt = kept.select("subject_id", "listing_id", x, "price").repartition(busy_tasks(kept), "subject_id")
    fit = stats.theil_sen(dealt, ["subject_id"], x, "price", "listing_id", large=True).select("subject_id", "slope", "x_span")
    counted = kept.groupBy("subject_id").agg(
        F.count(x).alias("_n"), F.first(subject_x).alias("_sx")
    )
    wrong_sign = (F.col("slope") >= 0) if name == "mileage" else (F.col("slope") <= 0)
    reason = (
        F.when(F.col("_sx").isNull(), "INPUT_UNKNOWN")
        .when(F.col("_n") < MIN_SLOPE_POINTS, "INSUFFICIENT_DATA")
        .when(F.col("slope").isNull() | (F.col("x_span") < MIN_SPAN[name]), "INSUFFICIENT_DATA")
        .when(wrong_sign, "NOT_MATERIAL")
        .otherwise("APPLIED")
    )
    return counted.join(fit, "subject_id", "left").select(
        "subject_id",
        F.when(reason == "APPLIED", F.col("slope")).alias(f"{name}_slope"),
        reason.alias(f"{name}_reason"),
        F.when(F.col("_sx").isNull(), 0).otherwise(F.col("_n")).alias(f"{name}_points"),
    )


def restate(kept: DataFrame) -> DataFrame:
    """Each comparable's price at the subject's mileage and year (``all``), and with one left out.

    A correction moves a price by 30 % of it at most; restated prices are 1 at least.
    """
    cap = F.col("price") * MAX_FACTOR_SHARE
    move = {
        name: F.coalesce(clamp_abs(F.col(f"{name}_slope") * (F.col(sx) - F.col(x)), cap), F.lit(0.0))
        for name, (x, sx) in _X.items()
    }
    floor = F.lit(1.0)
    return (
        kept.withColumn("p_all", F.greatest(floor, F.col("price") + move["mileage"] + move["age"]))
        .withColumn("p_no_mileage", F.greatest(floor, F.col("price") + move["age"]))
        .withColumn("p_no_age", F.greatest(floor, F.col("price") + move["mileage"]))
    )


def subgroups(kept: DataFrame) -> DataFrame:
    """Median price inside less outside the subject's region, and disclosed damage less expressly clean."""
    local = market_region(F.col("city")) == market_region(F.col("s_city"))
    price = F.col("price")
    part = {"local": local, "other": ~local, "disclosed": F.col("damage"), "clean": ~F.col("damage")}
    sums = kept.groupBy("subject_id").agg(
        F.first("s_city").alias("_city"),
        F.bool_or(F.coalesce("s_damage", F.lit(False))).alias("_damaged"),
        *(F.count_if(F.coalesce(test, F.lit(False))).alias(f"_n_{k}") for k, test in part.items()),
        *(F.median(F.when(test, price)).alias(f"_m_{k}") for k, test in part.items()),
    )
    few = lambda a, b, least: (F.col(f"_n_{a}") < least) | (F.col(f"_n_{b}") < least)
    place = (
        F.when(market_region(F.col("_city")) == "UNKNOWN", "INPUT_UNKNOWN")
        .when(few("local", "other", MIN_GROUP), "INSUFFICIENT_DATA")
        .otherwise("APPLIED")
    )
    harm = (
        F.when(~F.col("_damaged"), "INPUT_UNKNOWN")
        .when(few("disclosed", "clean", MIN_DISCLOSED), "INSUFFICIENT_DATA")
        .otherwise("APPLIED")
    )
    return sums.select(
        "subject_id",
        place.alias("geography_reason"),
        F.when(place == "APPLIED", F.round(F.col("_m_local") - F.col("_m_other"))).otherwise(0.0).alias("geography_amount"),
        harm.alias("disclosure_reason"),
        F.when(harm == "APPLIED", F.round(F.col("_m_disclosed") - F.col("_m_clean"))).otherwise(0.0).alias("disclosure_amount"),
    )


def _median(rows: DataFrame, price: str, name: str, more: dict[str, float] | None = None) -> DataFrame:
    found = stats.weighted_quantiles(rows, ["subject_id"], price, "weight", {name: 0.5, **(more or {})}, ["listing_id"], combine=False)
    return found.drop("n")


def value(summary: DataFrame, chosen: DataFrame, transactions: Column | None = None) -> DataFrame:
    """One row per subject of ``summary``: outcome, central, low, high, raw_median and their derivation.

    Below five comparables the outcome is INSUFFICIENT_DATA and all amounts are null.  The central
    estimate is the weighted median of the restated prices, guarded; an adjustment is what the
    estimate loses without its correction.  The range spans the 17 % and 83 % quantiles, widened by
    sqrt(1 + 1 / effective size) and kept between 2.5 % and 35 % of the centre on either side.
    ``transactions`` (their number) sets the basis label only.
    """
    enough = summary.filter(F.col("size") >= MIN_SAMPLE).select("subject_id")
    read = chosen.select("subject_id", "listing_id", "price", "weight", "city", "s_city", "damage", "s_damage", *(c for pair in _X.values() for c in pair))
    kept = materialise(trim(read.join(enough, "subject_id", "left_semi")), "kept")
    fitted = materialise(corrections(kept, "mileage").join(corrections(kept, "age"), "subject_id"), "fitted")
    rows = materialise(restate(kept.join(fitted.select("subject_id", "mileage_slope", "age_slope"), "subject_id")), "restated")
    named = {f"norm_{k}": q for k, q in stats.QUANTILES.items()} | RANGE_QUANTILES
    level = stats.spread(rows, ["subject_id"], "p_all").select("subject_id", F.round("cv", 4).alias("dispersion"))
    counts = kept.groupBy("subject_id").agg(
        F.count("*").alias("comparables_used"), F.max("outliers_removed").alias("outliers_removed")
    )
    medians = (
        _median(rows, "price", "_raw", {f"raw_{k}": q for k, q in stats.QUANTILES.items()})
        .join(_median(rows, "p_all", "_all", named), "subject_id")
        .join(_median(rows, "p_no_mileage", "_no_mileage"), "subject_id")
        .join(_median(rows, "p_no_age", "_no_age"), "subject_id")
    )
    found = (
        summary.select("subject_id", "size", "effective_size")
        .join(medians, "subject_id", "left")
        .join(level, "subject_id", "left")
        .join(counts, "subject_id", "left")
        .join(fitted, "subject_id", "left")
        .join(subgroups(kept), "subject_id", "left")
    )
    raw = F.col("_raw")
    found = found.withColumn("_central", guard(F.col("_all"), raw))
    centre = F.col("_central")
    inflate = F.sqrt(1.0 + 1.0 / F.greatest(F.lit(1.0), F.col("effective_size")))
    low = F.least(centre - (centre - F.col("low_q")) * inflate, centre * (1 - MIN_HALF_WIDTH))
    high = F.greatest(centre + (F.col("high_q") - centre) * inflate, centre * (1 + MIN_HALF_WIDTH))
    amount = {
        name: F.when(F.col(f"{name}_reason") == "APPLIED", F.round(centre - guard(F.col(f"_no_{name}"), raw))).otherwise(0.0)
        for name in _X
    }
    basis = F.lit("ASKING") if transactions is None else F.when(transactions >= MIN_TRANSACTIONS, "TRANSACTION").otherwise("ASKING")
    valued = F.col("size") >= MIN_SAMPLE
    return found.select(
        "subject_id",
        F.when(valued, "OK").otherwise("INSUFFICIENT_DATA").alias("outcome"),
        basis.alias("basis"),
        F.round(centre).alias("central"),
        F.when(centre.isNotNull(), F.round(F.greatest(F.lit(1.0), low, centre * (1 - MAX_HALF_WIDTH)))).alias("low"),
        F.round(F.least(high, centre * (1 + MAX_HALF_WIDTH))).alias("high"),
        F.round(raw).alias("raw_median"),
        "comparables_used",
        "outliers_removed",
        "dispersion",
        *(F.round(f"norm_{k}", 4).alias(f"norm_{k}") for k in stats.QUANTILES),
        *(F.round(f"raw_{k}", 4).alias(f"raw_{k}") for k in stats.QUANTILES),
        *(c for name in _X for c in (
            amount[name].alias(f"{name}_amount"), F.col(f"{name}_reason"), F.col(f"{name}_points"),
            F.round(f"{name}_slope", 6).alias(f"{name}_slope"),
            F.when(F.col(f"{name}_reason") == "APPLIED", slope_confidence(F.col(f"{name}_points"))).otherwise(0.0).alias(f"{name}_confidence"),
        )),
        "geography_amount", "geography_reason", "disclosure_amount", "disclosure_reason",
    )

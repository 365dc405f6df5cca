"""What a conversation is told about the market, a listing and its user; requests and presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import snapshots

# Request bounds
MAX_MILEAGE_KM, REJECTED_MILEAGE_KM = 2_000_000, 1_500_000
VIN = r"^[A-HJ-NPR-Z0-9]{17}$"
CURRENCIES = ("AZN", "USD", "EUR")
AXIS_PADDING, AXIS_FALLBACK = 0.08, 0.05
TRANSACTION_DAYS, TRANSACTIONS_READ = 365, 500
KNOWS_FROM = 5


def market(dated: DataFrame, configurations: DataFrame, key: str = "model_key") -> DataFrame:
    """The latest national 180-day snapshot of every configuration beside its label."""
    rows = snapshots.latest(dated).select(key, "snapshot_date", "sample_size", "p25", "p50", "p75", "median_mileage_km")
    return rows.join(configurations.select(key, "label"), key)


def listing(listings: DataFrame, configurations: DataFrame) -> DataFrame:
    """Listings beside the label of their configuration; those without a configuration have no context."""
    kept = listings.select("listing_id", "config_id", "price", "mileage_km", "city", "damage", "description")
    return kept.join(configurations.select("config_id", "label"), "config_id")


def profiles(users: DataFrame, analyses: DataFrame) -> DataFrame:
    """How familiar each user is with the service, by their number of analyses: none, some, knows."""
    counts = analyses.groupBy("user_id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    known = F.when(n == 0, "none").when(n < KNOWS_FROM, "some").otherwise("knows")
    return users.join(counts, "user_id", "left").select("user_id", "name", n.alias("analyses"), known.alias("familiarity"))


def request_errors(vin: Column, mileage_km: Column, price: Column, currency: Column) -> Column:
    """Names of what is wrong with a request; unknown values are no error."""
    cleaned = F.upper(F.trim(vin))
    found = F.array(
        F.when((cleaned != "") & (F.length(cleaned) != 17), "VIN_LENGTH"),
        F.when((F.length(cleaned) == 17) & ~cleaned.rlike(VIN), "VIN_CHARACTERS"),
        F.when((mileage_km < 0) | (mileage_km > MAX_MILEAGE_KM), "MILEAGE_RANGE").when(mileage_km > REJECTED_MILEAGE_KM, "MILEAGE_IMPLAUSIBLE"),
        F.when(price < 0, "PRICE_NEGATIVE"),
        F.when(~currency.isin(*CURRENCIES), "CURRENCY"),
    )
    return F.filter(found, lambda e: e.isNotNull())


def member(value: Column, members: tuple[str, ...], default: str) -> Column:
    """``value`` if it is one of ``members``, else the default; null and blank too."""
    return F.when(value.isin(*members), value).otherwise(F.lit(default))


def configuration(listings: DataFrame, configurations: DataFrame) -> DataFrame:
    """Make and model of each listing's configuration, else what its model key says."""
    known = configurations.select("config_id", F.col("make").alias("_make"), F.col("model").alias("_model"))
    split = lambda n: F.nullif(F.get(F.split("model_key", r"\|", 2), F.lit(n)), F.lit(""))
    joined = listings.select("listing_id", "config_id", "model_key").join(known, "config_id", "left")
    found = F.col("_make").isNotNull() | F.col("_model").isNotNull()
    return joined.select(
        "listing_id",
        F.when(found, F.col("_make")).otherwise(split(0)).alias("make"),
        F.when(found, F.col("_model")).otherwise(split(1)).alias("model"),
        found.alias("resolved"),
    )


def transactions(sales: DataFrame, as_of: Column, window_days: int, most: int = TRANSACTIONS_READ) -> DataFrame:
    """The latest ``most`` sales of each model inside the window (a year at least), with the discount from asking."""
    days = max(window_days, TRANSACTION_DAYS)
    recent = sales.filter(F.col("sold_at") >= snapshots.days_before(as_of, days))
    newest = Window.partitionBy("model_key").orderBy(F.desc("sold_at"), F.desc("sale_id"))
    rows = recent.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= most).drop("_rn")
    return rows.withColumn("discount_pct", (F.col("price") - F.col("asked")) / F.nullif("asked", F.lit(0.0)) * 100)


def position(value: Column, low: Column, high: Column) -> Column:
    """Where a value stands between two others, 0 to 100; 50 where they do not differ."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (value - low) * 100 / (high - low)))
    return F.when(high > low, at).otherwise(50.0)


def waterfall_scale(*amounts: Column) -> Column:
    """The largest magnitude among the components of a gap, 1 at least."""
    return F.greatest(F.lit(1.0), *(F.abs(F.coalesce(a, F.lit(0.0))) for a in amounts))


def axis(low: Column, high: Column) -> Column:
    """struct(from, to): the range widened by 8 %, or by 5 % of its end where it has no width; not below 0."""
    pad = F.when(high > low, (high - low) * AXIS_PADDING).otherwise(high * AXIS_FALLBACK)
    return F.struct(F.greatest(F.lit(0.0), low - pad).alias("from"), (high + pad).alias("to"))


def split_adjustments(adjustments: Column) -> Column:
    """struct(applied, unavailable) of an array of structs with ``reason``."""
    return F.struct(
        F.filter(adjustments, lambda a: a["reason"] == "APPLIED").alias("applied"),
        F.filter(adjustments, lambda a: a["reason"] != "APPLIED").alias("unavailable"),
    )

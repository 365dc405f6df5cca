"""Competing attribute values: trust weights, winners, material conflicts; exchange rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of a verification status, sources whose values age, half-life, materiality
STATUS_WEIGHT = {
    "VERIFIED": 1.0,
    "MARKET_DERIVED": 0.8,
    "USER_PROVIDED": 0.6,
    "AI_INTERPRETED": 0.35,
    "UNVERIFIED": 0.2,
}
AGING = ("MARKET_LISTING", "DEALER", "WEB_RESEARCH")
HALF_LIFE_DAYS = 180.0
MATERIAL = 0.5


def weight(as_of: Column) -> Column:
    """Verification weight times confidence, halved every 180 days for sources that go stale."""
    table = F.create_map(*(F.lit(x) for pair in STATUS_WEIGHT.items() for x in pair))
    base = F.try_element_at(table, F.col("status")) * F.col("confidence")
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    age = F.greatest(micros / 86_400_000_000, F.lit(0.0))
    return F.when(F.col("source_type").isin(*AGING), base * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)).otherwise(base)


def agree(a: Column, b: Column) -> Column:
    """Equal texts in any case, or numbers within one per cent of the larger (1 at least)."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) < 0.01
    same = F.lower(F.trim(a)) == F.lower(F.trim(b))
    return F.when(x.isNotNull() & y.isNotNull(), near).otherwise(same)


def resolve(values: DataFrame, as_of: Column) -> DataFrame:
    """One row per (entity, field): winner, its weight and status, number of candidates and conflicts.

    ``values``: entity, field, value, status, source_type, confidence, at, seq.  The heaviest value
    wins, then the newest, then the first recorded; null values are ignored.  A losing value is a
    conflict if it differs and weighs half of the winner at least.
    """
    kept = values.filter(F.col("value").isNotNull()).withColumn("weight", F.round(weight(as_of), 9))
    order = Window.partitionBy("entity", "field").orderBy(F.desc("weight"), F.desc("at"), "seq")
    ranked = kept.withColumn("_rn", F.row_number().over(order))
    won = Window.partitionBy("entity", "field").orderBy("_rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beside = ranked.withColumns({"_value": F.first("value").over(won), "_weight": F.first("weight").over(won)})
    clash = (F.col("_rn") > 1) & ~agree(F.col("value"), F.col("_value")) & (F.col("_weight") > 0) & (F.col("weight") / F.col("_weight") >= MATERIAL)
    return beside.groupBy("entity", "field").agg(
        F.first("_value").alias("value"),
        F.first("_weight").alias("weight"),
        F.max(F.when(F.col("_rn") == 1, F.col("status"))).alias("status"),
        F.count("*").alias("candidates"),
        F.count_if(clash).alias("conflicts"),
    )


def completeness(resolved: DataFrame, expected: int) -> DataFrame:
    """Per entity: share of the expected fields that have a value, share of winners that are verified."""
    return resolved.groupBy("entity").agg(
        (F.count("*") / expected).alias("completeness"),
        F.avg(F.when(F.col("status") == "VERIFIED", 1.0).otherwise(0.0)).alias("verified_share"),
        F.sum("conflicts").alias("conflicts"),
    )


def both_ways(rates: DataFrame) -> DataFrame:
    """``rates`` (base, quote, rate, rate_at) and their inverses; rates that are not positive are left out."""
    known = rates.filter(F.col("rate") > 0).select("base", "quote", F.col("rate").cast("double").alias("rate"), "rate_at")
    return known.unionByName(known.select(F.col("quote").alias("base"), F.col("base").alias("quote"), (1 / F.col("rate")).alias("rate"), "rate_at"))


def convert(amounts: DataFrame, rates: DataFrame, target: str = "AZN", at: str = "at") -> DataFrame:
    """``amounts`` (amount, currency, ``at``) with ``converted`` into ``target``: by the latest rate up to ``at``.

    ``rates``: base, quote, rate, rate_at, used in either direction (of two for the same instant the
    larger); or currency, rate, rate_at, all quoted in ``target``.  The target currency itself has a rate of 1; without a rate the result is null, never
    a guess.  Each rate holds until the next one of its currency; amounts meet the rates of their
    month, so a currency that all amounts share is dealt over as many tasks as there are months.
    """
    if amounts.schema[at].dataType.typeName() in ("integer", "long", "short", "double"):
        month = lambda c: F.floor(c / 30).cast("int")  # noqa: E731  days
    else:
        month = lambda c: F.year(c) * 12 + F.month(c)
    if "currency" in rates.columns:
        rates = rates.select(F.col("currency").alias("base"), F.lit(target).alias("quote"), "rate", "rate_at")
    used = both_ways(rates).filter(F.col("quote") == target).groupBy("base", "rate_at").agg(F.max("rate").alias("_rate"))
    until = F.lead("rate_at").over(Window.partitionBy("base").orderBy("rate_at"))
    horizon = amounts.agg(F.max(at).alias("_horizon"))  # a single row
    held = used.withColumn("_until", until).join(F.broadcast(horizon), F.lit(True))
    held = held.filter(F.col("rate_at") <= F.col("_horizon"))
    last = month(F.coalesce(F.least("_until", "_horizon"), F.col("_horizon")))
    held = held.select(
        F.col("base").alias("_base"), F.col("rate_at").alias("_from"), "_until", "_rate",
        F.explode(F.sequence(month(F.col("rate_at")), last)).alias("_month"),
    )
    when = (F.col(at) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    met = amounts.join(held, (F.col("currency") == F.col("_base")) & (month(F.col(at)) == F.col("_month")) & when, "left")
    rate = F.when(F.col("currency") == target, 1.0).otherwise(F.col("_rate"))
    return met.withColumn("converted", F.col("amount") * rate).select(*amounts.columns, "converted")


def pct_difference(a: Column, b: Column) -> Column:
    return (a - b) / F.nullif(b, F.lit(0)) * 100

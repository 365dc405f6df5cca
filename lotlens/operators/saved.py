"""Saved items of users: listing, adding, changing, removing, and whom a price drop concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_user(saved: DataFrame, user_id: Column) -> DataFrame:
    """A user's own items, newest first (ties: the largest id); nobody else's."""
    return saved.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("saved_id"))


def add(saved: DataFrame, wanted: DataFrame) -> DataFrame:
    """``saved`` and those of ``wanted`` whose user has not saved that configuration; ``outcome`` says which.

    Of several requests for one configuration the first (by created_at, then saved_id) counts.
    ``outcome``: kept, added or already_saved.  Labels are trimmed; blank ones are null.
    """
    key = ["user_id", "config_id"]
    held = saved.select(*key).distinct().withColumn("_held", F.lit(True))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("created_at", "saved_id"))
    label = F.nullif(F.trim("label"), F.lit(""))
    asked = wanted.withColumn("label", label).withColumn("_nth", nth).join(held, key, "left")
    again = F.col("_held").isNotNull() | (F.col("_nth") > 1)
    asked = asked.withColumn("outcome", F.when(again, "already_saved").otherwise("added"))
    return saved.withColumn("outcome", F.lit("kept")).unionByName(asked.drop("_nth", "_held").select(*saved.columns, "outcome"))


def change(saved: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """``saved`` after ``patches`` (saved_id, user_id and the columns to change; null leaves a value alone).

    A patch reaches only its own user's item.  A blank label clears the label.
    """
    fields = [c for c in patches.columns if c not in ("saved_id", "user_id")]
    new = patches.select("saved_id", "user_id", *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_patched"))
    both = saved.join(new, ["saved_id", "user_id"], "left")
    values = {f: F.coalesce(f"_{f}", f) for f in fields}
    if "label" in fields:
        values["label"] = F.when(F.col("_label").isNull(), F.col("label")).otherwise(F.nullif(F.trim("_label"), F.lit("")))
    values["updated_at"] = F.when(F.col("_patched"), as_of).otherwise(F.col("updated_at"))
    return both.withColumns(values).select(*saved.columns)


def remove(saved: DataFrame, unwanted: DataFrame) -> DataFrame:
    """``saved`` without the items of ``unwanted`` (saved_id, user_id); another user's stay."""
    return saved.join(unwanted.select("saved_id", "user_id"), ["saved_id", "user_id"], "left_anti")


def price_alerts(saved: DataFrame, listings: DataFrame) -> DataFrame:
    """Items whose users want to hear of drops and whose listing is cheaper than they last saw, or was never seen."""
    both = saved.filter("notify_on_price_drop").join(listings.select("listing_id", "price", "source_url"), "listing_id")
    new = both.filter(F.col("last_seen_price").isNull() | (F.col("price") < F.col("last_seen_price")))
    return new.select("saved_id", "user_id", "listing_id", "target_price", "last_seen_price", "price", "source_url")

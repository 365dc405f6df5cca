"""Lookups read few rows, histories need no exchange, rows survive the way to disk and back."""

import uuid

from pyspark.sql import functions as F

from lotlens.operators import state
from lotlens.sources import market, store

SF = "/root/testdata/sf0.001"


def scanned(df):
    """Rows that the file scans of an executed query gave out."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(
        F.concat(F.lit("https://x/"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("source_url"), F.xxhash64("id").alias("listing_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")
    )
    path = f"{tmp_path}/clustered"
    store.write_clustered(rows, path, "source_url", ["listing_id"], different=30_000, row_group_bytes=200_000)
    wanted = rows.filter("source_url = 'https://x/000123456'").first()
    for column in ("source_url", "listing_id"):
        found = store.lookup(spark, path, column, [wanted[column]])
        assert [r.text for r in found.collect()] == [wanted.text]
        assert scanned(found) < 25_000, column
    assert store.lookup(spark, path, "source_url", ["none", "such"]).collect() == []
    assert store.lookup(spark, path, "source_url", []).collect() == []


def test_histories_meet_without_an_exchange(spark, tmp_path):
    sides = [
        store.write_bucketed(rows, f"t_{uuid.uuid4().hex}", f"{tmp_path}/{name}", order=order, buckets=4)
        for name, rows, order in (("l", market.listings(spark, SF), ()), ("o", market.observations(spark, SF), ("observed_at", "seq")))
    ]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.with_history(*sides)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.listing_id: [(p.observed_at, p.price) for p in r.price_history] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {r.listing_id: [] for r in market.listings(spark, SF).select("listing_id").collect()}
    for r in market.observations(spark, SF).orderBy("observed_at", "seq").collect():
        if r.listing_id in want:
            want[r.listing_id].append((r.observed_at, r.price))
    assert got == want and any(got.values())


def test_rows_there_and_back(spark):
    rows = market.listings(spark, SF)
    back = store.from_row_values(store.to_row_values(rows, 3))
    same = ["source_url", "make", "model", "model_year", "generation", "trim", "displacement_l", "fuel", "transmission", "drivetrain", "body", "price", "mileage_km",
            "city", "region", "damage", "description", "status", "first_seen", "last_seen"]
    assert sorted(map(str, back.select(same).collect())) == sorted(map(str, rows.select(same).collect()))
    assert {(r.seller_type, r.condition, r.repaint, r.horsepower) for r in back.collect()} == {("UNKNOWN", "UNKNOWN", None, None)}


def test_unknown_models_have_no_keys(spark):
    rows = market.listings(spark, SF).withColumn("model", F.when(F.col("listing_id") % 2 == 0, F.col("model")))
    kept = store.to_row_values(rows, 1)
    assert kept.filter("(model_key is null) <> (cast(external_id as long) % 2 <> 0)").count() == 0


def test_issue_details_go_with_issues(spark):
    rows = spark.createDataFrame(
        [(299.0, 1_500_001, 1949, "A", "B"), (3_000_001.0, 5, 2030, "A", None), (300.0, None, None, "", "B"), (5000.0, 1_500_000, 2026, "A", "B"), (None, None, 2027, "A", "B")],
        "price double, mileage_km long, model_year int, make string, model string",
    )
    year = F.lit(2024)
    for r in rows.select(state.issues(year).alias("i"), state.issue_details(year).alias("d")).collect():
        assert [d.issue for d in r.d] == r.i and all(d.detail for d in r.d)


def test_a_price_just_below_nothing_is_told_without_a_sign(spark):
    prices = [-0.2999999999992724, -0.5, -0.51, 0.0, 0.4]
    rows = spark.createDataFrame([(p, 5, 2020, "A", "B") for p in prices], "price double, mileage_km long, model_year int, make string, model string")
    told = [r.d[0].detail for r in rows.select("price", state.issue_details(F.lit(2024)).alias("d")).collect()]
    assert told == [f"{n} is too low a price" for n in ("0", "0", "-1", "0", "0")]

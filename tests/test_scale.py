"""Faults that show on larger tables only, each on a small one."""

import datetime as dt

from pyspark.sql import functions as F

from lotlens.operators import comparables, stats
from lotlens.streaming import limits

def at():
    return F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")


def cars(spark, n):
    i = F.col("id")
    text = lambda *names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    return spark.range(n).select(
        i.alias("listing_id"), F.lit("A|B").alias("model_key"), F.concat(F.lit("u/"), i).alias("source_url"), (i % 5 + 1990).alias("model_year"),
        text("G", "H").alias("generation"), text("T", "U", "UNKNOWN").alias("trim"), F.when(i % 7 != 0, i % 4 / 2.0 + 1).alias("displacement_l"),
        text("LPG", "PETROL", "HYBRID").alias("fuel"), text("AUTOMATIC", "CVT", "MANUAL").alias("transmission"), text("FWD", "AWD").alias("drivetrain"),
        text("SEDAN", "WAGON", "SUV", "CROSSOVER").alias("body"), (i * 10.0 + 1000).alias("price"), (i * 500).alias("mileage_km"), text("X", "Y").alias("city"),
        (at() - F.make_dt_interval((i % 100).cast("int"))).alias("last_seen"),
    )


def test_the_pairs_of_one_model_are_dealt_over_tasks(spark):
    rows = cars(spark, 400).localCheckpoint()
    subjects = rows.drop("last_seen").select(F.col("listing_id").alias("subject_id"), *(F.col(c).alias(f"s_{c}") for c in rows.columns if c not in ("listing_id", "last_seen")))
    pairs = comparables.meet(subjects, comparables.latest(rows, at(), 300))
    tasks = pairs.select("subject_id", F.spark_partition_id().alias("t")).distinct().toPandas()
    assert tasks.t.nunique() > 1 and tasks.subject_id.is_unique and len(tasks) == 400
    assert pairs.count() == 400 * 300
    # the same comparables as from pairs that no block deals
    plain = comparables.latest(rows, at(), 300).join(subjects, F.col("model_key") == F.col("s_model_key"))
    kept = ("subject_id", "listing_id", "rank", "tier", "weight", "tier_used", "widened")
    want = comparables.select(comparables.score(plain, at())).select(*kept).collect()
    got = comparables.choose(subjects, comparables.latest(rows, at(), 300), at()).select(*kept).collect()
    assert want and sorted(want) == sorted(got)


def test_effective_size_of_whole_weights_outgrows_no_long(spark):
    df = spark.createDataFrame([(4_000_000_000,), (4_000_000_000,)], "w long")
    assert df.agg(stats.effective_size("w").alias("n")).first().n == 2.0


def test_a_busy_key_of_the_limiter_is_not_put_into_one_row(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=i // 10), i) for i in range(2000)]
    told = limits.allowed(spark.createDataFrame(rows, "key string, at timestamp_ntz, seq long"), 2, 10)
    assert "collect_list" not in told._jdf.queryExecution().toString()
    got = [r.seq for r in told.filter("allowed").orderBy("seq").collect()]
    assert got == [s for k in range(0, 2000, 110) for s in (k, k + 1)]

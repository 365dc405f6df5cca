"""A market of one crowded model: the queries that promise all comparables leave none out."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lotlens.operators import comparables, stats
from lotlens.plans import registry

from .oracle import differences
from .test_scale import at, cars

SMALL = "/root/testdata/sf0.001"
CROWD = {
    "part": "* REPLACE ('Brand#1' AS p_brand, 'ECONOMY' AS p_type, p_size % 2 AS p_size, 'plain blue' AS p_name)",
    "lineitem": "* REPLACE (TIMESTAMP '2001-07-01' + to_days(CAST(l_orderkey % 30 AS INTEGER)) AS l_shipdate)",
}
WHOLE = ("bundles", "comparables_chosen", "comparables_summary", "inspection_plans", "negotiations", "ratings", "reports_parsed",
         "reports_without_model", "responses")


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("crowded"))
    for name in sorted(os.listdir(SMALL)):
        if name.endswith(".parquet"):
            some = " WHERE l_orderkey < 800" if name == "lineitem.parquet" else ""
            duckdb.execute(f"COPY (SELECT {CROWD.get(name.split('.')[0], '*')} FROM '{SMALL}/{name}'{some}) TO '{path}/{name}' (FORMAT parquet)")
    return path


@pytest.mark.parametrize("name", WHOLE)
def test_a_crowded_model_keeps_all_its_comparables(spark, crowded, name):
    sql = registry.ORACLE_SQL[name]
    assert "2000 AND" not in sql and "rank <= 300" not in sql
    assert differences(registry.QUERIES[name](spark, crowded), sql, crowded) == []


def test_considered_and_chosen_outgrow_the_former_caps(spark, crowded):
    rows = registry.QUERIES["comparables_summary"](spark, crowded).collect()
    assert rows and all(r.considered > 2000 and r["size"] > 300 for r in rows)
    chosen = registry.QUERIES["comparables_chosen"](spark, crowded)
    assert chosen.groupBy("subject_id").agg(F.max("rank").alias("n")).filter("n <= 300").isEmpty()


def test_without_a_cap_every_listing_in_the_window_stays(spark):
    rows = cars(spark, 2400)
    assert comparables.latest(rows, at()).count() == 2400
    assert comparables.latest(rows, at(), 2000).count() == 2000


def test_percentiles_come_without_pairs_of_targets_and_rows(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 5.0), ("c", None)], "k string, v double")
    asked = [(1, "a", 2.0), (2, "a", 1.5), (3, "a", 0.5), (4, "a", 9.0), (5, "a", None), (6, "b", 5.0), (7, "c", 1.0), (8, "d", 1.0)]
    targets = spark.createDataFrame(asked, "i long, k string, t double")
    pairs = rows.join(targets, "k").groupBy("i").agg(F.count("*").alias("n"), stats.percentile_rank(F.col("v"), F.col("t")).alias("percentile"))
    found = stats.percentile_ranks(rows, ["k"], "v", targets, "t")
    assert sorted(found.select("i", "n", "percentile").collect()) == sorted(pairs.collect())
    assert {r.i: r.percentile for r in found.collect()}[1] == pytest.approx(200 / 3)
    got = registry.QUERIES["stats_percentile_rank"](spark, SMALL)
    assert differences(got, registry.ORACLE_SQL["stats_percentile_rank"], SMALL) == []


def test_only_pairs_of_kinds_and_admitted_tiers_are_formed(spark):
    rows = cars(spark, 2400).withColumn("last_seen", F.when(F.col("listing_id") % 10 == 0, F.lit("2000-01-01").cast("timestamp_ntz")).otherwise(F.col("last_seen")))
    rows = rows.withColumn("source_url", F.when(F.col("listing_id") < 20, F.lit("u/7/")).otherwise(F.col("source_url"))).localCheckpoint()
    named = [F.col("listing_id").alias("subject_id"), *(F.col(c).alias(f"s_{c}") for c in rows.columns if c not in ("listing_id", "last_seen"))]
    subjects = rows.filter("listing_id < 400").select(*named)
    totals, met, _ = comparables.tally(subjects, rows, at())
    assert met.count() < 400 * 2400 / 5
    plain = comparables.score(rows.join(subjects, F.col("model_key") == F.col("s_model_key")), at())
    counts = [F.count("*"), F.count_if(F.col("similarity").isNull()), F.count_if(F.col("similarity") < 0.45), F.count_if((F.col("similarity") >= 0.45) & (F.col("tier") > 3))]
    names = ("subject_id", "considered", "excluded_stale", "excluded_dissimilar", "left_in_tier_4")
    assert sorted(totals.select(*names).collect()) == sorted(plain.groupBy("subject_id").agg(*counts).collect())
    kept = ("subject_id", "listing_id", "rank", "tier", "weight", "tier_used", "widened")
    want = comparables.select(plain).select(*kept).collect()
    assert want and sorted(comparables.choose(subjects, rows, at()).select(*kept).collect()) == sorted(want)

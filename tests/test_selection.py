"""Selection by histograms and running totals against the built-in aggregates and windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotlens.operators import selection, snapshots, stats
from lotlens.sources import market

NAMED = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p93": 0.93, "top": 1.0}


def values():
    rng = random.Random(6)
    rows = [("wide", rng.gauss(0, 10 ** rng.randint(-3, 9))) for _ in range(3000)]
    rows += [("few", float(rng.choice([3, 3, 4]))) for _ in range(500)] + [("one", 7.5), (None, 1.0), (None, 2.0), ("none", None)]
    rows += [("edge", v) for v in (-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300, -1e-300)] * 5 + [("same", 2.0)] * 50
    return rows


@pytest.mark.parametrize("few", [20, 10_000])
def test_quantiles_equal_percentile(spark, few):
    df = spark.createDataFrame(values(), "g string, v double").repartition(7)
    want = df.filter("v is not null").groupBy("g").agg(F.count("v").alias("n"), *(F.expr(f"percentile(v, {q})").alias(k) for k, q in NAMED.items()))
    got = {r.g: r for r in selection.quantiles(df, ["g"], "v", NAMED, few).collect()}
    assert got.keys() == {r.g for r in want.collect()}
    for r in want.collect():
        assert got[r.g].n == r.n
        if r.g != "edge":  # a sum of two such numbers may be beyond doubles
            assert [got[r.g][k] for k in NAMED] == pytest.approx([r[k] for k in NAMED], rel=1e-12), r.g


def test_ranks_of_adversarial_values(spark):
    rows = sorted({(2.0**e) for e in range(-60, 60, 3)})
    df = spark.createDataFrame([(1, v) for v in rows], "g int, v double")
    ranks = spark.createDataFrame([(1, r) for r in (0, 1, 30, len(rows) - 1, len(rows), -1)], "g int, rank long")
    got = {r.rank: r.value for r in selection.order_statistics(df, ["g"], "v", ranks, few=0).collect()}
    assert got == {r: rows[r] for r in (0, 1, 30, len(rows) - 1)}


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(900), i, rng.randrange(5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, i int, w int").repartition(6)
    window = Window.partitionBy("g").orderBy("v", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = sorted(map(tuple, df.withColumn("t", F.sum("w").over(window)).collect()), key=str)
    assert sorted(map(tuple, selection.running_total(df, ["g"], ["v", "i"], "w", "t").collect()), key=str) == want


def close(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): r.asDict() for r in rows.collect()} for rows in (got, want))
    assert got.keys() == want.keys() and got
    for k, row in want.items():
        assert {n: v if isinstance(v, (str, int, type(None))) else pytest.approx(v, rel=1e-9, abs=1e-9) for n, v in row.items()} == got[k]


def test_large_groups_give_the_same_statistics(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), round(rng.lognormvariate(9, 0.6), rng.choice([0, 2])), rng.choice([0.0, 1.0, 2.5]), i) for i in range(4000)]
    rows += [("zero", float(i % 9), 0.0, i) for i in range(40)] + [("neg", float(i), -1.0 + (i > 5), i) for i in range(9)] + [("none", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w double, i int")
    close(stats.spread(df, ["g"], "v", large=True), stats.spread(df, ["g"], "v"), ["g"])
    for weight, combine in (("w", True), ("w", False), (None, True)):
        plain = stats.weighted_quantiles(df, ["g"], "v", weight, tie=("i",), combine=combine)
        large = stats.weighted_quantiles(df, ["g"], "v", weight, tie=("i",), combine=combine, large=True)
        close(large, plain, ["g"])
    flags = lambda large: sorted(map(tuple, stats.flag_outliers(df, ["g"], "v", large=large).select("i", "g", "is_outlier").collect()))
    assert flags(True) == flags(False)


def test_large_snapshots(spark):
    rows = market.listings(spark, "/root/testdata/sf0.001")
    keys = ["model_key", "scope", "window_days"]
    close(snapshots.build(rows, market.as_of(), large=True), snapshots.build(rows, market.as_of()), keys)


def test_trimming_leaves_five(spark):
    rng = random.Random(5)
    rows = [(g, v) for g in range(400) for v in [rng.choice([0.0, 1.0, 1.0, rng.gauss(0, 1), 10.0 ** rng.randint(0, 9)]) for _ in range(rng.randint(8, 11))]]
    df = spark.createDataFrame(rows, "g int, v double")
    left = stats.flag_outliers(df, ["g"], "v").groupBy("g").agg(F.count_if(~F.col("is_outlier")).alias("left"))
    assert left.agg(F.min("left")).first()[0] >= 5

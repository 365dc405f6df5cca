"""Literal vectors for the operators: each states one documented value."""

import math

import pytest
from pyspark.sql import functions as F

from lotlens.functions import disclosures, normalise
from lotlens.operators import comparables, evidence, judgement, provenance, state, stats
from lotlens.streaming import market as streams


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items() if v is not None) or "x int"
    row = [tuple(v for v in values.values() if v is not None) or (1,)]
    df = spark.createDataFrame(row, schema)
    for k, v in values.items():
        if v is None:
            df = df.withColumn(k, F.lit(None).cast("string"))
    return df.select(column.alias("r")).first()["r"]


def numbers(spark, values, weights=None):
    rows = [(1, i, float(v), float(w)) for i, (v, w) in enumerate(zip(values, weights or [1.0] * len(values), strict=True))]
    return spark.createDataFrame(rows, "g int, i int, v double, w double")


@pytest.mark.parametrize(
    "text, key",
    [("Ön ötürücü", "on oturucu"), ("ŞƏKİ", "seki"), ("Mercedes-Benz", "mercedes benz"), ("", ""), (None, "")],
)
def test_fold(spark, text, key):
    assert one(spark, normalise.fold(F.col("t")), t=text) == key


@pytest.mark.parametrize("raw", ["Mersedes", "Мерседес", "MB", "benz", "Mercedes-Benz"])
def test_make(spark, raw):
    assert one(spark, normalise.make(F.col("t")), t=raw) == "MERCEDES-BENZ"


def test_unknown_make_and_models(spark):
    assert one(spark, normalise.make(F.col("t")), t="Zaporozhets") is None
    assert one(spark, normalise.model(F.lit("BMW"), F.col("t")), t="5 er sedan") == "5 SERIES"
    assert one(spark, normalise.model(F.lit("TOYOTA"), F.col("t")), t="Camry Sedan") == "CAMRY"
    assert one(spark, normalise.model(F.lit("BMW"), F.col("t")), t=None) is None


@pytest.mark.parametrize(
    "raw, style", [("Offroader / SUV, 5 qapı", "SUV"), ("SUV Kupe", "SUV"), ("Avtobus", "UNKNOWN"), ("Hetçbek, 5 qapı", "HATCHBACK")]
)
def test_body(spark, raw, style):
    assert one(spark, normalise.body(F.col("t")), t=raw) == style


@pytest.mark.parametrize("raw, litres", [(1998.0, 2.0), (1600.0, 1.6), (2.04, 2.0), (0.0, None), (50.0, None)])
def test_displacement(spark, raw, litres):
    assert one(spark, normalise.displacement(F.col("t")), t=raw) == litres


def test_city_and_region(spark):
    assert one(spark, normalise.city(F.col("t")), t="Баку") == "Bakı"
    assert one(spark, normalise.market_region(F.col("t")), t="Sumqayıt") == "BAKU_METRO"
    assert one(spark, normalise.market_region(F.col("t")), t=None) == "UNKNOWN"


def test_money(spark):
    amount, currency = normalise.money(F.col("t"))
    assert one(spark, amount.cast("long"), t="43 500 AZN") == 43500
    assert one(spark, amount.cast("long"), t="43 500.50") == 4350050
    assert one(spark, currency, t="12 000 $") == "USD"
    assert one(spark, amount, t="razılaşma") is None


def test_disclosures(spark):
    got = one(spark, disclosures.read(F.col("t")), t="Vurulmayıb, rənglənməyib. Ideal vəziyyətdə.")
    assert (got.damage, got.repaint, got.needs_repair, got.claims) == (False, False, None, 2)  # plain and folded phrase
    got = one(spark, disclosures.read(F.col("t")), t=None)
    assert (got.damage, got.repaint, got.needs_repair, got.claims) == (None, None, None, 0)


def test_spread_and_outliers(spark):
    row = stats.spread(numbers(spark, [40_000, 41_000, 42_000, 43_000, 44_000, 4_000_000]), ["g"], "v").first()
    assert row.median == 42_500
    flagged = stats.flag_outliers(numbers(spark, [*range(10, 18), 4000]), ["g"], "v")
    assert [r.i for r in flagged.filter("is_outlier").collect()] == [8]
    assert stats.flag_outliers(numbers(spark, [1, 2, 900]), ["g"], "v").filter("is_outlier").count() == 0
    assert stats.spread(numbers(spark, [5, 5, 5, 5, 9]), ["g"], "v").first().sigma == pytest.approx(1.2533 * 0.8)


@pytest.mark.parametrize("values, weights, want", [([1, 2, 3, 4], [1, 1, 1, 1], 2.5), ([1, 2, 3], [0, 0, 0], 2.0), ([7], [3], 7.0)])
def test_weighted_median(spark, values, weights, want):
    got = stats.weighted_quantiles(numbers(spark, values, weights), ["g"], "v", "w", {"m": 0.5}, ["i"]).first()
    assert got.m == want and got.n == len(values)


def test_quantile_conventions_differ(spark):
    assert stats.weighted_quantiles(numbers(spark, [1, 2, 3, 4]), ["g"], "v", "w").first().p25 == 1.5
    assert numbers(spark, [1, 2, 3, 4]).agg(F.percentile("v", 0.25)).first()[0] == 1.75


def test_percentile_rank_and_size(spark):
    rows = numbers(spark, [5, 5, 5])
    assert rows.agg(stats.percentile_rank(F.col("v"), F.lit(5.0))).first()[0] == 50
    assert rows.agg(stats.effective_size("w")).first()[0] == 3


def test_theil_sen(spark):
    points = spark.createDataFrame(list(enumerate([10.0, 8.0, 6.0, 4.0, 900.0])), "x int, y double").withColumn("g", F.lit(1))
    assert stats.theil_sen(points, ["g"], "x", "y", "x").first().slope == -2.0
    flat = points.withColumn("x", F.lit(3))
    assert stats.theil_sen(flat, ["g"], "x", "y", "y").count() == 0
    assert stats.theil_sen(points.filter("x < 2"), ["g"], "x", "y", "x").count() == 0


def test_feature_scores(spark):
    fuel = comparables.fuel_score(F.col("a"), F.col("b"))
    assert one(spark, fuel, a="LPG", b="PETROL") == 0.75
    assert one(spark, fuel, a="PETROL", b="ELECTRIC") == 0.0
    assert one(spark, fuel, a="UNKNOWN", b="PETROL") == 0.5
    assert one(spark, comparables.body_score(F.col("a"), F.col("b")), a="SUV", b="CROSSOVER") == 0.8
    assert one(spark, comparables.displacement_score(F.col("a"), F.col("b")), a=2.0, b=2.4) == 0.4
    assert one(spark, comparables.year_score(F.col("a"), F.col("b")), a=2019, b=2014) == 0.0


def test_noisy_or_and_marginals(spark):
    struct = "array<struct<kind:string,severity:string,rank:int,confidence:double>>"
    row = [([("A", "HIGH", 3, 1.0), ("B", "LOW", 1, 1.0)],)]
    df = spark.createDataFrame(row, f"s {struct}")
    got = df.select(judgement.noisy_or(F.col("s")).alias("t"), judgement.marginals(F.col("s")).alias("m")).first()
    assert math.isclose(got.t, 1 - 0.65 * 0.92)
    # leaving A out: 0.08; leaving B out: 0.35
    assert [(m.kind, m.points) for m in got.m] == [("A", round((got.t - 0.08) * 100, 1)), ("B", round((got.t - 0.35) * 100, 1))]


def test_conflicts_and_rates(spark):
    rows = [
        (1, "drive", "AWD", "VERIFIED", "VIN_DECODER", 1.0, 1),
        (1, "drive", "awd ", "UNVERIFIED", "USER", 1.0, 2),
        (1, "drive", "FWD", "USER_PROVIDED", "USER", 0.9, 3),
        (1, "drive", "RWD", "UNVERIFIED", "USER", 0.9, 4),
    ]
    values = spark.createDataFrame(rows, "entity int, field string, value string, status string, source_type string, confidence double, seq int")
    values = values.withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = provenance.resolve(values, F.lit("2024-06-01").cast("timestamp_ntz")).first()
    assert (got.value, got.candidates, got.conflicts) == ("AWD", 4, 1)
    assert one(spark, provenance.agree(F.col("a"), F.col("b")), a="100000", b="100500") is True
    rates = spark.createDataFrame([("USD", 1.7, 5), ("USD", 1.8, 9)], "currency string, rate double, rate_at int")
    amounts = spark.createDataFrame([(10.0, "USD", 7), (10.0, "USD", 4), (10.0, "EUR", 7)], "amount double, currency string, at int")
    got = {(r.currency, r["at"]): r.converted for r in provenance.convert(amounts, rates).collect()}
    assert got == {("USD", 7): 17.0, ("USD", 4): None, ("EUR", 7): None}


def test_numbers_in_prose(spark):
    df = spark.createDataFrame([(1, "roughly 43,100 and 0.94 and 5 cars")], "k int, t string")
    known = evidence.registry(df, "k", "t")
    assert {r.value for r in known.collect()} == {43100.0, 0.94, 1.0, 94.0}
    claims = spark.createDataFrame([(1, 43_500.0), (1, 51_000.0), (2, 43_100.0)], "k int, value double")
    assert {(r.k, r.value) for r in evidence.unknown_numbers(claims, known, "k").collect()} == {(1, 51_000.0), (2, 43_100.0)}
    assert one(spark, evidence.reply(F.col("t")), t='```json\n{"reply": "ok"}\n```') == "ok"
    assert one(spark, evidence.reply(F.col("t")), t="plain") == "plain"


_STATE = "listing_id long, price long, mileage_km long, description string, fingerprint string, status string, first_seen timestamp_ntz, last_seen timestamp_ntz"


def test_upsert_outcomes(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    old = spark.createDataFrame(
        [(1, 100, 5, "a", "f1", "REMOVED", t, t), (2, 100, 5, "a", "f2", "ACTIVE", t, t), (3, 100, 5, "a", "f3", "ACTIVE", t, t), (4, 1, 1, "a", "f4", "ACTIVE", t, t)], _STATE
    )
    new = spark.createDataFrame(
        [(1, 100, 5, "a", "f1", None), (2, 90, None, "", "g2", None), (3, None, 5, "a", "g3", None), (5, 7, 7, "b", "g5", None)],
        "listing_id long, price long, mileage_km long, description string, fingerprint string, posted_at timestamp_ntz",
    )
    got = {r.listing_id: r for r in state.upsert(old, new, F.lit("2024-02-01").cast("timestamp_ntz")).collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "unchanged", 2: "price_changed", 3: "skipped", 4: "unseen", 5: "created"}
    assert got[1].status == "ACTIVE" and got[1].changes == []
    assert (got[2].price, got[2].mileage_km, got[2].description, got[2].changes) == (90, 5, "a", ["PRICE_CHANGE"])
    assert got[3].last_seen == t and got[5].changes == ["FIRST_SEEN"]


def test_stream_equals_batch(spark, tmp_path):
    schema = "listing_id long, price long, mileage_km long, description string, fingerprint string, posted_at timestamp_ntz, observed_at timestamp_ntz, seq long"
    rows = spark.range(40).select(
        (F.col("id") % 10).alias("listing_id"), (F.col("id") * 3 % 7).alias("price"), F.col("id").alias("mileage_km"), F.lit("").alias("description"),
        (F.col("id") * 3 % 7).cast("string").alias("fingerprint"), F.lit(None).cast("timestamp_ntz").alias("posted_at"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("observed_at"), F.col("id").alias("seq"),
    )
    source = f"{tmp_path}/in"
    for i in range(4):
        rows.filter(F.col("seq").between(i * 10, i * 10 + 9)).coalesce(1).write.mode("append").parquet(source)
    empty = spark.createDataFrame([], _STATE)
    stream = streams.read_stream(spark, source, schema)
    query = streams.upsert_stream(stream, f"{tmp_path}/state", f"{tmp_path}/log", f"{tmp_path}/cp", empty)
    query.awaitTermination(120)
    final = {r.listing_id: r.price for r in spark.read.parquet(f"{tmp_path}/state/v=4").collect()}
    assert final == {k: (k + 30) * 3 % 7 for k in range(10)}
    kinds = {r.change_kind: r["count"] for r in spark.read.parquet(f"{tmp_path}/log").groupBy("change_kind").count().collect()}
    assert kinds["FIRST_SEEN"] == 10 and kinds["PRICE_CHANGE"] == 30

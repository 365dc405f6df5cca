"""Queries of the statistics library and the snapshots over the test tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots, state, stats
from ..session import once, table
from ..sources import market


def rounded(df: DataFrame, digits: int = 4, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, as sums of doubles vary in the last bits with the partitioning; not those named ``exact``."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes))


def _twin(select: str, *views: str) -> str:
    return "WITH " + ",".join(views) + select


def stats_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spread(market.listings(spark, sf_dir), ["model_key"], "price", money=True), exact=("mean",))


SPREAD_SQL = """
SELECT model_key, n, mean, round(median, 4) AS median, round(mad, 4) AS mad,
  round(sigma, 4) AS sigma, round(CASE WHEN n < 2 OR median = 0 THEN 0 ELSE sigma / abs(median) END, 4) AS cv
FROM (
  SELECT *, CASE WHEN n < 2 THEN 0 WHEN mad > 0 THEN CAST(1.4826 AS DOUBLE) * mad
                 ELSE CAST(1.2533 AS DOUBLE) * mean_dev END AS sigma
  FROM (
    SELECT l.model_key, count(*) AS n,
      CAST(sum(CAST(round(price * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS mean, any_value(mid) AS median,
      median(abs(price - mid)) AS mad, avg(abs(price - mid)) AS mean_dev
    FROM listings l JOIN (SELECT model_key, median(price) AS mid FROM listings GROUP BY 1) m
      ON l.model_key = m.model_key
    GROUP BY 1))
"""


def stats_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = stats.flag_outliers(market.observations(spark, sf_dir), ["listing_id"], "price")
    return rounded(
        flagged.groupBy("listing_id").agg(
            F.count("*").alias("n"),
            F.count_if("is_outlier").alias("removed"),
            F.max(F.when(~F.col("is_outlier"), F.col("price"))).alias("highest_kept"),
        )
    )


OUTLIERS_SQL = """
, m AS (SELECT listing_id, median(price) AS mid, count(*) AS n FROM observations GROUP BY 1),
d AS (SELECT o.listing_id, median(abs(price - mid)) AS mad, avg(abs(price - mid)) AS mean_dev
      FROM observations o JOIN m ON o.listing_id = m.listing_id GROUP BY 1),
s AS (SELECT m.listing_id, mid, n, CASE WHEN mad > 0 THEN CAST(1.4826 AS DOUBLE) * mad
        ELSE CAST(1.2533 AS DOUBLE) * mean_dev END AS sigma
      FROM m JOIN d ON m.listing_id = d.listing_id),
f AS (SELECT o.listing_id, price, n >= 8 AND sigma > 0 AND
        (price < mid - CAST(3.5 AS DOUBLE) * sigma OR price > mid + CAST(3.5 AS DOUBLE) * sigma) AS out
      FROM observations o JOIN s ON o.listing_id = s.listing_id)
SELECT listing_id, count(*) AS n, count(*) FILTER (out) AS removed,
  round(max(price) FILTER (NOT out), 4) AS highest_kept
FROM f GROUP BY 1
"""


def stats_weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir)
    return rounded(stats.weighted_quantiles(rows, ["model_key"], "price", "mileage_km", tie=["listing_id"]))


def quantiles_sql(rows: str, keys: str, value: str, weight: str, tie: str, named: dict[str, float] = stats.QUANTILES) -> str:
    """DuckDB: the mid-point weighted quantiles of ``rows`` by ``keys`` (one column each), and n."""
    at = ", ".join(
        f"""coalesce(min(v) FILTER (rn = 1 AND pos >= CAST({q} AS DOUBLE)),
          min(v) FILTER (nxt_pos IS NULL AND pos <= CAST({q} AS DOUBLE)),
          min(CASE WHEN nxt_pos = pos THEN v ELSE v + (nxt - v) * ((CAST({q} AS DOUBLE) - pos) / (nxt_pos - pos)) END)
            FILTER (pos <= CAST({q} AS DOUBLE) AND nxt_pos >= CAST({q} AS DOUBLE))) AS {name}"""
        for name, q in named.items()
    )
    return f"""
      SELECT {keys}, count(*) AS n, {at}
      FROM (SELECT *, lead(pos) OVER o AS nxt_pos, lead(v) OVER o AS nxt
            FROM (SELECT *, (upto - w / 2) / total AS pos
                  FROM (SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY v{tie} ROWS UNBOUNDED PRECEDING) AS upto,
                          sum(w) OVER (PARTITION BY {keys}) AS total,
                          row_number() OVER (PARTITION BY {keys} ORDER BY v{tie}) AS rn
                        FROM (SELECT *, {value} AS v, CAST({weight} AS DOUBLE) AS w FROM {rows})))
            WINDOW o AS (PARTITION BY {keys} ORDER BY rn))
      GROUP BY {keys}"""


WEIGHTED_QUANTILES_SQL = f"""
SELECT model_key, n, round(p10, 4) AS p10, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75,
  round(p90, 4) AS p90
FROM ({quantiles_sql("listings", "model_key", "price", "mileage_km", ", listing_id")})
"""


def stats_interpolated_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        F.percentile("o_totalprice", 0.25).alias("q1"),
        F.median("o_totalprice").alias("q2"),
        F.percentile("o_totalprice", 0.75).alias("q3"),
    )
    return rounded(found)


INTERPOLATED_SQL = """
SELECT o_custkey, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
  round(median(o_totalprice), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3
FROM orders GROUP BY 1
"""


def stats_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seller's latest listing among all listings of its model."""
    rows = market.listings(spark, sf_dir)
    subjects = once(spark, sf_dir, "subjects", lambda: market.subjects(spark, sf_dir, rows))
    found = subjects.select("subject_id", F.col("s_model_key").alias("model_key"), "s_price")
    return rounded(stats.percentile_ranks(rows, ["model_key"], "price", found, "s_price").select("subject_id", "n", "percentile"))


PERCENTILE_RANK_SQL = """
SELECT subject_id, count(*) AS n,
  round(avg(CASE WHEN price < s_price THEN 1.0 WHEN price = s_price THEN 0.5 ELSE 0.0 END) * 100, 4) AS percentile
FROM subjects JOIN listings ON model_key = s_model_key GROUP BY 1
"""


def stats_effective_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir).groupBy("model_key", "region")
    return rounded(
        rows.agg(
            F.count("*").alias("n"),
            stats.effective_size("mileage_km").alias("effective_size"),
            stats.weighted_mean("price", "mileage_km").alias("weighted_price"),
        )
    )


EFFECTIVE_SQL = """
SELECT model_key, region, count(*) AS n,
  round(CAST(sum(mileage_km) AS DOUBLE) * CAST(sum(mileage_km) AS DOUBLE) / sum(CAST(mileage_km AS DOUBLE) * mileage_km), 4) AS effective_size,
  round(sum(price * mileage_km) / sum(mileage_km), 4) AS weighted_price
FROM listings GROUP BY 1, 2
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.build(market.listings(spark, sf_dir), market.as_of())


def market_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_snapshots(spark, sf_dir), exact=("mean",))


_AT = f"TIMESTAMP '{market.AS_OF}'"
SNAPSHOTS_SQL = f"""
scoped AS (
  SELECT l.*, w AS window_days, unnest([coalesce(region, 'UNKNOWN'), 'ALL']) AS scope
  FROM listings l, (VALUES (30), (90), (180)) v(w)
  WHERE price > 0 AND last_seen >= {_AT} - w * INTERVAL 1 DAY
), mid AS (
  SELECT model_key, scope, window_days, count(*) AS n_all, median(price) AS m FROM scoped GROUP BY 1, 2, 3
), dev AS (
  SELECT s.model_key, s.scope, s.window_days, any_value(m) AS m, any_value(n_all) AS n_all,
    median(abs(price - m)) AS mad, avg(abs(price - m)) AS mean_dev
  FROM scoped s JOIN mid USING (model_key, scope, window_days) GROUP BY 1, 2, 3
), bounds AS (
  SELECT *, CASE WHEN mad > 0 THEN CAST(1.4826 AS DOUBLE) * mad ELSE CAST(1.2533 AS DOUBLE) * mean_dev END AS sigma FROM dev
), flagged AS (
  SELECT s.*, n_all >= 8 AND sigma > 0 AND abs(price - m) > CAST(3.5 AS DOUBLE) * sigma AS out
  FROM scoped s JOIN bounds USING (model_key, scope, window_days)
), kept AS (
  SELECT * FROM (SELECT *, count(*) FILTER (NOT out) OVER (PARTITION BY model_key, scope, window_days) AS stays FROM flagged)
  WHERE NOT out OR stays < 5
), quants AS ({quantiles_sql("kept", "model_key, scope, window_days", "price", "1", "")}
), kmid AS (
  SELECT model_key, scope, window_days, median(price) AS m,
    CAST(sum(CAST(round(price * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS mean, count(*) AS k FROM kept GROUP BY 1, 2, 3
), level AS (
  SELECT s.model_key, s.scope, s.window_days, any_value(mean) AS mean,
    CASE WHEN any_value(k) < 2 OR any_value(m) = 0 THEN 0
         WHEN median(abs(price - m)) > 0 THEN CAST(1.4826 AS DOUBLE) * median(abs(price - m)) / abs(any_value(m))
         ELSE CAST(1.2533 AS DOUBLE) * avg(abs(price - m)) / abs(any_value(m)) END AS dispersion
  FROM kept s JOIN kmid USING (model_key, scope, window_days) GROUP BY 1, 2, 3
), whole AS (
  SELECT model_key, scope, window_days, CAST(floor(median(mileage_km)) AS BIGINT) AS median_mileage_km,
    median(greatest(CAST(floor(epoch(least(last_seen, {_AT}) - first_seen) / 86400) AS BIGINT), 0)) AS median_days_on_market,
    count(*) FILTER (first_seen >= {_AT} - window_days * INTERVAL 1 DAY) AS new_listings,
    count(*) FILTER (status = 'REMOVED') AS removed_listings
  FROM scoped GROUP BY 1, 2, 3 HAVING count(*) >= 5
), snapshots AS (
  SELECT model_key, scope, window_days, median_mileage_km, median_days_on_market, new_listings, removed_listings,
    n AS sample_size, p10, p25, p50, p75, p90, mean, dispersion
  FROM whole JOIN quants USING (model_key, scope, window_days) JOIN level USING (model_key, scope, window_days)
)"""
MARKET_SNAPSHOTS_SQL = f"""
SELECT model_key, scope, window_days, median_mileage_km, round(median_days_on_market, 4) AS median_days_on_market,
  new_listings, removed_listings, sample_size, round(p10, 4) AS p10, round(p25, 4) AS p25, round(p50, 4) AS p50,
  round(p75, 4) AS p75, round(p90, 4) AS p90, mean, round(dispersion, 4) AS dispersion
FROM snapshots
"""


def _national(rows: DataFrame) -> DataFrame:
    """The 180-day national snapshot of all listings, the only one that finds and recommendations read."""
    return snapshots.build(rows, market.as_of(), windows=(180,), scopes=(snapshots.NATIONAL,))


def finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir)
    return rounded(snapshots.finds(rows, _national(rows)))


_DEPOSIT = " OR ".join(f"contains(lower(description), '{p}')" for p in snapshots.DEPOSIT_PHRASES)
FINDS_SQL = f"""
SELECT listing_id, l.model_key, city, round(price, 4) AS price, round(p50, 4) AS median_price, sample_size,
  round((p50 - price) / p50 * 100, 4) AS below_median_pct,
  round(CASE WHEN mileage_km <> 0 THEN (mileage_km - median_mileage_km) / nullif(median_mileage_km, 0) * 100 END, 4) AS mileage_vs_median_pct
FROM listings l JOIN snapshots s ON l.model_key = s.model_key AND scope = 'ALL' AND window_days = 180
WHERE status = 'ACTIVE' AND price > 0 AND damage IS FALSE AND sample_size >= 8 AND price < p25
  AND (p50 - price) / p50 <= 0.40 AND NOT ({_DEPOSIT})
ORDER BY (p50 - price) / p50 DESC, listing_id LIMIT 15
"""


def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir)
    return rounded(snapshots.discover(rows, _national(rows), 20_000.0, 40_000.0))


DISCOVER_SQL = """
SELECT listing_id, l.model_key, city, round(price, 4) AS price, round(p50, 4) AS median_price, last_seen,
  round((p50 - price) / nullif(p50, 0) * 100, 4) AS vs_median_pct
FROM listings l LEFT JOIN snapshots s ON l.model_key = s.model_key AND scope = 'ALL' AND window_days = 180
WHERE status = 'ACTIVE' AND price BETWEEN 20000 AND 40000 AND (p50 IS NULL OR price <= p50)
ORDER BY last_seen DESC, listing_id LIMIT 20
"""


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    analysed = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("price"))
    return rounded(snapshots.budgets(analysed, targets))


BUDGETS_SQL = """
WITH prices AS (
  SELECT o_custkey AS user_id, o_totalprice AS price
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
  WHERE rn <= 50 AND o_totalprice > 0
  UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0
), g AS (
  SELECT user_id, count(*) AS observations, median(price) AS centre, quantile_cont(price, 0.25) AS q1,
    quantile_cont(price, 0.75) AS q3 FROM prices GROUP BY 1 HAVING count(*) >= 3)
SELECT user_id, observations, round(centre, 4) AS centre,
  round(CASE WHEN observations < 4 OR q3 - q1 < centre * CAST(0.1 AS DOUBLE) THEN centre * CAST(0.8 AS DOUBLE) ELSE q1 END, 4) AS low,
  round(CASE WHEN observations < 4 OR q3 - q1 < centre * CAST(0.1 AS DOUBLE) THEN centre * CAST(1.2 AS DOUBLE) ELSE q3 END, 4) AS high
FROM g
"""


def _observed_to() -> Column:
    return F.lit(market.OBSERVED_TO).cast("timestamp_ntz")


def price_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = snapshots.days_before(_observed_to(), 30)
    return rounded(snapshots.price_moves(market.observations(spark, sf_dir), market.listings(spark, sf_dir), since))


PRICE_MOVES_SQL = f"""
, ends AS (SELECT listing_id, min_by(price, (observed_at, seq)) AS a, max_by(price, (observed_at, seq)) AS b
  FROM observations WHERE observed_at >= TIMESTAMP '{market.OBSERVED_TO}' - INTERVAL 30 DAY GROUP BY 1)
SELECT model_key, count(*) AS price_moves,
  round(CASE WHEN count(*) >= 3 THEN median((b - a) / a * 100) END, 4) AS median_move_pct
FROM ends e JOIN listings l ON e.listing_id = l.listing_id WHERE a > 0 AND a <> b GROUP BY 1
"""


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snapshots.history(market.observations(spark, sf_dir)))


PRICE_HISTORY_SQL = """
, steps AS (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY observed_at, seq) AS before FROM observations),
h AS (SELECT listing_id, count(*) AS observations, count(*) FILTER (price <> before) AS moves,
  min_by(price, (observed_at, seq)) AS a, max_by(price, (observed_at, seq)) AS b FROM steps GROUP BY 1)
SELECT listing_id, observations, moves, round(a, 4) AS original_price, round(b, 4) AS last_price,
  round(CASE WHEN observations >= 2 AND a > 0 THEN (b - a) / a * 100 END, 4) AS total_change_pct
FROM h
"""


def stretched(rows: DataFrame) -> DataFrame:
    """Listings with prices, mileages and years stretched, so that every plausibility check fires."""
    return rows.withColumns(
        {"price": F.col("price") * 30 - 30_000, "mileage_km": F.col("mileage_km") * 8, "model_year": F.col("model_year") - 30,
         "model": F.when(F.col("model") != "ECONOMY", F.col("model"))}
    )


STRETCHED_SQL = """
stretched AS (SELECT listing_id, model_key, last_seen, price * 30 - 30000 AS price, mileage_km * 8 AS km, model_year - 30 AS y,
  year(last_seen) AS now, CASE WHEN model <> 'ECONOMY' THEN model END AS model FROM listings),
issues AS (SELECT listing_id, model_key, last_seen, unnest([CASE WHEN price < 300 OR price > 3000000 THEN 'IMPLAUSIBLE_PRICE' END,
    CASE WHEN km > 1500000 THEN 'IMPLAUSIBLE_MILEAGE' END, CASE WHEN y < 1950 OR y > now + 2 THEN 'IMPLAUSIBLE_YEAR' END,
    CASE WHEN model IS NULL THEN 'UNRESOLVABLE' END]) AS issue FROM stretched)"""


def market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir)
    quality = stretched(rows).select(F.col("last_seen").alias("observed_at"), F.explode(state.issues(F.year("last_seen"))))
    built = snapshots.build(rows, market.as_of())
    return rounded(snapshots.overview(rows, built, market.observations(spark, sf_dir), quality, market.as_of(), _observed_to()))


OVERVIEW_SQL = f"""
SELECT * FROM (
  SELECT count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (last_seen >= {_AT} - INTERVAL 1 DAY) AS seen_24h,
    count(*) FILTER (first_seen >= {_AT} - INTERVAL 1 DAY) AS new_24h,
    count(*) FILTER (status = 'REMOVED' AND last_seen >= {_AT} - INTERVAL 1 DAY) AS removed_24h,
    count(DISTINCT model_key) AS configurations FROM listings),
 (SELECT count(*) FILTER (sample_size >= 5 AND scope = 'ALL') AS usable_snapshots,
    round(quantile_cont(median_days_on_market, 0.5), 4) AS median_days_on_market FROM snapshots),
 (SELECT count(*) FILTER (observed_at >= TIMESTAMP '{market.OBSERVED_TO}' - INTERVAL 1 DAY AND change_kind = 'PRICE_CHANGE')
    AS price_changes_24h FROM observations),
 (SELECT count(*) FILTER (issue IS NOT NULL AND last_seen >= {_AT} - INTERVAL 7 DAY) AS quality_issues_7d FROM issues)
"""

def stats_quantile_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each model's prices and the distance of their quartiles, without a window over a model."""
    found = stats.weighted_quantiles(market.listings(spark, sf_dir), ["model_key"], "price", large=True)
    return rounded(found.withColumn("iqr", F.col("p75") - F.col("p25")))


QUANTILE_SETS_SQL = f"""
SELECT model_key, n, round(p10, 4) AS p10, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p90, 4) AS p90, round(p75 - p25, 4) AS iqr
FROM ({quantiles_sql("listings", "model_key", "price", "1", ", listing_id")})
"""


def model_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price against mileage over all listings of each model, by counts of pairs."""
    lines = stats.theil_sen(market.listings(spark, sf_dir), ["model_key"], "mileage_km", "price", "listing_id", large=True)
    return rounded(lines.withColumn("intercept", F.round("intercept", 2)), 6)


MODEL_SLOPES_SQL = """
, p AS (SELECT model_key, listing_id, CAST(mileage_km AS DOUBLE) AS x, price AS y FROM listings),
s AS (SELECT a.model_key, median((b.y - a.y) / (b.x - a.x)) AS slope FROM p a JOIN p b ON a.model_key = b.model_key AND a.listing_id < b.listing_id AND a.x <> b.x GROUP BY 1)
SELECT model_key, round(any_value(slope), 6) AS slope, round(median(y - slope * x), 2) AS intercept, count(*) AS n_points, max(x) - min(x) AS x_span
FROM p JOIN s USING (model_key) GROUP BY 1 HAVING count(*) >= 3
"""

QUERIES = {
    "stats_spread": stats_spread,
    "stats_quantile_sets": stats_quantile_sets,
    "model_slopes": model_slopes,
    "stats_outliers": stats_outliers,
    "stats_weighted_quantiles": stats_weighted_quantiles,
    "stats_interpolated_quantiles": stats_interpolated_quantiles,
    "stats_percentile_rank": stats_percentile_rank,
    "stats_effective_size": stats_effective_size,
    "market_snapshots": market_snapshots,
    "finds": finds,
    "discover": discover,
    "budgets": budgets,
    "price_moves": price_moves,
    "price_history": price_history,
    "market_overview": market_overview,
}

ORACLE_SQL = {
    "stats_spread": _twin(SPREAD_SQL, market.LISTINGS_SQL),
    "stats_quantile_sets": _twin(QUANTILE_SETS_SQL, market.LISTINGS_SQL),
    "model_slopes": _twin(MODEL_SLOPES_SQL, market.LISTINGS_SQL),
    "stats_outliers": _twin(OUTLIERS_SQL, market.OBSERVATIONS_SQL),
    "stats_weighted_quantiles": _twin(WEIGHTED_QUANTILES_SQL, market.LISTINGS_SQL),
    "stats_interpolated_quantiles": INTERPOLATED_SQL,
    "stats_percentile_rank": _twin(PERCENTILE_RANK_SQL, market.LISTINGS_SQL, market.SUBJECTS_SQL),
    "stats_effective_size": _twin(EFFECTIVE_SQL, market.LISTINGS_SQL),
    "market_snapshots": _twin(MARKET_SNAPSHOTS_SQL, market.LISTINGS_SQL, SNAPSHOTS_SQL),
    "finds": _twin(FINDS_SQL, market.LISTINGS_SQL, SNAPSHOTS_SQL),
    "discover": _twin(DISCOVER_SQL, market.LISTINGS_SQL, SNAPSHOTS_SQL),
    "budgets": BUDGETS_SQL,
    "price_moves": _twin(PRICE_MOVES_SQL, market.LISTINGS_SQL, market.OBSERVATIONS_SQL),
    "price_history": _twin(PRICE_HISTORY_SQL, market.OBSERVATIONS_SQL),
    "market_overview": _twin(OVERVIEW_SQL, market.LISTINGS_SQL, SNAPSHOTS_SQL, market.OBSERVATIONS_SQL, STRETCHED_SQL),
}

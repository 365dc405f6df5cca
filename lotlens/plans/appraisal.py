"""Comparables, valuation, risk, rating, confidence and negotiation over the test tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import disclosures, normalise
from ..operators import comparables, judgement, snapshots, stats, valuation
from ..session import once
from ..sources import market
from .ingestion import _FOLD, readings_sql
from .statistics import _AT, _twin, quantiles_sql, rounded

# Descriptions dealt to the subjects by their id
DESCRIPTIONS = ("Vurulmayıb, rənglənib", "İdeal vəziyyətdə", "Təmir tələb edir, vuruğu var", "Yeni gəlib")


# With ``whole`` a subject meets every listing of its model in the window and keeps every comparable of its tiers; without, the
# policy's latest 2000 listings of a model and first 300 comparables.  Each query goes by what its SQL says.


def _name(name: str, whole: bool) -> str:
    return f"whole_{name}" if whole else name


def _sides(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Subjects, and the listings of each model that they are compared with."""
    rows = market.listings(spark, sf_dir)
    subjects = once(spark, sf_dir, "subjects", lambda: market.subjects(spark, sf_dir, rows))
    most = None if whole else comparables.MOST_CANDIDATES
    return subjects, once(spark, sf_dir, _name("latest", whole), lambda: comparables.latest(rows, market.as_of(), most))


def _chosen(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    subjects, latest = _sides(spark, sf_dir, whole)
    most = None if whole else comparables.MAX_SAMPLE
    return once(spark, sf_dir, _name("chosen", whole), lambda: comparables.choose(subjects, latest, market.as_of(), most))


def _summary(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    subjects, latest = _sides(spark, sf_dir, whole)
    chosen = _chosen(spark, sf_dir, whole)

    def build() -> DataFrame:
        return comparables.summarise(subjects, comparables.tally(subjects, latest, market.as_of())[0], chosen)

    return once(spark, sf_dir, _name("summary", whole), build)


def _one_of(index: Column, values: tuple) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def comparables_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _chosen(spark, sf_dir, True).select(
        "subject_id", "listing_id", "rank", "similarity", "tier", "weight", "age_days", "tier_used", "widened",
        F.array_join(comparables.differences(), "; ").alias("differences"),
    )
    return rounded(chosen, 6)


def _unless_unknown(name: str, score: str, text: bool = True) -> str:
    unknown = f" OR {name} = 'UNKNOWN' OR s_{name} = 'UNKNOWN'" if text else ""
    return f"CASE WHEN {name} IS NULL OR s_{name} IS NULL{unknown} THEN 5e-1 ELSE {score} END"


_FUEL = """CASE WHEN fuel = s_fuel THEN 1e0
  WHEN least(fuel, s_fuel) = 'LPG' AND greatest(fuel, s_fuel) = 'PETROL' THEN 75e-2
  WHEN least(fuel, s_fuel) = 'HYBRID' AND greatest(fuel, s_fuel) = 'PLUGIN_HYBRID' THEN 6e-1
  WHEN fuel IN ('HYBRID', 'PLUGIN_HYBRID', 'ELECTRIC') AND s_fuel IN ('HYBRID', 'PLUGIN_HYBRID', 'ELECTRIC') THEN 35e-2
  WHEN fuel IN ('PETROL', 'DIESEL', 'LPG', 'CNG') AND s_fuel IN ('PETROL', 'DIESEL', 'LPG', 'CNG') THEN 25e-2 ELSE 0e0 END"""
_BODY = """CASE WHEN body = s_body THEN 1e0
  WHEN least(body, s_body) = 'CROSSOVER' AND greatest(body, s_body) = 'SUV' THEN 8e-1
  WHEN least(body, s_body) = 'SEDAN' AND greatest(body, s_body) = 'WAGON' THEN 6e-1 ELSE 2e-1 END"""
_GAP = "abs(displacement_l - s_displacement_l)"
_SCORES = {
    "20e-2": _unless_unknown("model_year", "greatest(0e0, 1e0 - abs(model_year - s_model_year) / 4e0)", False),
    "18e-2": _unless_unknown("generation", "CASE WHEN generation = s_generation THEN 1e0 ELSE 0e0 END"),
    "14e-2": _unless_unknown("displacement_l", f"CASE WHEN {_GAP} < 5e-2 THEN 1e0 WHEN {_GAP} <= 2e-1 THEN 7e-1 WHEN {_GAP} <= 5e-1 THEN 4e-1 WHEN {_GAP} <= 1e0 THEN 15e-2 ELSE 0e0 END", False),
    "120e-3": _unless_unknown("drivetrain", "CASE WHEN drivetrain = s_drivetrain THEN 1e0 WHEN 'AWD' IN (drivetrain, s_drivetrain) THEN 3e-1 ELSE 35e-2 END"),
    "12e-2": _unless_unknown("fuel", _FUEL),
    "10e-2": _unless_unknown("transmission", "CASE WHEN transmission = s_transmission THEN 1e0 WHEN transmission IN ('AUTOMATIC', 'CVT', 'DCT', 'AMT') AND s_transmission IN ('AUTOMATIC', 'CVT', 'DCT', 'AMT') THEN 6e-1 ELSE 1e-1 END"),
    "8e-2": _unless_unknown("trim", "CASE WHEN trim = s_trim THEN 1e0 ELSE 25e-2 END"),
    "6e-2": _unless_unknown("body", _BODY),
}
_SIMILARITY = "round(" + " + ".join(f"({s}) * {w}" for w, s in _SCORES.items()) + ", 4)"


def _apart(name: str, words: str) -> str:
    return f"CASE WHEN {name} <> 'UNKNOWN' AND s_{name} <> 'UNKNOWN' AND {name} <> s_{name} THEN {words} END"


_CRN = "row_number() OVER (PARTITION BY model_key ORDER BY last_seen DESC, listing_id DESC) AS crn"


def _comparables_sql(whole: bool) -> str:
    among, cap, first = ("*", "", "") if whole else (f"*, {_CRN}", "crn <= 2000 AND ", " WHERE rank <= 300")
    return f"""
scored AS (
  SELECT *, CASE WHEN similarity >= 9e-1 THEN 1 WHEN similarity >= 75e-2 THEN 2 WHEN similarity >= 55e-2 THEN 3
                 WHEN similarity IS NOT NULL THEN 4 END AS tier,
    round(pow(similarity, 25e-1) * pow(5e-1, age_days / 90e0)
      * greatest(5e-1, exp(-5e-1 * pow(abs(s_mileage_km - mileage_km) / 80000e0, 2)))
      * CASE WHEN city = s_city THEN 1e0 ELSE 7e-1 END, 6) AS weight
  FROM (SELECT *, CASE WHEN age_days <= 180 THEN {_SIMILARITY} END AS similarity
        FROM (SELECT *, greatest(CAST(floor(epoch({_AT} - last_seen) / 86400) AS BIGINT), 0) AS age_days
              FROM (SELECT {among}
                    FROM listings WHERE last_seen >= {_AT} - INTERVAL 180 DAY AND price > 0)
              JOIN subjects ON model_key = s_model_key
              WHERE {cap}source_url <> s_source_url))
), fit AS (
  SELECT *, count(*) FILTER (tier = 1) OVER (PARTITION BY subject_id) AS n1,
    count(*) FILTER (tier <= 2) OVER (PARTITION BY subject_id) AS n2
  FROM scored WHERE similarity >= 45e-2 AND tier <= 3
), admitted AS (
  SELECT * FROM fit WHERE tier <= CASE WHEN n1 >= 25 THEN 1 WHEN n2 >= 25 THEN 2 ELSE 3 END
), chosen AS (
  SELECT *, tier_used > 1 AS widened FROM (
    SELECT *, max(tier) OVER (PARTITION BY subject_id) AS tier_used,
      row_number() OVER (PARTITION BY subject_id ORDER BY tier, weight DESC, listing_id) AS rank
    FROM admitted){first}
), tried AS (
  SELECT subject_id, count(*) AS considered, count(*) FILTER (similarity IS NULL) AS excluded_stale,
    count(*) FILTER (similarity < 45e-2) AS excluded_dissimilar,
    count(*) FILTER (similarity >= 45e-2 AND tier > 3) AS left_in_tier_4 FROM scored GROUP BY 1
), set_of AS (
  SELECT subject_id, count(*) AS size, sum(weight) * sum(weight) / sum(weight * weight) AS effective_size,
    avg(similarity) AS mean_similarity, sum(similarity * weight) / sum(weight) AS weighted_similarity,
    max(tier_used) AS tier_used, bool_or(widened) AS widened, count(*) FILTER (tier = 1) AS tier_1,
    count(*) FILTER (tier = 2) AS tier_2, count(*) FILTER (tier = 3) AS tier_3, median(age_days) AS median_age_days,
    median(mileage_km) AS median_mileage_km, count(mileage_km) AS with_mileage,
    count(*) FILTER (city = s_city) AS local,
    avg(CASE WHEN price < s_price THEN 1e0 WHEN price = s_price THEN 5e-1 ELSE 0e0 END) * 100 AS percentile
  FROM chosen GROUP BY 1
), summary AS (
  SELECT s.subject_id, coalesce(considered, 0) AS considered, coalesce(excluded_stale, 0) AS excluded_stale,
    coalesce(excluded_dissimilar, 0) AS excluded_dissimilar, coalesce(left_in_tier_4, 0) AS left_in_tier_4,
    coalesce(size, 0) AS size, coalesce(effective_size, 0e0) AS effective_size,
    coalesce(mean_similarity, 0e0) AS mean_similarity, coalesce(weighted_similarity, 0e0) AS weighted_similarity,
    coalesce(tier_used, 1) AS tier_used, coalesce(widened, false) AS widened, coalesce(tier_1, 0) AS tier_1,
    coalesce(tier_2, 0) AS tier_2, coalesce(tier_3, 0) AS tier_3, median_age_days, median_mileage_km,
    coalesce(with_mileage, 0) AS with_mileage, coalesce(local, 0) AS local, percentile
  FROM subjects s LEFT JOIN tried USING (subject_id) LEFT JOIN set_of USING (subject_id)
)"""


COMPARABLES_SQL, WHOLE_SQL = _comparables_sql(False), _comparables_sql(True)

CHOSEN_SQL = f"""
SELECT subject_id, listing_id, rank, similarity, tier, weight, age_days, tier_used, widened,
  concat_ws('; ',
    CASE WHEN model_year <> s_model_year THEN abs(model_year - s_model_year) || ' model year'
      || CASE WHEN abs(model_year - s_model_year) > 1 THEN 's' ELSE '' END
      || CASE WHEN model_year > s_model_year THEN ' newer' ELSE ' older' END END,
    CASE WHEN trim <> s_trim THEN 'trim ' || trim || ' vs ' || s_trim END,
    CASE WHEN {_GAP} >= 5e-2 THEN format('{{:.1f}}L engine vs {{:.1f}}L', displacement_l, s_displacement_l) END,
    {_apart("transmission", "lower(transmission) || ' gearbox'")}, {_apart("drivetrain", "drivetrain || ' drivetrain'")},
    {_apart("fuel", "lower(fuel) || ' fuel'")},
    CASE WHEN abs(mileage_km - s_mileage_km) >= 10000 THEN format('{{:,}}', abs(mileage_km - s_mileage_km))
      || CASE WHEN mileage_km > s_mileage_km THEN ' km more' ELSE ' km less' END END) AS differences
FROM chosen
"""


def comparables_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_summary(spark, sf_dir, True))


SUMMARY_SQL = """
SELECT * REPLACE (round(effective_size, 4) AS effective_size, round(mean_similarity, 4) AS mean_similarity,
  round(weighted_similarity, 4) AS weighted_similarity, round(median_age_days, 4) AS median_age_days,
  round(median_mileage_km, 4) AS median_mileage_km, round(percentile, 4) AS percentile)
FROM summary
"""


def _valued(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Subjects, their comparables, the summary of these and the valuation, each made once for all queries."""
    subjects, _ = _sides(spark, sf_dir, whole)
    chosen, summary = _chosen(spark, sf_dir, whole), _summary(spark, sf_dir, whole)
    return subjects, chosen, summary, once(spark, sf_dir, _name("valued", whole), lambda: valuation.value(summary, chosen))


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valued(spark, sf_dir)[-1]


def _fit_sql(name: str, x: str, span: str, wrong: str) -> str:
    return f"""
, {name}_fit AS (
  SELECT a.subject_id, median((b.price - a.price) / CAST(b.{x} - a.{x} AS DOUBLE)) AS slope
  FROM kept a JOIN kept b ON a.subject_id = b.subject_id AND a.listing_id < b.listing_id AND a.{x} <> b.{x}
  GROUP BY 1
), {name}_reasons AS (
  SELECT subject_id, points, slope, CASE WHEN points < 8 OR slope IS NULL OR span < {span} THEN 'INSUFFICIENT_DATA'
      WHEN slope {wrong} 0 THEN 'NOT_MATERIAL' ELSE 'APPLIED' END AS reason
  FROM (SELECT subject_id, count(*) AS points, max({x}) - min({x}) AS span FROM kept GROUP BY 1)
  LEFT JOIN {name}_fit USING (subject_id)
), {name} AS (
  SELECT subject_id, points AS {name}_points, reason AS {name}_reason,
    CASE WHEN reason = 'APPLIED' THEN slope END AS {name}_slope FROM {name}_reasons
)"""


def _move(name: str, x: str) -> str:
    slope = f"{name}_slope * (s_{x} - {x})"
    return f"CASE WHEN {slope} IS NULL THEN 0e0 ELSE least(greatest({slope}, -(price * 3e-1)), price * 3e-1) END"


_Q = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
_APPLIED = lambda n: f"""CASE WHEN {n}_reason = 'APPLIED' THEN round(centre - least(greatest(no_{n}, raw * 45e-2), raw * 2e0)) ELSE 0e0 END"""
_CONF = lambda n: f"CASE WHEN {n}_reason = 'APPLIED' THEN round(least(95e-2, {n}_points / ({n}_points + 20e0) * 16e-1), 3) ELSE 0e0 END"

VALUED_SQL = (
    """
mids AS (
  SELECT c.subject_id, median(price) AS m, count(*) AS n_all FROM chosen c JOIN summary s ON c.subject_id = s.subject_id
  WHERE s.size >= 5 GROUP BY 1
), devs AS (
  SELECT c.subject_id, any_value(m) AS m, any_value(n_all) AS n_all, median(abs(price - m)) AS mad,
    avg(abs(price - m)) AS mean_dev FROM chosen c JOIN mids USING (subject_id) GROUP BY 1
), marked AS (
  SELECT c.*, n_all >= 8 AND sigma > 0 AND (price < m - 35e-1 * sigma OR price > m + 35e-1 * sigma) AS out
  FROM chosen c JOIN (SELECT *, CASE WHEN mad > 0 THEN 14826e-4 * mad ELSE 12533e-4 * mean_dev END AS sigma FROM devs)
    USING (subject_id)
), kept AS (
  SELECT * FROM (SELECT *, count(*) FILTER (NOT out) OVER (PARTITION BY subject_id) AS stays,
      count(*) OVER (PARTITION BY subject_id) AS of_all FROM marked)
  WHERE NOT out OR stays < 5
)"""
    + _fit_sql("mileage", "mileage_km", "25000", ">=")
    + _fit_sql("age", "model_year", "2", "<=")
    + f"""
, moved AS (
  SELECT *, greatest(1e0, price + mv + av) AS p_all, greatest(1e0, price + av) AS p_no_mileage,
    greatest(1e0, price + mv) AS p_no_age
  FROM (SELECT k.*, {_move("mileage", "mileage_km")} AS mv, {_move("age", "model_year")} AS av
        FROM kept k JOIN mileage USING (subject_id) JOIN age USING (subject_id))
), raws AS ({quantiles_sql("moved", "subject_id", "price", "weight", ", listing_id", {"raw": 0.5} | {f"raw_{k}": q for k, q in _Q.items()})}
), alls AS ({quantiles_sql("moved", "subject_id", "p_all", "weight", ", listing_id", {"al": 0.5, "lq": 0.17, "hq": 0.83} | {f"norm_{k}": q for k, q in _Q.items()})}
), no_m AS ({quantiles_sql("moved", "subject_id", "p_no_mileage", "weight", ", listing_id", {"no_mileage": 0.5})}
), no_a AS ({quantiles_sql("moved", "subject_id", "p_no_age", "weight", ", listing_id", {"no_age": 0.5})}
), levels AS (
  SELECT v.subject_id, round(CASE WHEN median(abs(p_all - pm)) > 0 THEN 14826e-4 * median(abs(p_all - pm))
      ELSE 12533e-4 * avg(abs(p_all - pm)) END / abs(any_value(pm)), 4) AS dispersion,
    count(*) AS comparables_used, max(CASE WHEN stays < 5 THEN 0 ELSE of_all - stays END) AS outliers_removed
  FROM moved v JOIN (SELECT subject_id, median(p_all) AS pm FROM moved GROUP BY 1) USING (subject_id) GROUP BY 1
), groups AS (
  SELECT subject_id, count(*) FILTER (city = s_city) AS nl, count(*) FILTER (city <> s_city) AS no,
    median(price) FILTER (city = s_city) AS ml, median(price) FILTER (city <> s_city) AS mo,
    bool_or(coalesce(s_damage, false)) AS damaged, count(*) FILTER (damage) AS nd, count(*) FILTER (NOT damage) AS nc,
    median(price) FILTER (damage) AS md, median(price) FILTER (NOT damage) AS mc FROM kept GROUP BY 1
), centred AS (
  SELECT *, least(greatest(al, raw * 45e-2), raw * 2e0) AS centre,
    sqrt(1e0 + 1e0 / greatest(1e0, effective_size)) AS inflate
  FROM summary LEFT JOIN raws USING (subject_id) LEFT JOIN alls USING (subject_id) LEFT JOIN no_m USING (subject_id)
    LEFT JOIN no_a USING (subject_id) LEFT JOIN levels USING (subject_id) LEFT JOIN mileage USING (subject_id)
    LEFT JOIN age USING (subject_id) LEFT JOIN groups USING (subject_id)
), valued AS (
  SELECT subject_id, CASE WHEN size >= 5 THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS outcome, 'ASKING' AS basis,
    round(centre) AS central,
    CASE WHEN centre IS NOT NULL THEN round(greatest(1e0, greatest(least(centre - (centre - lq) * inflate, centre * (1e0 - 25e-3)), centre * (1e0 - 35e-2)))) END AS low,
    CASE WHEN centre IS NOT NULL THEN round(least(greatest(centre + (hq - centre) * inflate, centre * (1e0 + 25e-3)), centre * (1e0 + 35e-2))) END AS high,
    round(raw) AS raw_median, comparables_used, outliers_removed, dispersion,
    {", ".join(f"round(norm_{k}, 4) AS norm_{k}, round(raw_{k}, 4) AS raw_{k}" for k in _Q)},
    {_APPLIED("mileage")} AS mileage_amount, mileage_reason, mileage_points, round(mileage_slope, 6) AS mileage_slope,
    {_CONF("mileage")} AS mileage_confidence,
    {_APPLIED("age")} AS age_amount, age_reason, age_points, round(age_slope, 6) AS age_slope, {_CONF("age")} AS age_confidence,
    CASE WHEN nl >= 10 AND no >= 10 THEN round(ml - mo) WHEN nl IS NOT NULL THEN 0e0 END AS geography_amount,
    CASE WHEN nl >= 10 AND no >= 10 THEN 'APPLIED' WHEN nl IS NOT NULL THEN 'INSUFFICIENT_DATA' END AS geography_reason,
    CASE WHEN damaged AND nd >= 8 AND nc >= 8 THEN round(md - mc) WHEN nd IS NOT NULL THEN 0e0 END AS disclosure_amount,
    CASE WHEN nd IS NULL THEN NULL WHEN NOT damaged THEN 'INPUT_UNKNOWN' WHEN nd < 8 OR nc < 8 THEN 'INSUFFICIENT_DATA'
      ELSE 'APPLIED' END AS disclosure_reason
  FROM centred
)"""
)
VALUATIONS_SQL = "\nSELECT * FROM valued"


def slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price against mileage over each subject's comparables, of which the policy admits 300 at most."""
    return stats.theil_sen(_chosen(spark, sf_dir), ["subject_id"], "mileage_km", "price", "listing_id", large=True)


_MIDDLE = "(list_sort(list({0}))[(count({0}) + 1) // 2] + list_sort(list({0}))[count({0}) // 2 + 1]) / 2"
SLOPES_SQL = f"""
, p AS (SELECT subject_id, listing_id, CAST(mileage_km AS DOUBLE) AS x, price AS y FROM chosen),
d AS (SELECT a.subject_id, (b.y - a.y) / (b.x - a.x) AS v
  FROM p a JOIN p b ON a.subject_id = b.subject_id AND a.listing_id < b.listing_id AND a.x <> b.x),
s AS (SELECT subject_id, {_MIDDLE.format("v")} AS slope FROM d GROUP BY 1),
r AS (SELECT p.*, slope, y - slope * x AS rest FROM p JOIN s USING (subject_id))
SELECT subject_id, any_value(slope) AS slope, {_MIDDLE.format("rest")} AS intercept, count(*) AS n_points, max(x) - min(x) AS x_span
FROM r GROUP BY 1 HAVING count(*) >= 3
"""


def _facts(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Subjects with summary, valuation, history and the dealt details; and the moves of their comparables."""
    subjects, chosen, summary, valued = _valued(spark, sf_dir, whole)
    history = snapshots.history(market.observations(spark, sf_dir)).select("listing_id", "moves", "total_change_pct")
    fields = {n: F.col(f"s_{n}") for n in normalise.SPECIFICITY if n != "engine_code"}
    key = F.col("subject_id")
    facts = (
        subjects.join(summary, "subject_id")
        .join(valued, "subject_id")
        .join(history.withColumnRenamed("listing_id", "subject_id"), "subject_id", "left")
        .fillna(0, ["moves"])
        .withColumns(
            {
                "read": disclosures.read(_one_of(key % len(DESCRIPTIONS), DESCRIPTIONS)),
                "s_repaint": F.lit(None).cast("boolean"),
                "vin": F.when(key % 3 != 0, F.lit("VIN")),
                "has_records": key % 2 == 0,
                "owners": F.when(key % 5 != 0, key % 4),
                "conflicts": key % 3,
                "days_listed": judgement.days_listed(market.as_of(), F.col("s_first_seen")),
                "specificity": normalise.specificity(fields),
                "verified_share": (key % 4) / 4,
            }
        )
    )
    made = facts
    facts = once(spark, sf_dir, _name("facts", whole), lambda: made)
    moves = (
        chosen.select("subject_id", "listing_id")
        .join(history, "listing_id")
        .filter(F.col("total_change_pct") != 0)
        .groupBy("subject_id")
        .agg(F.count("*").alias("comparable_moves"), F.median("total_change_pct").alias("_move_pct"))
    )
    return facts, moves


_READINGS = readings_sql("told_folded", "told_lower")
FACTS_SQL = f"""
hist AS (
  SELECT listing_id, count(*) FILTER (price <> before) AS moves,
    CASE WHEN count(*) >= 2 AND min_by(price, (observed_at, seq)) > 0
      THEN (max_by(price, (observed_at, seq)) - min_by(price, (observed_at, seq))) / min_by(price, (observed_at, seq)) * 100 END AS change
  FROM (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY observed_at, seq) AS before FROM observations) GROUP BY 1
), facts AS (
  SELECT *, coalesce(h.moves, 0) AS n_moves, {_READINGS["damage"]} AS rd,
    {_READINGS["repaint"]} AS rp, {_READINGS["needs_repair"]} AS rr, {_READINGS["claims"]} AS rc,
    subject_id % 2 = 0 AS has_records,
    (subject_id % 3 = 0)::INT + (subject_id % 2 <> 0)::INT + (subject_id % 5 = 0)::INT AS missing, subject_id % 3 AS conflicts,
    greatest(CAST(floor(epoch({_AT} - s_first_seen) / 86400) AS BIGINT), 0) AS days_listed,
    round(14e-2 + 14e-2 + 13e-2 + 10e-2 + 9e-2 + CASE WHEN s_displacement_l IS NOT NULL THEN 9e-2 ELSE 0 END
      + CASE WHEN s_fuel <> 'UNKNOWN' THEN 8e-2 ELSE 0 END + 8e-2 + CASE WHEN s_drivetrain <> 'UNKNOWN' THEN 8e-2 ELSE 0 END
      + CASE WHEN s_body <> 'UNKNOWN' THEN 4e-2 ELSE 0 END, 4) AS specificity,
    (subject_id % 4) / 4e0 AS verified_share
  FROM (SELECT *, {_FOLD.format("stated")} AS told_folded, lower(stated) AS told_lower
        FROM (SELECT *, {market._pick_sql("subject_id", DESCRIPTIONS)} AS stated FROM subjects))
    JOIN summary USING (subject_id) JOIN valued USING (subject_id) LEFT JOIN hist h ON h.listing_id = subject_id
), below AS (
  SELECT *, CASE WHEN outcome = 'OK' AND s_price < low THEN (low - s_price) / low END AS under,
    CASE WHEN with_mileage >= 5 AND median_mileage_km > 0 THEN s_mileage_km / median_mileage_km END AS ratio,
    coalesce(s_damage, rd) AS is_damaged FROM facts
), sig AS (
  SELECT subject_id, unnest([
    {{'kind': 'PRICE_ANOMALY', 'rank': CASE WHEN under >= 25e-2 THEN 3 WHEN under >= 15e-2 THEN 2 WHEN under >= 8e-2 THEN 1 END, 'conf': least(95e-2, under + 5e-1)}},
    {{'kind': 'MILEAGE_ANOMALY', 'rank': CASE WHEN ratio >= 18e-1 THEN 2 WHEN ratio >= 14e-1 THEN 1 END, 'conf': 9e-1}},
    {{'kind': 'INCONSISTENCY', 'rank': CASE WHEN conflicts > 1 THEN 2 WHEN conflicts > 0 THEN 1 END, 'conf': 85e-2}},
    {{'kind': 'HISTORY_GAPS', 'rank': CASE WHEN missing >= 2 THEN 2 WHEN missing > 0 THEN 1 END, 'conf': 1e0}},
    {{'kind': 'LISTING_BEHAVIOUR', 'rank': CASE WHEN days_listed >= 120 THEN 2 WHEN days_listed >= 60 OR n_moves >= 3 THEN 1 END, 'conf': 8e-1}},
    {{'kind': 'DAMAGE', 'rank': CASE WHEN is_damaged THEN 2 END, 'conf': 95e-2}},
    {{'kind': 'REPAINT', 'rank': CASE WHEN rp THEN 1 END, 'conf': 9e-1}},
    {{'kind': 'NEEDS_REPAIR', 'rank': CASE WHEN rr THEN 3 END, 'conf': 85e-2}},
    {{'kind': CASE WHEN size < 5 THEN 'NO_COVERAGE' ELSE 'THIN_MARKET' END, 'rank': CASE WHEN size < 15 OR widened THEN 1 END, 'conf': 75e-2}},
    {{'kind': 'UNVERIFIED_CLAIMS', 'rank': CASE WHEN rc > 0 THEN 0 END, 'conf': 7e-1}}]) AS s
  FROM below
), weighed AS (
  SELECT subject_id, s.kind AS kind, s.rank AS rank, s.conf AS conf,
    least(([2e-2, 8e-2, 18e-2, 35e-2, 55e-2])[s.rank + 1] * s.conf, 95e-2) AS w FROM sig WHERE s.rank IS NOT NULL
), totals AS (
  SELECT subject_id, 1e0 - product(1e0 - w) AS total, string_agg(kind, ',' ORDER BY rank DESC, conf DESC, kind) AS kinds,
    count(*) FILTER (rank >= 3) AS n_grave, count(*) FILTER (rank = 2) AS n_mild FROM weighed GROUP BY 1
), tops AS (
  SELECT subject_id, round(max((1e0 - total) * w / (1e0 - w) * 100), 1) AS top_points FROM weighed JOIN totals USING (subject_id) GROUP BY 1
), risks AS (
  SELECT *, CASE WHEN risk_score <= 20 THEN 'LOW' WHEN risk_score <= 40 THEN 'MODERATE_LOW' WHEN risk_score <= 60 THEN 'MODERATE'
    WHEN risk_score <= 80 THEN 'HIGH' ELSE 'VERY_HIGH' END AS risk_band
  FROM (SELECT *, CAST(round(coalesce(total, 0e0) * 100) AS INTEGER) AS risk_score
        FROM below LEFT JOIN totals USING (subject_id) LEFT JOIN tops USING (subject_id))
)"""


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgement.assess_risk(_facts(spark, sf_dir)[0])
    return rows.select(
        "subject_id", "risk_score", "risk_band",
        F.array_join(F.transform("signals", lambda s: s["kind"]), ",").alias("kinds"),
        F.get("contributions", F.lit(0))["points"].alias("top_points"),
        F.array_join("positives", ",").alias("positives"),
    )


RISK_SQL = """
SELECT subject_id, risk_score, risk_band, coalesce(kinds, '') AS kinds, top_points,
  concat_ws(',', CASE WHEN size >= 25 AND NOT widened THEN 'WELL_SUPPORTED' END, CASE WHEN has_records THEN 'RECORDS' END,
    CASE WHEN NOT rd THEN 'STATED_UNDAMAGED' END,
    CASE WHEN with_mileage >= 5 AND median_mileage_km > 0 AND s_mileage_km <= median_mileage_km * 85e-2 THEN 'LOW_MILEAGE' END,
    CASE WHEN outcome = 'OK' AND dispersion < 8e-2 THEN 'CLOSE_AGREEMENT' END) AS positives
FROM risks
"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgement.rate(judgement.assess_risk(_facts(spark, sf_dir, True)[0]))
    kept = rows.select(
        "subject_id", "rating", "difference", "difference_pct", "z", "within_range", "total_gap", "explained",
        "explained_share", "material_unexplained", F.array_join(judgement.explanations(), ",").alias("explanations"),
    )
    return rounded(kept)


RATED_SQL = """
gaps AS (
  SELECT *, CASE WHEN outcome = 'OK' THEN s_price - central END AS difference,
    CASE WHEN outcome = 'OK' THEN (s_price - central) / central * 100 END AS difference_pct,
    CASE WHEN outcome = 'OK' THEN (s_price - central) / greatest((high - low) / 2, central * 1e-2) END AS z,
    CASE WHEN outcome = 'OK' THEN s_price BETWEEN low AND high END AS within_range,
    CASE WHEN outcome = 'OK' THEN s_price - raw_median END AS total_gap,
    CASE WHEN outcome = 'OK' THEN central - raw_median END AS explained
  FROM risks
), shares AS (
  SELECT *, CASE WHEN NOT (abs(total_gap) < 1 AND abs(difference) < 1)
    THEN CASE WHEN total_gap = 0 THEN 1e0 ELSE least(greatest(1e0 - abs(difference) / abs(total_gap), 0e0), 1e0) END END AS explained_share
  FROM gaps
), rated AS (
  SELECT *, CASE WHEN outcome <> 'OK' THEN 'INSUFFICIENT_DATA' WHEN abs(difference_pct) < 25e-1 THEN 'FAIR_VALUE'
      WHEN z <= -2 AND difference_pct <= -18 THEN CASE WHEN material_unexplained THEN 'SUSPICIOUSLY_CHEAP'
        WHEN risk_score <= 40 THEN 'GREAT_VALUE' ELSE 'GOOD_VALUE' END
      WHEN z <= -12e-1 AND difference_pct <= -6 THEN CASE WHEN risk_score <= 40 THEN 'GREAT_VALUE' ELSE 'GOOD_VALUE' END
      WHEN z <= -5e-1 AND difference_pct <= -25e-1 THEN 'GOOD_VALUE'
      WHEN z >= 13e-1 AND difference_pct >= 8 THEN 'OVERPRICED'
      WHEN z >= 6e-1 AND difference_pct >= 25e-1 THEN 'HIGH_PRICED' ELSE 'FAIR_VALUE' END AS rating
  FROM (SELECT *, coalesce(total_gap <> 0 AND 1e0 - explained_share >= 35e-2, false) AS material_unexplained FROM shares)
)"""
RATINGS_SQL = """
SELECT subject_id, rating, round(difference, 4) AS difference, round(difference_pct, 4) AS difference_pct, round(z, 4) AS z,
  within_range, round(total_gap, 4) AS total_gap, round(explained, 4) AS explained,
  round(explained_share, 4) AS explained_share, material_unexplained,
  CASE WHEN difference < 0 AND material_unexplained THEN concat_ws(',', 'UNACCOUNTED_DISCOUNT',
    CASE WHEN NOT has_records THEN 'INCOMPLETE_MAINTENANCE' END, CASE WHEN s_damage IS NULL THEN 'UNDISCLOSED_REPAIR' END,
    CASE WHEN s_trim IS NULL THEN 'LOWER_EQUIPMENT' END, CASE WHEN days_listed > 45 THEN 'MOTIVATED_SELLER' END,
    CASE WHEN n_grave > 0 THEN 'RISK_SIGNALS' END, 'UNCONFIRMED') ELSE '' END AS explanations
FROM rated
"""


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgement.confidence(_facts(spark, sf_dir)[0])
    parts = [f"c_{k}" for k in judgement.CONFIDENCE_WEIGHT]
    return rows.select(
        "subject_id", "confidence", "confidence_band", F.array_join("limiting", ",").alias("limiting"),
        *(F.round(p, 3).alias(p) for p in parts),
    )


CONFIDENCE_SQL = """
, parts AS (
  SELECT subject_id, outcome, round(effective_size / (effective_size + 18e0), 4) AS c_sample_size,
    round(least(greatest((weighted_similarity - 5e-1) / 45e-2, 0e0), 1e0), 4) AS c_similarity,
    round(specificity * 7e-1 + 3e-1, 4) AS c_completeness, round(pow(5e-1, median_age_days / 60e0), 4) AS c_freshness,
    round(1e0 - CASE WHEN dispersion <= 0 THEN 0e0 ELSE dispersion / (dispersion + 14e-2) END, 4) AS c_agreement,
    round(local / CAST(size AS DOUBLE), 4) AS c_geography, round(verified_share, 4) AS c_verification
  FROM facts
), summed AS (
  SELECT *, CASE WHEN outcome = 'OK' THEN least(greatest(c_sample_size * 25e-2 + c_similarity * 22e-2 + c_completeness * 15e-2
    + c_freshness * 13e-2 + c_agreement * 12e-2 + c_geography * 8e-2 + c_verification * 5e-2, 5e-2), 95e-2) ELSE 0e0 END AS conf FROM parts
), weak AS (
  SELECT subject_id, string_agg(name, ',' ORDER BY score, seq) AS limiting FROM (
    SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY score, seq) AS rn FROM (
      SELECT subject_id, unnest([c_sample_size, c_similarity, c_completeness, c_freshness, c_agreement, c_geography, c_verification]) AS score,
        unnest(['sample_size', 'similarity', 'completeness', 'freshness', 'agreement', 'geography', 'verification']) AS name,
        unnest([0, 1, 2, 3, 4, 5, 6]) AS seq FROM parts WHERE outcome = 'OK') WHERE score < 6e-1) WHERE rn <= 4 GROUP BY 1
)
SELECT subject_id, round(conf, 4) AS confidence, CASE WHEN round(conf, 4) >= 8e-1 THEN 'HIGH'
    WHEN round(conf, 4) >= 6e-1 THEN 'MODERATE' WHEN round(conf, 4) >= 4e-1 THEN 'LIMITED' ELSE 'LOW' END AS confidence_band,
  coalesce(limiting, '') AS limiting,
""" + ", ".join(f"CASE WHEN outcome = 'OK' THEN round(c_{k}, 3) END AS c_{k}" for k in judgement.CONFIDENCE_WEIGHT) + """
FROM summed LEFT JOIN weak USING (subject_id)
"""


def negotiations(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, moves = _facts(spark, sf_dir, True)
    rows = judgement.negotiate(judgement.rate(judgement.assess_risk(facts)), moves)
    return rows.select(
        "subject_id", "rating", "opening", "target_low", "target_high", "walk_away", "comparable_moves", "reduction_pct",
        F.size("leverage").alias("arguments"),
        F.size(F.filter("leverage", lambda p: p["strength"] == "strong")).alias("strong_arguments"),
    )


NEGOTIATIONS_SQL = """
, cm AS (
  SELECT subject_id, count(*) AS n, median(change) AS pct FROM chosen c JOIN hist h ON c.listing_id = h.listing_id
  WHERE change <> 0 GROUP BY 1
), pts AS (
  SELECT *, (days_listed >= 45)::INT + (n_moves > 0)::INT + (difference > 0)::INT AS n_first,
    (days_listed >= 90)::INT + (n_moves >= 2)::INT + (difference > 0)::INT AS n_strong,
    (NOT has_records)::INT + (size >= 15)::INT AS n_last,
    CASE WHEN s_price <= central THEN least(s_price, greatest(low, s_price * 95e-2))
      ELSE greatest(low, central - (central - low) * 5e-1) END AS t_low
  FROM rated WHERE outcome = 'OK'
)
SELECT r.subject_id, r.rating, CASE WHEN p.s_price <= p.central THEN round(least(t_low, p.s_price))
    WHEN p.subject_id IS NOT NULL THEN round(greatest(p.low, t_low - (p.s_price - p.central) * 35e-2)) END AS opening,
  round(t_low) AS target_low, round(CASE WHEN p.s_price <= p.central THEN p.s_price ELSE p.central END) AS target_high,
  round(p.high) AS walk_away, coalesce(cm.n, 0) AS comparable_moves, CASE WHEN cm.n >= 6 THEN round(cm.pct, 1) END AS reduction_pct,
  CASE WHEN p.subject_id IS NOT NULL THEN least(8, n_first + coalesce(p.n_grave, 0) + least(coalesce(p.n_mild, 0), greatest(0, 6 - n_first - coalesce(p.n_grave, 0))) + n_last) END AS arguments,
  CASE WHEN p.subject_id IS NOT NULL THEN least(8, n_strong + coalesce(p.n_grave, 0)) END AS strong_arguments
FROM rated r LEFT JOIN pts p ON r.subject_id = p.subject_id LEFT JOIN cm ON r.subject_id = cm.subject_id
"""

QUERIES = {
    "comparables_chosen": comparables_chosen,
    "comparables_summary": comparables_summary,
    "stats_theil_sen": slopes,
    "valuations": valuations,
    "risk": risk,
    "ratings": ratings,
    "confidences": confidences,
    "negotiations": negotiations,
}

_BASE = (market.LISTINGS_SQL, market.SUBJECTS_SQL, COMPARABLES_SQL)
_ALL = (*_BASE, VALUED_SQL, market.OBSERVATIONS_SQL, FACTS_SQL)
_WHOLE_BASE = (market.LISTINGS_SQL, market.SUBJECTS_SQL, WHOLE_SQL)
_WHOLE_ALL = (*_WHOLE_BASE, VALUED_SQL, market.OBSERVATIONS_SQL, FACTS_SQL)
ORACLE_SQL = {
    "comparables_chosen": _twin(CHOSEN_SQL, *_WHOLE_BASE),
    "comparables_summary": _twin(SUMMARY_SQL, *_WHOLE_BASE),
    "stats_theil_sen": _twin(SLOPES_SQL, *_BASE),
    "valuations": _twin(VALUATIONS_SQL, *_BASE, VALUED_SQL),
    "risk": _twin(RISK_SQL, *_ALL),
    "ratings": _twin(RATINGS_SQL, *_WHOLE_ALL, RATED_SQL),
    "confidences": _twin(CONFIDENCE_SQL, *_ALL),
    "negotiations": _twin(NEGOTIATIONS_SQL, *_WHOLE_ALL, RATED_SQL),
}

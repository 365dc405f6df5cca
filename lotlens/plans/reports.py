"""Reports over the bundles of all subjects: parsed answers, checks place by place, reports without a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, reports
from ..operators import responses as responses_of
from ..session import materialise, once
from ..sources import market
from . import appraisal
from .services import _ALL, _WHOLE_ALL, _appraised
from .statistics import _twin


def _bundles(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """subject_id and bundle of every subject, written once."""

    def build() -> DataFrame:
        _, chosen, _, _ = appraisal._valued(spark, sf_dir, whole)
        facts, moves = appraisal._facts(spark, sf_dir, whole)
        return evidence.assemble(materialise(_appraised(facts, moves), "appraised"), chosen, market.as_of())

    return once(spark, sf_dir, appraisal._name("bundles", whole), build)


def _plain(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return reports.without_model(_bundles(spark, sf_dir, whole))


def _claimed(statement: str) -> Column:
    return F.array(F.struct(F.lit("FACT").alias("kind"), F.lit(statement).alias("statement"), F.lit("").alias("basis")))


def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check finds in reports with faults dealt by id, by the whole bundle of each subject.

    Every report also cites the first comparable's price, which stands in a nested array of its bundle.
    """
    bundles = _bundles(spark, sf_dir)
    plain = _plain(spark, sf_dir).join(bundles, "subject_id")
    k, r = F.col("subject_id"), F.col("report")
    a = r["market_assessment"]
    price = F.get_json_object("bundle", "$.comparables[0].price").try_cast("double")
    assessment = a.withField("central_estimate", F.when(k % 4 == 0, F.coalesce(a["central_estimate"], F.lit(5000.0)) * 1.02).otherwise(a["central_estimate"]))
    assessment = assessment.withField("confidence", a["confidence"] + F.when(k % 3 == 0, 5).otherwise(0))
    assessment = assessment.withField("price_percentile", a["price_percentile"] + F.when(k % 10 == 0, 7).otherwise(0))
    assessment = assessment.withField("rating", F.when(k % 5 == 0, "FAIR_VALUE").otherwise(a["rating"]))
    risks = (
        F.when(k % 6 == 0, _claimed("The car was in an accident")).when(k % 6 == 1, F.array().cast("array<struct<kind:string,statement:string,basis:string>>"))
        .when(k % 6 == 2, _claimed("The seller states it was in an accident")).otherwise(r["risk_signals"])
    )
    bargain = r["negotiation_strategy"]
    faulty = r.withField("market_assessment", assessment).withField("risk_signals", risks)
    faulty = faulty.withField("final_assessment", F.concat(r["final_assessment"], F.when(k % 7 == 0, " Others pay 7777777.").otherwise("")))
    faulty = faulty.withField("market_context", F.concat_ws(" ", r["market_context"], F.concat(F.lit("The nearest asks "), F.format_number(price, 0))))
    faulty = faulty.withField("limitations", F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(r["limitations"]))
    spoken = F.concat(bargain["summary"], F.when(k % 8 == 0, " Or 8888888.").otherwise(""))
    faulty = faulty.withField("negotiation_strategy", F.when(bargain.isNotNull(), bargain.withField("summary", spoken)))
    found = reports.feedback(reports.check(plain.select("subject_id", faulty.alias("report")), bundles))
    return bundles.select("subject_id").join(found, "subject_id", "left").select("subject_id", F.coalesce(F.array_join("findings", ", "), F.lit("")).alias("findings"))


CHECKS_SQL = """
SELECT subject_id, array_to_string(list_sort(list_filter([
  CASE WHEN subject_id % 4 = 0 THEN CASE WHEN central IS NULL THEN 'INVENTED_FIGURE' ELSE 'FIGURE_MISMATCH' END || ' market_assessment.central_estimate' END,
  CASE WHEN subject_id % 3 = 0 THEN 'FIGURE_MISMATCH market_assessment.confidence' END,
  CASE WHEN subject_id % 10 = 0 AND percentile IS NOT NULL THEN 'FIGURE_MISMATCH market_assessment.price_percentile' END,
  CASE WHEN subject_id % 5 = 0 AND rating <> 'FAIR_VALUE' THEN 'RATING_MISMATCH market_assessment.rating' END,
  CASE WHEN subject_id % 7 = 0 THEN 'UNSUPPORTED_NUMBER final_assessment' END,
  CASE WHEN subject_id % 8 = 0 AND central IS NOT NULL THEN 'UNSUPPORTED_NUMBER negotiation_strategy.summary' END,
  CASE WHEN subject_id % 6 = 0 THEN 'OVERSTATED_CLAIM risk_signals[0]' END,
  CASE WHEN subject_id % 6 = 1 AND n_grave > 0 THEN 'OMITTED_RISK risk_signals' END,
  CASE WHEN subject_id % 9 = 0 THEN 'MISSING_LIMITATIONS limitations' END], lambda x: x IS NOT NULL)), ', ') AS findings
FROM rated
"""


def reports_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and counts of the report that each subject's bundle alone gives."""
    r = F.col("report")
    a = r["market_assessment"]
    facts = F.filter(r["risk_signals"], lambda c: c["kind"] == "FACT")
    return _plain(spark, sf_dir, True).select(
        "subject_id", a["rating"].alias("rating"), a["confidence"].alias("confidence"), F.round(a["central_estimate"], 2).alias("central"),
        F.size("report.risk_signals").alias("risk_claims"), F.size(facts).alias("risk_facts"), F.size("report.inspection_priorities").alias("items"),
        F.size("report.limitations").alias("limitations"), r["negotiation_strategy"].isNotNull().alias("negotiable"),
        F.regexp_extract(r["final_assessment"], "central estimate is ([0-9,]*[0-9])", 1).alias("told_central"),
        F.regexp_extract(r["vehicle_summary"], "Odometer ([0-9,]*[0-9]) km", 1).alias("told_km"),
    )


def _commas(number: str) -> str:
    return f"format('{{:,}}', CAST(round_even({number}, 0) AS BIGINT))"


WITHOUT_SQL = f"""
, n AS (SELECT subject_id, count(*) AS signals FROM weighed GROUP BY 1), confident AS (
  SELECT subject_id, CASE WHEN outcome = 'OK' THEN least(greatest(round(effective_size / (effective_size + 18e0), 4) * 25e-2
    + round(least(greatest((weighted_similarity - 5e-1) / 45e-2, 0e0), 1e0), 4) * 22e-2 + round(specificity * 7e-1 + 3e-1, 4) * 15e-2
    + round(pow(5e-1, median_age_days / 60e0), 4) * 13e-2 + round(1e0 - CASE WHEN dispersion <= 0 THEN 0e0 ELSE dispersion / (dispersion + 14e-2) END, 4) * 12e-2
    + round(local / CAST(size AS DOUBLE), 4) * 8e-2 + round(verified_share, 4) * 5e-2, 5e-2), 95e-2) ELSE 0e0 END AS conf FROM facts
), items AS (
  SELECT r.subject_id, 12 + CAST(coalesce(bool_or(kind = 'DAMAGE'), false) AS INTEGER)
    + CAST(coalesce(bool_or(kind = 'MILEAGE_ANOMALY'), false) OR coalesce(any_value(s_mileage_km), 0) >= 150000 AS INTEGER)
    + CAST(coalesce(bool_or(kind = 'MILEAGE_ANOMALY'), false) OR coalesce(any_value(s_mileage_km), 0) >= 220000 AS INTEGER)
    + CAST(coalesce(bool_or(kind = 'MILEAGE_SEQUENCE'), false) AS INTEGER) AS items
  FROM rated r LEFT JOIN weighed w ON r.subject_id = w.subject_id GROUP BY 1
)
SELECT r.subject_id, rating, CAST(round(round(conf, 4) * 100) AS INTEGER) AS confidence, round(central, 2) AS central,
  CAST(least(15, 2 * coalesce(signals, 0)) AS INTEGER) AS risk_claims, CAST(least(8, coalesce(signals, 0)) AS INTEGER) AS risk_facts,
  CAST(least(15, items) AS INTEGER) AS items,
  CAST(4 + CAST(r.subject_id % 3 = 0 AS INTEGER) + CAST(widened AS INTEGER) AS INTEGER) AS limitations, central IS NOT NULL AS negotiable,
  CASE WHEN central IS NULL THEN '' ELSE {_commas("central")} END AS told_central, {_commas("s_mileage_km")} AS told_km
FROM rated r LEFT JOIN n ON r.subject_id = n.subject_id JOIN confident c ON r.subject_id = c.subject_id JOIN items i ON r.subject_id = i.subject_id
"""


def reports_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from the plain reports and spoilt by id: what the parser makes of each."""
    k, answer = F.col("subject_id"), F.to_json("report")
    spoilt = (
        F.when(k % 9 == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .when(k % 9 == 2, F.left(answer, F.char_length(answer) - 5))
        .when(k % 9 == 3, F.regexp_replace(answer, r'"confidence":\d+', '"confidence":"high"'))
        .when(k % 9 == 4, F.regexp_replace(answer, '"final_assessment"', '"closing"'))
        .when(k % 9 == 5, F.regexp_replace(answer, r'"vehicle_summary":"', '"vehicle_summary":"It is worth buying. '))
        .when(k % 9 == 6, F.concat(F.lit("["), answer, F.lit("]")))
        .when(k % 9 == 7, F.regexp_replace(answer, r'"confidence":\d+', '"confidence":140'))
        .when(k % 9 == 8, F.lit("The car looks fine to me."))
        .otherwise(answer)
    )
    parsed = reports.parse(_plain(spark, sf_dir, True).select("subject_id", spoilt.alias("answer")))
    rating = F.col("report.market_assessment.rating")
    return parsed.select("subject_id", "outcome", F.array_join("problems", ", ").alias("problems"), F.coalesce(rating, F.lit("")).alias("rating"))


PARSED_SQL = """
SELECT subject_id, CASE subject_id % 9 WHEN 2 THEN 'NOT_JSON' WHEN 8 THEN 'NOT_JSON' WHEN 6 THEN 'NOT_OBJECT' WHEN 0 THEN 'OK' WHEN 1 THEN 'OK' ELSE 'INVALID' END AS outcome,
  CASE subject_id % 9 WHEN 3 THEN 'WRONG_TYPE:market_assessment.confidence' WHEN 4 THEN 'MISSING:final_assessment, UNKNOWN_FIELD:closing'
    WHEN 5 THEN 'FORBIDDEN_PHRASE:vehicle_summary' WHEN 7 THEN 'OUT_OF_RANGE:market_assessment.confidence' ELSE '' END AS problems,
  CASE WHEN subject_id % 9 <= 1 THEN rating ELSE '' END AS rating
FROM rated
"""

def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client reads of each subject, out of its response."""
    _, chosen, _, _ = appraisal._valued(spark, sf_dir, True)
    facts, moves = appraisal._facts(spark, sf_dir, True)
    made = materialise(responses_of.respond(materialise(_appraised(facts, moves), "appraised"), chosen, market.as_of()), "responses")
    at = lambda path: F.get_json_object("response", f"$.{path}")
    types = F.transform(F.from_json(at("risk.signals"), "array<struct<type: string>>"), lambda s: s["type"])
    listed = F.transform(F.from_json(at("comparables"), "array<struct<listing_id: long>>"), lambda x: x["listing_id"].cast("string"))
    applied = F.filter(F.from_json(at("valuation.adjustments"), "array<struct<label: string, applied: boolean>>"), lambda a: a["applied"])
    return made.select(
        "subject_id", at("valuation.central_estimate.formatted").alias("central"), at("price_position.asking_price.formatted").alias("asking"),
        at("price_position.rating_label").alias("rating"), F.round(at("price_position.gap_analysis.unexplained").cast("double"), 2).alias("unexplained"),
        F.array_join(F.transform(applied, lambda a: a["label"]), ",").alias("applied"), F.array_join(types, ",").alias("signals"),
        F.size(listed).alias("n_comparables"), F.array_join(listed, ",").alias("comparables"), at("negotiation.opening.amount").isNotNull().alias("negotiable"),
    )


RESPONSES_SQL = f"""
, shown AS (
  SELECT subject_id, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(listing_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM chosen WHERE rank <= 20 GROUP BY 1
), told AS (SELECT subject_id, string_agg(kind, ',' ORDER BY rank DESC, conf DESC, kind) AS kinds FROM weighed GROUP BY 1)
SELECT r.subject_id, format('{{:,}}', CAST(round(central) AS BIGINT)) || ' AZN' AS central, format('{{:,}}', CAST(round(s_price) AS BIGINT)) || ' AZN' AS asking,
  upper(rating[1]) || lower(replace(rating[2:], '_', ' ')) AS rating, round(CASE WHEN outcome = 'OK' THEN total_gap - explained END, 2) AS unexplained,
  concat_ws(',', CASE WHEN mileage_reason = 'APPLIED' THEN 'Mileage' END, CASE WHEN age_reason = 'APPLIED' THEN 'Model year' END,
    CASE WHEN geography_reason = 'APPLIED' THEN 'Location' END, CASE WHEN disclosure_reason = 'APPLIED' THEN 'Disclosed condition' END) AS applied,
  coalesce(t.kinds, '') AS signals, coalesce(n, 0) AS n_comparables, coalesce(ids, '') AS comparables, central IS NOT NULL AS negotiable
FROM rated r LEFT JOIN shown s ON r.subject_id = s.subject_id LEFT JOIN told t ON r.subject_id = t.subject_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "report_checks": report_checks,
    "reports_without_model": reports_without_model,
    "reports_parsed": reports_parsed,
    "responses": responses,
}
ORACLE_SQL: dict[str, str] = {
    "report_checks": _twin(CHECKS_SQL, *_ALL),
    "reports_without_model": _twin(WITHOUT_SQL, *_WHOLE_ALL),
    "reports_parsed": _twin(PARSED_SQL, *_WHOLE_ALL),
    "responses": _twin(RESPONSES_SQL, *_WHOLE_ALL),
}

"""Parsing, checking and writing reports on small literal cases."""

import json

import pytest

from lotlens.operators import reports

BUNDLE = {
    "valuation": {"outcome": "OK", "central": 43107.0, "low": 41000.0, "high": 45200.0},
    "price_position": {"asking": 37301.0, "rating": "GOOD_VALUE", "difference": -5806.0, "difference_pct": -13.47, "percentile": 12.5},
    "confidence": {"score": 0.62}, "risk_signals": [{"kind": "DAMAGE", "severity": "HIGH", "rank": 3, "confidence": 0.9}],
    "positive_signals": ["RECORDS"], "market_statistics": {"size": 118, "mean_similarity": 0.94, "norm_p10": 39000.5, "norm_p50": 43000.0, "norm_p90": 47800.0},
    "comparables": [{"rank": 1, "more": {"deep": [{"price": 61234.0}]}}], "notes": ["roughly 7,890 AZN per step", "code x9999"], "flag": True, "none": None,
    "vehicle": {"make": "A", "model": "B", "model_year": 2019, "mileage_km": 100000, "city": "Baku"}, "limitations": ["ASKING_PRICES"],
    "negotiation": {"opening": 35000.0, "target_low": 36000.0, "target_high": 37000.0, "leverage": [{"name": "DAYS_LISTED", "strength": "HIGH"}] * 11},
    "candidate_explanations": ["UNCONFIRMED"], "inspection_priorities": [{"item": "Look", "rank": 0}] * 20, "seller_questions": [{"key": "WHY", "rank": 0}],
}


@pytest.fixture()
def bundles(spark):
    return spark.createDataFrame([(1, json.dumps(BUNDLE))], "subject_id long, bundle string")


def plain(bundles):
    return json.loads(reports.without_model(bundles).selectExpr("to_json(report) AS r").first().r)


def findings(spark, bundles, report):
    given = reports.parse(spark.createDataFrame([(1, json.dumps(report))], "subject_id long, answer string"))
    row = given.first()
    assert row.outcome == "OK", row.problems
    return sorted((r.code, r.path) for r in reports.check(given.select("subject_id", "report"), bundles).collect())


def test_walk_vouches_for_nested_numbers_and_those_in_strings(bundles):
    values = {r.value for r in reports.vouched(bundles).collect()}
    assert {43107.0, 61234.0, 7890.0, 5806.0, -5806.0, 62.0, 0.62, 94.0, 12.0, 39000.0, 39000.5} <= values
    assert 9999.0 not in values and 1.0 in values


def test_walk_reads_what_is_too_deep_as_text(spark):
    deep = 4321.5
    for _ in range(reports.DEEPEST + 3):
        deep = {"x": deep}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, "no json"), (3, None), (4, "[]")], "subject_id long, bundle string")
    assert {(r.subject_id, r.value) for r in reports.vouched(rows).collect()} == {(1, 4321.5), (1, 4322.0)}


def test_walk_does_not_take_ids_for_figures(spark):
    ids = {"analysis_id": "analysis-7777770", "comparables": [{"listing_id": 8888880, "id": 6666660, "price": 5550.0, "bid": 4440.0, "paid": 3330.0}]}
    rows = spark.createDataFrame([(1, json.dumps(ids))], "subject_id long, bundle string")
    assert {r.value for r in reports.vouched(rows).collect()} == {5550.0, 4440.0, 3330.0}


def test_plain_report_passes(spark, bundles):
    report = plain(bundles)
    assert findings(spark, bundles, report) == []
    assert len(report["negotiation_strategy"]["key_arguments"]) == 8 and len(report["inspection_priorities"]) == 15
    assert [c["kind"] for c in report["risk_signals"]] == ["FACT", "POSSIBILITY"]


@pytest.mark.parametrize(
    "change, want",
    [
        (lambda r: r["market_assessment"].update(price_percentile=40.0), [("FIGURE_MISMATCH", "market_assessment.price_percentile")]),
        (lambda r: r["market_assessment"].update(central_estimate=43400.0), [("FIGURE_MISMATCH", "market_assessment.central_estimate")]),
        (lambda r: r["market_assessment"].update(central_estimate=43120.0), []),
        (lambda r: r["market_assessment"].update(confidence=64), [("FIGURE_MISMATCH", "market_assessment.confidence")]),
        (lambda r: r["market_assessment"].update(rating="OVERPRICED"), [("RATING_MISMATCH", "market_assessment.rating")]),
        (lambda r: r.update(market_context="Others ask 77,777 AZN, or 43,100, or 61,000 at 94 per cent."), [("UNSUPPORTED_NUMBER", "market_context")]),
        (lambda r: r["negotiation_strategy"].update(summary="Say 29999."), [("UNSUPPORTED_NUMBER", "negotiation_strategy.summary")]),
        (lambda r: r["risk_signals"][1].update(statement="It costs 12345 or 43107."), [("UNSUPPORTED_NUMBER", "risk_signals[1]")]),
        (lambda r: r["positive_signals"].append({"kind": "FACT", "statement": "It was never stolen.", "basis": ""}), [("OVERSTATED_CLAIM", "positive_signals[1]")]),
        (lambda r: r["risk_signals"].insert(0, {"kind": "FACT", "statement": "The seller states a crash.", "basis": ""}), []),
        (lambda r: r["risk_signals"].insert(0, {"kind": "POSSIBILITY", "statement": "A crash.", "basis": ""}), []),
        (lambda r: r.update(risk_signals=[]), [("OMITTED_RISK", "risk_signals")]),
        (lambda r: r.update(limitations=[]), [("MISSING_LIMITATIONS", "limitations")]),
    ],
)
def test_findings_name_their_place(spark, bundles, change, want):
    report = plain(bundles)
    change(report)
    assert findings(spark, bundles, report) == want


def test_a_figure_that_was_never_computed(spark, bundles):
    report = plain(bundles)
    bare = {k: v for k, v in BUNDLE.items() if k != "valuation"}
    without = spark.createDataFrame([(1, json.dumps(bare))], "subject_id long, bundle string")
    found = findings(spark, without, report)
    assert ("INVENTED_FIGURE", "market_assessment.central_estimate") in found and ("INVENTED_FIGURE", "market_assessment.fair_market_low") in found


def test_parse_outcomes(spark, bundles):
    good = plain(bundles)
    text = json.dumps(good)
    wrong = lambda **kw: json.dumps(good | kw)
    cases = {
        "plain": (text, "OK", []),
        "fenced": (f"  ```json\n{text}\n```  ", "OK", []),
        "open fence": (f"```\n{text}", "OK", []),
        "cut": (text[:-3], "NOT_JSON", []),
        "prose": ("Here is the report: " + text, "NOT_JSON", []),
        "empty": ("", "NOT_JSON", []),
        "null": (None, "NOT_JSON", []),
        "array": ("[1, 2]", "NOT_OBJECT", []),
        "number": ("17", "NOT_OBJECT", []),
        "nothing in it": ("{}", "INVALID", [f"MISSING:{n}" for n in reports._REQUIRED]),
        "text for object": (wrong(market_assessment="fine"), "INVALID", ["WRONG_TYPE:market_assessment", "MISSING:market_assessment.rating", "MISSING:market_assessment.confidence"]),
        "number for text": (wrong(vehicle_summary=12), "INVALID", ["WRONG_TYPE:vehicle_summary"]),
        "null text": (wrong(final_assessment=None), "INVALID", ["WRONG_TYPE:final_assessment"]),
        "text for list": (wrong(limitations="none"), "INVALID", ["WRONG_TYPE:limitations"]),
        "half a point": (wrong(market_assessment=good["market_assessment"] | {"confidence": 50.5}), "INVALID", ["WRONG_TYPE:market_assessment.confidence"]),
        "too sure": (wrong(market_assessment=good["market_assessment"] | {"confidence": 101}), "INVALID", ["OUT_OF_RANGE:market_assessment.confidence"]),
        "no figure": (wrong(market_assessment=good["market_assessment"] | {"asking_price": None}), "OK", []),
        "no bargain": (wrong(negotiation_strategy=None), "OK", []),
        "extra": (wrong(verdict="x", advice="y"), "INVALID", ["UNKNOWN_FIELD:advice", "UNKNOWN_FIELD:verdict"]),
        "long": (wrong(vehicle_summary="x" * 1501), "INVALID", ["TOO_LONG:vehicle_summary"]),
        "many": (wrong(limitations=["x"] * 13), "INVALID", ["TOO_MANY:limitations"]),
        "bad claim": (wrong(risk_signals=[{"kind": "FACT", "statement": "a"}, {"kind": "RUMOUR", "statement": "b"}]), "INVALID", ["WRONG_TYPE:risk_signals[1]"]),
        "verdict in claim": (wrong(positive_signals=[{"kind": "FACT", "statement": "Definitely BUY it"}]), "INVALID", ["FORBIDDEN_PHRASE:positive_signals[0]"]),
        "guarantee": (wrong(final_assessment="Problem-free."), "INVALID", ["FORBIDDEN_PHRASE:final_assessment"]),
        "guarantee elsewhere": (wrong(market_context="Problem-free."), "OK", []),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, answer string")
    got = {r.name: (r.outcome, r.problems, r.report is not None) for r in reports.parse(rows).collect()}
    assert got == {k: (outcome, problems, outcome == "OK") for k, (_, outcome, problems) in cases.items()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "subject_id long, bundle string")
    assert reports.without_model(none).collect() == [] and reports.vouched(none).collect() == []
    assert reports.parse(spark.createDataFrame([], "answer string")).collect() == []

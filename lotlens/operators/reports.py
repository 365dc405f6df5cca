"""Written reports: parsing an answer, the numbers that a bundle vouches for, checks place by place, and a report without a model.

A report is a struct of ``FIELDS``; a bundle is the JSON document of ``evidence.assemble``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import numbers_in
from . import evidence

_CLAIMS = "array<struct<kind: string, statement: string, basis: string>>"
ASSESSMENT = {
    "central_estimate": "$.valuation.central", "fair_market_low": "$.valuation.low", "fair_market_high": "$.valuation.high",
    "asking_price": "$.price_position.asking", "price_difference_percent": "$.price_position.difference_pct",
    "price_percentile": "$.price_position.percentile",
}
FIELDS = {
    "market_assessment": f"struct<{', '.join(f'{n}: double' for n in ASSESSMENT)}, confidence: int, rating: string>",
    "vehicle_summary": "string", "market_context": "string", "price_explanation": "string", "final_assessment": "string",
    "positive_signals": _CLAIMS, "risk_signals": _CLAIMS, "model_specific_concerns": _CLAIMS,
    "seller_questions": "array<string>", "inspection_priorities": "array<string>",
    "negotiation_strategy": "struct<summary: string, opening_offer: double, target_low: double, target_high: double, key_arguments: array<string>>",
    "limitations": "array<string>",
}
REPORT = ", ".join(f"{n} {kind}" for n, kind in FIELDS.items())
KINDS = ("FACT", "INFERENCE", "POSSIBILITY")
PROSE = ("vehicle_summary", "market_context", "price_explanation", "final_assessment")
CLAIM_GROUPS = ("positive_signals", "risk_signals", "model_specific_concerns")

# Most characters of a text, most entries of a list
LONGEST = {"vehicle_summary": 1500, "market_context": 2000, "price_explanation": 2000, "final_assessment": 2500}
MOST = {
    "positive_signals": 10, "risk_signals": 15, "model_specific_concerns": 10, "seller_questions": 12, "inspection_priorities": 15, "limitations": 12,
}
LONGEST_STATEMENT, LONGEST_BASIS, LONGEST_SUMMARY, MOST_ARGUMENTS = 600, 300, 1200, 8
# Fields of an answer by the kind of value that they hold; a null is none, but for the optional figures
_REQUIRED = {
    "market_assessment": "OBJECT", "market_assessment.rating": "STRING", "market_assessment.confidence": "NUMBER",
    "vehicle_summary": "STRING", "final_assessment": "STRING",
}
_OPTIONAL = (
    {"market_context": "STRING", "price_explanation": "STRING"}
    | dict.fromkeys((*CLAIM_GROUPS, "seller_questions", "inspection_priorities", "limitations"), "ARRAY")
    | {"negotiation_strategy": "OBJECT", "negotiation_strategy.summary": "STRING"}
    | dict.fromkeys((f"market_assessment.{n}" for n in ASSESSMENT), "NUMBER")
)
_MAY_BE_NULL = ("negotiation_strategy", *(f"market_assessment.{n}" for n in ASSESSMENT))
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
DEEPEST = 8
IDENTIFIER = "^(.*_)?id$"  # names of fields that identify a thing


def unfenced(text: Column) -> Column:
    """An answer without a fence of back-ticks around it."""
    blank = F.lit(" \t\r\n")
    bare = F.trim(text, blank)
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n?", ""), r"```\s*$", "")
    return F.trim(F.when(bare.startswith("```"), inner).otherwise(bare), blank)


def _kept(found: Column) -> Column:
    return F.filter(found, lambda x: x.isNotNull())


def _texts() -> Column:
    return F.array().cast("array<string>")


def _says(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), p))


def _claims(report: Column, group: str) -> Column:
    return F.coalesce(report[group], F.array().cast(_CLAIMS))


def _place(group: str, i: Column) -> Column:
    return F.concat(F.lit(f"{group}["), i.cast("string"), F.lit("]"))


def _each_claim(report: Column, test, code: str) -> Column:
    """``code``:group[i] for each claim of a report that ``test`` holds for."""
    named = lambda group: lambda c, i: F.when(test(c), F.concat(F.lit(f"{code}:"), _place(group, i)))
    return F.concat(*(_kept(F.transform(_claims(report, group), named(group))) for group in CLAIM_GROUPS))


def parse(answers: DataFrame, text: str = "answer") -> DataFrame:
    """``answers`` with ``report`` (null if refused), ``outcome`` and ``problems``.

    Fences around the JSON are tolerated, nothing else.  ``outcome``: OK, NOT_JSON (cut off, no JSON, null), NOT_OBJECT or
    INVALID; ``problems`` names each fault of an INVALID one by its path: MISSING, WRONG_TYPE, UNKNOWN_FIELD, TOO_LONG, TOO_MANY,
    OUT_OF_RANGE, FORBIDDEN_PHRASE.
    """
    rows = answers.withColumn("_json", unfenced(F.col(text))).withColumn("_v", F.try_parse_json("_json"))
    rows = rows.withColumn("_report", F.from_json("_json", REPORT))
    r, v = F.col("_report"), F.col("_v")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    faults = []
    for path, wanted in (_REQUIRED | _OPTIONAL).items():
        held = kind(path)
        fits = held.rlike(_NUMBER) if wanted == "NUMBER" else held.startswith(wanted)
        if path in _MAY_BE_NULL:
            fits = fits | (held == "VOID")
        faults.append(F.when(held.isNotNull() & ~fits, f"WRONG_TYPE:{path}"))
        if path in _REQUIRED:
            faults.append(F.when(held.isNull(), f"MISSING:{path}"))
    score = F.try_variant_get(v, "$.market_assessment.confidence", "double")
    faults += [
        F.when(score != F.floor(score), "WRONG_TYPE:market_assessment.confidence"),
        F.when(~score.between(0, 100), "OUT_OF_RANGE:market_assessment.confidence"),
        *(F.when(F.char_length(r[n]) > most, f"TOO_LONG:{n}") for n, most in LONGEST.items()),
        F.when(F.char_length(r["negotiation_strategy"]["summary"]) > LONGEST_SUMMARY, "TOO_LONG:negotiation_strategy.summary"),
        *(F.when(F.size(r[n]) > most, f"TOO_MANY:{n}") for n, most in MOST.items()),
        F.when(F.size(r["negotiation_strategy"]["key_arguments"]) > MOST_ARGUMENTS, "TOO_MANY:negotiation_strategy.key_arguments"),
        *(F.when(_says(r[n], evidence.VERDICT_PHRASES), f"FORBIDDEN_PHRASE:{n}") for n in PROSE),
        F.when(_says(r["final_assessment"], evidence.GUARANTEE_PHRASES), "FORBIDDEN_PHRASE:final_assessment"),
    ]
    fields = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    known = F.array(*map(F.lit, FIELDS))
    unknown = F.transform(F.array_sort(F.array_except(fields, known)), lambda k: F.concat(F.lit("UNKNOWN_FIELD:"), k))
    unkind = lambda c: ~F.coalesce(c["kind"].isin(*KINDS), F.lit(False)) | (F.coalesce(F.char_length(c["statement"]), F.lit(0)) == 0)
    problems = F.concat(
        _kept(F.array(*faults)),
        F.coalesce(unknown, _texts()),
        _each_claim(r, unkind, "WRONG_TYPE"),
        _each_claim(r, lambda c: (F.char_length(c["statement"]) > LONGEST_STATEMENT) | (F.char_length(c["basis"]) > LONGEST_BASIS), "TOO_LONG"),
        _each_claim(r, lambda c: _says(c["statement"], evidence.VERDICT_PHRASES), "FORBIDDEN_PHRASE"),
    )
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    told = rows.withColumn("problems", F.when(is_object, F.array_distinct(problems)).otherwise(_texts()))
    outcome = F.when(v.isNull(), "NOT_JSON").when(~is_object, "NOT_OBJECT").when(F.size("problems") > 0, "INVALID").otherwise("OK")
    return told.withColumn("outcome", outcome).select(
        *answers.columns, F.when(F.col("outcome") == "OK", r).alias("report"), "outcome", "problems"
    )


def vouched(bundles: DataFrame, key: str = "subject_id", text: str = "bundle") -> DataFrame:
    """Distinct numbers (``key``, value) that a JSON document vouches for, from a walk over its values by their type.

    Numbers count as they are, numbers inside strings too; keys, flags and what identifies a thing (``IDENTIFIER``) do not: an
    id is no figure, and a large one lies close to some invented price.  Each also as magnitude, rounded, and as
    percentage or fraction twin.  What is nested deeper than DEEPEST is read as text.
    """
    found = bundles.select(key, F.try_parse_json(text).alias("_v"))
    kind = F.schema_of_variant("_v")
    for _ in range(DEEPEST):  # what is no container stays as it is
        fields = F.map_filter(F.try_variant_get("_v", "$", "map<string, variant>"), lambda name, _: ~name.rlike(IDENTIFIER))
        inner = F.when(kind.startswith("OBJECT"), F.map_values(fields))
        inner = inner.when(kind.startswith("ARRAY"), F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
        found = found.select(key, F.explode(inner).alias("_v"))
    deeper = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    found = found.select(key, F.when(deeper, F.to_json("_v").cast("variant")).otherwise(F.col("_v")).alias("_v"))
    own = F.array(F.try_variant_get("_v", "$", "double"))
    inside = F.regexp_extract_all(F.try_variant_get("_v", "$", "string"), F.lit(r"(?<![\w.])(\d{1,3}(?:[ ,]\d{3})+|\d+(?:\.\d+)?)(?!\w)"), F.lit(1))
    read = F.transform(inside, lambda n: F.regexp_replace(n, "[ ,]", "").try_cast("double"))
    values = found.select(key, F.explode(F.when(kind.rlike(_NUMBER), own).when(kind == "STRING", read)).alias("_n"))
    v, size = F.col("_n"), F.abs("_n")
    twins = F.array(v, size, F.bround(v), F.bround(size), F.when((size > 0) & (size <= 1), size * 100), F.when((size > 1) & (size <= 100), size / 100))
    return values.select(key, F.explode(_kept(twins)).alias("value")).distinct()


def check(reports: DataFrame, bundles: DataFrame, key: str = "subject_id") -> DataFrame:
    """One row (``key``, code, path) for each thing that is wrong with a ``report`` by its ``bundle``.

    Echoed figures may differ by half a per cent, the confidence by one point; a figure that was never computed is invented; the
    rating is given.  Every number of the prose, of a claim and of the negotiation summary must be vouched for.  What a listing cannot
    establish may not be called a fact unless it is reported as a statement; grave signals and the limitations may not be left out.
    A null report has no findings.
    """
    both = reports.join(bundles, key)
    r = F.col("report")
    at = lambda path: F.get_json_object("bundle", path)
    place = lambda code, path: F.struct(F.lit(code).alias("code"), (F.lit(path) if isinstance(path, str) else path).alias("path"))
    found = []
    for name, path in ASSESSMENT.items():
        got, want = r["market_assessment"][name], at(path).try_cast("double")
        apart = F.abs(got - want) / F.greatest(F.abs(want), F.lit(1.0)) > evidence.ECHO_TOLERANCE
        found.append(F.when(want.isNull() & got.isNotNull(), place("INVENTED_FIGURE", f"market_assessment.{name}")).when(apart, place("FIGURE_MISMATCH", f"market_assessment.{name}")))
    score = F.round(at("$.confidence.score").try_cast("double") * 100)
    found.append(F.when(F.abs(r["market_assessment"]["confidence"] - score) > 1, place("FIGURE_MISMATCH", "market_assessment.confidence")))
    found.append(F.when(r["market_assessment"]["rating"] != at("$.price_position.rating"), place("RATING_MISMATCH", "market_assessment.rating")))
    grave = F.size(F.filter(F.from_json(at("$.risk_signals"), "array<struct<rank: int>>"), lambda s: s["rank"] >= 3)) > 0
    found.append(F.when(grave & (F.coalesce(F.size(r["risk_signals"]), F.lit(0)) <= 0), place("OMITTED_RISK", "risk_signals")))
    found.append(F.when(F.coalesce(F.size(r["limitations"]), F.lit(0)) <= 0, place("MISSING_LIMITATIONS", "limitations")))
    told = lambda c: F.lower(c["statement"])
    overstated = lambda c: (c["kind"] == "FACT") & told(c).rlike("|".join(evidence.UNVERIFIABLE)) & ~told(c).rlike("|".join(evidence.REPORTED))
    groups = _each_claim(r, overstated, "OVERSTATED_CLAIM")
    split = F.transform(groups, lambda g: F.struct(F.substring_index(g, ":", 1).alias("code"), F.substring_index(g, ":", -1).alias("path")))
    given = both.filter(r.isNotNull())
    listed = given.select(key, F.explode(F.concat(_kept(F.array(*found)), split)).alias("f")).select(key, "f.code", "f.path")
    said = [F.struct(F.lit(n).alias("path"), r[n].alias("text")) for n in PROSE]
    said.append(F.struct(F.lit("negotiation_strategy.summary").alias("path"), r["negotiation_strategy"]["summary"].alias("text")))
    one = lambda group: lambda c, i: F.struct(_place(group, i).alias("path"), c["statement"].alias("text"))
    claimed = [F.transform(_claims(r, group), one(group)) for group in CLAIM_GROUPS]
    texts = given.select(key, F.explode(F.concat(F.array(*said), *claimed)).alias("t"))
    cited = texts.select(key, F.col("t.path").alias("path"), F.explode(F.array_distinct(numbers_in(F.col("t.text")))).alias("value"))
    unknown = evidence.unknown_numbers(cited, vouched(bundles, key), key)
    return listed.unionByName(unknown.select(key, F.lit("UNSUPPORTED_NUMBER").alias("code"), "path").distinct())


def feedback(findings: DataFrame, key: str = "subject_id") -> DataFrame:
    """(``key``, findings): the findings of each report in order of place, as ``code path``."""
    return findings.groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "code", "path"))).alias("findings"))


def _number(value: Column, digits: int = 0) -> Column:
    return F.format_number(value, digits)


def _words(code: Column) -> Column:
    return F.lower(F.replace(code, F.lit("_"), F.lit(" ")))


_BUNDLE = (
    "vehicle struct<make: string, model: string, model_year: int, mileage_km: long, city: string>, "
    "market_statistics struct<size: long, mean_similarity: double, dispersion: double, norm_p10: double, norm_p50: double, norm_p90: double>, "
    "valuation struct<outcome: string, central: double, low: double, high: double>, "
    "price_position struct<asking: double, rating: string, difference: double, difference_pct: double, percentile: double>, "
    "risk_signals array<struct<kind: string, severity: string, rank: int, confidence: double>>, positive_signals array<string>, "
    "confidence struct<score: double>, negotiation struct<opening: double, target_low: double, target_high: double, leverage: array<struct<name: string, strength: string>>>, "
    "inspection_priorities array<struct<item: string, rank: int>>, seller_questions array<struct<key: string, rank: int>>, "
    "candidate_explanations array<string>, limitations array<string>"
)


def without_model(bundles: DataFrame, key: str = "subject_id") -> DataFrame:
    """(``key``, report): a report of what the bundle holds and nothing else, for when no written one stands.

    A risk signal gives two claims, what was found as a FACT and what it may mean as a POSSIBILITY, in at most 15; positive ones at most
    10, negotiating arguments at most 8.
    """
    f = lambda path: F.col(f"b.{path}")
    valued = f("valuation.outcome") == "OK"
    priced = f("price_position.difference_pct").isNotNull()
    claim = lambda kind, statement, basis: F.struct(F.lit(kind).alias("kind"), statement.alias("statement"), basis.alias("basis"))
    summary = F.concat_ws(
        " ",
        F.concat(F.lit("Appraised: "), F.concat_ws(" ", f("vehicle.make"), f("vehicle.model"), f("vehicle.model_year").cast("string")), F.lit(".")),
        F.coalesce(F.concat(F.lit("Odometer "), _number(f("vehicle.mileage_km")), F.lit(" km.")), F.lit("The odometer reading is not known.")),
        F.concat(F.lit("Offered in "), f("vehicle.city"), F.lit(".")),
        F.when(f("market_statistics.size") > 0, F.concat(F.lit("Compared with "), f("market_statistics.size").cast("string"), F.lit(" listings."))),
    )
    market = F.when(F.coalesce(f("market_statistics.size"), F.lit(0)) <= 0, "There is no comparable listing.").otherwise(
        F.concat_ws(
            " ",
            F.concat(F.lit("Mean likeness of the comparables: "), _number(f("market_statistics.mean_similarity") * 100), F.lit(" per cent.")),
            F.concat(
                F.lit("Adjusted prices go from "), _number(f("market_statistics.norm_p10")), F.lit(" to "), _number(f("market_statistics.norm_p90")),
                F.lit(" with the middle at "), _number(f("market_statistics.norm_p50")), F.lit("."),
            ),
        )
    )
    price = F.concat_ws(
        " ",
        F.when(
            priced,
            F.concat(
                F.lit("The asking price is "), _number(F.abs(f("price_position.difference"))),
                F.when(f("price_position.difference") < 0, " below").otherwise(" above"), F.lit(" the central estimate."),
            ),
        ).otherwise("The asking price has no estimate to be compared with."),
        F.array_join(F.transform(f("candidate_explanations"), lambda e: F.concat(F.lit("Possible reason: "), _words(e), F.lit("."))), " "),
    )
    risks = F.flatten(
        F.transform(
            f("risk_signals"),
            lambda s: F.array(
                claim("FACT", F.concat(F.lit("Found: "), _words(s["kind"]), F.lit(" ("), F.lower(s["severity"]), F.lit(").")), s["kind"]),
                claim("POSSIBILITY", F.concat(F.lit("What "), _words(s["kind"]), F.lit(" means here is open until it has been verified.")), s["kind"]),
            ),
        )
    )
    positive = F.transform(f("positive_signals"), lambda p: claim("FACT", F.concat(F.lit("In its favour: "), _words(p), F.lit(".")), p))
    arguments = F.transform(f("negotiation.leverage"), lambda x: F.concat(_words(x["name"]), F.lit(" ("), F.lower(x["strength"]), F.lit(")")))
    bargain = F.when(
        f("negotiation.opening").isNotNull(),
        F.struct(
            F.concat(
                F.lit("Open at "), _number(f("negotiation.opening")), F.lit(" and aim for "), _number(f("negotiation.target_low")), F.lit(" to "),
                _number(f("negotiation.target_high")), F.lit("."),
            ).alias("summary"),
            f("negotiation.opening").alias("opening_offer"), f("negotiation.target_low").alias("target_low"), f("negotiation.target_high").alias("target_high"),
            F.slice(arguments, 1, MOST_ARGUMENTS).alias("key_arguments"),
        ),
    )
    grave = F.size(F.filter(f("risk_signals"), lambda s: s["rank"] >= 3))
    final = F.when(
        ~F.coalesce(valued, F.lit(False)),
        "The market data do not allow an estimate. What was found about the vehicle stands; its condition is for an inspection to establish.",
    ).otherwise(
        F.concat_ws(
            " ",
            F.concat(
                F.lit("The central estimate is "), _number(f("valuation.central")), F.lit(", in a fair range of "), _number(f("valuation.low")),
                F.lit(" to "), _number(f("valuation.high")), F.lit("."),
            ),
            F.when(priced, F.concat(F.lit("The asking price differs by "), _number(F.abs(f("price_position.difference_pct")), 2), F.lit(" per cent."))),
            F.when(grave > 0, F.concat(F.lit("Grave findings: "), grave.cast("string"), F.lit("."))),
        )
    )
    figures = [F.get_json_object("bundle", path).try_cast("double").alias(n) for n, path in ASSESSMENT.items()]
    assessment = F.struct(
        *figures,
        F.coalesce(F.round(F.get_json_object("bundle", "$.confidence.score").try_cast("double") * 100), F.lit(0.0)).cast("int").alias("confidence"),
        F.coalesce(F.get_json_object("bundle", "$.price_position.rating"), F.lit("INSUFFICIENT_DATA")).alias("rating"),
    )
    limits = F.when(F.size(f("limitations")) > 0, F.transform(f("limitations"), _words)).otherwise(F.array(F.lit("none recorded")))
    priority = lambda i: F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), i["rank"] + 1)
    fields = {
        "market_assessment": F.col("_assessment"), "vehicle_summary": summary, "market_context": market, "price_explanation": price, "final_assessment": final,
        "positive_signals": F.slice(positive, 1, MOST["positive_signals"]), "risk_signals": F.slice(risks, 1, MOST["risk_signals"]),
        "model_specific_concerns": F.array().cast(_CLAIMS),
        "seller_questions": F.slice(F.transform(f("seller_questions"), lambda q: _words(q["key"])), 1, MOST["seller_questions"]),
        "inspection_priorities": F.slice(F.transform(f("inspection_priorities"), lambda i: F.concat(i["item"], F.lit(", "), priority(i))), 1, MOST["inspection_priorities"]),
        "negotiation_strategy": bargain, "limitations": F.slice(limits, 1, MOST["limitations"]),
    }
    rows = bundles.select(key, F.from_json("bundle", _BUNDLE).alias("b"), assessment.alias("_assessment"))
    return rows.select(key, F.struct(*(c.alias(n) for n, c in fields.items())).cast("struct<" + ", ".join(f"{n}: {k}" for n, k in FIELDS.items()) + ">").alias("report"))


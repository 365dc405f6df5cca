"""Evidence bundles, the numbers they vouch for, and checks of prose against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import numbers_in

# Tolerance of a cited number, of an echoed figure
TOLERANCE = 0.02
ECHO_TOLERANCE = 0.005

# Phrases of a purchase verdict, and of a guarantee
VERDICT_PHRASES = (
    "you should buy", "you should not buy", "you shouldn't buy", "do not buy", "don't buy", "definitely buy",
    "i recommend buying", "i recommend purchasing", "we recommend buying", "avoid this car", "avoid this vehicle",
    "walk away from this car", "this is a must-buy", "buy it", "worth buying", "not worth buying",
)
GUARANTEE_PHRASES = (
    "guaranteed", "we guarantee", "is certainly accident-free", "definitely has no", "certainly free of",
    "no hidden problems", "problem-free",
)

# What a listing cannot establish, and words that report a seller's statement instead
UNVERIFIABLE = (
    "accident", "crash", "flood", "odometer rollback", "odometer fraud", "tampered", "stolen", "salvage",
    "engine failure", "transmission failure", "head gasket", "rust damage", "never been repaired", "has been repaired",
)
REPORTED = (
    "seller states", "seller disclosed", "listing states", "the listing discloses", "disclosed by",
    "according to the listing", "the description states", "is disclosed", "was disclosed",
)

# Comparables in a bundle, improvements named
COMPARABLES_SHOWN, IMPROVEMENTS_SHOWN = 10, 5


def bundle(rows: DataFrame, sections: dict[str, list[str]], key: str = "subject_id") -> DataFrame:
    """One JSON document per row: a struct per section, keys in the order given, nulls left out."""
    parts = [F.struct(*cols).alias(name) for name, cols in sections.items()]
    return rows.select(key, F.to_json(F.struct(*parts)).alias("bundle"))


def registry(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct numbers that a text vouches for: itself, rounded, and its percentage or fraction twin.

    Columns: ``key``, value.  Whole numbers up to 100 are too common to be worth a check and are
    left out.
    """
    values = rows.select(key, F.explode(F.array_distinct(numbers_in(F.col(text)))).alias("_v"))
    v = F.col("_v")
    twins = F.array(
        v, F.round(v), F.when((v > 0) & (v <= 1), v * 100), F.when((v > 1) & (v <= 100), v / 100)
    )
    return values.select(key, F.explode(F.array_distinct(F.filter(twins, lambda x: x.isNotNull()))).alias("value")).distinct()


def bands(value: Column, tolerance: float = TOLERANCE) -> Column:
    """Logarithmic cells whose neighbours hold every number within the tolerance."""
    return F.floor(F.log(F.greatest(F.abs(value), F.lit(1.0))) / F.log(F.lit(1.0 + 2 * tolerance))).cast("long")


def unknown_numbers(claims: DataFrame, known: DataFrame, key: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows of ``claims`` (value, and ``key`` if given) that no number of ``known`` matches within tolerance.

    |a - b| <= tolerance max(|a|, |b|, 1).  Cells of the logarithm make the test an equi-join: each
    known number is put into its own cell and both neighbours, so no pair of rows beyond them meets.
    """
    cell = bands(F.col("value"), tolerance)
    k = known.select(
        *([F.col(key).alias("_k")] if key else []), F.col("value").alias("_known"), F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell")
    )
    near = F.abs(F.col("value") - F.col("_known")) <= F.greatest(F.abs("value"), F.abs("_known"), F.lit(1.0)) * tolerance
    same = (F.col("_band") == F.col("_cell")) & near
    same = same & (F.col(key) == F.col("_k")) if key else same
    return claims.withColumn("_band", cell).join(k, same, "left_anti").drop("_band")


def forbidden(text: Column) -> Column:
    """The phrases of a verdict or a guarantee that a text contains."""
    lower = F.lower(text)
    return F.filter(F.array(*(F.when(F.instr(lower, p) > 0, p) for p in (*VERDICT_PHRASES, *GUARANTEE_PHRASES))), lambda p: p.isNotNull())


def echoes(claimed: Column, computed: Column, tolerance: float = ECHO_TOLERANCE) -> Column:
    """Whether a restated figure is the computed one; two absent figures agree."""
    near = F.abs(claimed - computed) <= F.abs(computed) * tolerance
    return F.when(claimed.isNull() | computed.isNull(), claimed.isNull() & computed.isNull()).otherwise(near)


def narrative() -> Column:
    """A plain summary of an appraised row (rating, range, confidence, risk) without any model."""
    c = F.col
    valued = F.concat_ws(
        " ",
        F.format_string("Central estimate %s, range %s to %s.", F.format_number("central", 0), F.format_number("low", 0), F.format_number("high", 0)),
        F.when(c("difference").isNotNull(), F.format_string("Asked %s: %s per cent against the estimate.", F.format_number("s_price", 0), F.format_number("difference_pct", 1))),
        F.concat(F.lit("Rated "), F.lower(F.replace(c("rating"), F.lit("_"), F.lit(" "))), F.lit(".")),
        F.format_string("Risk score %d.", "risk_score"),
    )
    short = F.format_string("Only %d comparable listings: no estimate.", c("size"))
    return F.when(c("outcome") == "OK", valued).otherwise(short)


def transcript(turns: DataFrame) -> DataFrame:
    """One text per conversation: ``role: text`` in order of turn, parted by blank lines."""
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda t: t["line"]), "\n\n").alias("transcript"), F.count("*").alias("turns")
    )


def reply(text: Column) -> Column:
    """The ``reply`` of a JSON answer, code fences tolerated; the text itself where it is no JSON."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.coalesce(F.get_json_object(bare, "$.reply"), text)


def limitations() -> Column:
    """Codes of what an appraisal cannot tell, from its own state."""
    c = F.col
    found = F.array(
        F.lit("LISTING_DATA_ONLY"),
        F.when(c("basis") == "ASKING", "ASKING_PRICES"),
        F.when(c("vin").isNull() | (c("vin") == ""), "NO_VIN"),
        F.lit("NO_HISTORY"),
        F.when(c("widened"), "WIDENED"),
        F.lit("NOT_CALIBRATED"),
        F.when(c("s_mileage_km").isNull(), "NO_MILEAGE"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def improvements(unknown: Column) -> Column:
    """What would strengthen an appraisal, five at most: ``unknown`` names the fields that are not known."""
    c = F.col
    first = F.array(F.when(c("s_mileage_km").isNull(), "ADD_MILEAGE"), F.when(c("s_city").isNull(), "ADD_CITY"))
    named = F.transform(F.filter(unknown, lambda n: ~n.isin("make", "model")), lambda n: F.concat(F.lit("SPECIFY_"), F.upper(n)))
    last = F.array(F.when(c("c_sample_size") < 0.5, "WAIT_FOR_LISTINGS"))
    return F.slice(F.filter(F.concat(first, named, last), lambda x: x.isNotNull()), 1, IMPROVEMENTS_SHOWN)


def assemble(appraised: DataFrame, chosen: DataFrame, as_of: Column) -> DataFrame:
    """subject_id and ``bundle``: one JSON document of everything that is known of an appraised row.

    ``appraised`` has been through risk, rating, confidence, negotiation, inspection and ``limitations``;
    ``chosen`` are its comparables, of which the first ten by rank are shown.
    """
    c = F.col
    part = lambda prefix, *names: F.struct(*(c(f"{prefix}{n}").alias(n) for n in names))
    shown = chosen.filter(c("rank") <= COMPARABLES_SHOWN).groupBy("subject_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "listing_id", "price", "mileage_km", "similarity", "tier", "age_days"))).alias("_shown")
    )
    none = F.array().cast("array<string>")
    sections = {
        "analysis_id": F.concat(F.lit("analysis-"), c("subject_id").cast("string")),
        "generated_at": F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss"),
        "currency": F.lit("AZN"),
        "vehicle": part("s_", "make", "model", "model_year", "generation", "trim", "displacement_l", "fuel", "transmission", "drivetrain", "body", "mileage_km", "city"),
        "market_statistics": part("", "size", "effective_size", "mean_similarity", "median_mileage_km", "dispersion", "norm_p10", "norm_p25", "norm_p50", "norm_p75", "norm_p90"),
        "comparables": F.coalesce("_shown", F.array().cast(shown.schema["_shown"].dataType)),
        "valuation": part("", "outcome", "basis", "central", "low", "high", "raw_median", "mileage_amount", "age_amount", "geography_amount", "disclosure_amount"),
        "price_position": F.struct(c("s_price").alias("asking"), *(c(n) for n in ("rating", "difference", "difference_pct", "percentile", "within_range", "explained_share"))),
        "risk_signals": c("signals"),
        "positive_signals": c("positives"),
        "confidence": F.struct(c("confidence").alias("score"), c("confidence_band").alias("band"), "limiting"),
        "negotiation": part("", "opening", "target_low", "target_high", "walk_away", "leverage"),
        "inspection_priorities": c("inspection"),
        "seller_questions": c("questions"),
        "candidate_explanations": c("explanations"),
        "data_conflicts": c("conflicts"),
        "vehicle_history": F.struct(F.lit(False).alias("available")),
        "service_records": F.struct(c("has_records").alias("provided")),
        "diagnostic_codes": none,
        "web_research": none,
        "model_specific_concerns": none,
        "limitations": c("limitations"),
    }
    rows = appraised.join(shown, "subject_id", "left")
    document = F.struct(*(value.alias(name) for name, value in sections.items()))
    return rows.select("subject_id", F.to_json(document).alias("bundle"))


def vouched(bundles: DataFrame, key: str = "subject_id", text: str = "bundle") -> DataFrame:
    """Distinct numbers (``key``, value) that a document vouches for, in fields or inside its strings.

    Magnitudes without a sign, each also rounded, and as percentage or fraction.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:E[0-9]+)?"), F.lit(0))
    values = bundles.select(key, F.explode(F.array_distinct(found)).alias("_t"))
    v = F.regexp_replace("_t", ",", "").try_cast("double")
    twins = F.array(v, F.round(v), F.when((v > 0) & (v <= 1), v * 100), F.when((v > 1) & (v <= 100), v / 100))
    return values.select(key, F.explode(F.filter(twins, lambda x: x.isNotNull())).alias("value")).distinct()


def _echo(claimed: Column, computed: Column, name: str) -> Column:
    apart = F.abs(claimed - computed) / F.greatest(F.abs(computed), F.lit(1.0)) > ECHO_TOLERANCE
    invented = computed.isNull() & claimed.isNotNull()
    return F.when(invented, f"INVENTED_FIGURE:{name}").when(apart, f"FIGURE_MISMATCH:{name}")


def validate(reports: DataFrame, appraised: DataFrame, known: DataFrame) -> DataFrame:
    """subject_id and ``findings``: what is wrong with a written report, by what was computed.

    ``reports``: subject_id, central, low, high, asking, difference_pct, confidence (per cent), rating, prose,
    claims (array of group, kind, statement) and limitations.  ``appraised``: the rated rows.
    ``known``: the numbers that each subject's evidence vouches for (see ``vouched``).

    Figures may differ by half a per cent and the confidence by one point; a figure that was never
    computed is invented; the rating is given; every number in the prose must be vouched for; what
    a listing cannot establish may not be called a fact unless reported as a statement; grave
    signals and limitations may not be left out; verdicts and guarantees are forbidden.
    """
    c = F.col
    facts = appraised.select(
        "subject_id", *(c(n).alias(f"_{n}") for n in ("central", "low", "high", "s_price", "difference_pct", "confidence", "rating")),
        F.exists("signals", lambda s: s["rank"] >= 3).alias("_grave"),
    )
    both = reports.join(facts, "subject_id")
    text = F.concat_ws(" ", "prose", F.transform("claims", lambda x: x["statement"]))
    cited = reports.select("subject_id", F.explode(F.array_distinct(numbers_in(text))).alias("value"))
    unknown = unknown_numbers(cited, known, "subject_id").groupBy("subject_id").agg(F.count("*").alias("_unknown"))
    overstated = F.exists(
        "claims",
        lambda x: (x["kind"] == "FACT") & F.lower(x["statement"]).rlike("|".join(UNVERIFIABLE)) & ~F.lower(x["statement"]).rlike("|".join(REPORTED)),
    )
    named = {"central": "_central", "low": "_low", "high": "_high", "asking": "_s_price", "difference_pct": "_difference_pct"}
    found = F.array(
        *(_echo(c(n), c(computed), n) for n, computed in named.items()),
        F.when(F.abs(c("confidence") - F.round(c("_confidence") * 100)) > 1, "FIGURE_MISMATCH:confidence"),
        F.when(c("rating") != c("_rating"), "RATING_MISMATCH"),
        F.when(c("_unknown") > 0, "UNSUPPORTED_NUMBER"),
        F.when(overstated, "OVERSTATED_CLAIM"),
        F.when(c("_grave") & ~F.exists("claims", lambda x: x["group"] == "risk_signals"), "OMITTED_RISK"),
        F.when(F.size("limitations") <= 0, "MISSING_LIMITATIONS"),
        F.when(F.size(forbidden(text)) > 0, "FORBIDDEN_PHRASE"),
    )
    joined = both.join(unknown, "subject_id", "left")
    return joined.select("subject_id", F.filter(found, lambda x: x.isNotNull()).alias("findings"))

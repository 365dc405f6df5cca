"""From a valuation to risk signals, rating, confidence and negotiating positions, one row per subject.

All of them are expressions over one joined row (``facts``): no shuffle beyond the joins that made
it.  Signals are an array of structs, so ordering, scoring and leave-one-out need no explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .comparables import MIN_SAMPLE
from .snapshots import whole_days

# Weight and rank of a severity
SEVERITY_WEIGHT = {"INFO": 0.02, "LOW": 0.08, "MODERATE": 0.18, "HIGH": 0.35, "CRITICAL": 0.55}
SEVERITIES = list(SEVERITY_WEIGHT)
PRICE_ANOMALY = (0.08, 0.15, 0.25)
MILEAGE_RATIO = (1.4, 1.8)
LISTED_DAYS = (60, 120)
MANY_CHANGES = 3
WELL_SUPPORTED = 15
RISK_BANDS = ((20, "LOW"), (40, "MODERATE_LOW"), (60, "MODERATE"), (80, "HIGH"))

# Rating thresholds in half range widths and in per cent
Z = {"suspicious": -2.0, "great": -1.2, "good": -0.5, "high": 0.6, "over": 1.3}
PCT = {"meaningful": 2.5, "great": -6.0, "suspicious": -18.0, "high": 2.5, "over": 8.0}
GREAT_RISK_CEILING = 40
MATERIAL_SHARE = 0.35

# Confidence components
CONFIDENCE_WEIGHT = {
    "sample_size": 0.25,
    "similarity": 0.22,
    "completeness": 0.15,
    "freshness": 0.13,
    "agreement": 0.12,
    "geography": 0.08,
    "verification": 0.05,
}
SAMPLE_HALF_POINT = 18.0
FRESHNESS_HALF_LIFE = 60.0
DISPERSION_HALF_POINT = 0.14
CONFIDENCE_RANGE = (0.05, 0.95)
CONFIDENCE_BANDS = ((0.80, "HIGH"), (0.60, "MODERATE"), (0.40, "LIMITED"))

# negotiation
MIN_MOVES = 6
LEVERAGE_DAYS = (45, 90)


def _signal(kind: str, severity: Column | str, confidence: Column | float) -> Column:
    name = F.lit(severity) if isinstance(severity, str) else severity
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), name).cast("int") - 1
    return F.struct(
        F.lit(kind).alias("kind"),
        name.alias("severity"),
        rank.alias("rank"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
    )


def signals() -> Column:
    """Detected risk signals, by falling severity and confidence, then kind."""
    c = F.col
    below = F.when((c("outcome") == "OK") & (c("s_price") < c("low")), (c("low") - c("s_price")) / c("low"))
    mild, strong, severe = PRICE_ANOMALY
    ratio = F.when((c("with_mileage") >= 5) & (c("median_mileage_km") > 0), c("s_mileage_km") / c("median_mileage_km"))
    missing = (
        F.when(c("vin").isNull() | (c("vin") == ""), 1).otherwise(0)
        + F.when(c("has_records"), 0).otherwise(1)
        + F.when(c("owners").isNull(), 1).otherwise(0)
    )
    damage = F.coalesce(c("s_damage"), c("read.damage"))
    repaint = F.coalesce(c("s_repaint"), c("read.repaint"))
    listed = c("days_listed") >= LISTED_DAYS[0]
    found = F.array(
        F.when(below >= mild, _signal("PRICE_ANOMALY", F.when(below >= severe, "HIGH").when(below >= strong, "MODERATE").otherwise("LOW"), F.least(F.lit(0.95), below + 0.5))),
        F.when(ratio >= MILEAGE_RATIO[0], _signal("MILEAGE_ANOMALY", F.when(ratio >= MILEAGE_RATIO[1], "MODERATE").otherwise("LOW"), 0.9)),
        F.when(c("conflicts") > 0, _signal("INCONSISTENCY", F.when(c("conflicts") > 1, "MODERATE").otherwise("LOW"), 0.85)),
        F.when(missing > 0, _signal("HISTORY_GAPS", F.when(missing >= 2, "MODERATE").otherwise("LOW"), 1.0)),
        F.when(F.coalesce(listed, F.lit(False)) | (c("moves") >= MANY_CHANGES), _signal("LISTING_BEHAVIOUR", F.when(c("days_listed") >= LISTED_DAYS[1], "MODERATE").otherwise("LOW"), 0.8)),
        F.when(damage, _signal("DAMAGE", "MODERATE", 0.95)),
        F.when(repaint, _signal("REPAINT", "LOW", 0.9)),
        F.when(c("read.needs_repair"), _signal("NEEDS_REPAIR", "HIGH", 0.85)),
        F.when((c("size") < MIN_SAMPLE), _signal("NO_COVERAGE", "LOW", 0.75)).when((c("size") < WELL_SUPPORTED) | c("widened"), _signal("THIN_MARKET", "LOW", 0.75)),
        F.when(c("read.claims") > 0, _signal("UNVERIFIED_CLAIMS", "INFO", 0.7)),
    )
    some = F.filter(found, lambda s: s.isNotNull())
    key = lambda s: F.struct(-s["rank"], -s["confidence"], s["kind"])
    return F.array_sort(some, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def positives() -> Column:
    """Names of the reassuring observations."""
    c = F.col
    found = F.array(
        F.when((c("size") >= 25) & ~c("widened"), "WELL_SUPPORTED"),
        F.when(c("has_records"), "RECORDS"),
        F.when(~c("read.damage"), "STATED_UNDAMAGED"),
        F.when((c("with_mileage") >= 5) & (c("median_mileage_km") > 0) & (c("s_mileage_km") <= c("median_mileage_km") * 0.85), "LOW_MILEAGE"),
        F.when((c("outcome") == "OK") & (c("dispersion") < 0.08), "CLOSE_AGREEMENT"),
    )
    return F.filter(found, lambda p: p.isNotNull())


def signal_weight(signal: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for pair in SEVERITY_WEIGHT.items() for x in pair))
    return stats.clamp(F.try_element_at(weights, signal["severity"]) * signal["confidence"], 0.0, 0.95)


def noisy_or(found: Column) -> Column:
    """1 - product of (1 - weight) over the signals, in [0, 1)."""
    return 1.0 - F.aggregate(found, F.lit(1.0), lambda left, s: left * (1.0 - signal_weight(s)))


def marginals(found: Column) -> Column:
    """Points that the score loses without each signal, largest first: (1 - total) w / (1 - w)."""
    total = noisy_or(found)
    points = F.transform(
        found,
        lambda s: F.struct(
            F.round((1.0 - total) * signal_weight(s) / (1.0 - signal_weight(s)) * 100, 1).alias("points"), s["kind"].alias("kind")
        ),
    )
    return F.sort_array(points, asc=False)


def band(value: Column, bands: tuple, top: str, rising: bool) -> Column:
    found = F.lit(top)
    for edge, name in reversed(bands):
        found = F.when(value <= edge if rising else value >= edge, name).otherwise(found)
    return found


def assess_risk(facts: DataFrame) -> DataFrame:
    """``facts`` with signals, positives, risk_score (0 to 100), risk_band and contributions."""
    rows = facts.withColumn("signals", signals()).withColumn("positives", positives())
    score = F.round(noisy_or(F.col("signals")) * 100).cast("int")
    return (
        rows.withColumn("risk_score", score)
        .withColumn("risk_band", band(F.col("risk_score"), RISK_BANDS, "VERY_HIGH", True))
        .withColumn("contributions", marginals(F.col("signals")))
    )


def rate(rows: DataFrame) -> DataFrame:
    """Adds rating, difference, difference_pct, z, within_range and the gap's decomposition.

    total_gap = explained + unexplained exactly: asking less raw median, centre less raw median,
    asking less centre.
    """
    c = F.col
    half = F.greatest((c("high") - c("low")) / 2, c("central") * 0.01)
    known = (c("outcome") == "OK") & c("s_price").isNotNull()
    pct = F.when(c("central") != 0, (c("s_price") - c("central")) / c("central") * 100).otherwise(0.0)
    rows = rows.withColumns(
        {
            "difference": F.when(known, c("s_price") - c("central")),
            "difference_pct": F.when(known, pct),
            "z": F.when(known, (c("s_price") - c("central")) / half),
            "within_range": F.when(known, c("s_price").between(c("low"), c("high"))),
            "total_gap": F.when(known, c("s_price") - c("raw_median")),
            "explained": F.when(known, c("central") - c("raw_median")),
        }
    )
    none = (F.abs("total_gap") < 1) & (F.abs("difference") < 1)
    share = F.when(c("total_gap") == 0, 1.0).otherwise(stats.clamp(1.0 - F.abs("difference") / F.abs("total_gap"), 0.0, 1.0))
    rows = rows.withColumn("explained_share", F.when(~none, share))
    material = F.coalesce((c("total_gap") != 0) & ((1.0 - c("explained_share")) >= MATERIAL_SHARE), F.lit(False))
    rows = rows.withColumn("material_unexplained", material)
    calm = F.when(c("risk_score") <= GREAT_RISK_CEILING, "GREAT_VALUE").otherwise("GOOD_VALUE")
    z, p = c("z"), c("difference_pct")
    rating = (
        F.when(~F.coalesce(known, F.lit(False)), "INSUFFICIENT_DATA")
        .when(F.abs(p) < PCT["meaningful"], "FAIR_VALUE")
        .when((z <= Z["suspicious"]) & (p <= PCT["suspicious"]), F.when(c("material_unexplained"), "SUSPICIOUSLY_CHEAP").otherwise(calm))
        .when((z <= Z["great"]) & (p <= PCT["great"]), calm)
        .when((z <= Z["good"]) & (p <= -PCT["meaningful"]), "GOOD_VALUE")
        .when((z >= Z["over"]) & (p >= PCT["over"]), "OVERPRICED")
        .when((z >= Z["high"]) & (p >= PCT["high"]), "HIGH_PRICED")
        .otherwise("FAIR_VALUE")
    )
    return rows.withColumn("rating", rating)


def explanations() -> Column:
    """Codes of what could explain a material unexplained discount; none of them is confirmed."""
    c = F.col
    found = F.array(
        F.lit("UNACCOUNTED_DISCOUNT"),
        F.when(~c("has_records"), "INCOMPLETE_MAINTENANCE"),
        F.when(c("s_damage").isNull(), "UNDISCLOSED_REPAIR"),
        F.when(c("s_trim").isNull(), "LOWER_EQUIPMENT"),
        F.when(c("days_listed") > LEVERAGE_DAYS[0], "MOTIVATED_SELLER"),
        F.when(F.exists(c("signals"), lambda s: s["rank"] >= 3), "RISK_SIGNALS"),
        F.lit("UNCONFIRMED"),
    )
    listed = F.filter(found, lambda e: e.isNotNull())
    return F.when((c("difference") < 0) & c("material_unexplained"), listed).otherwise(F.array().cast("array<string>"))


def confidence(rows: DataFrame) -> DataFrame:
    """Adds one score per component, the weighted confidence, its band and the limiting components.

    Without a valuation the confidence is 0 and the components are null.
    """
    c = F.col
    detail = F.when(c("s_mileage_km").isNotNull(), 1).otherwise(0) + F.when(c("s_city").isNotNull(), 1).otherwise(0) + F.when(c("s_price").isNotNull(), 1).otherwise(0)
    parts = {
        "sample_size": stats.saturating(c("effective_size"), SAMPLE_HALF_POINT),
        "similarity": stats.clamp((c("weighted_similarity") - 0.5) / 0.45, 0.0, 1.0),
        "completeness": c("specificity") * 0.7 + detail / 3 * 0.3,
        "freshness": F.pow(F.lit(0.5), c("median_age_days") / FRESHNESS_HALF_LIFE),
        "agreement": 1.0 - stats.saturating(c("dispersion"), DISPERSION_HALF_POINT),
        "geography": F.when(c("s_city").isNull(), 0.4).otherwise(c("local") / c("size")),
        "verification": c("verified_share"),
    }
    ok = c("outcome") == "OK"
    rows = rows.withColumns({f"c_{k}": F.when(ok, F.round(v, 4)) for k, v in parts.items()})
    total = sum((c(f"c_{k}") * w for k, w in CONFIDENCE_WEIGHT.items()), F.lit(0.0))
    rows = rows.withColumn("confidence", F.when(ok, F.round(stats.clamp(total, *CONFIDENCE_RANGE), 4)).otherwise(0.0))
    weak = F.array(*(F.when(c(f"c_{k}") < 0.6, F.struct(c(f"c_{k}").alias("score"), F.lit(i).alias("seq"), F.lit(k).alias("name"))) for i, k in enumerate(CONFIDENCE_WEIGHT)))
    worst = F.slice(F.transform(F.sort_array(F.filter(weak, lambda w: w.isNotNull())), lambda w: w["name"]), 1, 4)
    return rows.withColumn("confidence_band", band(c("confidence"), CONFIDENCE_BANDS, "LOW", False)).withColumn("limiting", worst)


def leverage() -> Column:
    """Up to eight arguments for a lower price, each with its strength."""
    c = F.col
    point = lambda name, strength: F.struct(F.lit(name).alias("name"), (F.lit(strength) if isinstance(strength, str) else strength).alias("strength"))
    first = F.filter(
        F.array(
            F.when(c("days_listed") >= LEVERAGE_DAYS[0], point("LONG_LISTED", F.when(c("days_listed") >= LEVERAGE_DAYS[1], "strong").otherwise("moderate"))),
            F.when(c("moves") > 0, point("ALREADY_MOVED", F.when(c("moves") >= 2, "strong").otherwise("moderate"))),
            F.when(c("difference") > 0, point("CHEAPER_ALTERNATIVES", "strong")),
        ),
        lambda p: p.isNotNull(),
    )
    # moderate signals enter while fewer than six points stand; signals come by falling severity
    grave = F.transform(F.filter(c("signals"), lambda s: s["rank"] >= 3), lambda s: F.struct(s["kind"].alias("name"), F.lit("strong").alias("strength")))
    mild = F.transform(F.filter(c("signals"), lambda s: s["rank"] == 2), lambda s: F.struct(s["kind"].alias("name"), F.lit("moderate").alias("strength")))
    room = F.greatest(F.lit(0), F.lit(6) - F.size(first) - F.size(grave))
    last = F.filter(
        F.array(F.when(~c("has_records"), point("NO_RECORDS", "moderate")), F.when(c("size") >= WELL_SUPPORTED, point("ALTERNATIVES", "moderate"))),
        lambda p: p.isNotNull(),
    )
    return F.slice(F.concat(first, grave, F.slice(mild, F.lit(1), room), last), 1, 8)


def negotiate(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Adds opening, target_low, target_high, walk_away, leverage and the observed reduction.

    ``moves``: subject_id, comparable_moves (comparables whose price moved), _move_pct (their median).
    At or below the centre the asking price itself is the position; above it the lower half of the
    range is, with room left to settle, never below the range.
    """
    c = F.col
    ask, mid, low, high = c("s_price"), c("central"), c("low"), c("high")
    fair = ask <= mid
    t_low = F.when(fair, F.least(ask, F.greatest(low, ask * 0.95))).otherwise(F.greatest(low, mid - (mid - low) * 0.5))
    known = F.col("rating") != "INSUFFICIENT_DATA"
    rows = rows.join(moves, "subject_id", "left").withColumn("leverage", F.when(known, leverage()))
    return rows.withColumns(
        {
            "target_low": F.when(known, F.round(t_low)),
            "target_high": F.when(known, F.round(F.when(fair, ask).otherwise(mid))),
            "opening": F.when(known, F.round(F.when(fair, F.least(t_low, ask)).otherwise(F.greatest(low, t_low - (ask - mid) * 0.35)))),
            "walk_away": F.when(known, F.round(high)),
            "comparable_moves": F.coalesce("comparable_moves", F.lit(0)),
            "reduction_pct": F.when(c("comparable_moves") >= MIN_MOVES, F.round("_move_pct", 1)),
        }
    ).drop("_move_pct")


def days_listed(as_of: Column, first_seen: Column) -> Column:
    return whole_days(as_of, first_seen)

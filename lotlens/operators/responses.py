"""An appraised row as the document that a client reads: amounts with their spelling, labels, adjustments, at most 20 comparables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise
from . import inspection, judgement

# Comparables in a response, labels of the factors and of the confidence's components
COMPARABLES = 20
FACTORS = {"mileage": "Mileage", "age": "Model year", "geography": "Location", "disclosure": "Disclosed condition"}


def _money(amount: Column) -> Column:
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), F.lit("AZN").alias("currency"), normalise.thousands(amount).alias("formatted")))


def _label(code: Column) -> Column:
    """A code in words: its first letter large."""
    words = F.lower(F.replace(code, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1000))


def respond(appraised: DataFrame, chosen: DataFrame, as_of: Column) -> DataFrame:
    """subject_id and ``response``, a JSON document.

    ``appraised`` has been through risk, rating, confidence, negotiation and inspection; ``chosen`` are its comparables.  Where there is
    no estimate the amounts, the gap and the negotiation are absent; every list is there, if empty.
    """
    c = F.col
    shown = chosen.filter(c("rank") <= COMPARABLES).groupBy("subject_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "listing_id", "price", "mileage_km", "similarity", "tier", "age_days"))).alias("_shown")
    )
    told = F.transform(
        "_shown",
        lambda x: F.struct(
            x["listing_id"].alias("listing_id"), _money(x["price"]).alias("price"), x["mileage_km"].alias("mileage_km"),
            F.round(x["similarity"] * 100, 1).alias("similarity_percent"), x["tier"].alias("tier"), x["age_days"].alias("age_days"),
        ),
    )
    adjustments = F.array(
        *(
            F.struct(
                F.lit(name).alias("factor"), F.lit(label).alias("label"), c(f"{name}_amount").alias("amount"), c(f"{name}_reason").alias("status"),
                (c(f"{name}_reason") == "APPLIED").alias("applied"),
            )
            for name, label in FACTORS.items()
        )
    )
    valued = c("outcome") == "OK"
    gap = F.when(
        valued & c("total_gap").isNotNull(),
        F.struct(
            c("raw_median").alias("reference_median"), c("total_gap"), c("explained"), (c("total_gap") - c("explained")).alias("unexplained"),
            F.round("explained_share", 3).alias("explained_share"), F.filter(adjustments, lambda a: a["applied"]).alias("components"),
        ),
    )
    graver = lambda s: F.struct(-s["rank"], -s["confidence"], s["kind"])
    ordered = F.transform(
        F.array_sort(F.transform("signals", lambda s: F.struct(graver(s).alias("at"), s.alias("s")))),
        lambda x: F.struct(
            x["s"]["kind"].alias("type"), _label(x["s"]["kind"]).alias("title"), x["s"]["severity"].alias("severity"), x["s"]["confidence"].alias("confidence")
        ),
    )
    by_rank = {p: F.transform(inspection.by_priority(c("inspection"), p), lambda i: F.struct(i["item"].alias("item"), i["system"].alias("system"), i["trigger"].alias("because"))) for p in inspection.PRIORITIES}
    components = F.array(*(F.struct(F.lit(k).alias("name"), _label(F.lit(k)).alias("label"), F.round(f"c_{k}", 3).alias("score")) for k in judgement.CONFIDENCE_WEIGHT))
    sections = {
        "analysis_id": F.concat(F.lit("analysis-"), c("subject_id").cast("string")),
        "generated_at": F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss"),
        "vehicle": F.struct(*(c(f"s_{n}").alias(n) for n in ("make", "model", "model_year", "generation", "trim", "displacement_l", "fuel", "transmission", "drivetrain", "body", "mileage_km", "city"))),
        "valuation": F.struct(
            c("outcome"), c("basis").alias("price_basis"), _money(c("central")).alias("central_estimate"), _money(c("low")).alias("fair_market_low"),
            _money(c("high")).alias("fair_market_high"), _money(c("raw_median")).alias("raw_market_median"),
            F.when(valued, F.round((c("high") - c("low")) / c("central") * 100, 1)).alias("range_width_percent"), c("comparables_used").alias("comparable_count"),
            F.round("effective_size", 1).alias("effective_sample_size"), F.round("dispersion", 4).alias("dispersion"), "outliers_removed",
            adjustments.alias("adjustments"),
        ),
        "price_position": F.struct(
            c("rating"), _label(c("rating")).alias("rating_label"), _money(c("s_price")).alias("asking_price"), F.round("difference", 2).alias("difference"),
            F.round("difference_pct", 2).alias("difference_percent"), F.round("percentile", 1).alias("percentile"), "within_range", gap.alias("gap_analysis"),
        ),
        "risk": F.struct(c("risk_score").alias("score"), c("risk_band").alias("band"), _label(c("risk_band")).alias("band_label"), ordered.alias("signals"), c("positives"), "contributions"),
        "confidence": F.struct(F.round(c("confidence") * 100).cast("int").alias("score_percent"), c("confidence_band").alias("band"), F.lit(False).alias("calibrated"), components.alias("components"), "limiting"),
        "comparables": told,
        "negotiation": F.when(
            c("opening").isNotNull(),
            F.struct(_money(c("opening")).alias("opening"), _money(c("target_low")).alias("target_low"), _money(c("target_high")).alias("target_high"), _money(c("walk_away")).alias("walk_away"), "leverage"),
        ),
        "inspection": F.struct(*(items.alias(p) for p, items in by_rank.items())),
        "seller_questions": F.transform("questions", lambda q: F.struct(_label(q["key"]).alias("question"), q["trigger"].alias("because"))),
        "explanations": c("explanations"),
        "limitations": c("limitations"),
    }
    rows = appraised.join(shown, "subject_id", "left")
    none = F.array().cast(shown.schema["_shown"].dataType)
    rows = rows.withColumn("_shown", F.coalesce("_shown", none))
    return rows.select("subject_id", F.to_json(F.struct(*(value.alias(name) for name, value in sections.items()))).alias("response"))

"""Seller questions and the inspection plan of an appraised item: rule tables over one joined row.

Every rule is a condition on the row and what it asks for; questions and items are arrays of
structs, so ordering and de-duplication need no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mileages and age from which wear is asked about, days listed, share of the usual mileage
HIGH_MILEAGE_KM, VERY_HIGH_MILEAGE_KM = 150_000, 220_000
OLDER_YEARS = 8
LISTED_DAYS = 45
LOW_MILEAGE_SHARE = 0.6
PRIORITIES = ("high", "medium", "low")

# Baseline checks by key (priority, system), present for every item
BASELINE = {
    "diagnostic": ("high", "electronics"),
    "cold_start": ("high", "powertrain"),
    "structure": ("medium", "structure"),
    "paint": ("medium", "structure"),
    "fluids": ("medium", "powertrain"),
    "transmission": ("medium", "powertrain"),
    "suspension": ("low", "wear"),
    "brakes": ("low", "wear"),
    "tyres": ("low", "wear"),
    "electrics": ("low", "electronics"),
    "documents": ("high", "documents"),
    "rust": ("low", "structure"),
}
#: Checks that only findings ask for.
FURTHER = {
    "alignment": "structure",
    "major_service": "powertrain",
    "compression": "powertrain",
    "odometer": "documents",
}
# The items' names, by which items of one priority and system are ordered
CHECKS = {
    "diagnostic": "Full diagnostic scan for stored and pending fault codes",
    "cold_start": "Cold engine start, observed from the first turn of the key",
    "structure": "Structural and chassis inspection on a lift",
    "paint": "Paint thickness measurement across all panels",
    "fluids": "Fluid condition and leak inspection",
    "transmission": "Transmission behaviour under load, hot and cold",
    "suspension": "Suspension, bushings and steering play",
    "brakes": "Brake pad, disc and fluid condition",
    "tyres": "Tyre age, tread depth and even wear across all four",
    "electrics": "Electrical systems, warning lights and all comfort functions",
    "documents": "Registration, ownership documents and VIN plate consistency",
    "rust": "Underbody and sill corrosion inspection",
    "alignment": "Wheel alignment and geometry check",
    "major_service": "Verification that mileage-due major services were performed",
    "compression": "Engine compression or leak-down test",
    "odometer": "Odometer verification against service records and ECU data",
}
ASKED_OF_SIGNALS = ("DAMAGE", "MILEAGE_ANOMALY", "MILEAGE_SEQUENCE", "INCONSISTENCY", "LISTING_BEHAVIOUR", "HISTORY_GAPS")


def _rank(priority: str) -> int:
    return PRIORITIES.index(priority)


def age_in_years(as_of: Column, model_year: Column) -> Column:
    """Whole years since the model year, 0 at least; null if it is unknown."""
    return F.when(model_year.isNotNull(), F.greatest(F.lit(0), F.year(as_of) - model_year))


def best_of(entries: Column) -> Column:
    """``entries`` (structs with key and rank) with the best rank of each key; of equal ones the first stays."""
    places = F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    better = lambda p: F.exists(
        places,
        lambda q: (q["e"]["key"] == p["e"]["key"])
        & ((q["e"]["rank"] < p["e"]["rank"]) | ((q["e"]["rank"] == p["e"]["rank"]) & (q["i"] < p["i"]))),
    )
    return F.transform(F.filter(places, lambda p: ~better(p)), lambda p: p["e"])


def _entry(key: str, priority: Column | str, trigger: str) -> Column:
    rank = F.lit(_rank(priority)) if isinstance(priority, str) else priority
    return F.struct(F.lit(key).alias("key"), rank.cast("int").alias("rank"), F.lit(trigger).alias("trigger"))


def _given(rules: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*(F.when(test, entry) for test, entry in rules)), lambda e: e.isNotNull())


def questions() -> Column:
    """Questions to the seller (key, rank, trigger), by priority; each once, at its best priority.

    Reads the columns of a rated row: difference, material_unexplained, signals, has_records, owners,
    vin, s_repaint, read, days_listed, s_mileage_km, with_mileage, median_mileage_km.
    """
    c = F.col
    km = c("s_mileage_km")
    gap = (c("difference") < 0) & c("material_unexplained")
    no_vin = c("vin").isNull() | (c("vin") == "")
    few_km = (c("with_mileage") >= 5) & (km > 0) & (km < c("median_mileage_km") * LOW_MILEAGE_SHARE)
    asked = F.transform(
        F.filter(c("signals"), lambda s: s["kind"].isin(*ASKED_OF_SIGNALS)),
        lambda s: F.struct(
            F.concat(F.lit("ABOUT_"), s["kind"]).alias("key"),
            F.when(s["rank"] >= 3, _rank("high")).otherwise(_rank("medium")).alias("rank"),
            s["kind"].alias("trigger"),
        ),
    )
    listed = F.concat(
        _given([(gap, _entry("REASON_FOR_PRICE", "high", "PRICE_GAP"))]),
        asked,
        _given(
            [
                (~c("has_records"), _entry("SERVICE_RECORDS", "high", "NO_RECORDS")),
                (c("owners").isNull(), _entry("PREVIOUS_OWNERS", "medium", "NO_OWNERS")),
                (no_vin, _entry("SHARE_VIN", "high", "NO_VIN")),
                (F.coalesce("s_repaint", "read.repaint"), _entry("REPAINTED_PANELS", "high", "REPAINT")),
                (c("days_listed") >= LISTED_DAYS, _entry("INSPECTED_BEFORE", "medium", "LONG_LISTED")),
                (km >= HIGH_MILEAGE_KM, _entry("SERVICES_DONE", "high", "HIGH_MILEAGE")),
                (few_km, _entry("ODOMETER_PROOF", "high", "LOW_MILEAGE")),
                (F.lit(True), _entry("INDEPENDENT_INSPECTION", "high", "ALWAYS")),
            ]
        ),
    )
    placed = F.transform(best_of(listed), lambda e, i: F.struct(e["rank"].alias("rank"), i.alias("at"), e["key"].alias("key"), e["trigger"].alias("trigger")))
    return F.transform(F.sort_array(placed), lambda p: F.struct(p["key"].alias("key"), p["rank"].alias("rank"), p["trigger"].alias("trigger")))


def items(as_of: Column) -> Column:
    """The inspection plan (rank, system, item, key, trigger) by priority, system and item.

    The baseline is there for every item; findings add checks or raise a check's priority, never
    lower it.  Reads signals, s_mileage_km, s_model_year and has_records.
    """
    c = F.col
    km = c("s_mileage_km")
    age = age_in_years(as_of, c("s_model_year"))
    has = lambda kind, rank=0: F.exists(c("signals"), lambda s: (s["kind"] == kind) & (s["rank"] >= rank))
    rules = [(F.lit(True), _entry(key, priority, "ALWAYS")) for key, (priority, _) in BASELINE.items()]
    promoted = [
        (has("DAMAGE"), [("structure", "high"), ("paint", "high"), ("alignment", "high")], "DAMAGE"),
        (has("MILEAGE_ANOMALY"), [("major_service", "high"), ("compression", "medium")], "MILEAGE_ANOMALY"),
        (has("MILEAGE_SEQUENCE"), [("odometer", "high")], "MILEAGE_SEQUENCE"),
        (has("INCONSISTENCY"), [("documents", "high")], "INCONSISTENCY"),
        (has("PRICE_ANOMALY", 2), [("structure", "high"), ("diagnostic", "high")], "PRICE_ANOMALY"),
        (km >= HIGH_MILEAGE_KM, [("major_service", "high"), ("transmission", "high")], "HIGH_MILEAGE"),
        (km >= VERY_HIGH_MILEAGE_KM, [("compression", "high")], "VERY_HIGH_MILEAGE"),
        (age >= OLDER_YEARS, [("rust", "medium"), ("suspension", "medium")], "AGE"),
        (~c("has_records"), [("fluids", "high")], "NO_RECORDS"),
    ]
    rules += [(test, _entry(key, priority, trigger)) for test, raised, trigger in promoted for key, priority in raised]
    system = {k: s for k, (_, s) in BASELINE.items()} | FURTHER
    named = lambda table, key: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    return F.sort_array(
        F.transform(
            best_of(_given(rules)),
            lambda e: F.struct(
                e["rank"].alias("rank"), named(system, e["key"]).alias("system"), named(CHECKS, e["key"]).alias("item"),
                e["key"].alias("key"), e["trigger"].alias("trigger"),
            ),
        )
    )


def plan(rated: DataFrame, as_of: Column) -> DataFrame:
    """``rated`` rows with ``questions`` and ``inspection``."""
    return rated.withColumn("questions", questions()).withColumn("inspection", items(as_of))


def by_priority(entries: Column, priority: str) -> Column:
    """The entries of one priority."""
    return F.filter(entries, lambda e: e["rank"] == _rank(priority))

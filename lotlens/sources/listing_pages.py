"""Listing pages to typed rows: the rules of one site's markup, parsing, discovery, and replay of stored payloads."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import disclosures, normalise
from ..session import bound_batches


def _property(*labels: str) -> str:
    named = "|".join(labels)
    return rf'>(?:{named})</span><span class="[^"]*product-properties__i-value[^"]*">(?:<a[^>]*>)?\s*([^<]+?)\s*(?:</a>)?</span>'


# Labels of the properties, in two languages
PROPERTIES = {
    "make": ("Marka", "Марка"),
    "model": ("Model", "Модель"),
    "model_year": ("Buraxılış ili", "Год выпуска"),
    "mileage_km": ("Yürüş", "Пробег"),
    "city": ("Şəhər", "Город"),
    "transmission": ("Sürətlər qutusu", "Коробка передач"),
    "drivetrain": ("Ötürücü", "Привод"),
    "body": ("Ban növü", "Тип кузова"),
    "engine": ("Mühərrik", "Двигатель"),
    "condition": ("Vəziyyəti", "Состояние"),
}
# Where a listing page holds each field
RULES = {
    "external_id": r'rel="canonical"\s+href="[^"]*?/autos/(\d+)',
    "price": r'class="[^"]*product-price__i--bold[^"]*"[^>]*>\s*([^<]+?)\s*<',
    "make": _property(*PROPERTIES["make"]),
    "model": _property(*PROPERTIES["model"]),
    "model_year": _property(*PROPERTIES["model_year"]),
    "mileage_km": _property(*PROPERTIES["mileage_km"]),
    "city": _property(*PROPERTIES["city"]),
    "fuel": r'>(?:Mühərrik|Двигатель)</span><span class="[^"]*product-properties__i-value[^"]*">[^<]*/\s*([^<]+?)\s*</span>',
    "transmission": _property(*PROPERTIES["transmission"]),
    "drivetrain": _property(*PROPERTIES["drivetrain"]),
    "body": _property(*PROPERTIES["body"]),
    "engine": _property(*PROPERTIES["engine"]),
    "seller_type": r'class="product-shop__owner-featured">\s*([^<]+?)\s*<',
    "description": r'(?s)class="[^"]*product-description__content[^"]*"[^>]*>(.*?)</div>',
    "condition": _property(*PROPERTIES["condition"]),
}
# A labelled property as its rule has it: the label ends before BREAK, the value follows it
BREAK = '</span><span class="'
_IN_VALUE = r'^[^"]*product-properties__i-value[^"]*">'
VALUE = _IN_VALUE + r"(?:<a[^>]*>)?\s*([^<]+?)\s*(?:</a>)?</span>"
FUEL = _IN_VALUE + r"[^<]*/\s*([^<]+?)\s*</span>"
# What a match of these rules holds: the text before the first of them cannot be part of a match, but for an opening of its attribute
MARKS = {
    "external_id": 'rel="canonical"',
    "price": "product-price__i--bold",
    "seller_type": 'class="product-shop__owner-featured">',
    "description": "product-description__content",
}
LINK = r'href="(/autos/\d+(?:-[^"/]*)?)"'


_PATTERNS = {n: re.compile(p, re.ASCII) for n, p in RULES.items()}
_VALUE, _FUEL = re.compile(VALUE, re.ASCII), re.compile(FUEL, re.ASCII)
_TAG, _GAP, _ROUGH = re.compile("<[^>]+>"), re.compile(r"\s+", re.ASCII), re.compile("[\t-\r]|  ")
_FIELD = {label: name for name, labels in PROPERTIES.items() for label in labels}
_ENGINE = tuple(f">{label}" for label in PROPERTIES["engine"])
BATCH_BYTES = 16 << 20  # of pages that a Python worker is sent at once


def _first(pattern: re.Pattern, text: str, start: int = 0) -> str | None:
    found = pattern.search(text, start)
    return found[1] if found else None


def _marked(text: str, name: str) -> str | None:
    """The match of rule ``name``, sought from its mark on, which a search for plain text finds sooner than a pattern."""
    mark = MARKS[name]
    at = text.find(mark)
    if at < 0:
        return None
    # the attribute that the mark stands in opens with the last class=" before it
    return _first(_PATTERNS[name], text, at if "=" in mark else max(text.rfind('class="', 0, at), 0))


def _labelled(text: str) -> dict[str, str]:
    """The labelled properties, read in one go from the places where BREAK parts a label from its value; of a field's labels the
    first on the page counts."""
    pieces = text.split(BREAK)
    last, found = len(pieces) - 1, {}
    for i in range(last):
        before = pieces[i]
        name = _FIELD.get(before[before.rfind(">") + 1 :]) if ">" in before else None
        engine = before.endswith(_ENGINE) and "fuel" not in found
        if (name is None or name in found) and not engine:
            continue
        follows = pieces[i + 1] + ("</span>" if i + 1 < last else "")
        value = _VALUE.search(follows) if name is not None and name not in found else None
        if value:
            found[name] = value[1]
        fuel = _FUEL.search(follows) if engine else None
        if fuel:
            found["fuel"] = fuel[1]
    return found


def _texts(text: str) -> dict[str, str]:
    """What every rule finds on a page, without tags and with single spaces."""
    if BREAK + ">" in text:
        # a class attribute may itself hold the text of BREAK, whose quote then closes it; such a page goes rule by rule
        found = {n: _first(p, text) for n, p in _PATTERNS.items()}
    else:
        found = _labelled(text)
        found |= {n: _marked(text, n) for n in MARKS}
    told = {}
    for name in RULES:
        value = found.get(name)
        if value:
            if "<" in value:
                value = _TAG.sub(" ", value)
            if _ROUGH.search(value):
                value = _GAP.sub(" ", value)
            value = value.strip(" ")
            if value:
                told[name] = value
    return told


@F.arrow_udf(returnType=T.MapType(T.StringType(), T.StringType()))
def _raw(html: pa.Array) -> pa.Array:
    ends, names, values = [0], [], []
    for page in html.cast(pa.binary()).to_pylist():
        if page:
            told = _texts(page.decode("utf-8", "replace"))
            names.extend(told)
            values.extend(told.values())
        ends.append(len(names))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))


def with_payload(landed: DataFrame, html: str = "html") -> DataFrame:
    """``landed`` with ``raw``: map of field to text as the page states it; fields without a match are absent.

    Pages are read in Python, whose patterns with ASCII classes find what Spark's do; the compiled projection of all rules
    outgrows what the JVM is willing to compile and took several times as long.
    """
    bound_batches(landed.sparkSession, BATCH_BYTES)
    return landed.withColumn("raw", _raw(html))


def rule_matches(landed: DataFrame) -> DataFrame:
    """page_id, field and value of every rule on every page, null where the rule finds nothing: what a person checks rules by."""
    read = with_payload(landed)
    told = F.array(*(F.struct(F.lit(n).alias("field"), F.try_element_at("raw", F.lit(n)).alias("value")) for n in RULES))
    return read.select("page_id", F.explode(told).alias("rule")).select("page_id", "rule.field", "rule.value")


def fields(raw: Column, make: Column | None = None) -> dict[str, Column]:
    """The configuration that a payload states, in canonical members; ``make`` if it is worked out already."""
    text = lambda n: F.try_element_at(raw, F.lit(n))
    make = normalise.make(text("make")) if make is None else make
    return {
        "make": make,
        "model": normalise.model(make, text("model")),
        "model_year": normalise.whole_number(text("model_year")).cast("int"),
        "trim": text("trim"),
        "displacement_l": normalise.displacement(normalise.decimal_number(text("engine"))),
        "fuel": normalise.category("fuel", text("fuel")),
        "transmission": normalise.category("transmission", text("transmission")),
        "drivetrain": normalise.category("drivetrain", text("drivetrain")),
        "body": normalise.body(text("body")),
    }


def parse(landed: DataFrame) -> DataFrame:
    """Typed listings of landed pages (page_id, url, html), with ``raw``, ``missing``, ``errors`` and ``unmapped``.

    A page without an identifier or a price gives a row with errors and no listing_id.  The
    structured condition is read before the prose.
    """
    text = lambda n: F.try_element_at(F.col("raw"), F.lit(n))
    rows = with_payload(landed.select("page_id", "url", "html")).drop("html")
    rows = disclosures.with_readings(disclosures.with_readings(rows, text("condition"), "_box"), text("description"), "_prose")
    amount, currency = normalise.money(text("price"))
    make = normalise.make(text("make"))
    rows = rows.withColumns(
        {"_amount": amount, "_make": make, "_city": normalise.city(text("city")),
         "_id": F.coalesce(text("external_id"), normalise.id_from_url(F.col("url")))}
    )
    c = F.col
    known = fields(c("raw"), c("_make"))
    errors = F.filter(
        F.array(F.when(c("_id").isNull(), "NO_IDENTIFIER"), F.when(c("_amount").isNull(), "NO_PRICE")), lambda e: e.isNotNull()
    )
    unmapped = F.filter(
        F.array(
            F.when(text("make").isNotNull() & c("_make").isNull(), F.concat(F.lit("make:"), text("make"))),
            F.when(text("city").isNotNull() & c("_city").isNull(), F.concat(F.lit("city:"), text("city"))),
        ),
        lambda u: u.isNotNull(),
    )
    asked = [n for n in RULES if n != "description"]
    return rows.select(
        "page_id",
        "url",
        F.when(c("_amount").isNotNull(), c("_id")).alias("listing_id"),
        c("_amount").cast("double").alias("price"),
        F.when(c("_amount").isNotNull(), currency).alias("currency"),
        normalise.whole_number(text("mileage_km")).alias("mileage_km"),
        c("_city").alias("city"),
        *(known[n].alias(n) for n in known if n != "trim"),
        normalise.category("seller_type", text("seller_type")).alias("seller_type"),
        *(F.coalesce(F.col("_box")[k], F.col("_prose")[k]).alias(k) for k in ("damage", "repaint")),
        text("description").alias("description"),
        "raw",
        F.filter(F.array(*(F.when(text(n).isNull(), n) for n in asked)), lambda n: n.isNotNull()).alias("missing"),
        errors.alias("errors"),
        unmapped.alias("unmapped"),
    )


def discover(index: DataFrame, pattern: str = LINK) -> DataFrame:
    """Links of numbered index pages (page, html), newest first, up to the first page without a fresh one.

    Gives link and the page that holds it first.  Paging is in order of ``page``; what stands behind
    the stop is not taken, even if it is new.
    """
    found = index.select("page", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("link"))
    first = found.groupBy("link").agg(F.min("page").alias("page"))
    fresh = first.groupBy("page").agg(F.count("*").alias("_fresh"))
    stop = index.select("page").distinct().join(fresh, "page", "left").filter(F.col("_fresh").isNull()).agg(F.min("page").alias("_stop"))
    return first.join(F.broadcast(stop), F.lit(True)).filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).drop("_stop")


def replay(stored: DataFrame) -> DataFrame:
    """``stored`` rows (listing_id, config_id, body, raw) with what today's rules make of the payload.

    Adds new_config_id, new_body and verdict (same, changed, or unresolved where make or model is not known any more).
    """
    known = {n: c.alias(n) for n, c in fields(F.col("raw")).items()}
    rows = stored.withColumn("_now", F.struct(*known.values()))
    now = {n: F.col("_now")[n] for n in known}
    rows = rows.withColumn("_fresh", F.when(now["make"].isNotNull() & now["model"].isNotNull(), normalise.identity(now)["config_id"]))
    same = F.col("config_id").eqNullSafe(F.col("_fresh"))
    verdict = F.when(F.col("_fresh").isNull(), "unresolved").when(same, "same").otherwise("changed")
    return rows.select(*stored.columns, F.col("_fresh").alias("new_config_id"), now["body"].alias("new_body"), verdict.alias("verdict"))


def replay_report(replayed: DataFrame) -> DataFrame:
    """Counts of the replay's verdicts, with the body before and after."""
    return replayed.groupBy("verdict", "body", "new_body").agg(F.count("*").alias("n"))

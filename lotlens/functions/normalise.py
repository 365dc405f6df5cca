"""Text to comparison keys, canonical members, numbers and content-addressed identities.

Column expressions only: every one of them stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

# Letters folded to their plain forms before lower-casing
FOLD_FROM = "əƏıIİğĞşŞçÇöÖüÜâÂéÉń"
FOLD_TO = "eeiiiggssccoouuaaeen"

# How much each known field narrows a configuration
SPECIFICITY = {
    "make": 0.14,
    "model": 0.14,
    "model_year": 0.13,
    "generation": 0.10,
    "trim": 0.09,
    "displacement_l": 0.09,
    "fuel": 0.08,
    "transmission": 0.08,
    "drivetrain": 0.08,
    "body": 0.04,
    "engine_code": 0.03,
}
CATEGORIES = ("fuel", "transmission", "drivetrain", "body", "import_status")
POWERTRAIN = ("fuel", "displacement_l", "engine_code", "transmission", "drivetrain")


def fold(text: Column) -> Column:
    """Lower case without diacritics and punctuation, single spaces; null gives the empty text."""
    plain = F.lower(F.translate(F.coalesce(text, F.lit("")), FOLD_FROM, FOLD_TO))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def cyrillic_key(text: Column) -> Column:
    """Lower case with punctuation as single spaces, letters of any script kept."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def lookup_key(text: Column) -> Column:
    """The key of the synonym tables: Cyrillic texts keep their script, others are folded."""
    return F.when(text.rlike(r"[\x{0400}-\x{04FF}]"), cyrillic_key(text)).otherwise(fold(text))


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def make(raw: Column) -> Column:
    """Canonical make; null for blank and unknown ones."""
    names = V.spellings({m: (m.lower().replace("-", " "), *keys) for m, keys in V.MAKES.items()})
    return F.when(~blank(raw), F.try_element_at(V.as_map(names), lookup_key(raw)))


def model(make_name: Column, raw: Column) -> Column:
    """Canonical model of a make: noise words out, aliases resolved, otherwise upper case."""
    bare = F.regexp_replace(fold(raw), rf"\b({V.MODEL_NOISE})\b", " ")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    aliases = {f"{m}|{key}": name for m, table in V.MODEL_ALIASES.items() for key, name in V.spellings(table).items()}
    known = F.try_element_at(V.as_map(aliases), F.concat_ws("|", make_name, bare))
    return F.when(~blank(raw) & (bare != ""), F.coalesce(F.when(make_name.isNotNull(), known), F.upper(bare)))


def category(field: str, raw: Column) -> Column:
    """Member of a category table (fuel, transmission, drivetrain, seller_type), else UNKNOWN."""
    return F.coalesce(V.look_up(V.TABLES[field], lookup_key(raw)), F.lit("UNKNOWN"))


def body(raw: Column) -> Column:
    """Body style: the whole key if known, else the first style in precedence that a word names."""
    key = lookup_key(raw)
    order = list(V.BODIES)
    ranks = V.spellings({name: keys for name, keys in V.BODIES.items()})
    rank_of = V.as_map({k: order.index(name) for k, name in ranks.items()}, "int")
    best = F.array_min(F.filter(F.transform(F.split(key, " "), lambda w: F.try_element_at(rank_of, w)), lambda r: r.isNotNull()))
    worded = F.try_element_at(F.array(*(F.lit(o) for o in order)), best + 1)
    return F.coalesce(V.look_up(V.BODIES, key), worded, F.lit("UNKNOWN"))


def city(raw: Column) -> Column:
    return F.when(~blank(raw), V.look_up(V.CITIES, lookup_key(raw)))


def market_region(city_name: Column) -> Column:
    """Trading area: the capital's metro, UNKNOWN for null or empty, else the city itself."""
    metro = F.try_element_at(V.as_map(V.METRO), city_name)
    return F.when(blank(city_name), "UNKNOWN").otherwise(F.coalesce(metro, city_name))


def displacement(raw: Column) -> Column:
    """Litres to one decimal from litres or cubic centimetres; null for implausible values."""
    litres = F.when(raw > 100, raw / 1000).otherwise(raw)
    return F.when((raw > 0) & (litres <= 20), F.round(litres.cast("double"), 1))


def token(value: Column, kind: str = "string") -> Column:
    """One part of a key: upper case, '?' for unknown, one decimal for doubles."""
    if kind == "double":
        return F.coalesce(F.format_string("%.1f", value), F.lit("?")) if value is not None else F.lit("?")
    text = F.upper(F.trim(value.cast("string")))
    return F.when(text.isNull() | (text == ""), "?").otherwise(text)


def identity(fields: dict[str, Column]) -> dict[str, Column]:
    """The key ladder of a configuration given as columns by field name; absent fields are unknown.

    model_key, generation_key, powertrain_key, canonical and config_id, each containing the one
    before it.
    """

    def part(name: str) -> Column:
        if name not in fields:
            return F.lit("UNKNOWN" if name in CATEGORIES else "?")
        value = fields[name]
        if name == "displacement_l":
            return F.when(value.isNull(), "?").otherwise(F.format_string("%.1f", value))
        if name in CATEGORIES:
            return F.coalesce(token(value), F.lit("UNKNOWN"))
        return token(value)

    model_key = F.concat_ws("|", part("make"), part("model"))
    generation_key = F.concat_ws("|", model_key, part("generation"))
    powertrain_key = F.concat_ws("|", generation_key, *(part(f) for f in POWERTRAIN))
    canonical = F.concat_ws("|", powertrain_key, *(part(f) for f in ("model_year", "trim", "body", "import_status")))
    return {
        "model_key": model_key,
        "generation_key": generation_key,
        "powertrain_key": powertrain_key,
        "canonical": canonical,
        "config_id": F.concat(F.lit("cfg_"), F.substring(F.sha2(canonical, 256), 1, 20)),
    }


def is_known(name: str, value: Column) -> Column:
    if name in CATEGORIES:
        return value.isNotNull() & (value != "UNKNOWN")
    return ~blank(value.cast("string"))


def specificity(fields: dict[str, Column]) -> Column:
    """Share of the identifying detail that is known, to four decimals."""
    known = [F.when(is_known(n, fields[n]), w).otherwise(0.0) for n, w in SPECIFICITY.items() if n in fields]
    return F.round(sum(known, F.lit(0.0)), 4)


def unknown_fields(fields: dict[str, Column]) -> Column:
    """Names of the unknown fields, in the order of their weight."""
    names = [F.when(is_known(n, fields[n]), None).otherwise(n) if n in fields else F.lit(n) for n in SPECIFICITY]
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def describe(fields: dict[str, Column]) -> Column:
    """A short label of the known parts."""
    some = lambda n: fields.get(n, F.lit(None).cast("string"))
    litres = F.when(some("displacement_l").isNotNull(), F.format_string("%.1fL", some("displacement_l").cast("double")))
    fuel = F.when(some("fuel") != "UNKNOWN", F.initcap(some("fuel")))
    drive = F.when(some("drivetrain") != "UNKNOWN", some("drivetrain"))
    label = F.concat_ws(" ", some("model_year").cast("string"), some("make"), some("model"), some("trim"), litres, fuel, drive)
    return F.when(label == "", "Unidentified vehicle").otherwise(label)


# Currency marks in the order in which they are tried
CURRENCY_MARKS = {"azn": "AZN", "₼": "AZN", "usd": "USD", "$": "USD", "eur": "EUR", "€": "EUR"}


def money(text: Column) -> tuple[Column, Column]:
    """(amount, currency): digits of the first number, separators dropped; AZN without a mark."""
    digits = F.regexp_replace(F.regexp_extract(text, r"\d[\d\s,.]*", 0), r"\D", "")
    amount = F.expr("cast(null as decimal(20, 0))")
    amount = F.when(digits != "", digits.try_cast("decimal(20,0)")).otherwise(amount)
    lower = F.lower(text)
    currency = F.lit("AZN")
    for mark, code in reversed(CURRENCY_MARKS.items()):
        currency = F.when(F.instr(lower, mark) > 0, code).otherwise(currency)
    return amount, F.when(amount.isNotNull(), currency)


def whole_number(text: Column) -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(digits != "", digits.try_cast("long"))


def decimal_number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"\d+(?:[.,]\d+)?", 0), ",", ".").try_cast("double")


def id_from_url(url: Column) -> Column:
    found = F.regexp_extract(url, r"/(\d{4,})", 1)
    return F.when(found != "", found)


def fingerprint(parts: list[Column], description: Column) -> Column:
    """32 hex digits over the parts and a digest of the description; nulls count as 'None'."""
    inner = F.substring(F.sha2(F.coalesce(description, F.lit("")), 256), 1, 16)
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts), inner)
    return F.substring(F.sha2(text, 256), 1, 32)


def numbers_in(text: Column) -> Column:
    """Numbers of a text as doubles (thousands separators dropped), whole ones up to 100 left out."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0))
    values = F.transform(found, lambda n: F.regexp_replace(n, ",", "").try_cast("double"))
    return F.filter(values, lambda v: v.isNotNull() & ~((v == F.floor(v)) & (v <= 100)))


def normalise_email(text: Column) -> Column:
    return F.lower(F.trim(text))


def thousands(value: Column, currency: Column | str = "AZN") -> Column:
    unit = F.lit(currency) if isinstance(currency, str) else currency
    return F.concat_ws(" ", F.format_number(F.round(value), 0), unit)

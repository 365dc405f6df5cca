"""What a seller's description states about condition, as tri-state columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalise import fold

_EDGE = r"[\p{L}\p{N}_]"


def _word(stem: str) -> str:
    return rf"(?<!{_EDGE}){stem}(?!{_EDGE})"


# Phrases of the market in two languages; a denial is read before a statement
DAMAGE_DENIED = [r"vurulmay[ıi]b", r"vuru[ğg]u\s*yoxdur", r"qəzas[ıi]z", r"qezasiz", r"не\s*бит", r"без\s*авари"]
DAMAGE_STATED = [
    r"vurulub", r"vuru[ğg]u\s*var", r"qəza", r"qeza", r"битый", _word("бит"), r"авари", r"после\s*дтп", _word("дтп"),
]
REPAINT_DENIED = [
    r"rənglənməy[ıi]b", r"renglenmeyib", r"boyanmay[ıi]b", r"не\s*краш", r"без\s*покраск", r"родная\s*краска",
]
REPAINT_STATED = [r"rənglən", r"renglen", r"boyan[ıi]b", r"краш", r"покраш", r"перекраш"]
NEEDS_REPAIR = [r"təmir\s*tələb", r"temir\s*teleb", r"требует\s*ремонт", r"на\s*запчаст", r"ehtiyat\s*hissə"]
STRONG_CLAIMS = [
    r"ideal\s*vəziyyət", r"ideal\s*veziyyet", r"əla\s*vəziyyət", r"идеальн", r"отличн[оеый]+\s*состоян",
    r"как\s*новый", r"yeni\s*kimi",
]


def _told(description: Column) -> Column:
    """The folded and the lower-case form as one text, parted by a character that no pattern can match."""
    return F.concat(fold(description), F.lit("\u0001"), F.lower(F.coalesce(description, F.lit(""))))


def _read(told: Column) -> Column:
    says = lambda patterns: told.rlike("|".join(patterns))
    claims = F.array(*(F.when(told.rlike(p), i) for i, p in enumerate(STRONG_CLAIMS)))
    return F.struct(
        F.when(says(DAMAGE_DENIED), False).when(says(DAMAGE_STATED), True).alias("damage"),
        F.when(says(REPAINT_DENIED), False).when(says(REPAINT_STATED), True).alias("repaint"),
        F.when(says(NEEDS_REPAIR), True).alias("needs_repair"),
        F.size(F.filter(claims, lambda c: c.isNotNull())).alias("claims"),
    )


def read(description: Column) -> Column:
    """struct(damage, repaint, needs_repair, claims): true, false, or null where nothing is said."""
    return _read(_told(description))


def with_readings(rows: DataFrame, description: Column, name: str = "read") -> DataFrame:
    """``rows`` with ``read`` of the description, which is folded and lower-cased once for all patterns."""
    return rows.withColumn("_told", _told(description)).withColumn(name, _read(F.col("_told"))).drop("_told")


def disclosure(condition: Column, description: Column, kind: str) -> Column:
    """The structured field's statement, else the prose's."""
    return F.coalesce(read(condition)[kind], read(description)[kind])

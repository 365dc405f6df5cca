"""Landed web pages to rows: links, and one value per extraction rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rules for the pages at hand: a name, and the pattern whose first group holds the value
RULES = {
    "title": r"(?is)<title[^>]*>(.*?)</title>",
    "heading": r"(?is)<h1[^>]*>(.*?)</h1>",
    "article": r"(?is)<article[^>]*>(.*?)</article>",
    "first_paragraph": r"(?is)<p[^>]*>(.*?)</p>",
    "lang": r"(?is)<html[^>]*\blang=\"([^\"]*)\"",
    "canonical": r"(?is)<link[^>]*rel=\"canonical\"[^>]*href=\"([^\"]*)\"",
}
LINK = r"(?i)href=\"([^\"#]+)\""


def untagged(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def extract(html: Column, pattern: str, group: int = 1) -> Column:
    """The matched group without tags and with single spaces; null where nothing is left."""
    found = untagged(F.regexp_extract(html, pattern, group))
    text = F.trim(F.regexp_replace(found, r"\s+", " "))
    return F.nullif(text, F.lit(""))  # the text is worked out once


def parse(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, url and a column per rule, in one pass over the pages."""
    return pages.select("page_id", "url", *(extract(F.col("html"), p).alias(name) for name, p in rules.items()))


def links(pages: DataFrame, pattern: str = LINK) -> DataFrame:
    """Distinct links of all pages with the first page that holds each and the number of pages."""
    found = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("link"))
    return found.groupBy("link").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))


Reader = Callable[[SparkSession, str], DataFrame]
ADAPTERS: dict[str, Reader] = {"pages": lambda spark, path: spark.read.parquet(f"{path}/pages.parquet")}


def read(slug: str, spark: SparkSession, path: str) -> DataFrame:
    """The registered source's raw pages; an unknown slug is an error that names the known ones."""
    if slug not in ADAPTERS:
        raise KeyError(f"no source {slug!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[slug](spark, path)

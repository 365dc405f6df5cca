"""Text keys, identities, listing state, pages, provenance and evidence over the test tables, with DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import disclosures, normalise, vocabulary
from ..operators import evidence, provenance, snapshots, state
from ..session import table
from ..sources import market, pages
from .statistics import _AT, STRETCHED_SQL, _twin, rounded, stretched

_FOLD = f"trim(regexp_replace(lower(translate(coalesce({{0}}, ''), '{normalise.FOLD_FROM}', '{normalise.FOLD_TO}')), '[^a-z0-9]+', ' ', 'g'))"


def fold_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = normalise.fold(F.col("text"))
    return docs.select("doc_id", F.length(key).cast("long").alias("key_length"), F.sha2(key, 256).alias("key_sha256"))


FOLD_SQL = f"""
SELECT doc_id, length({_FOLD.format("text")}) AS key_length, sha256({_FOLD.format("text")}) AS key_sha256 FROM documents
"""

_FIELDS = ("make", "model", "model_year", "generation", "trim", "displacement_l", "fuel", "transmission", "drivetrain", "body")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir)
    fields = {f: F.col(f) for f in _FIELDS}
    ladder = normalise.identity(fields)
    return rows.select(
        "listing_id", *(ladder[k].alias(k) for k in ("generation_key", "powertrain_key", "config_id")),
        normalise.specificity(fields).alias("specificity"),
        F.array_join(normalise.unknown_fields(fields), ",").alias("unknown"),
        normalise.describe(fields).alias("label"),
    )


_GEN = "upper(make) || '|' || upper(model) || '|' || generation"
_POW = f"{_GEN} || '|' || fuel || '|' || coalesce(format('{{:.1f}}', displacement_l), '?') || '|?|' || transmission || '|' || drivetrain"
IDENTITIES_SQL = f"""
SELECT listing_id, {_GEN} AS generation_key, {_POW} AS powertrain_key,
  'cfg_' || substr(sha256({_POW} || '|' || model_year || '|' || trim || '|' || body || '|UNKNOWN'), 1, 20) AS config_id,
  round(14e-2 + 14e-2 + 13e-2 + 10e-2 + 9e-2 + CASE WHEN displacement_l IS NULL THEN 0 ELSE 9e-2 END
    + CASE WHEN fuel = 'UNKNOWN' THEN 0 ELSE 8e-2 END + 8e-2 + CASE WHEN drivetrain = 'UNKNOWN' THEN 0 ELSE 8e-2 END
    + CASE WHEN body = 'UNKNOWN' THEN 0 ELSE 4e-2 END, 4) AS specificity,
  concat_ws(',', CASE WHEN displacement_l IS NULL THEN 'displacement_l' END, CASE WHEN fuel = 'UNKNOWN' THEN 'fuel' END,
    CASE WHEN drivetrain = 'UNKNOWN' THEN 'drivetrain' END, CASE WHEN body = 'UNKNOWN' THEN 'body' END, 'engine_code') AS unknown,
  concat_ws(' ', CAST(model_year AS VARCHAR), make, model, trim, format('{{:.1f}}L', displacement_l),
    CASE WHEN fuel <> 'UNKNOWN' THEN upper(fuel[1]) || lower(fuel[2:]) END, CASE WHEN drivetrain <> 'UNKNOWN' THEN drivetrain END) AS label
FROM listings
"""
IDENTITIES_SQL = IDENTITIES_SQL.replace("format('{:.1f}L', displacement_l)", "CASE WHEN displacement_l IS NOT NULL THEN format('{:.1f}L', displacement_l) END")


def unmapped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names and types that the body table does not know, with their parts."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("word"))
    known = vocabulary.look_up(vocabulary.BODIES, normalise.lookup_key(F.col("word"))).isNotNull()
    return words.filter((F.trim("word") != "") & ~known).groupBy("word").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


_KNOWN_BODIES = ", ".join(f"'{k}'" for k in vocabulary.spellings(vocabulary.BODIES))
UNMAPPED_SQL = f"""
SELECT word, count(*) AS n, min(p_partkey) AS first_part
FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS word FROM part)
WHERE trim(word) <> '' AND {_FOLD.format("word")} NOT IN ({_KNOWN_BODIES}) GROUP BY 1
"""


def document_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document states, with one of the market's phrases appended by id."""
    phrases = F.array(*(F.lit(p) for p in _PHRASES))
    phrase = F.element_at(phrases, (F.col("doc_id") % len(_PHRASES) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "text", phrase).alias("stated"))
    read = disclosures.with_readings(docs, F.col("stated"), "r")
    return read.select("doc_id", "r.*", snapshots.no_deposit(F.col("stated")).alias("no_deposit"))


_PHRASES = ("Vurulmayıb, rənglənib", "не битый, идеальное состояние", "после ДТП, требует ремонта", "ilkin ödəniş 5000", "boyanmayıb, vuruğu var", "")


def _pattern_sql(patterns: list[str], folded: str, lower: str) -> str:
    """Whether one of the patterns, none of which may touch a further letter where it is a whole word, is in either form."""
    edge = r"[^\p{L}\p{N}_]"
    whole = re.compile(r"\(\?<!\[.*?\]\)(.*)\(\?!\[.*?\]\)")  # how the library writes a whole word
    found = "|".join(whole.sub(lambda m: f"(?:^|{edge}){m[1]}(?:{edge}|$)", p) for p in patterns)
    return f"(regexp_matches({folded}, '{found}') OR regexp_matches({lower}, '{found}'))"


def readings_sql(folded: str, lower: str) -> dict[str, str]:
    """DuckDB: what ``disclosures.read`` finds in a text given in its folded and its lower-case form."""
    holds = lambda patterns: _pattern_sql(patterns, folded, lower)
    d = disclosures
    return {
        "damage": f"CASE WHEN {holds(d.DAMAGE_DENIED)} THEN false WHEN {holds(d.DAMAGE_STATED)} THEN true END",
        "repaint": f"CASE WHEN {holds(d.REPAINT_DENIED)} THEN false WHEN {holds(d.REPAINT_STATED)} THEN true END",
        "needs_repair": f"CASE WHEN {holds(d.NEEDS_REPAIR)} THEN true END",
        "claims": "CAST(" + " + ".join(f"{holds([p])}::INT" for p in d.STRONG_CLAIMS) + " AS INTEGER)",
    }


DISCLOSURES_SQL = f"""
WITH t AS (SELECT doc_id, text || ' ' || {market._pick_sql("doc_id", _PHRASES)} AS stated FROM documents),
f AS (SELECT doc_id, {_FOLD.format("stated")} AS folded, lower(stated) AS low FROM t)
SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in readings_sql("folded", "low").items())},
  NOT ({" OR ".join(f"contains(low, '{p}')" for p in snapshots.DEPOSIT_PHRASES)}) AS no_deposit FROM f
"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each document, whole ones up to 100 left out."""
    found = normalise.numbers_in(F.col("text"))
    values = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("value"))
    return values.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("value").alias("largest"))


NUMBERS_SQL = """
SELECT doc_id, count(*) AS n, max(v) AS largest
FROM (SELECT doc_id, TRY_CAST(replace(unnest(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?')), ',', '') AS DOUBLE) AS v FROM documents)
WHERE v IS NOT NULL AND NOT (v = floor(v) AND v <= 100) GROUP BY 1
"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.transcript(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turns", F.sha2("transcript", 256).alias("sha256"))


TRANSCRIPTS_SQL = """
SELECT conv_id, count(*) AS turns, sha256(string_agg(line, chr(10) || chr(10) ORDER BY turn, line)) AS sha256
FROM (SELECT conv_id, turn, role || ': ' || coalesce(text, '') AS line FROM conversations) GROUP BY 1
"""


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues per model over the stretched listings."""
    rows = stretched(market.listings(spark, sf_dir))
    found = rows.select("model_key", F.explode(state.issues(F.year("last_seen"))).alias("issue"))
    return found.groupBy("model_key", "issue").agg(F.count("*").alias("n"))


QUALITY_SQL = "\nSELECT model_key, issue, count(*) AS n FROM issues WHERE issue IS NOT NULL GROUP BY 1, 2\n"


def _print(*cols: str) -> Column:
    return normalise.fingerprint([F.col(c) for c in cols], F.lit(""))


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings first seen before 2000 as the state; those seen since as a batch with moved prices and mileages."""
    rows = market.listings(spark, sf_dir).withColumn("cents", F.round(F.col("price") * 100).cast("long"))
    old = rows.filter(F.col("first_seen") < F.lit("2000-01-01").cast("timestamp_ntz"))
    cols = ["listing_id", "cents", "mileage_km"]
    before = old.select("listing_id", F.col("cents").alias("price"), "mileage_km", F.lit(None).cast("string").alias("description"), _print(*cols).alias("fingerprint"), "status", "first_seen", "last_seen")
    new = rows.filter(F.col("last_seen") >= F.lit("2000-01-01").cast("timestamp_ntz")).withColumns(
        {"cents": F.when(F.col("listing_id") % 3 == 0, F.col("cents") - 1000).otherwise(F.col("cents")),
         "mileage_km": F.when(F.col("listing_id") % 5 == 0, F.col("mileage_km") + 700).otherwise(F.col("mileage_km"))}
    )
    batch = new.select("listing_id", F.when(F.col("listing_id") % 7 != 0, F.col("cents")).alias("price"), "mileage_km", F.lit("").alias("description"), _print(*cols).alias("fingerprint"), F.lit(None).cast("timestamp_ntz").alias("posted_at"))
    return state.upsert(before, batch, market.as_of())


def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).select("listing_id", "price", "mileage_km", "status", "first_seen", "last_seen", "outcome", F.array_join("changes", ",").alias("changes"))


UPSERT_SQL = f"""
, o AS (SELECT listing_id, CAST(round(price * 100) AS BIGINT) AS price, mileage_km, status, first_seen, last_seen FROM listings WHERE first_seen < TIMESTAMP '2000-01-01'),
b AS (SELECT listing_id, CASE WHEN listing_id % 7 <> 0 THEN CAST(round(price * 100) AS BIGINT) - CASE WHEN listing_id % 3 = 0 THEN 1000 ELSE 0 END END AS np,
    mileage_km + CASE WHEN listing_id % 5 = 0 THEN 700 ELSE 0 END AS nm FROM listings WHERE last_seen >= TIMESTAMP '2000-01-01'),
j AS (SELECT coalesce(o.listing_id, b.listing_id) AS listing_id, o.* EXCLUDE (listing_id), np, nm, o.listing_id IS NOT NULL AS was,
    b.listing_id IS NOT NULL AS came, b.listing_id IS NOT NULL AND np IS NOT NULL AS seen FROM o FULL JOIN b ON o.listing_id = b.listing_id),
upserted AS (
SELECT listing_id, CASE WHEN seen THEN np ELSE price END AS price, CASE WHEN seen THEN nm ELSE mileage_km END AS mileage_km,
  CASE WHEN seen THEN 'ACTIVE' ELSE status END AS status, CASE WHEN was THEN first_seen ELSE {_AT} END AS first_seen,
  CASE WHEN seen THEN {_AT} ELSE last_seen END AS last_seen,
  CASE WHEN came AND np IS NULL THEN 'skipped' WHEN NOT seen THEN 'unseen' WHEN NOT was THEN 'created'
    WHEN price <> np THEN 'price_changed' WHEN mileage_km <> nm THEN 'updated' ELSE 'unchanged' END AS outcome,
  concat_ws(',', CASE WHEN seen AND NOT was THEN 'FIRST_SEEN' END, CASE WHEN seen AND was AND price <> np THEN 'PRICE_CHANGE' END,
    CASE WHEN seen AND was AND mileage_km <> nm THEN 'MILEAGE_CHANGE' END) AS changes
FROM j WHERE was OR seen)
SELECT * FROM upserted
"""


def state_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals by source region, after a run that saw the listings of the last 30 days."""
    rows = market.listings(spark, sf_dir)
    seen = rows.filter(F.col("last_seen") >= snapshots.days_before(market.as_of(), 30)).select("listing_id")
    marked = state.mark_removed(rows, seen, market.as_of())
    return marked.groupBy("region", "status").agg(F.count("*").alias("n"), F.count_if("removed").alias("removed"))


REMOVED_SQL = f"""
, m AS (SELECT region, status, status = 'ACTIVE' AND last_seen < {_AT} - INTERVAL 3 DAY AND last_seen < {_AT} - INTERVAL 30 DAY AS removed FROM listings)
SELECT region, CASE WHEN removed THEN 'REMOVED' ELSE status END AS status, count(*) AS n, count(*) FILTER (removed) AS removed FROM m GROUP BY 1, 2
"""


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.parse(pages.read("pages", spark, sf_dir))
    return rows.select("page_id", "title", "heading", F.sha2("article", 256).alias("article_sha256"), "first_paragraph", "lang")


def _rule_sql(name: str) -> str:
    text = rf"trim(regexp_replace(regexp_replace(regexp_extract(html, '{pages.RULES[name]}', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"nullif({text}, '')"


PAGE_FIELDS_SQL = f"""
SELECT page_id, {_rule_sql("title")} AS title, {_rule_sql("heading")} AS heading, sha256({_rule_sql("article")}) AS article_sha256,
  {_rule_sql("first_paragraph")} AS first_paragraph, {_rule_sql("lang")} AS lang FROM pages
"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(pages.read("pages", spark, sf_dir))


LINKS_SQL = f"""
SELECT link, min(page_id) AS first_page, count(*) AS pages
FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '{pages.LINK}', 1))) AS link FROM pages) GROUP BY 1
"""


def extraction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.parse(pages.read("pages", spark, sf_dir))
    return rounded(state.extraction_rates(rows, list(pages.RULES)))


RATES_SQL = " UNION ALL ".join(
    f"SELECT count(*) AS pages, '{n}' AS field, round(avg(CASE WHEN {_rule_sql(n)} IS NULL THEN 0e0 ELSE 1e0 END), 4) AS rate, "
    f"avg(CASE WHEN {_rule_sql(n)} IS NULL THEN 0e0 ELSE 1e0 END) < 6e-1 AS degraded FROM pages"
    for n in pages.RULES
)


def removal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The STATUS_CHANGE rows of the same run's removals."""
    rows = market.listings(spark, sf_dir)
    seen = rows.filter(F.col("last_seen") >= snapshots.days_before(market.as_of(), 30)).select("listing_id")
    return state.removal_log(state.mark_removed(rows, seen, market.as_of()), market.as_of())


REMOVAL_LOG_SQL = f"""
SELECT listing_id, price, mileage_km, 'REMOVED' AS status, 'STATUS_CHANGE' AS change_kind, {_AT} AS observed_at FROM listings
WHERE status = 'ACTIVE' AND last_seen < {_AT} - INTERVAL 30 DAY
"""


def _since() -> Column:
    return F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.price_changes(market.observations(spark, sf_dir), market.listings(spark, sf_dir), _since())
    return rows.select("listing_id", "observed_at", "price", "listed_price", "model_key", "status", "seq")


CHANGES_SQL = """
SELECT o.listing_id, observed_at, o.price, l.price AS listed_price, model_key, status, seq
FROM observations o JOIN listings l ON o.listing_id = l.listing_id
WHERE observed_at > TIMESTAMP '2024-01-30' AND change_kind = 'PRICE_CHANGE' ORDER BY observed_at DESC, seq DESC LIMIT 500
"""


def price_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.price_drops(market.observations(spark, sf_dir), market.listings(spark, sf_dir), _since())
    return rows.select("listing_id", "observed_at", "price", "price_before", "listed_price", "model_key", "status", "seq")


DROPS_SQL = """
, steps AS (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY observed_at, seq) AS price_before FROM observations)
SELECT o.listing_id, observed_at, o.price, price_before, l.price AS listed_price, model_key, status, seq
FROM steps o JOIN listings l ON o.listing_id = l.listing_id
WHERE observed_at > TIMESTAMP '2024-01-30' AND change_kind = 'PRICE_CHANGE' AND o.price < price_before
ORDER BY observed_at DESC, seq DESC LIMIT 500
"""


def orphan_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that neither an active nor an expressly undamaged listing refers to.

    Lines of large quantities stand for those listings: of all lines together no part is left out, so none would be an orphan.
    """
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    one, two = lines.filter("l_linestatus = 'O' and l_quantity > 40"), lines.filter("l_returnflag = 'A' and l_quantity > 45")
    return state.orphans(table(spark, sf_dir, "part"), one, two, key="p_partkey").select("p_partkey", "p_brand", "p_type")


ORPHANS_SQL = """
SELECT p_partkey, p_brand, p_type FROM part p WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linestatus = 'O' AND l_quantity > 40
  UNION ALL SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity > 45)
"""
_STATUSES, _SOURCES = tuple(provenance.STATUS_WEIGHT), ("MARKET_LISTING", "USER", "DEALER", "VIN_DECODER")


def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as competing values: an entity per user, a field per kind, status and source by id."""
    events = table(spark, sf_dir, "events")
    values = events.select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("field"), F.floor("value").cast("long").cast("string").alias("value"),
        market._pick("event_id", _STATUSES).alias("status"), market._pick("user_id", _SOURCES).alias("source_type"),
        (F.lit(1.0) - (F.col("event_id") % 5) / 10).alias("confidence"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )
    resolved = provenance.resolve(values, F.lit(market.OBSERVED_TO).cast("timestamp_ntz"))
    return resolved.withColumn("weight", F.round("weight", 6))


VALUES_SQL = f"""
WITH v AS (
  SELECT user_id AS entity, event_type AS field, CAST(floor(value) AS BIGINT) AS value, {market._pick_sql("event_id", _STATUSES)} AS status,
    ts AS at_ts, event_id AS seq, round(([{", ".join(f"{w}e0" for w in provenance.STATUS_WEIGHT.values())}])[event_id % 5 + 1]
      * (1e0 - CAST(event_id % 5 AS DOUBLE) / 10) * CASE WHEN {market._pick_sql("user_id", _SOURCES)} IN ('MARKET_LISTING', 'DEALER')
        THEN pow(5e-1, greatest(epoch_us(TIMESTAMP '{market.OBSERVED_TO}') - epoch_us(ts), 0) / 86400000000e0 / 180e0) ELSE 1e0 END, 9) AS weight
  FROM events
), r AS (SELECT *, row_number() OVER w AS rn, first_value(value) OVER w AS won, first_value(weight) OVER w AS best FROM v
  WINDOW w AS (PARTITION BY entity, field ORDER BY weight DESC, at_ts DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT entity, field, CAST(any_value(won) AS VARCHAR) AS value, round(any_value(best), 6) AS weight, max(status) FILTER (rn = 1) AS status, count(*) AS candidates,
  count(*) FILTER (rn > 1 AND abs(value - won) / greatest(abs(value), abs(won), 1e0) >= 1e-2 AND weight / best >= 5e-1) AS conflicts
FROM r GROUP BY 1, 2
"""


def exchange_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in P by the latest daily rate up to their date: O is quoted in P, F the other way round."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("currency"), F.col("o_orderdate").alias("at"))
    direct = F.col("l_linestatus") == "O"
    rates = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_linestatus", F.col("l_shipdate").alias("rate_at"))
        .agg((F.sum("l_quantity") / (F.count("*") * 10)).alias("rate"))
        .select(F.when(direct, "O").otherwise("P").alias("base"), F.when(direct, "P").otherwise("F").alias("quote"), "rate", "rate_at")
    )
    return provenance.convert(orders, rates, "P").select("o_orderkey", "currency", "amount", "converted")


FX_SQL = """
WITH rates AS (SELECT l_linestatus AS c, l_shipdate AS t, CASE WHEN l_linestatus = 'O' THEN sum(l_quantity) / (count(*) * 10)
    ELSE 1e0 / (sum(l_quantity) / (count(*) * 10)) END AS rate FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, o_orderstatus AS currency, o_totalprice AS amount,
  CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE o_totalprice * rate END AS converted
FROM orders ASOF LEFT JOIN rates ON o_orderstatus = c AND o_orderdate >= t
"""


def cited_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals that no part price times ten comes within two per cent of."""
    claims = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    known = table(spark, sf_dir, "part").select((F.col("p_retailprice") * 10).alias("value")).distinct()
    return evidence.unknown_numbers(claims, known)


CITED_SQL = """
SELECT o_orderkey, o_totalprice AS value FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM part p WHERE abs(o_totalprice - p_retailprice * 10) <= greatest(abs(o_totalprice), abs(p_retailprice * 10), 1e0) * 2e-2)
"""

QUERIES = {
    "fold_keys": fold_keys,
    "identities": identities,
    "unmapped_words": unmapped_words,
    "document_disclosures": document_disclosures,
    "numbers": numbers,
    "transcripts": transcripts,
    "quality_issues": quality_issues,
    "state_upsert": state_upsert,
    "state_removed": state_removed,
    "page_fields": page_fields,
    "page_links": page_links,
    "extraction_rates": extraction_rates,
    "removal_log": removal_log,
    "price_changes": price_changes,
    "price_drops": price_drops,
    "orphan_configurations": orphan_configurations,
    "attribute_values": attribute_values,
    "exchange_rates": exchange_rates,
    "cited_numbers": cited_numbers,
}

ORACLE_SQL = {
    "fold_keys": FOLD_SQL,
    "identities": _twin(IDENTITIES_SQL, market.LISTINGS_SQL),
    "unmapped_words": UNMAPPED_SQL,
    "document_disclosures": DISCLOSURES_SQL,
    "numbers": NUMBERS_SQL,
    "transcripts": TRANSCRIPTS_SQL,
    "quality_issues": _twin(QUALITY_SQL, market.LISTINGS_SQL, STRETCHED_SQL),
    "state_upsert": _twin(UPSERT_SQL, market.LISTINGS_SQL),
    "state_removed": _twin(REMOVED_SQL, market.LISTINGS_SQL),
    "page_fields": PAGE_FIELDS_SQL,
    "page_links": LINKS_SQL,
    "extraction_rates": RATES_SQL,
    "removal_log": _twin(REMOVAL_LOG_SQL, market.LISTINGS_SQL),
    "price_changes": _twin(CHANGES_SQL, market.LISTINGS_SQL, market.OBSERVATIONS_SQL),
    "price_drops": _twin(DROPS_SQL, market.LISTINGS_SQL, market.OBSERVATIONS_SQL),
    "orphan_configurations": ORPHANS_SQL,
    "attribute_values": VALUES_SQL,
    "exchange_rates": FX_SQL,
    "cited_numbers": CITED_SQL,
}

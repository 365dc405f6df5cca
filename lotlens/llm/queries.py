"""The registered queries of this subpackage, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, conversations, exact_dedup, jaccard, langid, line_dedup, media_gif, packing, secrets, sharding, suffix_dedup, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_documents(spark, sf_dir)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group_similar(_documents(spark, sf_dir))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), 40)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.find_repeats(_documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media_gif.read_media(media_gif.store_text(_documents(spark, sf_dir)))
    bins = F.array_join(F.col("histogram").cast("array<string>"), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("gif").cast("long").alias("media_bytes"),
        F.sha2("gif", 256).alias("media_sha256"),
        F.format_string("frames=%d;ms=%d;rgb=%s", "frames", "duration_ms", bins).alias("feature"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = exact_dedup.group_copies(_documents(spark, sf_dir))
    return copies.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align.align(
        _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return found.drop("pairs")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda sum_, span: sum_ + span["end"] - span["start"])
    return suffix_dedup.find_repeats(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_langid": op5_langid,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_bpe": op8_bpe,
    "op9_media_gif": op9_media_gif,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversations": op11_conversations,
    "op12_alignment": op12_alignment,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), g AS (
  SELECT *, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
         row_number() OVER (PARTITION BY text, doc_id) AS copy_no
  FROM t
)
SELECT doc_id, keep_id, group_size, (doc_id = keep_id AND copy_no = 1) AS kept, sha256(text) AS text_sha256
FROM g
""",
    "op13_suffix_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)
), f AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s
), hit AS (
  SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s AND w.doc_id > f.least
), b AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS byte FROM (SELECT doc_id, h, unnest(range(n)) AS p FROM d)
), c AS (
  SELECT b.doc_id, b.p, b.byte, coalesce(max(hit.i) OVER (PARTITION BY b.doc_id ORDER BY b.p), -50) >= b.p - 49 AS gone
  FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id AND b.p = hit.i
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM c
), r AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
         sha256(unhex(coalesce(string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone), ''))) AS kept_sha256
  FROM e GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans,
       coalesce(r.kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
""",
}

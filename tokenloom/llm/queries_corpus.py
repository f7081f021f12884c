"""Queries over the whole corpus: mixing, sharding, duplicates, languages, decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import stored, table
from tokenloom.llm.decontaminate import find_items
from tokenloom.llm.language import declared_in, host_of, identify, learn_text_model, visible
from tokenloom.llm.mixture import mix_plan, word_count
from tokenloom.llm.near_duplicates import near_duplicates
from tokenloom.llm.registry import ORACLES, query
from tokenloom.llm.shards import shuffle_into_shards
from tokenloom.llm.spot_signatures import compare_with_next, fingerprint


@query
def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when the sources are mixed to their targets."""
    docs = table(spark, sf_dir, "documents")
    sizes = stored(docs.select("doc_id", "source", word_count("text").alias("size")), "sizes")
    return mix_plan(sizes).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


ORACLES["op7_mixture"] = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS most,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sizes GROUP BY source),
steps AS (
  SELECT most / weight AS ratio, 1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM sources) AS wanted,
         coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM sources),
level AS (SELECT (wanted - capped) / rest AS level FROM steps WHERE (wanted - capped) / rest <= ratio ORDER BY ratio LIMIT 1),
targets AS (SELECT source, source_size, least((SELECT level FROM level) * weight, most) AS target FROM sources),
rates AS (
  SELECT d.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
         ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + (draw < rate - floor(rate))::INTEGER))::BIGINT AS taken
FROM rates
"""


SHARDS = 16


@query
def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 16 shards whose row counts are at most one apart."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shuffle_into_shards(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 85 % common five-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)
    return found.withColumnRenamed("doc", "doc_id")


@query
def op10_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they and the next one are."""
    compared = compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds up to 10 % edits."""
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "distance", "budget", F.col("end").alias("found_end"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page from its text, markup, address suffix and host."""
    model = learn_text_model(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    html = F.col("html")
    found = identify(table(spark, sf_dir, "pages"), model, "page_id", visible(html), declared_in(html), host_of(F.col("url")))
    return found.select(
        F.col("doc").alias("page_id"), "host", "declared", "suffix", "text_lang", "lang", F.round("confidence", 6).alias("confidence")
    )

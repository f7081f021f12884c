"""Queries that number, pack or join whole tables: packing, manifest, hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import table
from tokenloom.llm.hard_negatives import mine
from tokenloom.llm.merkle import folded, manifest, proof_digest
from tokenloom.llm.packing import pack
from tokenloom.llm.registry import ORACLES, query


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in windows of at most 2,048, one row per piece."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step"
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle proof of every document, and whether it holds for a possibly tampered one."""
    made = manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", FIELDS, "text")
    tampered = F.coalesce(F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    given = F.when(tampered, F.col("tampered_leaf")).otherwise(F.col("leaf"))
    checked = made.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("way")).alias("proof_sha256"), folded(given, F.col("way")).alias("folded_root")
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD_SQL = " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in FIELDS)
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of the trees over ``leaves(tree, pos, nodes, digest)``, eight children a node."""
    return f"""{name}(tree, level, pos, nodes, digest) AS (
      SELECT tree, 0, pos, nodes, digest FROM {leaves}
      UNION ALL
      SELECT tree, level + 1, pos // 8, (nodes + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
      FROM {name} WHERE nodes > 1 GROUP BY tree, level, pos // 8, nodes)"""


def _way_sql(name: str, tree: str) -> str:
    """The siblings of every node of a tree, as texts to its left and right."""
    return f"""{name} AS (
      SELECT a.tree, a.level, a.pos,
             coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
             coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
      FROM {tree} a JOIN {tree} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8
      WHERE a.nodes > 1 GROUP BY a.tree, a.level, a.pos)"""


ORACLES["op12_manifest"] = f"""
WITH RECURSIVE
digests AS (
  SELECT doc_id, lang, sha256({_FIELD_SQL}) AS leaf,
         sha256({_FIELD_SQL.replace("text::VARCHAR", f"translate(text, '{_CAPITALS}', '{_SMALL}')")}) AS changed,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS register
  FROM documents),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS nodes
  FROM digests),
low_leaves AS (SELECT tree, pos, nodes, leaf AS digest FROM leaves),
{_tree_sql("low", "low_leaves")},
subroots AS (SELECT tree, digest FROM low WHERE nodes = 1),
high_leaves AS (SELECT -1::BIGINT AS tree, tree AS pos, (SELECT count(*) FROM subroots) AS nodes, digest FROM subroots),
{_tree_sql("high", "high_leaves")},
{_way_sql("low_way", "low")},
{_way_sql("high_way", "high")},
steps AS (
  SELECT x.tree, x.pos AS leaf_pos, w.level AS step, w.l, w.r
  FROM low_leaves x JOIN low_way w ON w.tree = x.tree AND w.pos = x.pos // (8 ** w.level)::BIGINT
  UNION ALL
  SELECT x.tree, x.pos, 100 + w.level, w.l, w.r
  FROM low_leaves x JOIN high_way w ON w.pos = x.tree // (8 ** w.level)::BIGINT),
ways AS (SELECT tree, leaf_pos, list({{'l': l, 'r': r}} ORDER BY step) AS way FROM steps GROUP BY ALL),
found AS (
  SELECT x.doc_id, x.leaf, s.digest AS subroot, (SELECT digest FROM high WHERE nodes = 1) AS root, coalesce(w.way, []) AS way,
         CASE WHEN xor(x.register, 4294967295) % 3 = 0 THEN x.changed ELSE x.leaf END AS given
  FROM leaves x JOIN subroots s ON s.tree = x.tree LEFT JOIN ways w ON w.tree = x.tree AND w.leaf_pos = x.pos),
folded AS (
  SELECT *, sha256(coalesce(array_to_string(list_transform(way, lambda s: s.l || s.r), ''), '')) AS proof_sha256,
         list_reduce(list_prepend({{'l': given, 'r': ''}}, way), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root
  FROM found)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and its positives, the hardest rows of other labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


ORACLES["op13_hard_negatives"] = """
WITH usable AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable a JOIN usable b ON a.id <> b.id WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s
  ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""

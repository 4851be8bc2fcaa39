"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import copies, language, near, neighbours, packing, split, tokens
from tidemark.sources.tables import table

QUERIES = {
    "p2_found": lambda spark, d: near.similar_pairs(table(spark, d, "chunks")),
    "p2_classes": lambda spark, d: near.similarity_classes(table(spark, d, "chunks")),
    "p3_pieces": lambda spark, d: split.oversized_pieces(table(spark, d, "chunks"), table(spark, d, "chunk_limits")),
    "p3_found": lambda spark, d: split.oversized_pieces(table(spark, d, "chunks"), table(spark, d, "chunk_limits")).select("chunk_id").distinct(),
    "p3_checked": lambda spark, d: split.checked(table(spark, d, "chunks"), table(spark, d, "chunk_limits")),
    "p4_found": lambda spark, d: neighbours.similar_pairs(table(spark, d, "vectors")),
    "p4_neighbours": lambda spark, d: neighbours.nearest(table(spark, d, "vectors"), recall=0.95, asked=F.col("chunk_id") % 20 == 0),
    "p5_found": lambda spark, d: copies.duplicate_copies(table(spark, d, "files"), table(spark, d, "chunks")),
    "p5_collapsed": lambda spark, d: copies.collapsed(table(spark, d, "files"), table(spark, d, "chunks")),
    "p6_ids": lambda spark, d: tokens.token_ids(table(spark, d, "documents")),
    "p6_round_trip": lambda spark, d: tokens.round_trip(table(spark, d, "documents")),
    "p7_packed": lambda spark, d: packing.packed(table(spark, d, "documents")),
    "p7_fill": lambda spark, d: packing.fill(packing.packed(table(spark, d, "documents"))),
    "p7_checked": lambda spark, d: packing.checked(table(spark, d, "documents")),
    "p7_conflicts": lambda spark, d: packing.conflicts(table(spark, d, "documents")),
    "p8_found": lambda spark, d: language.mislabelled(table(spark, d, "documents"), table(spark, d, "lang_samples")),
    "p8_segments": lambda spark, d: language.segments(table(spark, d, "documents"), table(spark, d, "lang_samples")),
}

_CANONICAL = r"""
WITH f AS (
  SELECT id, arg_max(struct_pack(d := coalesce(is_deleted, false), h := file_hash), updated_at) AS s FROM files WHERE id IS NOT NULL GROUP BY id
), c AS (
  SELECT id, arg_max(struct_pack(d := coalesce(is_deleted, false), t := content), updated_at) AS s FROM chunks WHERE id IS NOT NULL GROUP BY id
), live AS (
  SELECT 'file' AS kind, id, s.h AS raw, regexp_replace(lower(s.h), '[^\p{L}\p{N}]+', '', 'g') AS plain, false AS shaped FROM f WHERE NOT s.d AND s.h IS NOT NULL
  UNION ALL
  SELECT 'chunk', id, s.t, regexp_replace(lower(s.t), '[^\p{L}\p{N}]+', '', 'g'),
         regexp_matches(s.t, '^[\s\p{Z};|]*[^:=\r\n;|]*[:=][^:=\r\n;|]*([\r\n;|][\s\p{Z};|]*[^:=\r\n;|]*[:=][^:=\r\n;|]*)+[\s\p{Z};|]*$')
  FROM c WHERE NOT s.d AND s.t IS NOT NULL
), parts AS (
  SELECT kind, id, plain, shaped, CASE WHEN shaped THEN list_transform(
    list_filter(regexp_split_to_array(raw, '[\r\n;|]+'), lambda x: contains(x, ':') OR contains(x, '=')),
    lambda x: [regexp_replace(lower(regexp_extract(x, '^([^:=]*)', 1)), '[^\p{L}\p{N}]+', '', 'g'), regexp_replace(lower(regexp_extract(x, '[:=]([^:=]*)$', 1)), '[^\p{L}\p{N}]+', '', 'g')]) END AS fields
  FROM live WHERE plain <> ''
), keyed AS (
  SELECT kind, id, CASE WHEN shaped AND len(list_filter(fields, lambda x: x[1] = '' OR x[2] = '')) = 0
    THEN array_to_string(list_sort(list_transform(fields, lambda x: x[1] || '=' || x[2])), chr(10)) ELSE plain END AS k FROM parts
)"""

#: CTEs sc: live chunks of at least 40 tokens with their sets of shingles; pr: pairs of them that share one, and the similarity.
_SHINGLES = r""", tk AS (
  SELECT id, regexp_extract_all(regexp_replace(lower(raw), '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS t FROM live WHERE kind = 'chunk'
), sc AS (
  SELECT id, list_sort(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS s FROM tk WHERE len(t) >= 40
), u AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sc),
pr AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id)"""

_OVERSIZED = r"""
WITH c AS (
  SELECT id, arg_max(struct_pack(d := coalesce(is_deleted, false), t := content, y := content_type), coalesce(updated_at, -9e18)) AS s FROM chunks WHERE id IS NOT NULL GROUP BY id
), l AS (SELECT content_type, max(max_tokens) AS max_tokens FROM chunk_limits GROUP BY content_type),
z AS (
  SELECT id, s.y AS content_type, length(regexp_replace(regexp_replace(s.t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[^\x{4E00}-\x{9FFF}]+', '', 'g')) AS h,
         length(regexp_replace(s.t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS n
  FROM c WHERE NOT s.d AND s.t IS NOT NULL
), o AS (SELECT id AS chunk_id FROM z JOIN l USING (content_type) WHERE (8 * h + 3 * (n - h)) // 12 > max_tokens)"""

SQL = {
    "p2_found": _CANONICAL
    + _SHINGLES
    + """, ky AS (SELECT live.id, coalesce(k, '') AS k FROM live LEFT JOIN keyed ON keyed.kind = 'chunk' AND keyed.id = live.id WHERE live.kind = 'chunk')
SELECT a AS chunk_id_a, b AS chunk_id_b FROM pr JOIN ky x ON x.id = a JOIN ky y ON y.id = b WHERE similarity >= 0.5 AND x.k <> y.k""",
    "p3_found": _OVERSIZED + " SELECT chunk_id FROM o",
    "p3_checked": _OVERSIZED + " SELECT chunk_id, true AS within, true AS covers, true AS shares FROM o",
    "p6_round_trip": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, true AS same FROM documents",
    "p7_checked": "SELECT doc_id, true AS whole, true AS within FROM documents",
    "p4_found": """
WITH v AS (
  SELECT chunk_id, any_value(embedding)::DOUBLE[] AS x FROM vectors
  WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0 GROUP BY chunk_id
), n AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.x, b.x) AS s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id WHERE list_cosine_similarity(a.x, b.x) >= 0.899999),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM n)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE rank <= 5""",
    "p5_found": _CANONICAL
    + """, g AS (SELECT kind, id, min(id) OVER (PARTITION BY kind, k) AS keep_id FROM keyed)
SELECT kind, keep_id, id AS copy_id FROM g WHERE id <> keep_id""",
    "p5_collapsed": _CANONICAL + " SELECT kind, min(id) AS keep_id, count(*) AS n_copies FROM keyed GROUP BY kind, k",
}

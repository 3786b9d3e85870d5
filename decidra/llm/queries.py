"""The queries over this subpackage's operators, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm._common import new_path, ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.rans import token_stream

    return token_stream(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.mixing import mix_schedule

    return mix_schedule(table(spark, sf_dir, "documents"), max_repeat=2.0)


def op4_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.line_dedup import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "pages"), ratio=0.2, min_pages=3)


def op5_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.sharding import sharded_rows

    return sharded_rows(table(spark, sf_dir, "documents"), new_path(spark, "shards"), target_bytes=32 << 20, least_bytes=1 << 20)


def op6_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))[0]


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.conversation_repair import damaged, repair_facts

    return repair_facts(damaged(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.llm.hard_negatives import hard_negatives

    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=changed)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_rans_tokens": op2_rans_tokens,
    "op3_temperature_mixing": op3_temperature_mixing,
    "op4_site_line_dedup": op4_site_line_dedup,
    "op5_tiered_shards": op5_tiered_shards,
    "op6_additive_quantisation": op6_additive_quantisation,
    "op7_ngram_join": op7_ngram_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_quality": op11_quality,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

#: With a repetition limit alone, alpha has a closed form: the smallest source is repeated as often as the limit allows.
OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) + 1 AS n_tokens,
         ('0x' || md5('17|' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT % 1024 AS block
  FROM documents
), b AS (SELECT source, block, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL
), t AS (SELECT source, sum(tokens)::BIGINT AS total FROM b GROUP BY ALL
), a AS (SELECT round(greatest(0, CASE WHEN min(total) = max(total) THEN 0 ELSE 1 - ln(2.0::DOUBLE) / (ln(max(total)::DOUBLE) - ln(min(total)::DOUBLE)) END), 12) AS alpha, max(total) AS most, sum(total) AS everything FROM t
), w AS (SELECT source, total, exp(alpha * ln(total::DOUBLE / everything)) AS raw, floor(round(exp((alpha - 1) * (ln(total::DOUBLE) - ln(most::DOUBLE))), 9) * total)::BIGINT AS budget FROM t, a
), p AS (SELECT source, total, round(raw / sum(raw) OVER (), 9) AS weight, budget // total AS passes, budget % total AS rest FROM w
), e AS (
  SELECT b.*, p.total, p.weight, p.passes, p.rest, unnest(range(0, passes + 1)) AS copy FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source
), o AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source, copy ORDER BY ('0x' || md5('17|' || copy || '|' || coalesce(source, 'null') || '|' || block)[1:8])::BIGINT, block ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM e
)
SELECT d.doc_id, d.source, o.copy::INT AS copy, o.block::INT AS block, (o.copy * total + upto - tokens)::BIGINT AS block_start, d.n_tokens, o.weight
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source AND d.block = o.block WHERE copy < passes OR upto <= rest
"""

OP4_SQL = r"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '')) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'),
      '(?i)</?(?:html|head|body|title|meta|link|p|br|div|ul|ol|li|h[1-6]|table|tr|td|th|nav|header|footer|main|article|section|aside|pre|blockquote|form|hr)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines, row_number() OVER () AS r
  FROM pages
), t AS (SELECT host, count(*) AS pages FROM p GROUP BY ALL
), l AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM p
), b AS (SELECT l.host, line FROM l JOIN t USING (host) GROUP BY l.host, line, pages HAVING count(*) >= 3 AND count(*) > 0.2::DOUBLE * pages
), x AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p
), k AS (
  SELECT r, count(b.line) AS n_dropped, string_agg(x.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL) AS kept
  FROM x LEFT JOIN b ON x.host = b.host AND x.line = b.line GROUP BY r
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(kept, '') AS clean_text FROM p LEFT JOIN k USING (r)
"""

#: States: 0 nothing written, 1 system, 2 user, 3 assistant. best: the least cost, and of those the least string, up to a row and into a state.
OP12_SQL = r"""
WITH RECURSIVE c AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295::BIGINT, list_reduce(range(8 * len(k))::BIGINT[], lambda c, i: xor(c >> 1, 3988292384 * (xor(c, ascii(substr(k, (i // 8 + 1)::INT, 1)) >> (i % 8)) & 1)), 4294967295::BIGINT)) % 20 AS h
  FROM c
), r AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE h <> 0
), n AS (
  SELECT *, row_number() OVER w AS pos, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER w AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), f AS (SELECT *, blank OR again AS must, (cut AND NOT blank AND NOT again)::INT AS short FROM n
), moves(state, initial, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), inserts(state, made, price, nxt) AS (VALUES (0, '', 0, 0), (0, 'I', 2, 2), (0, 'II', 4, 3), (1, '', 0, 1), (1, 'I', 2, 2), (1, 'II', 4, 3), (2, '', 0, 2), (2, 'I', 2, 3), (3, '', 0, 3), (3, 'I', 2, 2)
), forced(state, nxt) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)
), edges AS (
  SELECT i.state, i.made || 'D' AS made, i.price + 3 AS price, NULL::VARCHAR AS initial, 'D' AS kind, i.nxt FROM inserts i
  UNION ALL SELECT i.state, i.made || 'R', i.price + 2, NULL::VARCHAR, 'R', forced.nxt FROM inserts i JOIN forced ON forced.state = i.nxt
  UNION ALL SELECT i.state, i.made || 'K', i.price, m.initial, 'K', m.nxt FROM inserts i JOIN moves m ON m.state = i.nxt
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS found FROM conversations
  UNION ALL
  SELECT b.conv_id, f.pos, e.nxt, min({'cost': b.found.cost + e.price + CASE WHEN e.kind = 'D' THEN 0 ELSE f.short END, 'audit': b.found.audit || e.made})
  FROM best b JOIN f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = b.pos + 1 JOIN edges e ON e.state = b.state AND (e.kind = 'D' OR NOT f.must) AND (e.initial IS NULL OR e.initial = f.initial)
  GROUP BY b.conv_id, f.pos, e.nxt
), total AS (SELECT conv_id, count(*) AS n FROM f GROUP BY conv_id
), chosen AS (
  SELECT b.conv_id, min({'cost': b.found.cost + i.price, 'audit': b.found.audit || i.made}) AS found
  FROM best b LEFT JOIN total t ON t.conv_id IS NOT DISTINCT FROM b.conv_id JOIN inserts i ON i.state = b.state AND i.nxt IN (0, 3) WHERE b.pos = coalesce(t.n, 0) GROUP BY b.conv_id
), steps AS (
  SELECT conv_id, found.audit AS audit, unnest(range(1, len(found.audit) + 1)) AS step FROM chosen
), placed AS (
  SELECT conv_id, step, audit[step] AS edit, len(replace(audit[:step], 'I', '')) AS pos, len(replace(audit[:step], 'D', '')) AS place FROM steps
), lines AS (
  SELECT p.*, f.role, f.text, max(p.edit = 'K' AND f.initial = 's') OVER (PARTITION BY p.conv_id) AS has_system FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos AND p.edit <> 'I'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - coalesce(has_system, FALSE)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY step) AS whole
  FROM lines WHERE edit <> 'D' GROUP BY conv_id
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate,
    sum(short)::BIGINT AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  found.cost::BIGINT AS cost, found.audit AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM chosen c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_sum(list_transform(list_zip(a.e, r.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

SQL: dict[str, str] = {"op3_temperature_mixing": OP3_SQL, "op4_site_line_dedup": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op12_conversation_repair": OP12_SQL, "op13_hard_negatives": OP13_SQL}

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import alignment, decontamination, exact_topk, hilbert_ann, html_extract, mixing, ngram_join, packing, secrets, toxicity, url_rules, warc, whitening
from tickweave.llm.common import read, scratch_path

TOKENIZER, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; empty for null html."""
    return html_extract.extract_main_text(read(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked inclusion probability and draw of every document."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by one ledger run; no spans for null or empty texts."""
    findings = secrets.scan_with_ledger(read(spark, sf_dir, "documents"), "doc_id", "text", scratch_path(spark, "secret-ledger"), first=True)
    kinds = [r.kind for r in secrets.BASE_RULES]
    text = secrets.listed(kinds)
    return findings.select(
        F.col("path").cast("long").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans")
    )


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer products of every vector whose id is divisible by 100."""
    return exact_topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return hilbert_ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of every document's token ids; an empty one has its end id."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "bucket_sequence")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page from its rebuilt WARC record; null html is an empty payload."""
    return warc.archive_and_read(read(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fixed rule and verdict of every page; null urls have empty parts."""
    return url_rules.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by models that never see the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every usable vector."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of both tokenizers in every document."""
    return alignment.align(read(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and benchmark items hit in every document; a null text has no words."""
    return decontamination.report(decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_source_mixing, op3_secret_scan, op4_exact_topk, op5_hilbert_ann, op6_packing, op7_warc, op8_ngram_join, op9_url_filter, op10_toxicity, op11_whitening, op12_token_alignment, op13_decontamination)
}

_OP3 = r"""
WITH RECURSIVE kinds(kind, ord, pattern, least) AS (VALUES
  ('assign', 0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
  ('access', 1, '(AKIA[A-Z0-9]{12,})', 16),
  ('hex', 2, '([0-9a-f]{32,})', 32)),
parts AS (
  SELECT doc_id, kind, ord, least, regexp_extract_all(t, pattern, 0) AS whole, regexp_extract_all(t, pattern, 1) AS value, regexp_split_to_array(t, pattern) AS gaps
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), kinds),
spans AS (
  SELECT doc_id, kind, ord, list_filter(list_transform(range(1, len(whole) + 1), lambda i: {
      'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda w: length(w))), 0),
      'ord': ord, 'stop': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(whole[1:i], lambda w: length(w))),
      'kind': kind, 'keep': length(value[i]) >= least}), lambda s: s.keep) AS found
  FROM parts),
all_ AS (
  SELECT doc_id, coalesce(sum(len(found)) FILTER (kind = 'assign'), 0)::BIGINT AS n_assign, coalesce(sum(len(found)) FILTER (kind = 'access'), 0)::BIGINT AS n_access,
    coalesce(sum(len(found)) FILTER (kind = 'hex'), 0)::BIGINT AS n_hex,
    coalesce(array_to_string(list_transform(list_sort(flatten(list(found))), lambda s: s.kind || ':' || s.start::BIGINT || ':' || s.stop::BIGINT), ','), '') AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, n_assign, n_access, n_hex, sha256(spans) AS base_sha256, spans FROM all_
"""

_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

_OP7 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < newest THEN newest END AS refers_to
FROM p
"""

ORACLE_SQL = {"op2_source_mixing": mixing.oracle_sql(), "op3_secret_scan": _OP3, "op4_exact_topk": _OP4, "op7_warc": _OP7, "op13_decontamination": decontamination.oracle_sql()}

"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.llm import bpe_counts, chunkprint, langid, maxent, nbest, packing, quality, simhash, sorted_lists, trie, vamana, warc, whitening


def _vocabulary(name: str) -> str:
    """Place of a public vocabulary file, as this session's environment has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_groups(_documents(spark, sf_dir), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.segmentations(_documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"), n=2)


def op3_chunkprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkprint.edit_resistance(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.token_counts(_documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"), limit=4096)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.derive(warc.response_records(pages, date="2024-01-01T00:00:00Z"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir), folds=4, held_out=2)


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_folds(_documents(spark, sf_dir), folds=5, held_out=1)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=4, held_out=2, threshold=0.7)


def op10_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vamana.nearest(rows, F.pmod(F.col("vec_id"), F.lit(20)) == 0, answers=20)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), every=5, most=9)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4)


def op13_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return sorted_lists.top_k(rows, F.pmod(F.col("vec_id"), F.lit(50)) == 0, answers=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_nbest": op2_nbest,
    "op3_chunkprint": op3_chunkprint,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_langid": op6_langid,
    "op7_token_counts": op7_token_counts,
    "op8_maxent": op8_maxent,
    "op9_quality": op9_quality,
    "op10_vamana": op10_vamana,
    "op11_trie": op11_trie,
    "op12_whitening": op12_whitening,
    "op13_sorted_lists": op13_sorted_lists,
}

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""

#: The other operators can't be expressed in SQL; tests hold them against brute force, round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op11_trie": f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), counted AS (SELECT conv_id, count(*) AS n, {_CRC32} % 9 AS h, conv_id - conv_id % 5 AS base FROM turns GROUP BY conv_id
), plan AS (SELECT c.conv_id, c.h, c.base, least(c.h, coalesce(b.n, 0)) AS k FROM counted c LEFT JOIN counted b ON b.conv_id = c.base
), rebuilt AS (
  SELECT p.conv_id, t.pos, t.r, t.x FROM plan p JOIN turns t ON t.conv_id = p.base AND t.pos < p.k
  UNION ALL SELECT p.conv_id, p.k + t.pos - p.h, t.r, t.x FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.pos >= p.h
), keys AS (
  SELECT conv_id, pos + 1 AS d, octet_length(encode(x)) AS bytes, sha256(string_agg(sha256(octet_length(encode(r)) || ':' || r || x), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM counted
), path AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS parent, lead(key) OVER (PARTITION BY conv_id ORDER BY d) AS child FROM keys
), node AS (
  SELECT d, key, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, count(DISTINCT child) AS children, (count(*) - 1) * min(bytes) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE child IS NULL), '')) AS ends FROM path GROUP BY d, key
), below AS (
  SELECT p.d, p.key, sum(m.saved) AS saved, count(*) FILTER (WHERE m.children = 0) AS leaves FROM node m JOIN path p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.d, p.key
)
SELECT o.conv_id, o.d::BIGINT AS depth, up.conv_id AS parent_conv_id, o.n AS n_convs, o.children AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, o.ends AS ends_sha256
FROM node o JOIN below b ON b.d = o.d AND b.key = o.key LEFT JOIN node up ON up.d = o.d - 1 AND up.key = o.parent""",
    "op13_sorted_lists": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM whole q JOIN whole v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
}

"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oriel.llm import embeddings, idfile, mixing, sharding, simhash, suffixes, tiling, tokens, toxicity, warc
from oriel.session import table, workers_see_package


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: $ORIEL_TOKENIZERS if set, else where the installed package says."""
    folder = os.environ.get("ORIEL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.roundtrip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_rows(docs)


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.roundtrip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_benchmark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_jump_shards": op2_jump_shards,
    "op3_warc_normaliser": op3_warc_normaliser,
    "op4_benchmark_tiles": op4_benchmark_tiles,
    "op5_near_vectors": op5_near_vectors,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_mix_sources": op8_mix_sources,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_simhash_groups": op10_simhash_groups,
}

#: Two numbers of 64 bits: the multiplier of jump consistent hashing, and 2 ** 64.
_JUMP = "(k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT"
_CRC_TABLE = "(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UINTEGER, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384::UINTEGER, a >> 1) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"

ORACLE: dict[str, str] = {
    "op2_jump_shards": f"""
WITH RECURSIVE walk(doc_id, k, here, nxt) AS (
  SELECT doc_id, doc_id::UHUGEINT, 0::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, {_JUMP}, nxt, CAST(floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((({_JUMP}) // 8589934592::UHUGEINT) + 1)::DOUBLE)) AS BIGINT) FROM walk WHERE nxt <= 24
),
places AS (SELECT doc_id, CAST(max(CASE WHEN here < 24 THEN here END) AS INT) AS shard, CAST(max(here) AS INT) AS grown_shard FROM (SELECT * FROM walk WHERE nxt > 0) GROUP BY doc_id),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UINTEGER)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::UINTEGER)::BIGINT AS c FROM documents, {_CRC_TABLE}
)
SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, c AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM documents JOIN places USING (doc_id) JOIN crc USING (doc_id)""",
    "op3_warc_normaliser": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages),
l AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY s) END AS leader FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN leader <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN leader <> page_id THEN leader END AS refers_to FROM l""",
    "op5_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: (x * x)::DOUBLE)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT *, component_id = vec_id AS kept FROM (SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM embeddings)""",
    "op8_mix_sources": """
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM s),
f AS (SELECT *, source_size::DOUBLE * 3 / weight AS full_level FROM w),
r AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lv FROM f
  WINDOW o AS (ORDER BY full_level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (SELECT arg_min(lv, full_level) FROM r WHERE lv <= full_level) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(level * weight, source_size * 3.0::DOUBLE) END AS target FROM g),
u AS (SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN target >= source_size * 3 THEN 3 ELSE target / source_size END AS rate FROM t)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_see_package(spark)
            return f(spark, sf_dir)

        return call

    return {name: ready(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

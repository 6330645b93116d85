"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import alignment, bpe, exact, fingerprints, mixing, quality, sharding, simhash, suffixes, tokencounts, toxicity, urls, whitening
from kinweave.llm.common import table

SHARDS = 8


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary of the queries; their folder is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.kd_shards(table(spark, folder, "documents"), shards=SHARDS)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, folder, "documents"), vocabulary_path(), decoded=True))


def op7_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = suffixes.repeated_spans(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op8_exact(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages"))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, folder, "documents"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    return alignment.align(table(spark, folder, "documents"), *paths).documents()


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.by_component(whitening.whiten(table(spark, folder, "embeddings")))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, folder, "documents"), vocabulary_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_kd_shards": op1_kd_shards,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_suffixes": op7_suffixes,
    "op8_exact": op8_exact,
    "op9_urls": op9_urls,
    "op10_fingerprints": op10_fingerprints,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_token_counts": op13_token_counts,
}

OP8_SQL = r"""
WITH plain AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
    FROM documents
), ranked AS (
    SELECT doc_id, sha256(body) AS text_sha256,
           first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY body) AS group_size
    FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""

OP9_SQL = r"""
WITH cut_up AS (
    SELECT page_id,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut_up
), rules(verdict, rule, rule_host, rule_path) AS (
    VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
           ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
           ('block', 'com/de/', 'com', '/de/')
), fits AS (
    SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""

ORACLES = {"op8_exact": OP8_SQL, "op9_urls": OP9_SQL}

"""Mention views over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLE_PATTERN = "<title>([^<]*)</title>"
LANGUAGE_PATTERN = "^https?://[^/]+/([a-z]+)/"
DOMAIN_PATTERN = "^https?://[^/]*?([a-z]+[.][a-z]+)/"
HOST_PATTERN = "^https?://([^/]+)/"
PATH_NUMBER_PATTERN = "/([0-9]+)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _found(text: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as mentions: brand is the country, type the region, size the post code."""
    return table(spark, folder, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("mention_id"),
        F.col("p_partkey").alias("arrival_seq"),
        F.col("p_name").alias("legal_name"),
        F.col("p_brand").alias("country_code"),
        F.col("p_type").alias("nuts_code"),
        F.col("p_size").cast("string").alias("post_code"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as mentions: whole title as name, language as country, domain, path number and host as address."""
    return table(spark, folder, "pages").select(
        F.concat(F.lit("g"), "page_id").alias("mention_id"),
        F.col("page_id").alias("arrival_seq"),
        _found("html", TITLE_PATTERN).alias("legal_name"),
        _found("url", LANGUAGE_PATTERN).alias("country_code"),
        _found("url", DOMAIN_PATTERN).alias("nuts_code"),
        _found("url", PATH_NUMBER_PATTERN).alias("post_code"),
        _found("url", HOST_PATTERN).alias("post_name"),
    )


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as mentions: nation as country, region as region."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("s"), "s_suppkey").alias("mention_id"),
            F.col("s_suppkey").alias("arrival_seq"),
            F.col("s_name").alias("legal_name"),
            F.col("n_name").alias("country_code"),
            F.col("r_name").alias("nuts_code"),
        )
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as mentions named by their whole text."""
    return table(spark, folder, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("mention_id"),
        F.col("doc_id").alias("arrival_seq"),
        F.col("text").alias("legal_name"),
        F.col("lang").alias("country_code"),
        F.col("source").alias("nuts_code"),
    )


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as submissions: one id per conversation, so ids repeat with other content."""
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("v"), "conv_id").alias("mention_id"),
        "conv_id",
        "turn",
        F.col("text").alias("legal_name"),
        F.col("role").alias("country_code"),
    )

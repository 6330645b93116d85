"""Mention files: CSV with text columns only, and JSON data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str], fields: list[str]) -> DataFrame:
    """Mentions of a CSV file with a header row, in whose `columns` order; empty means missing, nothing is inferred.

    Rows of a distributed file have no order: pass an `arrival_seq` column in the file to fix one.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    kept = [F.nullif(F.col(f), F.lit("")).alias(f) for f in fields if f in columns]
    order = [F.col("arrival_seq").cast("long").alias("arrival_seq")] if "arrival_seq" in columns else []
    return rows.select("mention_id", *order, *kept)


def read_json(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Mentions of a JSON data set `{..., "mentions": [...]}`; position in the list is the arrival order."""
    document = spark.read.option("multiLine", True).json(path)
    if "mentions" not in document.columns:
        raise ValueError("The JSON data set has no 'mentions' key")
    rows = document.select(F.posexplode("mentions").alias("arrival_seq", "m")).select("arrival_seq", "m.*")
    present = [f for f in ("request_id", "source_id", "entity_type", *fields) if f in rows.columns]
    return rows.select(F.col("arrival_seq").cast("long").alias("arrival_seq"), *present)


#: Rows that are numbered at once.
MOST_NUMBERED = 1_000_000


def number_arrivals(batch: DataFrame, after: int, *order: Column | str, most: int = MOST_NUMBERED) -> DataFrame:
    """Number the rows of one bounded batch in the given order, continuing after the last stored arrival.

    The batch is sorted in one task, so more than `most` rows are an error: a whole corpus needs its own arrival column.
    """
    if batch.limit(most + 1).count() > most:
        raise ValueError(f"More than {most} rows to number")
    return batch.withColumn("arrival_seq", F.lit(after) + F.row_number().over(Window.orderBy(*order)))

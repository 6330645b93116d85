"""Conflict, repeat and novelty checks of incoming records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, IDEMPOTENT, REPEAT, CONFLICT = "new", "idempotent", "repeat", "conflict"


def digest(fields: list[str]) -> Column:
    """Digest of the attributes; NULL equals NULL and differs from an empty string."""
    return F.md5(F.to_json(F.struct(*fields)))


def conflicts(incoming: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """Incoming records whose id is stored with other attributes."""
    known = stored.select("mention_id", digest(fields).alias("stored_digest"))
    return incoming.join(known, "mention_id").where(digest(fields) != F.col("stored_digest")).drop("stored_digest")


def already_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming records whose id is stored."""
    return incoming.join(stored.select("mention_id"), "mention_id", "left_semi")


def unseen(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming records whose id is not stored."""
    return incoming.join(stored.select("mention_id"), "mention_id", "left_anti")


def in_batch(incoming: DataFrame, fields: list[str]) -> DataFrame:
    """Add `guard`: the first record of an id is new, later ones repeat it or conflict with it.

    The first record per id is found by a combinable aggregate, so an id that is sent very often costs one row
    per input partition.
    """
    judged = incoming.withColumn("_digest", digest(fields))
    first = judged.groupBy("mention_id").agg(
        F.min("arrival_seq").alias("_first_seq"), F.min_by("_digest", "arrival_seq").alias("_first_digest")
    )
    return (
        judged.join(first, "mention_id")
        .withColumn(
            "guard",
            F.when(F.col("arrival_seq") == F.col("_first_seq"), NEW)
            .when(F.col("_digest") == F.col("_first_digest"), REPEAT)
            .otherwise(CONFLICT),
        )
        .drop("_digest", "_first_seq", "_first_digest")
    )


def guard(incoming: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """Add `guard` against stored records first, then within the batch.

    Only stored records with an incoming id are looked at, so a small batch is sent to the stored table and not
    the other way round.
    """
    asked = stored.join(incoming.select("mention_id").distinct(), "mention_id", "left_semi")
    known = asked.select("mention_id", digest(fields).alias("_stored_digest"))
    checked = in_batch(incoming, fields).join(known, "mention_id", "left")
    return checked.withColumn(
        "guard",
        F.when(F.col("_stored_digest").isNull(), F.col("guard"))
        .when(F.col("_stored_digest") == digest(fields), IDEMPOTENT)
        .otherwise(CONFLICT),
    ).drop("_stored_digest")

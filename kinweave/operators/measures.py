"""Latency and batch summaries of a request log."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of the sort key that a counting round settles: at most 4,096 counters a rank, six rounds for any doubles.
ROUND_BITS = (12, 12, 12, 12, 12, 4)
_SIGN = -(1 << 63)


def sort_key(value: Column) -> Column:
    """A double as a long whose bits, without a sign, order like the values: NaN last, the zeros equal."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(_SIGN)))


def value_of_key(key: int) -> float:
    """The double of a sort key, given without a sign."""
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return struct.unpack(">d", bits.to_bytes(8, "big"))[0]


def order_statistics(frame: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """Exact values at zero-based ranks of the sorted column, for any doubles; NULLs do not count.

    A radix select over the bits of the values, for all ranks together: a round counts the next bits of the values that
    share the bits settled so far (a combinable aggregate), and each rank goes on with the bits that hold it.  The rounds
    are as many for any data.  The zeros are one value, which comes back as 0.0.
    """
    keys = frame.where(F.col(value).isNotNull()).select(sort_key(F.col(value)).alias("key"))
    found, shift = [(0, rank) for rank in ranks], 64
    for bits in ROUND_BITS if ranks else ():
        before, shift = shift, shift - bits
        settled = F.shiftrightunsigned("key", before) if before < 64 else F.lit(0)
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << bits) - 1))
        asked = sorted({prefix for prefix, _ in found})
        counts = keys.where(settled.isin(asked)).groupBy(settled.alias("settled"), digit.alias("digit")).count()
        rows = sorted(counts.collect())
        for i, (prefix, rank) in enumerate(found):
            left = rank
            for row in (row for row in rows if row["settled"] == prefix):
                if 0 <= left < row["count"]:
                    found[i] = prefix << bits | row["digit"], left
                    break
                left -= row["count"]
            else:
                raise ValueError(f"rank {rank} is outside the {sum(row['count'] for row in rows)} values")
    return [value_of_key(key) for key, _ in found]


def latency_summary(frame: DataFrame, value: str) -> DataFrame:
    """Mean, median, tails, extremes and deviation; the median and the tails are elements, not interpolations."""
    size = frame.where(F.col(value).isNotNull()).count()
    names = {"median_ms": size // 2, "p95_ms": int(0.95 * size), "p99_ms": int(0.99 * size)}
    picked = dict(zip(names, order_statistics(frame, value, list(names.values()))))
    return frame.agg(
        F.count(value).alias("records"),
        F.avg(value).alias("mean_ms"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev_ms"),
    ).withColumns({name: F.lit(number) for name, number in picked.items()})


def growth_profile(frame: DataFrame, seq: str, value: str, window: int, extra: list[Column] | None = None) -> DataFrame:
    """Mean and 95th percentile per window of `window` consecutive records, plus further aggregates."""
    slot = F.floor(F.col(seq) / window)
    order = Window.partitionBy("window").orderBy(value)
    whole = Window.partitionBy("window")
    ranked = frame.withColumn("window", slot).withColumns(
        {"_position": F.row_number().over(order), "_size": F.count("*").over(whole)}
    )
    at_p95 = F.col("_position") == F.greatest(F.floor(F.col("_size") * 0.95), F.lit(1))
    return ranked.groupBy("window").agg(
        F.count("*").alias("records"),
        F.avg(value).alias("mean_ms"),
        F.max(F.when(at_p95, F.col(value))).alias("p95_ms"),
        *(extra or []),
    )


def batch_summary(frame: DataFrame, batch: str, payload: str, stage: str, value: str, stages: list[str]) -> DataFrame:
    """Size, payload bytes, total time and time per stage of each batch."""
    return frame.groupBy(F.col(batch).alias("batch_id")).agg(
        F.count("*").alias("batch_size"),
        F.sum(F.octet_length(payload)).alias("payload_bytes"),
        F.sum(value).alias("total_ms"),
        *[F.coalesce(F.sum(F.when(F.col(stage) == s, F.col(value))), F.lit(0.0)).alias(f"{s}_ms") for s in stages],
    )


def write_report(summary: DataFrame, records: DataFrame, folder: str) -> None:
    """Write a run's summary and its per-record metrics as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    records.write.mode("overwrite").json(f"{folder}/records")

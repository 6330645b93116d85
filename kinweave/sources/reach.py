"""Stored mentions by block: what a new mention may be matched with, at rest, without the mentions it never needs.

Of each profile only its *representatives* matter to later batches: its first `top_n` mentions, and the first mention of each
of its first `top_n` clusters.  Links lead to a profile's earliest mentions, candidate lists hold at most `top_n` entries, and
later arrivals never displace earlier ones, so a representative stays one and the table only grows by those of each batch.
However many mentions a profile gets, it keeps at most twice `top_n` rows.

Rows lie in buckets by the equality keys of the rules, once for each set of keys, so a batch reads the buckets of its own
blocks only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import ResolverConfig
from kinweave.operators import blocking

#: Buckets of a table; a batch asks for at most so many.
BUCKETS = 32


@dataclass(frozen=True)
class ReachLayout:
    """How the settings lay out the table; tables of other settings have other names."""

    config: ResolverConfig
    buckets: int = BUCKETS

    @property
    def key_sets(self) -> list[tuple[str, ...]]:
        """The distinct equality keys of the rules."""
        return sorted({tuple(sorted(rule.keys)) for rule in self.config.rules})

    @property
    def name(self) -> str:
        told = (self.key_sets, blocking.profile_fields(self.config), self.config.entity_fields, self.config.top_n, self.buckets)
        return f"reach-{hashlib.md5(repr(told).encode()).hexdigest()[:12]}"

    def bucket(self, number: int) -> Column:
        """Bucket of a row for a set of keys; all sets share the buckets."""
        return F.pmod(F.xxhash64(F.lit(number), *self.key_sets[number]), F.lit(self.buckets)).cast("int")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows once for each set of keys that they have in full."""
        parts = []
        for number, keys in enumerate(self.key_sets):
            whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
            parts.append(rows.where(whole).withColumn("key_set", F.lit(number)).withColumn("bucket", self.bucket(number)))
        return reduce(DataFrame.unionByName, parts)

    def asked(self, new: DataFrame) -> list[int]:
        """Buckets of the blocks of some mentions: at most `buckets` numbers."""
        rows = self.dealt(new.select(*sorted({k for keys in self.key_sets for k in keys})).distinct())
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())

    def in_reach(self, stored: DataFrame, new: DataFrame) -> DataFrame:
        """Stored rows that share a block with a new mention, each once."""
        found = []
        for number, keys in enumerate(self.key_sets):
            blocks = new.select(*keys).distinct()
            found.append(stored.where(F.col("key_set") == number).join(blocks, list(keys), "left_semi"))
        rows = reduce(DataFrame.unionByName, [f.drop("key_set", "bucket") for f in found])
        return rows if len(found) == 1 else rows.dropDuplicates(["mention_id"])


def representatives(mentions: DataFrame, config: ResolverConfig) -> DataFrame:
    """Of mentions with their cluster_id the ones that later batches may need, with the digest of their profile."""
    keyed = blocking.with_profile_key(blocking.with_normalised(mentions, config), config)
    arrival = Window.partitionBy("profile_key").orderBy("arrival_seq")
    in_cluster = Window.partitionBy("profile_key", "cluster_id").orderBy("arrival_seq")
    firsts = keyed.withColumn("nth", F.row_number().over(arrival)).withColumn("in_cluster", F.row_number().over(in_cluster))
    heads = F.sum((F.col("in_cluster") == 1).cast("int")).over(arrival)
    head = (F.col("in_cluster") == 1) & (F.col("heads") <= config.top_n)
    kept = firsts.withColumn("heads", heads).where((F.col("nth") <= config.top_n) | head)
    return kept.drop("nth", "in_cluster", "heads")


def added(near: DataFrame, new: DataFrame, config: ResolverConfig) -> DataFrame:
    """Representatives among new mentions (with cluster_id), given the stored ones in their blocks."""
    columns = [c for c in new.columns if c != "profile_key"]
    # profiles that get no new mention keep theirs
    touched = blocking.with_profile_key(blocking.with_normalised(new, config), config).select("profile_key").distinct()
    before = near.join(touched, "profile_key", "left_semi").select(*columns, F.lit(False).alias("fresh"))
    both = before.unionByName(new.select(*columns, F.lit(True).alias("fresh")))
    return representatives(both, config).where("fresh").drop("fresh")

"""One-off parameter estimation: u from random pairs, m by expectation maximisation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import Comparison, LevelParameters, Model, ResolverConfig, default_parameters
from kinweave.operators import scoring

MAX_RANDOM_PAIRS = 1_000_000
MAX_ROUNDS = 25
CONVERGED_BELOW = 1e-4
COLD_START, PERSISTED, TRAINED = "cold_start", "persisted", "trained"


def training_sample(mentions: DataFrame, size: int) -> DataFrame:
    """The first `size` mentions by id."""
    return mentions.orderBy("mention_id").limit(size)


def sample_size_for(max_pairs: int) -> int:
    """Largest number of rows whose pairs stay within the limit."""
    rows = int((2 * max_pairs) ** 0.5) + 2
    while rows * (rows - 1) // 2 > max_pairs:
        rows -= 1
    return rows


def _levels(pairs: DataFrame, config: ResolverConfig) -> DataFrame:
    return pairs.select(
        *[
            F.coalesce(
                F.when(F.col(f"l.{c.field}").isNull() | F.col(f"r.{c.field}").isNull(), scoring.NULL_LEVEL),
                scoring.LEVELS[c.kind](F.col(f"l.{c.field}"), F.col(f"r.{c.field}"), c),
            ).alias(scoring.gamma(c.field))
            for c in config.comparisons
        ]
    )


def random_pairs(sample: DataFrame, fields: list[str], max_pairs: int = MAX_RANDOM_PAIRS) -> DataFrame:
    """Pairs of a pseudo-random row sample small enough that all its pairs stay within the limit."""
    drawn = sample.orderBy(F.xxhash64("mention_id"), "mention_id").limit(sample_size_for(max_pairs))
    numbered = drawn.select(
        F.row_number().over(Window.orderBy("mention_id")).alias("number"), F.struct(*fields).alias("row")
    )
    later = numbered.where("number > 1").select(
        F.col("row").alias("r"), F.explode(F.sequence(F.lit(1), F.col("number") - 1)).alias("number")
    )
    return later.join(numbered.withColumnRenamed("row", "l"), "number").select("l", "r")


def blocked_pairs(sample: DataFrame, fields: list[str], block: str) -> DataFrame:
    """Pairs of the training sample that agree on the training block."""
    rows = sample.select("mention_id", F.col(block).alias("block"), F.struct(*fields).alias("row")).where("block is not null")
    l = rows.select("block", F.col("mention_id").alias("l_id"), F.col("row").alias("l"))
    r = rows.select("block", F.col("mention_id").alias("r_id"), F.col("row").alias("r"))
    return l.join(r, "block").where(F.col("l_id") < F.col("r_id")).select("l", "r")


def patterns(pairs: DataFrame, config: ResolverConfig) -> DataFrame:
    """Pairs per combination of levels: at most a few thousand rows for any number of pairs."""
    return _levels(pairs, config).groupBy(*scoring.gamma_columns(config)).agg(F.count("*").alias("pairs"))


def _fields(config: ResolverConfig) -> list[str]:
    return [c.field for c in config.comparisons]


def pattern_table(sample: DataFrame, config: ResolverConfig) -> DataFrame:
    """Level patterns of the training pairs."""
    return patterns(blocked_pairs(sample, _fields(config), config.em_blocking_field), config)


def u_shares(rows: list[dict], comparison: Comparison) -> dict[int, float]:
    """Share of each level among the pairs where both values are present."""
    column = scoring.gamma(comparison.field)
    counts: dict[int, int] = {}
    for row in rows:
        if row[column] != scoring.NULL_LEVEL:
            counts[row[column]] = counts.get(row[column], 0) + row["pairs"]
    total = sum(counts.values())
    return {level: n / total for level, n in counts.items()}


def expectation_maximisation(
    rows: list[dict], comparisons: tuple[Comparison, ...], u: dict[str, dict[int, float]], prior: float
) -> dict[str, dict[int, float]]:
    """m of every observed level, on the bounded pattern table, with u fixed.

    The share of matches among the training pairs is estimated along with m, from the configured prior on; it belongs to
    these pairs only, so it is not part of the result.
    """
    m = {c.field: dict(zip(c.levels, default_parameters(c.levels)[0])) for c in comparisons}
    for _ in range(MAX_ROUNDS):
        expected = {c.field: dict.fromkeys(c.levels, 0.0) for c in comparisons}
        present = {c.field: 0.0 for c in comparisons}
        matches = total = 0.0
        for row in rows:
            match, other = prior, 1.0 - prior
            for c in comparisons:
                level = row[scoring.gamma(c.field)]
                if level != scoring.NULL_LEVEL:
                    match *= m[c.field][level]
                    other *= u[c.field].get(level, 1.0)
            weight = row["pairs"] * match / (match + other) if match + other else 0.0
            matches, total = matches + weight, total + row["pairs"]
            for c in comparisons:
                level = row[scoring.gamma(c.field)]
                if level != scoring.NULL_LEVEL:
                    expected[c.field][level] += weight
                    present[c.field] += weight
        change = 0.0
        for c in comparisons:
            if present[c.field] > 0:
                for level in c.levels:
                    updated = expected[c.field][level] / present[c.field]
                    change = max(change, abs(updated - m[c.field][level]))
                    m[c.field][level] = updated
        if total:
            change, prior = max(change, abs(matches / total - prior)), matches / total
        if change < CONVERGED_BELOW:
            break
    return m


def train(mentions: DataFrame, config: ResolverConfig) -> ResolverConfig:
    """Estimate the parameters on the training sample; a level never observed keeps its hand-set value."""
    sample = training_sample(mentions, config.auto_train_threshold)
    random_rows = [r.asDict() for r in patterns(random_pairs(sample, _fields(config)), config).collect()]
    training_rows = [r.asDict() for r in pattern_table(sample, config).collect()]
    u = {c.field: {p.level: p.u for p in config.model.parameters[c.field]} for c in config.comparisons}
    observed_u = {c.field: u_shares(random_rows, c) for c in config.comparisons}
    for field, shares in observed_u.items():
        u[field].update(shares)
    m = expectation_maximisation(training_rows, config.comparisons, u, config.model.prior)
    parameters = {}
    for c in config.comparisons:
        seen = {row[scoring.gamma(c.field)] for row in training_rows}
        trained = []
        for p in config.model.parameters[c.field]:
            learned_m = p.level in seen and m[c.field][p.level] > 0
            trained.append(
                LevelParameters(
                    p.level,
                    m[c.field][p.level] if learned_m else p.m,
                    observed_u[c.field].get(p.level, p.u),
                    TRAINED if learned_m or p.level in observed_u[c.field] else p.source,
                )
            )
        parameters[c.field] = tuple(trained)
    return replace(config, model=Model(config.model.prior, parameters))


def should_train(stored_before: int, stored_after: int, config: ResolverConfig, source: str) -> bool:
    """Whether this batch crosses the training threshold while hand-set parameters are in use."""
    limit = config.auto_train_threshold
    return limit > 0 and source == COLD_START and stored_before < limit <= stored_after

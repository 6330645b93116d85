"""Fellegi-Sunter scoring of candidate pairs with the model's weights as literals."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.config import COMPARISON_KINDS, EXACT_MATCH, JARO_WINKLER, Comparison, Model, ResolverConfig
from kinweave.functions.meetings import NULL_LEVEL, Grade, counted, first_stored, kept, listed
from kinweave.functions.similarity import jaro_winkler
from kinweave.functions.text import NORMALISED_SUFFIX
from kinweave.operators import blocking


def jaro_winkler_level(left: Column, right: Column, comparison: Comparison) -> Column:
    """Level by similarity: equal, then one level per threshold, else 0."""
    similarity = jaro_winkler(left, right)
    level = F.when(left == right, len(comparison.thresholds) + 1)
    for position, threshold in enumerate(comparison.thresholds):
        level = level.when(similarity >= F.lit(threshold), len(comparison.thresholds) - position)
    return level.otherwise(0)


def exact_level(left: Column, right: Column, comparison: Comparison) -> Column:
    """Level 1 when equal, else 0."""
    return F.when(left == right, 1).otherwise(0)


# Patterns of levels up to which the driver tells tasks how they rank.
MOST_PATTERNS = 1 << 16

# Comparison kinds by name: (left, right, comparison) -> level of two present values.
LEVELS = {JARO_WINKLER: jaro_winkler_level, EXACT_MATCH: exact_level}


def register(kind: str, level: Callable[[Column, Column, Comparison], Column]) -> None:
    """Add a kind of comparison: `level` grades two present values, 0 for the else level, rising with similarity."""
    LEVELS[kind] = level
    if kind not in COMPARISON_KINDS:
        COMPARISON_KINDS.append(kind)


def gamma(name: str) -> str:
    return f"gamma_{name}"


def gamma_columns(config: ResolverConfig) -> list[str]:
    return [gamma(c.field) for c in config.comparisons]


def match_weight(model: Model, comparisons: tuple[Comparison, ...], prefix: str = "gamma_") -> Column:
    """log2 prior odds plus the weight of each level; the NULL level adds 0."""
    terms = [f"{model.prior_weight!r}D"]
    for comparison in comparisons:
        cases = " ".join(f"WHEN {p.level} THEN {p.weight!r}D" for p in model.parameters[comparison.field])
        terms.append(f"CASE {prefix}{comparison.field} WHEN {NULL_LEVEL} THEN 0.0D {cases} END")
    return F.expr(" + ".join(terms))


def match_probability(weight: Column) -> Column:
    """Probability of a match from its weight."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(2.0), -weight))


def graded_pairs(pairs: DataFrame, config: ResolverConfig) -> DataFrame:
    """Directed profile pairs with their levels: `new_*` is the later mention's side, `stored_*` the earlier one's.

    Similarities are symmetric and computed once per pair; only the missing-value rule depends on the direction: a
    stored NULL is neutral, a new record's NULL counts as an empty string, i.e. as the else level, unless missing
    values are neutral on both sides.
    A direction exists when some mention of its stored profile arrived before the last new one of its new profile.
    """
    keep = [c for c in ("match_key",) if c in pairs.columns]
    levels = pairs.select(
        "a",
        "b",
        *keep,
        *[LEVELS[c.kind](F.col(f"a.{c.field}"), F.col(f"b.{c.field}"), c).alias(f"_{c.field}") for c in config.comparisons],
    )

    def direction(new: str, stored: str) -> str:
        graded = "".join(
            f", CASE WHEN {stored}.{c.field} IS NULL THEN {NULL_LEVEL} WHEN {new}.{c.field} IS NULL THEN {new_missing}"
            f" ELSE _{c.field} END AS {gamma(c.field)}"
            for c in config.comparisons
        )
        return (
            f"struct({new}.profile_id AS new_profile, {stored}.profile_id AS stored_profile, "
            f"{new}.mentions AS new_mentions, {stored}.mentions AS stored_mentions, {new}.last_new AS last_new{graded})"
        )

    new_missing = 0 if config.missing == "penalise" else NULL_LEVEL
    ways = F.expr(
        f"CASE WHEN a.profile_id = b.profile_id THEN array({direction('b', 'a')}) "
        f"ELSE array({direction('b', 'a')}, {direction('a', 'b')}) END"
    )
    return (
        levels.select(*keep, F.explode(ways).alias("way"))
        .select("way.*", *keep)
        .where(F.col("stored_profile") < F.col("last_new"))
        .drop("last_new")
    )


def profile_links(pairs: DataFrame, config: ResolverConfig) -> DataFrame:
    """Directed links between profiles that reach the match-weight cut-off."""
    return linked(graded_pairs(pairs, config), config)


def grades(known: DataFrame, config: ResolverConfig) -> list[Grade] | None:
    """How tiles of profiles are graded, or None where pairs have to be formed one by one: rules but one of similar names, kinds
    of comparison with levels of their own, fields that are no strings."""
    types = dict(known.dtypes)
    kinds = all(LEVELS[c.kind] in (jaro_winkler_level, exact_level) and types[c.field] == "string" for c in config.comparisons)
    if len(config.rules) != 1 or config.rules[0].name is None or not kinds:
        return None
    return [
        (gamma(c.field), c.thresholds if LEVELS[c.kind] is jaro_winkler_level else None, len(c.thresholds) + 3)
        for c in config.comparisons
    ]


def placed(known: DataFrame, config: ResolverConfig) -> DataFrame:
    """Profiles by blocks and tiles, for configurations with `grades`; written once where tiles meet more than once."""
    rule = config.rules[0]
    fields = [c.field for c in config.comparisons]
    return blocking.placed_profiles(known, list(rule.keys), f"{rule.name}{NORMALISED_SUFFIX}", rule.cutoff, fields)


def _graded_tiles(
    known: DataFrame, config: ResolverConfig, grade: Callable, columns: list[str], tiles: DataFrame | None = None
) -> DataFrame:
    layout = ", ".join([f"{c} {'int' if c in gamma_columns(config) else 'long'}" for c in columns])
    graded = grade(grades(known, config), config.missing == "penalise", config.rules[0].cutoff)
    return blocking.tiled_profiles(placed(known, config) if tiles is None else tiles).mapInArrow(graded, layout)


def linked(graded: DataFrame, config: ResolverConfig) -> DataFrame:
    """Of graded directed pairs the links, those that reach the match-weight cut-off."""
    weighed = graded.withColumn("match_weight", match_weight(config.model, config.comparisons))
    return weighed.where(F.col("match_weight") >= config.match_weight_threshold)


def graded(known: DataFrame, config: ResolverConfig, pairs: DataFrame | None) -> DataFrame:
    """The `pairs` of profiles in each direction that exists, with their levels: new_profile, stored_profile, levels.

    Pairs are found and graded where two tiles of profiles meet, and leave as they are; `pairs` are read only where `grades`
    says that they are formed one by one.
    """
    columns = ["new_profile", "stored_profile", *gamma_columns(config)]
    if grades(known, config) is None:
        return graded_pairs(pairs, config).select(*columns, *[c for c in ("match_key",) if c in pairs.columns])
    return _graded_tiles(known, config, listed, columns).withColumn("match_key", F.lit(0))


def first_links(
    known: DataFrame, config: ResolverConfig, small: bool, links: DataFrame | None, tiles: DataFrame | None = None
) -> DataFrame:
    """Of the `links` between profiles, at least the earliest stored profile of each new profile and weight: new_profile,
    stored_profile, match_weight.

    All pairs of two tiles of profiles are graded where the tiles meet, and only the earliest of each pattern of levels leave.
    `tiles` are the profiles as `placed`, where they are written.
    """
    columns = ["new_profile", "stored_profile"]
    if grades(known, config) is not None:
        links = linked(_graded_tiles(known, config, first_stored, [*columns, *gamma_columns(config)], tiles), config)
    return links.select(*columns, "match_weight")


def graded_patterns(known: DataFrame, config: ResolverConfig, pairs: DataFrame | None) -> DataFrame:
    """The directed `pairs` of profiles counted by their levels, whatever they weigh: levels, pairs.

    All pairs of two tiles of profiles are graded and counted where the tiles meet.
    """
    levels = gamma_columns(config)
    if grades(known, config) is None:
        return graded_pairs(pairs, config).groupBy(*levels).agg(F.count("*").alias("pairs"))
    return _graded_tiles(known, config, counted, [*levels, "links"]).groupBy(*levels).agg(F.sum("links").alias("pairs"))


def link_patterns(known: DataFrame, config: ResolverConfig, small: bool, links: DataFrame | None) -> DataFrame:
    """The `links` between profiles counted by their levels: levels, match_weight, links."""
    levels = gamma_columns(config)
    if grades(known, config) is None:
        return links.groupBy(*levels, "match_weight").agg(F.count("*").alias("links"))
    graded = linked(_graded_tiles(known, config, counted, [*levels, "links"]), config)
    return graded.groupBy(*levels, "match_weight").agg(F.sum("links").alias("links"))


def _ranks(known: DataFrame, config: ResolverConfig, score: Callable[[Column], Column]) -> tuple[np.ndarray, np.ndarray]:
    """Of all patterns of levels, in the order of their numbers, the rank by `score` (-1 below the cut-off) and the match weight."""
    sizes = [size for _, _, size in grades(known, config)]
    strides = [math.prod(sizes[i + 1 :]) for i in range(len(sizes))]
    levels = [F.expr(f"CAST(id div {n} % {size} + {NULL_LEVEL} AS int)").alias(c) for n, size, c in zip(strides, sizes, gamma_columns(config))]
    every = known.sparkSession.range(0, math.prod(sizes), 1, 1).select("id", *levels)
    weighed = every.withColumn("w", match_weight(config.model, config.comparisons))
    told = sorted(weighed.select("id", "w", score(F.col("w")).alias("s")).collect())
    weight, scores = (np.array([row[i] for row in told], dtype=np.float64) for i in (1, 2))
    rank = np.unique(scores, return_inverse=True)[1].astype(np.int64)
    return np.where(weight >= config.match_weight_threshold, rank, -1), weight


def ranked_in_tiles(known: DataFrame, config: ResolverConfig) -> bool:
    """Whether the links that count are told from the others where tiles of profiles meet."""
    found = grades(known, config)
    return found is not None and math.prod(size for _, _, size in found) <= MOST_PATTERNS


def best_links(tiles: DataFrame, known: DataFrame, config: ResolverConfig, top_n: int) -> DataFrame:
    """Of the links between profiles, which are `placed` in tiles, at least those that can be among the best `top_n` of some
    mention: new_profile, stored_profile, match_weight.

    The others are dropped where two tiles of profiles meet, so a profile has few links of each pair of tiles.
    """
    return _kept(tiles, known, config, lambda weight: weight, top_n, False)


def offered_links(
    tiles: DataFrame, known: DataFrame, config: ResolverConfig, seen: DataFrame, top_n: int, score: Callable[[Column], Column]
) -> DataFrame:
    """Like `best_links`, at least the links that offer one of the best `top_n` clusters to some mention.

    `seen` holds clusters of profiles with their first arrival there: stored_profile, cluster_id, first_seq.
    """
    clusters = F.collect_list(F.struct("cluster_id", "first_seq")).alias("seen")
    held = seen.groupBy(F.col("stored_profile").alias("profile_id")).agg(clusters)
    return _kept(tiles.join(held, "profile_id", "left"), known, config, score, top_n, True)


def _kept(
    tiles: DataFrame, known: DataFrame, config: ResolverConfig, score: Callable[[Column], Column], top_n: int, offered: bool
) -> DataFrame:
    rank, weight = _ranks(known, config, score)
    rule, penalise = config.rules[0], config.missing == "penalise"
    keep = kept(grades(known, config), penalise, rule.cutoff, top_n, rank, weight, offered)
    return blocking.tiled_profiles(tiles).mapInArrow(keep, "new_profile long, stored_profile long, match_weight double")


def parameter_rows(model: Model, comparisons: tuple[Comparison, ...]) -> list[tuple]:
    """The model as rows (field, level, label, m, u, weight, source)."""
    rows = []
    for comparison in comparisons:
        labels = ["exact", *[f">= {t}" for t in comparison.thresholds], "else"]
        rows += [
            (comparison.field, p.level, label, float(p.m), float(p.u), p.weight, p.source)
            for label, p in zip(labels, model.parameters[comparison.field])
        ]
    return rows

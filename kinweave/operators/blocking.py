"""Candidate pairs: which mentions are scored against which.

Pairs are formed between *profiles*, the distinct combinations of all fields that blocking and scoring read.
Copies therefore never multiply pairs: a profile stands for any number of equal mentions, and carries the
arrival number of its first mention as its id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.config import JARO_WINKLER, JoinRule, ResolverConfig
from kinweave.functions.similarity import (
    BOOST_ABOVE,
    MAX_PREFIX,
    PREFIX_WEIGHT,
    ROUNDING_SLACK,
    TILE_PAIR_SCHEMA,
    jaro_winkler,
    similar_within_tiles,
)
from kinweave.functions.text import NORMALISED_SUFFIX, normalise_name
from kinweave.session import task_slots

# Values per tile: small blocks make small tiles for parallelism, large ones large tiles for little replication.
TILE_ROWS = (512, 8192)
TILES_WANTED = 64
# Signatures of names: length classes for a factor of two, room for all of them, and what stands for first characters beyond ASCII.
CLASSES_PER_OCTAVE, LENGTH_CLASSES, OTHER = 4, 256, 128
# Profiles up to this measured size are sent to every task; beyond it, pairs and profiles are sorted and merged.
SMALL_BYTES = 32 << 20
# Profiles of a value that meet those of another at once, and tasks a slot for such meetings, whose work differs.
PROFILES_PER_TILE = 512
TASKS_A_SLOT = 4
# Profiles per tile where whole tiles are graded, and how many tiles of a block: fewer than of names, as a profile goes to each.
MEETING_ROWS, MEETING_TILES = (2048, 16384), 32


def with_normalised(mentions: DataFrame, config: ResolverConfig) -> DataFrame:
    """Add `<field>_norm` for every normalised field the mentions have and lack a copy of."""
    wanted = {
        f"{name}{NORMALISED_SUFFIX}": normalise_name(F.col(name))
        for name in config.normalised_fields
        if name in mentions.columns and f"{name}{NORMALISED_SUFFIX}" not in mentions.columns
    }
    return mentions.withColumns(wanted) if wanted else mentions


def profile_fields(config: ResolverConfig) -> list[str]:
    """All columns that decide blocking and scoring."""
    names = [c.field for c in config.comparisons]
    for rule in config.rules:
        names += rule.keys
        if rule.name is not None:
            names.append(f"{rule.name}{NORMALISED_SUFFIX}")
    return sorted(set(names))


def with_profile_key(mentions: DataFrame, config: ResolverConfig) -> DataFrame:
    """Add the digest that equal profiles share."""
    fields = profile_fields(config)
    return mentions.withColumn("profile_key", F.md5(F.to_json(F.struct(*fields))))


def profiles(mentions: DataFrame, config: ResolverConfig) -> DataFrame:
    """Distinct profiles: id (first arrival), last arrival among new mentions, number of mentions, fields.

    `is_new` marks the mentions to resolve; without it all are.
    """
    fields = profile_fields(config)
    fresh = F.col("arrival_seq")
    if "is_new" in mentions.columns:
        fresh = F.when(F.col("is_new"), fresh)
    return mentions.groupBy("profile_key", *fields).agg(
        F.min("arrival_seq").alias("profile_id"),
        F.max(fresh).alias("last_new"),
        F.count("*").alias("mentions"),
    )


def _tile_count(size: str, least: int, most: int, wanted: int) -> Column:
    """Tiles of a block by its number of values; a power of two up to `wanted`, then multiples of it."""
    rows = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col(size) / wanted)))
    tiles = F.ceil(F.col(size) / rows)
    doubled = F.pow(F.lit(2), F.ceil(F.log2(tiles)))
    return F.when(tiles <= wanted, doubled).otherwise(F.ceil(tiles / wanted) * wanted).cast("int")


def signature(name: str) -> Column:
    """First character (all beyond ASCII alike) and length class of a name, as one number that orders by both.

    Names of different first characters here have no common prefix, and of a length class the longest and shortest differ
    by a factor of at most `2 ** (1 / CLASSES_PER_OCTAVE)`, so ranges of signatures bound the similarity of their names.
    """
    length = F.floor(F.log2(F.greatest(F.octet_length(name), F.lit(1))) * CLASSES_PER_OCTAVE)
    return (F.least(F.ascii(name), F.lit(OTHER)) * LENGTH_CLASSES + length).cast("int")


def reachable(first: Column, length: Column, low: Column, high: Column, cutoff: float) -> Column:
    """Lossless: False only where no name with a signature from `low` to `high` reaches the cut-off with a name of this first
    character and number of bytes.

    Matching bytes are at most as many as the shorter name has, the transposition term is at most 1, and the prefix counts
    where the first characters may be the same.
    """
    low_first, high_first = F.floor(low / LENGTH_CLASSES), F.floor(high / LENGTH_CLASSES)
    # lengths are known where all signatures of the range have one first character
    one = low_first == high_first
    slack = 1e-9  # of the logarithm and the power
    shortest = F.when(one, F.pow(F.lit(2.0), (low % LENGTH_CLASSES) / CLASSES_PER_OCTAVE) * (1 - slack)).otherwise(F.lit(1.0))
    longest = F.pow(F.lit(2.0), (high % LENGTH_CLASSES + 1) / CLASSES_PER_OCTAVE) * (1 + slack)
    longest = F.when(one, longest).otherwise(F.lit(float("inf")))
    own = F.greatest(length, F.lit(1))
    jaro = (F.least(longest / own, F.lit(1.0)) + F.least(own / F.greatest(shortest, F.lit(1.0)), F.lit(1.0)) + 1.0) / 3.0
    boosted = jaro + MAX_PREFIX * PREFIX_WEIGHT * (1.0 - jaro)
    best = F.when(first.between(low_first, high_first) & (jaro > BOOST_ABOVE), boosted).otherwise(jaro)
    return best >= cutoff - ROUNDING_SLACK


def placed_values(values: DataFrame, keys: list[str], cutoff: float, tile_rows: tuple[int, int] = TILE_ROWS) -> DataFrame:
    """Values of blocks that can have pairs: block, tile (its number among `tiles`), and the tiles `in_reach` of the value."""
    placed = _placed(values, keys, cutoff, tile_rows, TILES_WANTED, F.col("size") > 1, ["name"])
    return placed.select(
        "block", "value_id", "name", "fresh_value", _tiles().alias("value_tiles"), "tile", "tiles", "stale", "in_reach"
    )


def _placed(
    values: DataFrame, keys: list[str], cutoff: float, tile_rows: tuple[int, int], wanted: int, has_pairs: Column, dealt: list[str]
) -> DataFrame:
    """Rows with a `name`, a `value_id` and `last_new` (NULL: not new), with their block, tile and the tiles in their reach.

    Tiles are ranges of signatures: quantiles of the block's rows, found in the aggregate that sizes the blocks.  Where
    one signature fills several tiles its rows are given to them by a hash of `dealt`.  Which tiles are in reach is found
    once for all rows of a block that begin with the same character and are equally long.
    """
    steps = [i / wanted for i in range(1, wanted)]
    rows = values.withColumns({"signature": signature("name"), "_first": F.ascii("name"), "_length": F.octet_length("name")})
    blocks = rows.groupBy(*keys).agg(
        F.min("value_id").alias("block"),
        F.count("*").alias("size"),
        F.count("last_new").alias("fresh"),
        F.count_if(F.col("last_new").isNull()).alias("stale"),
        F.min("signature").alias("least"),
        F.max("signature").alias("most"),
        F.percentile_approx("signature", steps, 1_000).alias("quantiles"),
    )
    blocks = blocks.where(has_pairs & (F.col("fresh") > 0)).withColumn("tiles", _tile_count("size", *tile_rows, wanted))
    # upper ends of the ranges but the last; beyond `wanted` tiles several share a range
    ranges = F.least("tiles", F.lit(wanted))
    ends = "transform(sequence(1, ranges), i -> CASE WHEN i = ranges THEN most ELSE quantiles[i * {0} div ranges - 1] END)"
    blocks = blocks.withColumn("ranges", ranges).withColumn("ends", F.expr(ends.format(wanted)))
    blocks = blocks.withColumn("share", (F.col("tiles") / F.col("ranges")).cast("int")).drop("quantiles", "size", "fresh")

    def near(t: Column) -> Column:
        at = F.floor(t / F.col("share")).cast("int")
        start = F.when(at == 0, F.col("least")).otherwise(F.element_at("ends", at))
        first, length = F.least("_first", F.lit(OTHER)), F.col("_length").cast("double")
        return reachable(first, length, start, F.element_at("ends", at + 1), cutoff)

    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    in_reach = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.filter(every, near))
    alike = [*keys, "signature", "_first", "_length"]
    low = F.size(F.filter("ends", lambda e: e < F.col("signature")))
    high = F.greatest(low, F.size(F.filter("ends", lambda e: e <= F.col("signature"))) - 1)
    kinds = rows.select(*alike).distinct().join(blocks, keys).withColumns({"low": low, "in_reach": in_reach})
    kinds = kinds.withColumn("room", (high - F.col("low") + 1) * F.col("share"))
    kinds = kinds.select(*alike, "block", "tiles", "stale", "share", "low", "room", "in_reach")
    spread = F.pmod(F.xxhash64(*dealt), F.col("room")).cast("int")
    return (
        rows.join(kinds, alike)
        .withColumns({"tile": F.col("low") * F.col("share") + spread, "fresh_value": F.col("last_new").isNotNull()})
        .drop("signature", "_first", "_length", "low", "room", "share")
    )


def similar_values(
    values: DataFrame, keys: list[str], cutoff: float, tile_rows: tuple[int, int] = TILE_ROWS
) -> DataFrame:
    """Pairs of similar `name` values that agree on `keys`, each pair once, with its similarity.

    `values` has one row per distinct (keys, name): `value_id`, `name`, `profiles` (how many profiles share it),
    `last_new` (NULL: no new mention).
    A block is cut into tiles by its number of values, and tile pairs are spread over the cluster, so no task
    holds more than two tiles however large the block.  A value goes only to tiles that may hold a similar one, and
    pairs without a new value are never formed.  New values meet in the pair of tiles whose left one has the lower number,
    stored ones are always on the right.
    """
    placed = placed_values(values, keys, cutoff, tile_rows)
    columns = ["value_id", "name", "fresh_value", "value_tiles"]
    # without stored values, a left tile has nothing to meet in tiles of lower numbers
    forward = F.filter("in_reach", lambda t: (t >= F.col("tile")) | (F.col("stale") > 0))
    left = placed.where("fresh_value").select(
        "block", F.col("tile").alias("l_tile"), F.explode(forward).alias("r_tile"), F.lit(0).alias("side"), *columns
    )
    backward = F.filter("in_reach", lambda t: (t <= F.col("tile")) | ~F.col("fresh_value"))
    right = placed.select(
        "block", F.explode(backward).alias("l_tile"), F.col("tile").alias("r_tile"), F.lit(1).alias("side"), *columns
    )
    group = ["block", "l_tile", "r_tile"]
    return (
        left.unionByName(right)
        .repartition(task_slots(values.sparkSession), *group)
        .sortWithinPartitions(*group, "side")
        .mapInPandas(similar_within_tiles(cutoff), TILE_PAIR_SCHEMA)
    )


def distinct_values(known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct non-NULL key combinations: id (first profile), last new arrival, number of profiles."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    return (
        known.where(present)
        .groupBy(*keys)
        .agg(
            F.min("profile_id").alias("value_id"),
            F.max("last_new").alias("last_new"),
            F.count("*").alias("profiles"),
        )
    )


def _tiles(profiles_column: str = "profiles") -> Column:
    return F.ceil(F.col(profiles_column) / PROFILES_PER_TILE).cast("int")


def _spread(known: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles under the id of their value; a value with very many profiles is spread over several tiles."""
    sized = values.select(*keys, "value_id", _tiles().alias("tiles"))
    return known.join(sized, keys).select(
        "value_id",
        F.pmod(F.xxhash64("profile_id"), F.col("tiles")).cast("int").alias("tile"),
        F.struct(*[c for c in known.columns if c != "profile_key"]).alias("profile"),
    )


def _expand(value_pairs: DataFrame, left: DataFrame, right: DataFrame, small: bool, mirrored: bool = False) -> DataFrame:
    """Profile pairs (a, b) of value pairs, one tile of a value with one of the other at a time.

    The planner cannot foresee how many pairs come out of a similarity join, so pairs of tiles are dealt evenly to a fixed
    number of tasks before their profiles meet there.  Where the measured size of the profiles is small they are sent to
    every task; otherwise both tiles travel to their meeting as arrays, so nothing that is shuffled grows with the pairs, and
    a value with very many partners is no skewed key.  With `mirrored`, both sides are the same profiles, and two tiles of
    one value meet once.
    """
    meeting = ["l_value", "l_tile", "r_value", "r_tile"]
    if small:
        a = left.select(F.col("value_id").alias("l_value"), F.col("tile").alias("l_tile"), F.col("profile").alias("a"))
        b = right.select(F.col("value_id").alias("r_value"), F.col("tile").alias("r_tile"), F.col("profile").alias("b"))
        dealt = _dealt(_addressed(value_pairs, mirrored))
        return dealt.join(a.hint("broadcast"), meeting[:2]).join(b.hint("broadcast"), meeting[2:])
    return _met(value_pairs, left, right, mirrored).withColumn("a", F.explode("as")).drop("as").withColumn("b", F.explode("bs")).drop("bs")


def _addressed(value_pairs: DataFrame, mirrored: bool) -> DataFrame:
    """Pairs of tiles of value pairs; with `mirrored`, two tiles of one value once."""
    addressed = value_pairs.withColumn("l_tile", F.explode(F.sequence(F.lit(0), F.col("l_tiles") - 1))).withColumn(
        "r_tile", F.explode(F.sequence(F.lit(0), F.col("r_tiles") - 1))
    )
    if mirrored:
        addressed = addressed.where((F.col("l_value") != F.col("r_value")) | (F.col("l_tile") <= F.col("r_tile")))
    return addressed.select("l_value", "l_tile", "r_value", "r_tile")


def _dealt(meetings: DataFrame) -> DataFrame:
    """Meetings of tiles dealt evenly to a fixed number of tasks."""
    return meetings.repartition(TASKS_A_SLOT * task_slots(meetings.sparkSession), "l_value", "l_tile", "r_value", "r_tile")


def _met(value_pairs: DataFrame, left: DataFrame, right: DataFrame, mirrored: bool) -> DataFrame:
    """Pairs of tiles of value pairs, with the profiles of both as arrays `as` and `bs`, dealt evenly."""

    def tiles(side: DataFrame, end: str, name: str) -> DataFrame:
        held = side.groupBy(F.col("value_id").alias(f"{end}_value"), F.col("tile").alias(f"{end}_tile"))
        return held.agg(F.collect_list("profile").alias(name)).hint("merge")

    met = _addressed(value_pairs, mirrored).join(tiles(left, "l", "as"), ["l_value", "l_tile"])
    return _dealt(met.join(tiles(right, "r", "bs"), ["r_value", "r_tile"]))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Order both ends by first arrival; drop pairs of stored mentions and a single mention with itself."""
    swap = F.col("a.profile_id") > F.col("b.profile_id")
    usable = F.col("a.last_new").isNotNull() | F.col("b.last_new").isNotNull()
    alone = (F.col("a.profile_id") == F.col("b.profile_id")) & (F.col("a.mentions") == 1)
    return pairs.where(usable & ~alone).select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
    )


def _with_itself(values: DataFrame) -> DataFrame:
    """Each value with itself."""
    value, tiles = F.col("value_id"), _tiles()
    return values.where("last_new is not null").select(
        value.alias("l_value"), value.alias("r_value"), tiles.alias("l_tiles"), tiles.alias("r_tiles")
    )


def _once() -> Column:
    """Whether a pair of profiles that tiles of one or two values formed is not formed the other way round as well."""
    apart = (F.col("l_value") != F.col("r_value")) | (F.col("l_tile") != F.col("r_tile"))
    return apart | (F.col("a.profile_id") <= F.col("b.profile_id"))


def pairs_by_name(known: DataFrame, keys: list[str], name: str, cutoff: float, small: bool = False) -> DataFrame:
    """Profile pairs that agree on `keys` and whose `name` values reach the cut-off."""
    values = distinct_values(known, [*keys, name])
    similar = similar_values(values.withColumnRenamed(name, "name"), keys, cutoff).drop("similarity")
    spread = _spread(known, values, [*keys, name])
    pairs = _expand(similar.unionByName(_with_itself(values)), spread, spread, small, mirrored=True)
    return _ordered(pairs.where(_once()))


def placed_profiles(known: DataFrame, keys: list[str], name: str, cutoff: float, fields: list[str]) -> DataFrame:
    """Profiles that can have pairs by their `keys` and similar `name` values: block, tile, the tiles in_reach, `name`, `profile_id`,
    `last_new` and the `fields` as f0, f1 and so on.  Profiles of one name stay together up to `PROFILES_PER_TILE`."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("profile_id", *keys, name)])
    named = {f"k{i}": key for i, key in enumerate(keys)} | {"name": name}
    held = named | {c: c for c in ("profile_id", "last_new")} | {f"f{i}": field for i, field in enumerate(fields)}
    rows = known.where(present).select(*[F.col(c).alias(short) for short, c in held.items()])
    chunks = rows.groupBy(*named).agg(F.count("*").alias("profiles")).select(*named, _tiles().alias("chunks"))
    chunk = F.pmod(F.xxhash64("profile_id"), F.col("chunks"))
    rows = rows.join(chunks, list(named)).withColumns({"chunk": chunk, "value_id": F.col("profile_id")})
    keys = [c for c in named if c != "name"]
    placed = _placed(rows, keys, cutoff, MEETING_ROWS, MEETING_TILES, F.lit(True), ["name", "chunk"])
    # ids of profiles may repeat, so blocks are known by their keys
    block = F.to_json(F.struct(*keys)).alias("block")
    columns = ["name", "profile_id", "last_new", *[f"f{i}" for i in range(len(fields))]]
    return placed.select(block, "tile", "stale", "fresh_value", "in_reach", *columns)


def tiled_profiles(placed: DataFrame) -> DataFrame:
    """Placed profiles by pairs of tiles that may hold similar names: `block`, `l_tile`, `r_tile`, `side` and what they carry.

    Whatever is graded, counted or kept of a pair is decided where its tiles meet, so nothing that is shuffled grows with the
    pairs.  A profile goes only to tiles that may hold a similar name.  Groups of two tiles hold new profiles of the left one
    (side 0) and what they meet in the right one (side 1): all where the left one has the lower number, else stored ones.  The
    group of a tile with itself holds all its profiles once.
    """
    columns = [c for c in placed.columns if c not in ("block", "tile", "stale", "fresh_value", "in_reach")]
    forward = F.filter("in_reach", lambda t: (t > F.col("tile")) | ((F.col("stale") > 0) & (t != F.col("tile"))))
    backward = F.filter("in_reach", lambda t: (t <= F.col("tile")) | ~F.col("fresh_value"))
    left = placed.where("fresh_value").select(
        "block", F.col("tile").alias("l_tile"), F.explode(forward).alias("r_tile"), F.lit(0).alias("side"), *columns
    )
    right = placed.select("block", F.explode(backward).alias("l_tile"), F.col("tile").alias("r_tile"), F.lit(1).alias("side"), *columns)
    group = ["block", "l_tile", "r_tile"]
    met = left.unionByName(right).repartition(TASKS_A_SLOT * task_slots(placed.sparkSession), *group)
    return met.sortWithinPartitions(*group, "side", "name")


def pairs_by_equality(known: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Profile pairs that agree on `keys`."""
    values = distinct_values(known, keys)
    spread = _spread(known, values, keys)
    pairs = _expand(_with_itself(values), spread, spread, small, mirrored=True)
    return _ordered(pairs.where(_once()))


def _pairs_without_name(known: DataFrame, keys: list[str], name: str, small: bool) -> DataFrame:
    """Profile pairs that agree on `keys` and lack `name` on at least one side."""
    values = distinct_values(known, keys)
    spread = _spread(known, values, keys)
    nameless = spread.where(F.col("profile").getField(name).isNull())
    pairs = _expand(_with_itself(values), nameless, spread, small)
    once = F.col("b").getField(name).isNotNull() | (F.col("a.profile_id") <= F.col("b.profile_id"))
    return _ordered(pairs.where(once))


def required_similarity(config: ResolverConfig) -> tuple[str, float] | None:
    """A field and similarity without which no pair reaches the match-weight cut-off, if the model implies one."""
    best = {
        c.field: max([0.0, *(p.weight for p in config.model.parameters[c.field])]) for c in config.comparisons
    }
    for comparison in config.comparisons:
        if comparison.kind != JARO_WINKLER:
            continue
        others = config.model.prior_weight + sum(w for f, w in best.items() if f != comparison.field)
        cutoffs = (1.0, *comparison.thresholds)
        reachable = [
            cutoff
            for cutoff, p in zip(cutoffs, config.model.parameters[comparison.field])
            if others + p.weight >= config.match_weight_threshold
        ]
        else_level = config.model.parameters[comparison.field][-1]
        if reachable and others + else_level.weight < config.match_weight_threshold:
            return comparison.field, min(reachable)
    return None


def rule_pairs(known: DataFrame, rule: JoinRule, config: ResolverConfig, small: bool) -> DataFrame:
    """Profile pairs one rule admits.

    For an equality rule, pairs that cannot reach the match-weight cut-off are left out where the model tells.
    """
    keys = list(rule.keys)
    if rule.name is not None:
        return pairs_by_name(known, keys, f"{rule.name}{NORMALISED_SUFFIX}", rule.cutoff, small)
    needed = required_similarity(config)
    if needed is None or needed[0] in keys:
        return pairs_by_equality(known, keys, small)
    named = pairs_by_name(known, keys, *needed, small)
    return named.unionByName(_pairs_without_name(known, keys, needed[0], small))


def admits(rule: JoinRule) -> Column:
    """Whether a rule admits the pair (a, b)."""
    agree = reduce(lambda x, y: x & y, [F.col(f"a.{f}") == F.col(f"b.{f}") for f in rule.keys])
    if rule.name is not None:
        name = f"{rule.name}{NORMALISED_SUFFIX}"
        agree &= jaro_winkler(F.col(f"a.{name}"), F.col(f"b.{name}")) >= F.lit(rule.cutoff)
    return F.coalesce(agree, F.lit(False))


def payload_bytes(config: ResolverConfig) -> Column:
    """Measure of a profile table: bytes of all fields plus the fixed columns."""
    return F.coalesce(F.sum(sum((F.coalesce(F.octet_length(f), F.lit(0)) for f in profile_fields(config)), F.lit(64))), F.lit(0))


def candidate_pairs(known: DataFrame, config: ResolverConfig, small: bool = False) -> DataFrame:
    """Profile pairs admitted by any rule, each once, with the number of the first rule that admits it.

    `small` says that the profiles were measured and may be sent to every task.

    A rule leaves out the pairs that an earlier rule admits, which each pair tells by itself; no shuffle removes
    duplicates.
    """
    found = []
    for number, rule in enumerate(config.rules):
        pairs = rule_pairs(known, rule, config, small)
        for earlier in config.rules[:number]:
            pairs = pairs.where(~admits(earlier))
        found.append(pairs.withColumn("match_key", F.lit(number)))
    return reduce(DataFrame.unionByName, found)

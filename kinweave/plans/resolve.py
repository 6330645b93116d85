"""Resolution of mentions: block, score, assign, rank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinweave.config import ResolverConfig
from kinweave.operators import blocking, clustering, scoring
from kinweave.session import cut


@dataclass
class Linked:
    """Mentions with profile ids, their profiles and the links between profiles.

    `small` says that the profiles were measured and may be sent to every task.
    """

    mentions: DataFrame
    profiles: DataFrame
    config: ResolverConfig | None = None
    small: bool = False

    @cached_property
    def pairs(self) -> DataFrame:
        """Candidate pairs of profiles."""
        return blocking.candidate_pairs(self.profiles, self.config, self.small)

    @cached_property
    def links(self) -> DataFrame:
        """Links between profiles."""
        return scoring.linked(self.graded(), self.config)

    @cached_property
    def placed(self) -> DataFrame:
        """The profiles by blocks and tiles, written, as clusters and candidates need them."""
        return cut(scoring.placed(self.profiles, self.config))

    def first(self) -> DataFrame:
        """Of the links at least the earliest of each new profile and weight, which decide the clusters."""
        if not self.tiled:
            return scoring.first_links(self.profiles, self.config, self.small, self.links)
        return scoring.first_links(self.profiles, self.config, self.small, None, self.placed)

    def best(self, top_n: int) -> DataFrame:
        """Of the links at least those that can be among the best `top_n` of some mention."""
        if self.config is None or not scoring.ranked_in_tiles(self.profiles, self.config):
            return self.links.select("new_profile", "stored_profile", "match_weight")
        return scoring.best_links(self.placed, self.profiles, self.config, top_n)

    def graded(self) -> DataFrame:
        """All pairs in each direction that exists, with their levels."""
        return scoring.graded(self.profiles, self.config, None if self.tiled else self.pairs)

    def graded_patterns(self) -> DataFrame:
        """The number of pairs by levels, whatever they weigh."""
        return scoring.graded_patterns(self.profiles, self.config, None if self.tiled else self.pairs)

    @property
    def tiled(self) -> bool:
        """Whether pairs are found and graded where tiles of profiles meet."""
        return self.config is not None and scoring.grades(self.profiles, self.config) is not None

    def patterns(self) -> DataFrame:
        """The number of links by levels."""
        return scoring.link_patterns(self.profiles, self.config, self.small, None if self.tiled else self.links)


@dataclass
class Resolution:
    """Outcome of one run: cluster per new mention, and what ranks its candidates; `best` are its best links, where written."""

    linked: Linked
    clusters: DataFrame
    all_clusters: DataFrame
    config: ResolverConfig
    score: Callable[[Column], Column] = scoring.match_probability
    best: DataFrame | None = None

    def candidates(self) -> DataFrame:
        """Ranked clusters; where tiles tell them, the links that offer none of the best clusters are not even written."""
        linked, top_n = self.linked, self.config.top_n

        def offered(seen: DataFrame) -> DataFrame:
            return scoring.offered_links(linked.placed, linked.profiles, linked.config, seen, top_n, clustering.at_rest(self.score))

        tiled = linked.config is not None and scoring.ranked_in_tiles(linked.profiles, linked.config)
        return clustering.rank_candidates(linked.mentions, offered if tiled else linked.links, self.all_clusters, top_n, self.score)

    def stored_links(self) -> DataFrame:
        """The best links of each new mention as they are kept at rest: probability as a float."""
        links = self.linked.best(self.config.top_n) if self.best is None else self.best
        best = clustering.top_links(self.linked.mentions, links, self.config.top_n)
        return best.select(
            "mention_id_l",
            "mention_id_r",
            self.score(F.col("match_weight")).cast("float").alias("match_probability"),
        )


def link(mentions: DataFrame, config: ResolverConfig) -> Linked:
    """Profiles, candidate pairs and links of all mentions (`is_new` limits which ones get links)."""
    keyed = blocking.with_profile_key(blocking.with_normalised(mentions, config), config)
    measured = Observation()
    known = cut(blocking.profiles(keyed, config), measured, blocking.payload_bytes(config).alias("bytes"))
    small = measured.get["bytes"] <= blocking.SMALL_BYTES
    return Linked(mentions=clustering.with_profile_id(keyed, known), profiles=known, config=config, small=small)


def resolve(
    mentions: DataFrame, config: ResolverConfig, stored_clusters: DataFrame | None = None, ranked: bool = True
) -> Resolution:
    """Resolve all new mentions in arrival order.

    With `ranked` the links that can be among the best `top_n` of a mention are written once, for clusters as well as for stored
    links.  Otherwise clusters come from the first links, and stored links are derived when they are asked for.  Where links
    are not found by tiles of profiles, `ranked` writes all of them, for candidates as well.

    Without stored clusters every mention is new.  Otherwise `mentions` holds stored and new ones, told apart by
    `is_new`, and `stored_clusters` has mention_id and cluster_id of the stored ones; new ones have arrival numbers behind
    all stored ones, as `plans.requests` sees to.
    """
    linked = link(mentions, config)
    best = None
    if ranked and scoring.ranked_in_tiles(linked.profiles, config):
        best = cut(linked.best(config.top_n))
    elif ranked:
        best = linked.links = cut(linked.links.select("new_profile", "stored_profile", "match_weight"))
    linked.mentions = linked.mentions.select(*_carried(linked.mentions))
    if stored_clusters is not None:
        linked.mentions = cut(linked.mentions)
    done = _settle(linked, linked.first() if best is None else best, config, stored_clusters)
    done.best = best
    return done


def resolve_scored(
    mentions: DataFrame, scores: DataFrame, config: ResolverConfig, stored_clusters: DataFrame | None = None
) -> Resolution:
    """Resolve with links scored elsewhere: (mention_id_l, mention_id_r, match_probability) of mentions.

    Scores are compared and kept as they are given.  Links to later mentions and to the mention itself are dropped; every
    mention is a profile of its own.
    """
    own = cut(mentions.withColumn("profile_id", F.col("arrival_seq")).select(*_carried(mentions), "profile_id"))
    ends = scores.select("mention_id_l", "mention_id_r", F.col("match_probability").cast("double").alias("match_weight"))
    for side, name in (("l", "new_profile"), ("r", "stored_profile")):
        ends = ends.join(own.select(F.col("mention_id").alias(f"mention_id_{side}"), F.col("profile_id").alias(name)), f"mention_id_{side}")
    links = cut(ends.where("stored_profile < new_profile").select("new_profile", "stored_profile", "match_weight"))
    linked = Linked(own, own)
    linked.links = links
    return _settle(linked, links, config, stored_clusters, lambda score: score)


def _carried(mentions: DataFrame) -> list[str]:
    return [c for c in ("mention_id", "arrival_seq", "is_new", "profile_id") if c in mentions.columns]


def _settle(
    linked: Linked,
    links: DataFrame,
    config: ResolverConfig,
    stored_clusters: DataFrame | None,
    score: Callable[[Column], Column] = scoring.match_probability,
) -> Resolution:
    best = clustering.best_match(linked.mentions, links)
    if stored_clusters is None:
        clusters = cut(clustering.assign(best, config, score=score))
        # The written clusters hold every mention; later steps need not derive the profiles again.
        linked.mentions = clusters.select("mention_id", "arrival_seq", "profile_id")
        return Resolution(linked, clusters, clusters, config, score)
    before = (
        linked.mentions.where(~F.col("is_new"))
        .select("mention_id", "arrival_seq", "profile_id")
        .join(stored_clusters.select("mention_id", "cluster_id"), "mention_id")
    )
    clusters = cut(clustering.assign(best, config, before, score))
    everything = clusters.select("mention_id", "arrival_seq", "profile_id", "cluster_id").unionByName(before)
    return Resolution(linked, clusters, everything, config, score)

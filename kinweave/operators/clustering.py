"""Greedy clustering in arrival order, as joins.

A mention's best link leads to an earlier mention and never changes, so the clusters are the trees of a parent
forest.  All mentions of one profile share the same links; what differs is only which linked mentions had
arrived.  For each profile and link weight the earliest arrivals therefore suffice, a list bounded by the number
of level combinations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kinweave.config import ResolverConfig
from kinweave.operators import blocking, scoring
from kinweave.session import cut

#: The score of a link from its match weight.
Score = Callable[[Column], Column]
#: Links of one profile beyond which they are cut in parts before they meet in a task.
HEAVY = 1_000_000
#: Bytes of a cluster that a profile belongs to, beside the cluster's id.
SEEN_BYTES = 32


def with_profile_id(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """Mentions with the id of their profile."""
    return mentions.join(known.select("profile_key", "profile_id"), "profile_key")


def _only_new(mentions: DataFrame) -> DataFrame:
    return mentions.where("is_new") if "is_new" in mentions.columns else mentions


def best_match(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Best link of each new mention to an earlier mention: highest weight, then earliest arrival (NULL: none)."""
    steps = (
        links.groupBy("new_profile", "match_weight")
        .agg(F.min("stored_profile").alias("first_seq"))
        .groupBy(F.col("new_profile").alias("profile_id"))
        .agg(F.collect_list(F.struct("match_weight", "first_seq")).alias("steps"))
    )
    reachable = F.filter("steps", lambda s: s["first_seq"] < F.col("arrival_seq"))
    ranked = F.transform(
        reachable, lambda s: F.struct(s["match_weight"].alias("weight"), (-s["first_seq"]).alias("order"))
    )
    return (
        _only_new(mentions)
        .join(steps, "profile_id", "left")
        .withColumn("best", F.array_max(ranked))
        .select(
            "mention_id",
            "arrival_seq",
            "profile_id",
            F.col("best.weight").alias("best_weight"),
            (-F.col("best.order")).alias("best_seq"),
        )
    )


def joins(weight: Column, threshold: float, score: Score = scoring.match_probability) -> Column:
    """Whether a best link is good enough to join its cluster (inclusive)."""
    return F.coalesce(score(weight) >= F.lit(threshold), F.lit(False))


def roots(forest: DataFrame) -> DataFrame:
    """Root of every node by pointer jumping, two jumps per round: the depth falls to a third each time.

    `forest` is a written table of `node` and `parent` (itself for a root).  A parent outside the forest is final.
    """
    current = forest.select("node", "parent")
    while True:
        progress = Observation()
        upper = current.select(F.col("node").alias("parent"), F.col("parent").alias("upper"))
        jumped = current.join(upper, "parent", "left").select("node", F.coalesce("upper", "parent").alias("parent"))
        jumped = jumped.join(upper, "parent", "left").select(
            "node", F.coalesce("upper", "parent").alias("parent"), F.col("parent").alias("second")
        )
        # When the second jump changed nothing, the first one had reached every root.
        moved = F.col("parent") != F.col("second")
        current = cut(jumped, progress, F.count_if(moved).alias("moved")).select("node", "parent")
        if progress.get["moved"] == 0:
            return current.withColumnRenamed("parent", "root")


def assign(
    best: DataFrame, config: ResolverConfig, stored: DataFrame | None = None, score: Score = scoring.match_probability
) -> DataFrame:
    """Cluster of each new mention: its root's cluster.

    Every parent is the first mention of its profile, so only those take part in the pointer jumping.
    `stored` holds (arrival_seq, cluster_id) of mentions clustered before.
    """
    parent = F.when(joins(F.col("best_weight"), config.threshold, score), F.col("best_seq")).otherwise(F.col("arrival_seq"))
    edges = cut(best.withColumn("parent", parent))
    inner = edges.where(F.col("arrival_seq") == F.col("profile_id"))
    top = roots(inner.select(F.col("arrival_seq").alias("node"), "parent"))
    founders = edges.where(F.col("parent") == F.col("arrival_seq")).select(
        F.col("arrival_seq").alias("root"), F.col("mention_id").alias("cluster_id")
    )
    if stored is not None:
        founders = founders.unionByName(stored.select(F.col("arrival_seq").alias("root"), "cluster_id"))
    return (
        edges.join(top.withColumnRenamed("node", "parent"), "parent", "left")
        .withColumn("root", F.coalesce("root", "parent"))
        .join(founders, "root")
        .select("mention_id", "arrival_seq", "profile_id", "cluster_id", "best_weight", "best_seq")
    )


def earliest_mentions(mentions: DataFrame, top_n: int) -> DataFrame:
    """The first `top_n` mentions of every profile; later ones can never enter a `top_n` list."""
    order = Window.partitionBy("profile_id").orderBy("arrival_seq")
    return (
        mentions.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= top_n)
        .select(F.col("profile_id").alias("stored_profile"), "mention_id", "arrival_seq")
    )


def useful_links(links: DataFrame, top_n: int) -> DataFrame:
    """Links that can be among the best `top_n` of some mention: new_profile, stored_profile, match_weight, and `until`, the
    last arrival number of a stored mention that counts (NULL: any).  Partitioned by `new_profile` in one shuffle.

    A profile that arrived before the new one's first mention is known to all of its mentions, so of these links only the
    best `top_n` count, and where there are so many, later arrivals count only above the weight of the last of them.  Of one
    weight, the first `top_n` profiles have a mention each before any of a later one.
    """
    early, whole = F.col("stored_profile") < F.col("new_profile"), Window.partitionBy("new_profile")
    level = Window.partitionBy("new_profile", "match_weight")
    floor = F.max(F.when(early & (F.col("place") == top_n), F.col("match_weight"))).over(whole)
    nth = F.max(F.when(F.col("place") == top_n, F.col("stored_profile"))).over(level)
    return (
        links.select("new_profile", "stored_profile", "match_weight")
        .repartition("new_profile")
        .withColumn("place", F.row_number().over(whole.orderBy(early.desc(), F.col("match_weight").desc(), "stored_profile")))
        .withColumn("floor", floor)
        .where(F.when(early, F.col("place") <= top_n).otherwise(F.col("floor").isNull() | (F.col("match_weight") > F.col("floor"))))
        .withColumn("place", F.row_number().over(level.orderBy("stored_profile")))
        .where(F.col("place") <= top_n)
        .withColumn("until", F.least(nth, F.when(F.col("match_weight") <= F.col("floor"), F.col("new_profile"))))
        .select("new_profile", "stored_profile", "match_weight", "until")
    )


def top_links(mentions: DataFrame, links: DataFrame, top_n: int) -> DataFrame:
    """The best `top_n` links of each new mention to earlier ones (ties: earliest arrival first)."""
    order = Window.partitionBy("new_profile", "match_weight").orderBy("arrival_seq")
    first = earliest_mentions(mentions, top_n).groupBy("stored_profile").agg(F.collect_list(F.struct("arrival_seq", "mention_id")).alias("first"))
    counts = F.filter("first", lambda m: F.col("until").isNull() | (m["arrival_seq"] <= F.col("until")))
    choices = (
        useful_links(links, top_n)
        .join(first, "stored_profile")
        .select("new_profile", "match_weight", counts.alias("first"))
        .repartition("new_profile")
        .select("new_profile", "match_weight", F.inline("first"))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= top_n)
        .groupBy(F.col("new_profile").alias("profile_id"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct((-F.col("match_weight")).alias("order"), "arrival_seq", "mention_id")
                )
            ).alias("choices")
        )
    )
    earlier = F.filter("choices", lambda c: c["arrival_seq"] < F.col("new_seq"))
    return (
        _only_new(mentions)
        .select("profile_id", F.col("mention_id").alias("mention_id_l"), F.col("arrival_seq").alias("new_seq"))
        .join(choices, "profile_id")
        .select("mention_id_l", "new_seq", F.posexplode(F.slice(earlier, 1, top_n)).alias("position", "link"))
        .select(
            "mention_id_l",
            F.col("link.mention_id").alias("mention_id_r"),
            (-F.col("link.order")).alias("match_weight"),
            (F.col("position") + 1).alias("rank"),
            F.col("new_seq").alias("seq_l"),
            F.col("link.arrival_seq").alias("seq_r"),
        )
    )


def _front(offers: DataFrame, keys: list[str], top_n: int) -> DataFrame:
    """Offers that can be among the first `top_n` of some mention; all windows use the partitioning by `keys`.

    A cluster's offer counts only where no better one of it arrived earlier, and of one score only the first clusters do.
    """
    better = Window.partitionBy(*keys, "cluster_id").orderBy(F.col("match_weight").desc(), "first_seq")
    in_level = Window.partitionBy(*keys, "match_weight").orderBy("first_seq")
    earliest = F.min("first_seq").over(better.rowsBetween(Window.unboundedPreceding, -1))
    return (
        offers.withColumn("earliest", earliest)
        .where(F.col("earliest").isNull() | (F.col("first_seq") < F.col("earliest")))
        .drop("earliest")
        .withColumn("position", F.row_number().over(in_level))
        .where(F.col("position") <= top_n)
        .drop("position")
    )


def _fronts(links: DataFrame, seen: DataFrame, top_n: int, split_at: int | None = None) -> DataFrame:
    """The clusters that links offer to each profile, cut to what counts, partitioned by `new_profile`.

    Of a cluster and score only the first arrival counts, which tasks find among their own links before these are shuffled.
    Profiles with more than `split_at` links (HEAVY) are cut in parts by cluster before that, so no task gets more than about
    `split_at` links of one profile.  `links` is read twice.
    """
    split_at = split_at or HEAVY
    pooled = None
    if links.count() > split_at:
        counted = links.groupBy("new_profile").agg(F.count("*").alias("n")).where(F.col("n") > split_at)
        heavy = cut(counted.select("new_profile", F.ceil(F.col("n") / split_at).alias("parts")))
        part = F.pmod(F.xxhash64("cluster_id"), F.col("parts"))
        spread = links.join(heavy, "new_profile").join(seen, "stored_profile").withColumn("part", part)
        pooled = _front(spread.repartition("new_profile", "part"), ["new_profile", "part"], top_n)
        links = links.join(heavy, "new_profile", "left_anti")
    columns = ["new_profile", "match_weight", "cluster_id", "first_seq"]
    first = F.min("first_seq").alias("first_seq")
    offers = links.join(seen, "stored_profile").groupBy("new_profile", "match_weight", "cluster_id").agg(first).select(columns)
    if pooled is not None:
        offers = offers.unionByName(pooled.select(columns))
    return _front(offers.repartition("new_profile"), ["new_profile"], top_n)


def at_rest(score: Score) -> Score:
    """A score as a float, the form scores have at rest."""
    return lambda weight: score(weight).cast("float")


def seen_clusters(clusters: DataFrame, top_n: int) -> DataFrame:
    """The first `top_n` clusters of each profile, with the first arrival of its mentions there."""
    in_profile = Window.partitionBy("stored_profile").orderBy("first_seq")
    return (
        clusters.groupBy(F.col("profile_id").alias("stored_profile"), "cluster_id")
        .agg(F.min("arrival_seq").alias("first_seq"))
        .withColumn("position", F.row_number().over(in_profile))
        .where(F.col("position") <= top_n)
        .drop("position")
    )


def rank_candidates(
    mentions: DataFrame,
    links: DataFrame | Callable[[DataFrame], DataFrame],
    clusters: DataFrame,
    top_n: int,
    score: Score = scoring.match_probability,
) -> DataFrame:
    """Ranked candidate clusters of each new mention, from all its links to earlier mentions.

    A cluster scores its best link, as a float, the form scores have at rest; the own cluster is added at 0.0 before the
    cut.  Ties go to the cluster whose best-scoring link arrived first, as in `requery`.  `clusters` holds profile_id,
    arrival_seq, mention_id and cluster_id of all mentions.  Links that depend on the clusters of profiles are given as what
    finds them, from `seen_clusters`.
    """
    # links are many and the planner cannot foresee how few clusters there are: these move where their measured size is small
    measured = Observation()
    held = F.sum(F.octet_length("cluster_id") + SEEN_BYTES)
    seen = cut(seen_clusters(clusters, top_n), measured, F.coalesce(held, F.lit(0)).alias("bytes"))
    links = cut(links(seen)) if callable(links) else links
    links = links.select("new_profile", "stored_profile", at_rest(score)(F.col("match_weight")).alias("match_weight"))
    if measured.get["bytes"] <= blocking.SMALL_BYTES:
        seen = seen.hint("broadcast")
    offers = _fronts(links, seen, top_n)
    choices = (
        offers.groupBy("new_profile", "cluster_id")
        .agg(F.collect_list(F.struct((-F.col("match_weight")).alias("order"), "first_seq")).alias("steps"))
        .groupBy(F.col("new_profile").alias("profile_id"))
        .agg(F.collect_list(F.struct("cluster_id", "steps")).alias("choices"))
    )
    # Per mention everything happens inside one array: the best step of each cluster that had arrived, the own
    # cluster at the end of the order where nothing links to it, and the cut.
    ranked = """
        slice(sort_array(
          CASE WHEN exists(found, f -> f.cluster_id = own_cluster) THEN found
               ELSE concat(found, array(struct(float('Infinity') AS order, arrival_seq AS first_seq, own_cluster AS cluster_id)))
          END), 1, {top_n})"""
    found = """
        transform(
          filter(
            transform(
              coalesce(choices, array()),
              c -> struct(array_min(filter(c.steps, s -> s.first_seq < arrival_seq)) AS best, c.cluster_id AS cluster_id)),
            f -> f.best IS NOT NULL),
          f -> struct(f.best.order AS order, f.best.first_seq AS first_seq, f.cluster_id AS cluster_id))"""
    asked = _only_new(mentions).select("mention_id").join(clusters, "mention_id") if "is_new" in mentions.columns else clusters
    return (
        asked.select("mention_id", "arrival_seq", "profile_id", "cluster_id")
        .withColumnRenamed("cluster_id", "own_cluster")
        .join(choices, "profile_id", "left")
        .withColumn("found", F.expr(found))
        .select("mention_id", "arrival_seq", "own_cluster", F.posexplode(F.expr(ranked.format(top_n=top_n))).alias("position", "offer"))
        .select(
            "mention_id",
            "arrival_seq",
            "own_cluster",
            "offer.cluster_id",
            F.when(F.col("offer.order") == float("inf"), 0.0).otherwise(-F.col("offer.order")).cast("double").alias("score"),
            (F.col("position") + 1).alias("rank"),
        )
    )


def requery(stored_links: DataFrame, clusters: DataFrame, top_n: int, ids: DataFrame | None = None) -> DataFrame:
    """Candidates of resolved mentions from stored links, whichever end they are on.

    `stored_links` holds mention_id_l, mention_id_r and match_probability at rest (float), `clusters` mention_id,
    arrival_seq and cluster_id.  Ties go to the cluster whose best-scoring link arrived first.
    """
    owners, ends = clusters, links_either_side(stored_links)
    if ids is not None:
        owners, ends = owners.join(ids, "mention_id", "left_semi"), ends.join(ids, "mention_id", "left_semi")
    own = owners.select("mention_id", "cluster_id", F.lit(0.0).cast("float").alias("score"), "arrival_seq")
    linked = (
        ends.join(clusters.select(F.col("mention_id").alias("other_id"), "cluster_id", "arrival_seq"), "other_id")
        .select("mention_id", "cluster_id", F.col("match_probability").alias("score"), "arrival_seq")
    )
    order = Window.partitionBy("mention_id").orderBy(F.col("score").desc(), "first_seq", "cluster_id")
    best = F.min(F.struct((-F.col("score")).alias("order"), "arrival_seq"))
    return (
        linked.unionByName(own)
        .groupBy("mention_id", "cluster_id")
        .agg(F.max("score").alias("score"), best["arrival_seq"].alias("first_seq"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .drop("first_seq")
    )


def links_either_side(stored_links: DataFrame) -> DataFrame:
    """Each link once per end: the mention, the other end, the score."""
    forward = stored_links.select(
        F.col("mention_id_l").alias("mention_id"), F.col("mention_id_r").alias("other_id"), "match_probability"
    )
    backward = stored_links.select(
        F.col("mention_id_r").alias("mention_id"), F.col("mention_id_l").alias("other_id"), "match_probability"
    )
    return forward.unionByName(backward)


def members(clusters: DataFrame, slice_: int = 100_000) -> DataFrame:
    """Members of each cluster, one row each: cluster_id, members (its size), position in arrival order from 1, mention_id.

    Positions are counted within slices of arrival numbers, which start behind the members of all earlier slices, so the
    members of one huge cluster are numbered by many tasks.
    """
    sliced = clusters.select("cluster_id", "arrival_seq", "mention_id", F.floor(F.col("arrival_seq") / slice_).alias("slice"))
    sizes = sliced.groupBy("cluster_id", "slice").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("cluster_id")
    upto = F.sum("n").over(whole.orderBy("slice"))
    sizes = sizes.select("cluster_id", "slice", (upto - F.col("n")).alias("before"), F.sum("n").over(whole).alias("members"))
    nth = F.row_number().over(Window.partitionBy("cluster_id", "slice").orderBy("arrival_seq"))
    numbered = sliced.withColumn("nth", nth).join(sizes, ["cluster_id", "slice"])
    return numbered.select("cluster_id", "members", (F.col("nth") + F.col("before")).alias("position"), "mention_id")


def cluster_of(ids: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster of each asked id; an id that was never resolved is an error row, not a lost one."""
    return ids.join(clusters.select("mention_id", "cluster_id"), "mention_id", "left").withColumn(
        "lookup_error", F.when(F.col("cluster_id").isNull(), F.lit("The mention was never resolved"))
    )


def listing(clusters: DataFrame, mentions: DataFrame, name: str = "legal_name") -> DataFrame:
    """Members with their names, one row per mention.  The cluster table decides, not the top candidate."""
    return clusters.select("cluster_id", "mention_id").join(mentions.select("mention_id", name), "mention_id")

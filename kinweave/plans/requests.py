"""From request messages to responses: parse, map, guard, resolve, answer.  Errors are rows, never exceptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinweave.config import ResolverConfig
from kinweave.functions.text import mention_id, queue_wait_ms
from kinweave.operators import blocking, clustering, guards, scoring
from kinweave.plans.resolve import resolve, resolve_scored
from kinweave.session import cut
from kinweave.sources import requests
from kinweave.sources.tables import LINK_LAYOUT, of_ids

Mapper = Callable[[DataFrame], DataFrame]
#: (new mentions, stored mentions) -> mention_id_l, mention_id_r, match_probability: the links of new mentions.
Scorer = Callable[[DataFrame, DataFrame], DataFrame]
SETTLED_LAYOUT = "mention_id string, arrival_seq long, profile_id long, cluster_id string, best_weight double, best_seq long"
CANDIDATES = "array<struct<cluster_id:string,score:double>>"


@dataclass
class Stored:
    """What was resolved before: mentions with normalised copies, links at rest, clusters.

    `last_seq` is the largest arrival number among the mentions; it is looked up where it is not given.  `reach` gives the
    stored mentions, with cluster_id, that new ones (with normalised copies) may be matched with; without it they are sought
    among all.
    """

    mentions: DataFrame
    links: DataFrame
    clusters: DataFrame
    last_seq: int | None = None
    reach: Callable[[DataFrame], DataFrame] | None = None

    def last(self) -> int:
        if self.last_seq is None:
            self.last_seq = self.mentions.agg(F.coalesce(F.max("arrival_seq"), F.lit(-1))).first()[0]
        return self.last_seq


@dataclass
class Outcome:
    """Responses in request order, the rows the batch adds to the state, and the stored mentions it was matched with."""

    responses: DataFrame
    mentions: DataFrame
    links: DataFrame
    clusters: DataFrame
    events: DataFrame
    near: DataFrame | None = None


def read_requests(raw: DataFrame, config: ResolverConfig, mapper: Mapper) -> DataFrame:
    """Messages with mention id, entity fields, and error type and detail where a message is unusable.

    `raw` has `arrival_seq`, the unique position of the message, and `raw`.  `mapper` turns payloads (request_key,
    entity_type, content) into request_key, fields and mapping_error.
    """
    parsed = requests.parse(raw)
    payloads = parsed.where("parse_error is null").withColumnRenamed("arrival_seq", "request_key")
    mapped = mapper(payloads)
    absent = [F.lit(None).cast("string").alias(f) for f in config.entity_fields if f not in mapped.columns]
    kept = mapped.select(
        F.col("request_key").alias("arrival_seq"), "mapping_error", *[f for f in config.entity_fields if f in mapped.columns], *absent
    )
    error_type = F.when(F.col("parse_error").isNotNull(), requests.PROCESSING_ERROR).when(
        F.col("mapping_error").isNotNull(), requests.VALUE_ERROR
    )
    return (
        parsed.join(kept, "arrival_seq", "left")
        .withColumn("mention_id", mention_id(F.col("source_id"), F.col("request_id"), F.col("entity_type")))
        .withColumn("error_type", error_type)
        .withColumn("error_detail", F.coalesce("parse_error", "mapping_error"))
        .drop("content", "parse_error", "mapping_error")
    )


def in_reach(stored: DataFrame, new: DataFrame, config: ResolverConfig) -> DataFrame:
    """Stored mentions that share the equality keys of some rule with a new one; no other can be paired."""
    reached = []
    for rule in config.rules:
        keys = list(rule.keys)
        reached.append(stored.join(new.select(*keys).distinct(), keys, "left_semi"))
    return reached[0] if len(reached) == 1 else reduce(DataFrame.unionByName, reached).dropDuplicates(["mention_id"])


def _listed(ranked: DataFrame) -> DataFrame:
    """Ranked candidates as one array per mention (at most top_n entries)."""
    return ranked.groupBy("mention_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "cluster_id", F.col("score").cast("double").alias("score")))),
            lambda c: F.struct(c["cluster_id"].alias("cluster_id"), c["score"].alias("score")),
        ).alias("candidates")
    )


def process(
    raw: DataFrame,
    stored: Stored,
    config: ResolverConfig,
    mapper: Mapper,
    answered_at: Column | None = None,
    scorer: Scorer | None = None,
) -> Outcome:
    """One batch of requests against the stored state.

    Links come from the model of the settings, or from a `scorer` of the caller, whose scores are taken as they are; mentions
    are then not blocked, and only those that are linked are looked at.

    Whatever number a source gives its messages, everything stored counts as earlier: where the numbers of a batch start
    at or below the last stored one, its mentions are stored under numbers behind it.  Answers keep the messages' numbers.
    """
    answered_at = F.current_timestamp() if answered_at is None else answered_at
    messages = cut(read_requests(raw, config, mapper))
    fields = list(config.entity_fields)
    sound = blocking.with_normalised(messages.where("error_type is null"), config)
    seen = Observation()
    outcomes = (guards.NEW, guards.REPEAT, guards.IDEMPOTENT)
    judged = cut(
        guards.guard(sound, of_ids(stored.mentions, sound), fields),
        seen,
        *[F.count_if(F.col("guard") == outcome).alias(outcome) for outcome in outcomes],
        F.min(F.when(F.col("guard") == guards.NEW, F.col("arrival_seq"))).alias("first"),
    )
    shift = max(0, stored.last() + 1 - seen.get["first"]) if seen.get[guards.NEW] else 0
    columns = ["mention_id", "arrival_seq", *[c for c in stored.mentions.columns if c not in ("mention_id", "arrival_seq")]]
    new = judged.where(F.col("guard") == guards.NEW).withColumn("arrival_seq", F.col("arrival_seq") + shift).select(*columns)
    owners = stored.clusters.select("mention_id", "cluster_id", "arrival_seq")
    answers, near, score = [], None, scoring.match_probability
    if seen.get[guards.NEW]:
        if scorer is not None:
            scores = cut(scorer(new, stored.mentions).select("mention_id_l", "mention_id_r", "match_probability"))
            ends = scores.select(F.explode(F.array("mention_id_l", "mention_id_r")).alias("mention_id")).distinct()
            near, owned = stored.mentions.join(ends, "mention_id", "left_semi"), stored.clusters
        elif stored.reach is None:
            near, owned = in_reach(stored.mentions, new, config), stored.clusters
        else:
            near = cut(stored.reach(new))
            owned = near
        everything = (
            near.select(*columns)
            .withColumn("is_new", F.lit(False))
            .unionByName(new.withColumn("is_new", F.lit(True)))
        )
        if scorer is None:
            done = resolve(everything, config, owned)
        else:
            done = resolve_scored(everything, scores, config, owned)
            score = done.score
        links, settled = cut(done.stored_links()), done.clusters
        answers.append(_listed(done.candidates()).withColumn("guard", F.lit(guards.NEW)))
    else:
        links = raw.sparkSession.createDataFrame([], LINK_LAYOUT)
        settled = raw.sparkSession.createDataFrame([], SETTLED_LAYOUT)
    clusters = settled.select("mention_id", "arrival_seq", "cluster_id")
    # Stored mentions are answered from the state before the batch, repeats within it from the state after it.
    after = (stored.links.unionByName(links), owners.unionByName(clusters.select("mention_id", "cluster_id", "arrival_seq")))
    for outcome, (known_links, known_clusters) in ((guards.IDEMPOTENT, (stored.links, owners)), (guards.REPEAT, after)):
        if seen.get[outcome]:
            ids = judged.where(F.col("guard") == outcome).select("mention_id").distinct()
            ranked = clustering.requery(known_links, known_clusters, config.top_n, ids)
            answers.append(_listed(ranked).withColumn("guard", F.lit(outcome)))
    if not answers:
        answers.append(raw.sparkSession.createDataFrame([], f"mention_id string, candidates {CANDIDATES}, guard string"))
    envelope = ["arrival_seq", "request_id", "source_id", "entity_type", "ere_request_id"]
    answered = judged.join(reduce(DataFrame.unionByName, answers), ["mention_id", "guard"], "left")
    conflict = F.col("guard") == guards.CONFLICT
    detail = F.concat(F.lit("Mention "), F.col("mention_id"), F.lit(" was already submitted with other attributes"))
    responses = answered.select(
        *envelope,
        F.when(conflict, requests.error_response(F.lit(requests.CONFLICT_ERROR), detail, answered_at))
        .otherwise(requests.response(F.coalesce("candidates", F.array().cast(CANDIDATES)), answered_at))
        .alias("response"),
    ).unionByName(
        messages.where("error_type is not null").select(
            *envelope, requests.error_response(F.col("error_type"), F.col("error_detail"), answered_at).alias("response")
        )
    )
    return Outcome(
        responses=responses.select("arrival_seq", "ere_request_id", "response"),
        mentions=new,
        links=links,
        clusters=clusters,
        events=events(messages, judged, settled, links, answered_at, score),
        near=near,
    )


EVENT_FIELDS = {
    "payload_bytes": "int",
    "queue_wait_ms": "double",
    "guard": "string",
    "stored_links": "bigint",
    "best_score": "double",
    "decision": "string",
    "cluster_id": "string",
}


def events(
    messages: DataFrame,
    judged: DataFrame,
    clusters: DataFrame,
    links: DataFrame,
    answered_at: Column,
    score: Callable[[Column], Column] = scoring.match_probability,
) -> DataFrame:
    """Lifecycle events per request: ids, sizes, scores and decisions only, never attributes or content."""

    def stage(frame: DataFrame, name: str, *filled: Column) -> DataFrame:
        given = frame.select("arrival_seq", "ere_request_id", "mention_id", F.lit(name).alias("event"), *filled)
        return given.select(
            "arrival_seq",
            "ere_request_id",
            "mention_id",
            "event",
            *[
                (F.col(field) if field in given.columns else F.lit(None)).cast(kind).alias(field)
                for field, kind in EVENT_FIELDS.items()
            ],
        )

    sound = messages.where("error_type is null")
    counted = links.groupBy(F.col("mention_id_l").alias("mention_id")).agg(F.count("*").alias("stored_links"))
    joined = F.when(F.col("cluster_id") == F.col("mention_id"), "new").otherwise("join")
    settled = (
        judged.where(F.col("guard") == guards.NEW)
        .select("arrival_seq", "ere_request_id", "mention_id")
        .join(clusters.drop("arrival_seq"), "mention_id")
        .join(counted, "mention_id", "left")
    )
    return reduce(
        DataFrame.unionByName,
        [
            stage(
                messages,
                "dequeued",
                F.octet_length("raw").alias("payload_bytes"),
                queue_wait_ms(F.col("created_at"), answered_at).alias("queue_wait_ms"),
            ),
            stage(sound, "parsed"),
            stage(judged, "guard", F.col("guard")),
            stage(
                settled,
                "scored",
                F.coalesce("stored_links", F.lit(0)).alias("stored_links"),
                score(F.col("best_weight")).alias("best_score"),
            ),
            stage(settled, "clustered", joined.alias("decision"), F.col("cluster_id")),
            stage(settled, "persisted"),
            stage(messages, "responded"),
        ],
    )

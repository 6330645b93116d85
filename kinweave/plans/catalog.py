"""Registered queries: every operator over the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import config as settings
from kinweave.functions import text
from kinweave.operators import blocking, clustering, evaluation, guards, measures, scoring, training
from kinweave.plans.requests import Outcome, Stored, process, read_requests
from kinweave.plans.resolve import Linked, Resolution, link, resolve
from kinweave.session import cut, shared_folder
from kinweave.sources import mentions, ntriples, queue, rdf, requests, tables, views
from kinweave.streaming import guarding, resolver

TURNS_PER_CONVERSATION = 1 << 20
REPLAYED = 1 << 19
QUEUE_BYTES = 1 << 40
WINDOW = 2500
REPLAY_BATCHES = 3
EVENT_LAYOUT = "arrival_seq long, mention_id string, event string, guard string"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SUBMISSION_FIELDS = ["legal_name", "country_code"]


def parts_config() -> settings.ResolverConfig:
    return settings.shipped().with_fields(["legal_name", "country_code", "nuts_code", "post_code"])


def pages_config() -> settings.ResolverConfig:
    return settings.shipped().with_fields(["legal_name", "country_code", "nuts_code", "post_code", "post_name"])


def _link_parts(spark: SparkSession, folder: str) -> Linked:
    return link(views.parts(spark, folder), parts_config())


def _link_pages(spark: SparkSession, folder: str) -> Linked:
    return link(views.pages(spark, folder), pages_config())


def _parts(spark: SparkSession, folder: str, **changes) -> Resolution:
    return resolve(views.parts(spark, folder), replace(parts_config(), **changes))


def _grouped(spark: SparkSession, folder: str, **changes) -> Resolution:
    """Clusters of all parts, from their first links alone."""
    return resolve(views.parts(spark, folder), replace(parts_config(), **changes), ranked=False)


def _score(column: str):
    return F.round(F.col(column).cast("double"), 6)


def _long(frame: DataFrame) -> DataFrame:
    """Counts of pairs as 64-bit numbers, the type of the SQL they are compared with."""
    return frame.withColumns({f.name: F.col(f.name).cast("long") for f in frame.schema if f.dataType.typeName() == "decimal"})


# --- expressions -----------------------------------------------------------------------------------------------


def mention_id(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "customer").select(
        "c_custkey",
        text.mention_id(F.col("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit("ORGANISATION")).alias("mention_id"),
    )


def normalise_name(spark: SparkSession, folder: str) -> DataFrame:
    return views.documents(spark, folder).select("mention_id", text.normalise_name(F.col("legal_name")).alias("name"))


def queue_wait(spark: SparkSession, folder: str) -> DataFrame:
    taken = views.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("taken"))
    orders = views.table(spark, folder, "orders")
    return orders.join(taken, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey",
        text.queue_wait_ms(F.col("o_orderdate").cast("timestamp"), F.col("taken").cast("timestamp")).alias("queue_wait_ms"),
    )


# --- blocking and comparison -----------------------------------------------------------------------------------


def block_equality(spark: SparkSession, folder: str) -> DataFrame:
    return _long(evaluation.blocks(views.parts(spark, folder), ["country_code"]))


def block_compound(spark: SparkSession, folder: str) -> DataFrame:
    return _long(evaluation.blocks(views.parts(spark, folder), ["country_code", "nuts_code"]))


def block_multirule(spark: SparkSession, folder: str) -> DataFrame:
    return _long(evaluation.first_rule_counts(views.pages(spark, folder), [["country_code"], ["post_name"], ["legal_name"]]))


def block_prefix_address(spark: SparkSession, folder: str) -> DataFrame:
    mentions = cut(evaluation.with_name_keys(views.pages(spark, folder)))
    return _long(evaluation.first_rule_counts(mentions, PREFIX_ADDRESS_RULES))


def dedupe_pairs(spark: SparkSession, folder: str) -> DataFrame:
    mentions = evaluation.with_name_keys(views.documents(spark, folder))
    keyed = mentions.withColumn("name", F.sha2("name", 256))
    found = evaluation.blocks(keyed, ["country_code", "name"]).where("pairs > 0")
    return _long(found.select("first_mention", "mentions", "pairs"))


def block_name_similarity(spark: SparkSession, folder: str) -> DataFrame:
    mentions = evaluation.with_name_keys(views.parts(spark, folder))
    values = cut(evaluation.counted_values(mentions, ["country_code"]))
    return _rounded_similarity(evaluation.similar_names(values, ["country_code"], 0.8))


def jaro_winkler(spark: SparkSession, folder: str) -> DataFrame:
    mentions = evaluation.with_name_keys(views.pages(spark, folder))
    values = cut(evaluation.counted_values(mentions, ["country_code"]))
    return _rounded_similarity(evaluation.similar_names(values, ["country_code"], 0.8))


def _rounded_similarity(pairs: DataFrame) -> DataFrame:
    return _long(pairs.withColumn("similarity", F.round("similarity", 9)).drop("l_value", "r_value"))


def compare_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _link_pages(spark, folder).graded().drop("match_key")


def match_weight(spark: SparkSession, folder: str) -> DataFrame:
    links = _link_parts(spark, folder).links
    return links.select("new_profile", "stored_profile", _score("match_weight").alias("match_weight"))


def match_probability(spark: SparkSession, folder: str) -> DataFrame:
    config = parts_config()
    return (
        _link_parts(spark, folder)
        .patterns()
        .withColumn("match_probability", F.round(scoring.match_probability(F.col("match_weight")), 9))
        .drop("match_weight")
    )


def score_threshold(spark: SparkSession, folder: str) -> DataFrame:
    config = pages_config()
    kept = scoring.match_weight(config.model, config.comparisons) >= config.match_weight_threshold
    return _link_pages(spark, folder).graded_patterns().select(*scoring.gamma_columns(config), kept.alias("kept"), "pairs")


def multirule_links(spark: SparkSession, folder: str) -> DataFrame:
    links = link(views.pages(spark, folder), settings.multirule()).links
    return links.select("new_profile", "stored_profile", "match_key", _score("match_weight").alias("match_weight"))


def model_report(spark: SparkSession, folder: str) -> DataFrame:
    config = parts_config()
    patterns = _link_parts(spark, folder).patterns()
    levels = patterns.select(
        "links",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c.field).alias("field"), F.col(scoring.gamma(c.field)).alias("level"))
                    for c in config.comparisons
                ]
            )
        ).alias("seen"),
    )
    observed = levels.groupBy("seen.field", "seen.level").agg(F.sum("links").alias("links"))
    rows = spark.createDataFrame(
        scoring.parameter_rows(config.model, config.comparisons),
        "field string, level int, label string, m double, u double, weight double, source string",
    )
    return rows.join(observed, ["field", "level"], "left").select(
        "field", "level", "label", "m", "u", _score("weight").alias("weight"), "source", F.coalesce("links", F.lit(0)).alias("links")
    )


# --- clustering ------------------------------------------------------------------------------------------------


def best_match(spark: SparkSession, folder: str) -> DataFrame:
    linked = _link_parts(spark, folder)
    best = clustering.best_match(linked.mentions, linked.first()).where("best_seq is not null")
    names = linked.mentions.select(F.col("arrival_seq").alias("best_seq"), F.col("mention_id").alias("best_id"))
    return best.join(names, "best_seq").select(
        "mention_id", "best_id", F.round(scoring.match_probability(F.col("best_weight")), 6).alias("best_score")
    )


def greedy_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _grouped(spark, folder).clusters.select("mention_id", "cluster_id")


def cluster_members(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.members(_grouped(spark, folder).clusters)


def state_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    done = _parts(spark, folder)
    return _counters(done).select("mention_count", "similarity_count", "cluster_count")


def _counters(done: Resolution) -> DataFrame:
    clusters = done.clusters.select(
        F.lit(1).alias("mentions"),
        (F.col("cluster_id") != F.col("mention_id")).cast("int").alias("joined"),
        F.lit(0).alias("links"),
    )
    links = done.stored_links().select(F.lit(0).alias("mentions"), F.lit(0).alias("joined"), F.lit(1).alias("links"))
    return (
        clusters.unionByName(links)
        .agg(
            F.sum("mentions").alias("mention_count"),
            F.sum("links").alias("similarity_count"),
            F.sum("joined").alias("joins"),
        )
        .withColumn("cluster_count", F.col("mention_count") - F.col("joins"))
    )


def run_counters(spark: SparkSession, folder: str) -> DataFrame:
    return _counters(_parts(spark, folder)).selectExpr("mention_count mentions", "joins", "similarity_count stored_links")


def top_links(spark: SparkSession, folder: str) -> DataFrame:
    linked = _link_parts(spark, folder)
    best = clustering.top_links(linked.mentions, linked.best(5), 5)
    return best.select(
        "mention_id_l",
        "mention_id_r",
        F.round(scoring.match_probability(F.col("match_weight")), 6).alias("match_probability"),
        "rank",
    )


def rank_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = _grouped(spark, folder, top_n=3).candidates()
    return found.select("mention_id", "cluster_id", _score("score").alias("score"), "rank")


def top_candidate(spark: SparkSession, folder: str) -> DataFrame:
    found = _grouped(spark, folder).candidates().where("rank = 1")
    return found.select("mention_id", "cluster_id", _score("score").alias("score"))


def resolve_batch(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve(views.pages(spark, folder), pages_config(), ranked=False).candidates()
    return found.select("mention_id", "own_cluster", "cluster_id", _score("score").alias("score"), "rank")


def requery_candidates(spark: SparkSession, folder: str) -> DataFrame:
    done = _parts(spark, folder, top_n=5)
    found = clustering.requery(cut(done.stored_links()), done.clusters, 5)
    return found.select("mention_id", "cluster_id", _score("score").alias("score"), "rank")


def links_either_side(spark: SparkSession, folder: str) -> DataFrame:
    linked = _link_parts(spark, folder)
    stored = Resolution(linked, linked.mentions, linked.mentions, parts_config()).stored_links()
    return (
        clustering.links_either_side(cut(stored))
        .groupBy("mention_id")
        .agg(F.count("*").alias("links"), F.round(F.max("match_probability").cast("double"), 6).alias("best"))
    )


def clusters_for(spark: SparkSession, folder: str) -> DataFrame:
    done = _parts(spark, folder)
    linked = done.stored_links().select(F.col("mention_id_r").alias("mention_id"))
    return done.clusters.join(linked, "mention_id", "left_semi").select("mention_id", "cluster_id")


def cluster_lookup(spark: SparkSession, folder: str) -> DataFrame:
    asked = views.table(spark, folder, "conversations").select(F.concat(F.lit("p"), F.col("conv_id") * 25).alias("mention_id"))
    return clustering.cluster_of(asked.distinct(), _grouped(spark, folder).clusters)


def cluster_listing(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.listing(_grouped(spark, folder).clusters, views.parts(spark, folder))


# --- guards ----------------------------------------------------------------------------------------------------


def _submissions(spark: SparkSession, folder: str) -> DataFrame:
    arrival = F.col("conv_id") * TURNS_PER_CONVERSATION + F.col("turn")
    return views.submissions(spark, folder).withColumn("arrival_seq", arrival)


def _stored_submissions(incoming: DataFrame) -> DataFrame:
    return incoming.where((F.col("turn") == 0) & (F.col("country_code") == "user"))


def conflict_guard(spark: SparkSession, folder: str) -> DataFrame:
    incoming = _submissions(spark, folder)
    return guards.conflicts(incoming, _stored_submissions(incoming), SUBMISSION_FIELDS).select("mention_id", "turn")


def idempotent_split(spark: SparkSession, folder: str) -> DataFrame:
    incoming = _submissions(spark, folder)
    stored = _stored_submissions(incoming)
    seen = guards.already_stored(incoming, stored).withColumn("state", F.lit("stored"))
    return seen.unionByName(guards.unseen(incoming, stored).withColumn("state", F.lit("new"))).select(
        "mention_id", "turn", "state"
    )


def _replayed(incoming: DataFrame) -> DataFrame:
    """First turns arrive a second time, behind the other turns of their conversation."""
    again = incoming.where("turn = 0").withColumns(
        {"turn": F.col("turn") + REPLAYED, "arrival_seq": F.col("arrival_seq") + REPLAYED}
    )
    return incoming.unionByName(again)


def in_batch_guard(spark: SparkSession, folder: str) -> DataFrame:
    judged = guards.in_batch(_replayed(_submissions(spark, folder)), SUBMISSION_FIELDS)
    return judged.select("mention_id", "turn", "guard")


def stream_guard(spark: SparkSession, folder: str) -> DataFrame:
    """The same submissions through a message queue, in about four batches that share turns of conversations.

    They arrive turn by turn, so the turns of one conversation lie in several batches; which repeats find their record stored
    depends on the batches, so both kinds are `seen`.
    """
    incoming = _replayed(_submissions(spark, folder))
    record = ["mention_id", "turn", *SUBMISSION_FIELDS]
    by_turn = incoming.select(
        (F.col("turn") * TURNS_PER_CONVERSATION + F.col("conv_id")).alias("arrival_seq"), F.to_json(F.struct(*record)).alias("raw")
    )
    place = f"{shared_folder(spark)}/kinweave/{uuid.uuid4().hex}"
    queue.push(by_turn, f"{place}/queue")
    sent = queue.read_queue(spark, f"{place}/queue", max(by_turn.count() // 4, 1), QUEUE_BYTES)
    layout = incoming.select(record).schema
    records = sent.select("arrival_seq", F.from_json("raw", layout).alias("record")).select("arrival_seq", "record.*")
    key, store = guarding.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        told = guarding.guard_stream(records, SUBMISSION_FIELDS)
        query = (
            told.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/told").start()
        )
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    finally:
        spark.conf.set(key, before)
    seen = F.col("guard").isin(guards.REPEAT, guards.IDEMPOTENT)
    return spark.read.schema(told.schema).parquet(f"{place}/told").select(
        "mention_id",
        F.floor(F.col("arrival_seq") / TURNS_PER_CONVERSATION).alias("turn"),
        F.when(seen, "seen").otherwise(F.col("guard")).alias("guard"),
    )


# --- training --------------------------------------------------------------------------------------------------


def training_sample(spark: SparkSession, folder: str) -> DataFrame:
    return training.training_sample(views.parts(spark, folder), settings.DEFAULT_TRAIN_AT)


def gamma_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return training.pattern_table(training_sample(spark, folder), parts_config())


def em_train(spark: SparkSession, folder: str) -> DataFrame:
    return _parameters(spark, training.train(views.parts(spark, folder), parts_config()))


def _parameters(spark: SparkSession, config: settings.ResolverConfig) -> DataFrame:
    rows = spark.createDataFrame(
        scoring.parameter_rows(config.model, config.comparisons),
        "field string, level int, label string, m double, u double, weight double, source string",
    )
    return rows.withColumns({c: F.round(c, 6) for c in ("m", "u", "weight")})


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """The trained parameters written to model files and read again by settings that know only the hand-set ones."""
    path = f"{shared_folder(spark)}/kinweave/{uuid.uuid4().hex}"
    tables.save_model(spark, training.train(views.parts(spark, folder), parts_config()), path)
    loaded, origin, problem = tables.load_model(spark, parts_config(), path)
    return _parameters(spark, loaded).withColumns({"origin": F.lit(origin), "problem": F.lit(problem).cast("string")})


# --- evaluation ------------------------------------------------------------------------------------------------

# The rules of the variant that is evaluated.
PREFIX_ADDRESS_RULES = [["country_code", "prefix"], ["country_code", "post_code"], ["country_code", "nuts_code", "post_name"]]
# Blocking variants that are OR-ed equality rules, by name.
EQUALITY_VARIANTS = {
    "country": [["country_code"]],
    "prefix_address": PREFIX_ADDRESS_RULES,
    "prefix_post": PREFIX_ADDRESS_RULES[:2],
}


def pairs_per_mention(spark: SparkSession, folder: str) -> DataFrame:
    mentions = cut(evaluation.with_name_keys(views.pages(spark, folder)))
    total = mentions.count()
    counted = [
        evaluation.first_rule_counts(mentions, rules).agg(F.sum("pairs").alias("pairs")).withColumn("variant", F.lit(name))
        for name, rules in EQUALITY_VARIANTS.items()
    ]
    values = evaluation.counted_values(mentions, ["country_code"])
    similar = evaluation.similar_names(values, ["country_code"], 0.8).select("pairs")
    same = values.select(evaluation.pairs_of(F.col("mentions")).alias("pairs"))
    counted.append(
        similar.unionByName(same).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).withColumn("variant", F.lit("name_similarity"))
    )
    return _long(reduce(DataFrame.unionByName, counted)).select(
        "variant", "pairs", F.round(F.col("pairs") / F.lit(total), 6).alias("pairs_per_mention")
    )


def reference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    mentions = cut(evaluation.with_name_keys(views.parts(spark, folder)))
    exact = evaluation.exact_pairs(mentions).withColumn("reference", F.lit("exact"))
    variants = evaluation.variant_names(mentions).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    return _long(exact.unionByName(variants.withColumn("reference", F.lit("variant"))).select("reference", "pairs"))


def blocking_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Share of both reference sets that single equality rules admit."""
    mentions = cut(evaluation.with_name_keys(views.parts(spark, folder)))
    variants = cut(evaluation.variant_names(mentions))
    rows = []
    for rule in (["prefix"], ["post_code"], ["nuts_code"]):
        for reference, admitted, whole in (
            ("exact", evaluation.exact_pairs(mentions, rule), evaluation.exact_pairs(mentions)),
            (
                "variant",
                evaluation.agreeing_pairs(mentions, variants, ["country_code", "post_code"], [c for c in rule if c != "post_code"]),
                variants.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")),
            ),
        ):
            label = [F.lit(rule[0]).alias("rule"), F.lit(reference).alias("reference")]
            none = F.lit(0).cast("long")
            rows.append(admitted.select(*label, F.col("pairs").alias("admitted"), none.alias("reference_pairs")))
            rows.append(whole.select(*label, none.alias("admitted"), F.col("pairs").alias("reference_pairs")))
    return (
        _long(reduce(DataFrame.unionByName, rows))
        .groupBy("rule", "reference")
        .agg(F.sum("admitted").alias("admitted"), F.sum("reference_pairs").alias("reference_pairs"))
        .withColumn("recall", F.round(F.try_divide("admitted", "reference_pairs"), 6))
    )


def _clustered(spark: SparkSession, folder: str, done: Resolution) -> DataFrame:
    named = evaluation.with_name_keys(views.parts(spark, folder))
    return cut(named.join(done.clusters.select("mention_id", "cluster_id"), "mention_id"))


def cluster_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _recall_of(_clustered(spark, folder, _grouped(spark, folder)))


def _recall_of(mentions: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """`similar` holds the similar names of the blocks by country, where they are known already."""
    if similar is None:
        keys, also = ["country_code", "post_code"], []
        variants = cut(evaluation.variant_names(mentions))
        whole_variants = variants.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    else:
        keys, also = ["country_code"], ["post_code"]
        variants = similar.where(F.col("similarity") >= evaluation.VARIANT_SIMILARITY)
        whole_variants = evaluation.agreeing_pairs(mentions, variants, keys, also)
    none = F.lit(0).cast("long")
    rows = []
    for reference, together, whole in (
        ("exact", evaluation.exact_pairs(mentions, ["cluster_id"]), evaluation.exact_pairs(mentions)),
        (
            "variant",
            evaluation.agreeing_pairs(mentions, variants, keys, [*also, "cluster_id"]),
            whole_variants,
        ),
    ):
        label = F.lit(reference).alias("reference")
        rows.append(together.select(label, F.col("pairs").alias("together"), none.alias("reference_pairs")))
        rows.append(whole.select(label, none.alias("together"), F.col("pairs").alias("reference_pairs")))
    return (
        _long(reduce(DataFrame.unionByName, rows))
        .groupBy("reference")
        .agg(F.sum("together").alias("together"), F.sum("reference_pairs").alias("reference_pairs"))
        .withColumn("recall", F.round(F.try_divide("together", "reference_pairs"), 6))
    )


def unrelated_merges(spark: SparkSession, folder: str) -> DataFrame:
    return _long(evaluation.unrelated_pairs(_clustered(spark, folder, _grouped(spark, folder))))


def co_clustered_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _long(evaluation.co_clustered(_grouped(spark, folder).clusters))


def evaluate_variant(spark: SparkSession, folder: str) -> DataFrame:
    """One report (measure, value) of blocking and clustering with the shipped rules, from one similarity join over its blocks."""
    done = _parts(spark, folder)
    mentions = _clustered(spark, folder, done)
    keys = ["country_code"]
    values = evaluation.counted_values(mentions, keys)
    similar = cut(evaluation.similar_names(values, keys, evaluation.UNRELATED_BELOW))
    same = values.select(evaluation.pairs_of(F.col("mentions")).alias("pairs"))
    admitted = similar.select("pairs").unionByName(same).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("v"))
    merged = evaluation.co_clustered(done.clusters).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("v"))
    # clusters lie within blocks, as links do
    unrelated = evaluation.unrelated_pairs(mentions, similar, keys).agg(F.coalesce(F.sum("unrelated"), F.lit(0)).alias("v"))
    counters = _counters(done).select(
        F.explode(
            F.create_map(
                F.lit("mentions"), "mention_count", F.lit("joins"), "joins", F.lit("stored_links"), "similarity_count"
            )
        ).alias("measure", "v")
    )
    recall = _recall_of(mentions, similar).select(
        F.explode(
            F.create_map(
                F.concat("reference", F.lit("_pairs")), "reference_pairs", F.concat("reference", F.lit("_together")), "together"
            )
        ).alias("measure", "v")
    )
    single = [("admitted_pairs", admitted), ("merged_pairs", merged), ("unrelated_pairs", unrelated)]
    parts = [_long(frame).select(F.lit(name).alias("measure"), "v") for name, frame in single]
    return reduce(DataFrame.unionByName, [*parts, counters, recall]).withColumnRenamed("v", "value")


# --- requests and RDF ------------------------------------------------------------------------------------------

SEGMENT_PREFIXES = {"AUTOMOBILE": "epo", "BUILDING": "org", "FURNITURE": "locn", "MACHINERY": "cccev", "HOUSEHOLD": "other"}
SOURCE_ID = "portal"
CREATED_AT = "2024-01-01 00:00:00"


def _page_requests(spark: SparkSession, folder: str) -> DataFrame:
    created = F.lit(CREATED_AT).cast("timestamp")
    return requests.render(views.pages(spark, folder), F.lit(SOURCE_ID), created)


def request_render(spark: SparkSession, folder: str) -> DataFrame:
    return _page_requests(spark, folder)


def request_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = requests.parse(_page_requests(spark, folder).select("arrival_seq", "raw"))
    return parsed.select(
        "arrival_seq", "request_id", "source_id", "entity_type", "ere_request_id", F.sha2("content", 256).alias("content_hash")
    )


def rdf_prefix_resolve(spark: SparkSession, folder: str) -> DataFrame:
    prefix = F.create_map(*[F.lit(part) for pair in SEGMENT_PREFIXES.items() for part in pair])[F.col("c_mktsegment")]
    name = F.concat_ws(":", prefix, "c_name")
    return views.table(spark, folder, "customer").select("c_custkey", rdf.resolved(name, rdf.NAMESPACES).alias("iri"))


def rdf_property_path(spark: SparkSession, folder: str) -> DataFrame:
    parsed = requests.parse(_page_requests(spark, folder).select("arrival_seq", "raw"))
    payloads = parsed.withColumnRenamed("arrival_seq", "request_key")
    return rdf.turtle_mapper(rdf.shipped_hops())(payloads)


def rdf_ntriples(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as N-Triples lines: its text, its language, its source as a node; short texts lack the last dot."""
    docs = views.table(spark, folder, "documents")
    subject, end = F.concat(F.lit("<urn:doc:"), "doc_id", F.lit("> ")), F.when(F.length("text") < 200, "").otherwise(" .")
    text = F.concat(subject, F.lit(f'<{rdf.NAMESPACES["epo"]}hasLegalName> "'), ntriples.escaped(F.col("text")), F.lit('"'), end)
    language = F.concat(subject, F.lit('<urn:lang> "'), ntriples.escaped(F.col("lang")), F.lit('"@en .'))
    source = F.concat(F.lit("_:b"), "doc_id", F.lit(" <urn:source> <urn:"), "source", F.lit("> . # node"))
    content = F.concat_ws("\n", F.lit("# a document"), *[F.coalesce(part, F.lit("#")) for part in (text, language, source)])
    found = ntriples.triples(docs.select(F.col("doc_id").alias("request_key"), content.alias("content")))
    return found.select("request_key", "line", "s", "p", F.md5("o").alias("o_md5"), "o_kind", "error")


def _supplier_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every supplier once, some again, some with another name, in arrival order; some broken, some with payloads that no
    reader can take: a character that does not exist, and brackets that open by the thousand."""
    mentions = views.suppliers(spark, folder)
    balance = views.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("arrival_seq"), "s_acctbal")
    known = mentions.join(balance, "arrival_seq")
    renamed = known.where("s_acctbal < 0").withColumn("legal_name", F.concat("legal_name", F.lit(" (renamed)")))
    created = F.lit(CREATED_AT).cast("timestamp")

    def rendered(rows: DataFrame, step: int) -> DataFrame:
        messages = requests.render(rows, F.lit(SOURCE_ID), created)
        return messages.select((F.col("arrival_seq") * 8 + step).alias("arrival_seq"), "raw")

    broken = rendered(known.where("s_acctbal > 9000"), 3).withColumn("raw", F.concat(F.lit("{"), "raw"))
    repeated = rendered(known.where("s_acctbal > 5000"), 1)
    odd = {4: ("epo:hasLegalName ", '\\"\\\\uD800\\" , '), 5: ("epo:hasLegalName ", "[ epo:x " * 3000)}
    unreadable = [
        rendered(known.where(f"s_acctbal BETWEEN {at} AND {at + 1000}"), step).withColumn(
            "raw", F.replace("raw", F.lit(word), F.lit(word + more))
        )
        for at, (step, (word, more)) in zip((3000, 6000), odd.items())
    ]
    sent = [rendered(known, 0), repeated, rendered(renamed, 2), broken, *unreadable]
    return cut(reduce(DataFrame.unionByName, sent))


def _processed(spark: SparkSession, folder: str) -> Outcome:
    config = settings.shipped()
    stored = Stored(
        spark.createDataFrame([], tables.mention_layout(config)),
        spark.createDataFrame([], tables.LINK_LAYOUT),
        spark.createDataFrame([], tables.CLUSTER_LAYOUT),
    )
    return process(_supplier_messages(spark, folder), stored, config, rdf.turtle_mapper(rdf.shipped_hops()))


def _answers(responses: DataFrame) -> DataFrame:
    offers = "array<struct<cluster_id string, confidence_score double>>"
    answer = F.from_json("response", f"type string, error_type string, candidates {offers}")
    first = F.try_element_at("r.candidates", F.lit(1))
    return responses.withColumn("r", answer).select(
        "arrival_seq",
        "ere_request_id",
        "r.type",
        "r.error_type",
        F.when(F.col("r.candidates").isNotNull(), F.size("r.candidates")).alias("candidates"),
        first["cluster_id"].alias("top_cluster"),
        F.round(first["confidence_score"], 6).alias("top_score"),
        F.sha2(F.array_join("r.candidates.cluster_id", ","), 256).alias("order_digest"),
    )


def process_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every answer: its best cluster and score, and a digest of all its clusters in their order."""
    return _answers(_processed(spark, folder).responses)


def stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The supplier messages in three batches through state tables, with a restart after each and a batch that runs again.

    Every answer with its error; for new mentions also the offered clusters and the stored cluster.  None depends on the batches.
    """
    config = replace(settings.shipped(), auto_train_threshold=0)
    sent = _supplier_messages(spark, folder)
    low, high = sent.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    place = f"{shared_folder(spark)}/kinweave/{uuid.uuid4().hex}"
    mapper = rdf.turtle_mapper(rdf.shipped_hops())
    if high is not None:
        step = (high - low) // REPLAY_BATCHES + 1
        for number in (0, 1, 1, 2):
            state = tables.StateTables(spark, place, config)
            batch = sent.where(F.col("arrival_seq").between(low + number * step, low + (number + 1) * step - 1))
            resolver.resolve_micro_batch(state, mapper, batch, number, "replay")
    state = tables.StateTables(spark, place, config)
    told = state.table("events", EVENT_LAYOUT).where("event = 'guard'").select("arrival_seq", "mention_id", "guard")
    owners = state.clusters().select("mention_id", "cluster_id")
    new = told.where(F.col("guard") == guards.NEW).join(owners, "mention_id").select("arrival_seq", "cluster_id")
    answers = _answers(state.table("responses", resolver.RESPONSE_LAYOUT)).join(new, "arrival_seq", "left")
    shown = F.col("cluster_id").isNotNull()
    return answers.withColumns({c: F.when(shown, F.col(c)) for c in ("candidates", "top_cluster", "top_score", "order_digest")})


def resolve_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The first half of the parts is stored, then the second half resolved against it; clusters of all."""
    config, parts = parts_config(), views.parts(spark, folder)
    half = parts.agg(F.floor((F.min("arrival_seq") + F.max("arrival_seq")) / 2)).first()[0]
    stored = resolve(parts.where(F.col("arrival_seq") <= half), config).clusters.select("mention_id", "cluster_id")
    later = resolve(parts.withColumn("is_new", F.col("arrival_seq") > half), config, stored)
    return stored.unionByName(later.clusters.select("mention_id", "cluster_id"))


def request_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of unknown entity types, without a type, without an id, and of other message types, by market segment."""
    customers = views.table(spark, folder, "customer")
    kinds = {
        "AUTOMOBILE": (requests.REQUEST_TYPE, "VEHICLE", True),
        "BUILDING": (None, "ORGANISATION", True),
        "FURNITURE": (requests.REQUEST_TYPE, "ORGANISATION", False),
        "MACHINERY": ("RebuildRequest", "ORGANISATION", True),
    }

    def by_segment(place: int) -> Column:
        pairs = [F.lit(x) for segment, kind in kinds.items() for x in (segment, kind[place]) if kind[place] is not None]
        return F.try_element_at(F.create_map(*pairs), F.col("c_mktsegment"))

    key = F.col("c_custkey").cast("string")
    named = F.coalesce(by_segment(2), F.lit(True))
    ids = F.struct(
        F.when(named, key).alias("request_id"), F.lit(SOURCE_ID).alias("source_id"), F.coalesce(by_segment(1), F.lit("PERSON")).alias("entity_type")
    )
    mention = F.struct(ids.alias("identifiedBy"), F.lit("<a> a <b> .").alias("content"), F.lit(requests.CONTENT_TYPE).alias("content_type"))
    body = F.to_json(F.struct(F.coalesce(by_segment(0), F.when(F.col("c_mktsegment") == "HOUSEHOLD", requests.REQUEST_TYPE)).alias("type"), mention.alias("entity_mention")))
    raw = customers.select(F.col("c_custkey").alias("arrival_seq"), body.alias("raw"))
    read = read_requests(raw, settings.shipped(), rdf.turtle_mapper(rdf.shipped_hops()))
    return read.select("arrival_seq", "request_id", "error_type", "error_detail")


def corpus_growth(spark: SparkSession, folder: str) -> DataFrame:
    """Parts grown three-fold, counted by cycle and brand."""
    grown = evaluation.synthetic_corpus(views.parts(spark, folder), 3)
    cycle = F.substring_index("mention_id", "-", -1).cast("int")
    return grown.groupBy(cycle.alias("cycle"), "country_code").agg(
        F.count("*").alias("mentions"), F.min("arrival_seq").alias("first_seq"), F.countDistinct("legal_name").alias("names")
    )


def random_pair_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of random pairs of the training sample."""
    sample, config = training_sample(spark, folder), parts_config()
    return training.patterns(training.random_pairs(sample, [c.field for c in config.comparisons]), config)


def mention_files(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers written as a CSV file and read again."""
    path = f"{shared_folder(spark)}/kinweave/{uuid.uuid4().hex}"
    columns = ["mention_id", "arrival_seq", "legal_name", "country_code", "nuts_code"]
    views.suppliers(spark, folder).select(columns).write.option("header", True).csv(path)
    return mentions.read_csv(spark, path, columns, columns[2:])


def lifecycle_events(spark: SparkSession, folder: str) -> DataFrame:
    found = _processed(spark, folder).events
    return found.groupBy("event", "guard", "decision").agg(
        F.count("*").alias("events"), F.sum("stored_links").alias("stored_links"), F.round(F.max("best_score"), 6).alias("best_score")
    )


# --- request log -----------------------------------------------------------------------------------------------


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = measures.latency_summary(views.table(spark, folder, "events"), "value")
    return summary.withColumns({c: F.round(c, 6) for c in ("mean_ms", "stdev_ms")})


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """Summary and records of the request log written as JSON and read again, with what the read records add up to."""
    path = f"{shared_folder(spark)}/kinweave/{uuid.uuid4().hex}"
    records = views.table(spark, folder, "events").select("event_id", "event_type", "value")
    summary = measures.latency_summary(records, "value")
    measures.write_report(summary, records, path)
    read = spark.read.schema(records.schema).json(f"{path}/records").agg(
        F.count("event_id").alias("read_records"), F.countDistinct("event_type").alias("read_types"), F.max("value").alias("read_max_ms")
    )
    written = spark.read.schema(summary.schema).json(f"{path}/summary")
    return written.withColumns({c: F.round(c, 6) for c in ("mean_ms", "stdev_ms")}).crossJoin(F.broadcast(read))


def growth_profile(spark: SparkSession, folder: str) -> DataFrame:
    events = views.table(spark, folder, "events")
    profile = measures.growth_profile(
        events, "event_id", "value", WINDOW, [F.count_if(F.col("event_type") == "click").alias("clicks")]
    )
    return profile.withColumn("mean_ms", F.round("mean_ms", 6))


def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    events = views.table(spark, folder, "events")
    summary = measures.batch_summary(events, "user_id", "props", "event_type", "value", EVENT_TYPES)
    return summary.withColumns({c: F.round(c, 4) for c in ("total_ms", *[f"{e}_ms" for e in EVENT_TYPES])})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        greedy_clusters,
        resolve_incremental,
        mention_id,
        normalise_name,
        queue_wait,
        block_equality,
        block_compound,
        block_multirule,
        block_prefix_address,
        block_name_similarity,
        dedupe_pairs,
        jaro_winkler,
        compare_levels,
        match_weight,
        match_probability,
        score_threshold,
        multirule_links,
        model_report,
        best_match,
        cluster_members,
        state_snapshot,
        run_counters,
        top_links,
        rank_candidates,
        top_candidate,
        resolve_batch,
        requery_candidates,
        links_either_side,
        clusters_for,
        cluster_lookup,
        cluster_listing,
        conflict_guard,
        idempotent_split,
        in_batch_guard,
        stream_guard,
        training_sample,
        gamma_patterns,
        random_pair_levels,
        em_train,
        model_files,
        corpus_growth,
        pairs_per_mention,
        reference_pairs,
        blocking_recall,
        cluster_recall,
        unrelated_merges,
        co_clustered_pairs,
        evaluate_variant,
        request_render,
        request_parse,
        rdf_prefix_resolve,
        rdf_property_path,
        rdf_ntriples,
        request_errors,
        mention_files,
        process_requests,
        stream_replay,
        lifecycle_events,
        latency_summary,
        report_files,
        growth_profile,
        batch_summary,
    )
}

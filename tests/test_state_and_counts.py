"""State that is not lost, answers that do not vanish, counts that are exact."""

import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinweave import config
from kinweave.operators import clustering, evaluation
from kinweave.plans.requests import Stored, process
from kinweave.plans.resolve import resolve_scored
from kinweave.session import cut, scratch, shared_folder
from kinweave.sources import rdf, requests, tables
from kinweave.streaming import resolver

MAPPER = rdf.turtle_mapper(rdf.shipped_hops())
TURTLE = (
    "@prefix org: <http://www.w3.org/ns/org#> . @prefix epo: <http://data.europa.eu/a4g/ontology#> . "
    '@prefix cccev: <http://data.europa.eu/m8g/> . <http://e.org/x> a org:Organization ; epo:hasLegalName "{name}" ; '
    'cccev:registeredAddress [ epo:hasCountryCode "DEU" ] .'
)


def message(number, name, content=None, **ids):
    known = {"request_id": f"r{number}", "source_id": "t", "entity_type": "ORGANISATION"} | ids
    known = {k: v for k, v in known.items() if v is not None}
    body = {"identifiedBy": known, "content": content or TURTLE.replace("{name}", name), "content_type": "text/turtle"}
    return number, json.dumps({"type": requests.REQUEST_TYPE, "entity_mention": body, "ere_request_id": f"e{number}"})


def frame(spark, rows):
    return spark.createDataFrame(rows, "arrival_seq long, raw string")


def nothing_stored(spark, settings):
    return Stored(
        spark.createDataFrame([], tables.mention_layout(settings)),
        spark.createDataFrame([], tables.LINK_LAYOUT),
        spark.createDataFrame([], tables.CLUSTER_LAYOUT),
    )


def answers(outcome):
    found = outcome.responses.collect()
    assert len({r.arrival_seq for r in found}) == len(found)
    return {r.arrival_seq: json.loads(r.response) for r in found}


def test_every_request_is_answered_whatever_it_lacks(spark):
    settings = config.shipped()
    surrogate = TURTLE.replace("{name}", "a\\uD800b")
    rows = [
        message(1, "Acme Industries"),
        message(2, "Acme Industries", request_id=None),
        message(3, "Acme Industries", source_id=None),
        message(4, "Acme Industries", entity_type=None),
        message(5, "", content=surrogate),
        message(6, "", content="[ " * 100_000),
        message(7, "Acme Industries"),
        message(8, "", content=TURTLE.replace("{name}", "Deep")[:-1] + "; epo:x " + "[ epo:x " * 5000 + '"v"' + " ]" * 5000 + " ."),
    ]
    done = answers(process(frame(spark, rows), nothing_stored(spark, settings), settings, MAPPER))
    assert sorted(done) == list(range(1, 9))
    assert {n: a.get("error_type") for n, a in done.items()} == {
        1: None, 2: "ProcessingError", 3: "ProcessingError", 4: "ProcessingError", 5: "ValueError", 6: "ValueError", 7: None, 8: None,
    }
    assert done[7]["candidates"][0]["confidence_score"] > 0.9


def test_stored_mentions_are_earlier_whatever_their_numbers(spark):
    settings = config.shipped()
    first = process(frame(spark, [message(50, "Acme Industries")]), nothing_stored(spark, settings), settings, MAPPER)
    stored = Stored(cut(first.mentions), cut(first.links), cut(first.clusters))
    second = process(frame(spark, [message(7, "Acme Industries"), message(8, "Acme Industries")]), stored, settings, MAPPER)
    founder = stored.clusters.first().cluster_id
    assert {r.cluster_id for r in second.clusters.collect()} == {founder}
    assert sorted(answers(second)) == [7, 8]
    assert min(r.arrival_seq for r in second.mentions.collect()) > 50
    told = {r.arrival_seq for r in second.events.collect()}
    assert told == {7, 8}


def test_repeated_requests_get_the_order_of_the_first_answer(spark):
    """Three names at equal distance: ties go by arrival in first answers and in repeats."""
    settings = replace(config.shipped(), threshold=0.999999)
    names = ["Zeta Holding Berlin A", "Zeta Holding Berlin B", "Zeta Holding Berlin C", "Zeta Holding Berlin X"]
    done = process(frame(spark, [message(n, name) for n, name in enumerate(names)]), nothing_stored(spark, settings), settings, MAPPER)
    stored = Stored(cut(done.mentions), cut(done.links), cut(done.clusters))
    again = process(frame(spark, [(9, message(3, names[3])[1])]), stored, settings, MAPPER)
    first, repeat = answers(done)[3]["candidates"], answers(again)[9]["candidates"]
    assert [c["cluster_id"] for c in first] == [c["cluster_id"] for c in repeat] and len(first) == 4
    assert [c["confidence_score"] for c in first] == pytest.approx([c["confidence_score"] for c in repeat])


def test_links_of_the_callers_scorer(spark):
    """Names do not count: a table of links decides, for stored mentions and within the batch."""
    from kinweave.functions.text import mention_id

    settings = replace(config.shipped(), threshold=0.7)
    ids = spark.range(6).select(F.concat(F.lit("r"), "id").alias("r"), "id").select(
        "id", mention_id(F.lit("t"), F.col("r"), F.lit("ORGANISATION")).alias("m")
    )
    known = {r.id: r.m for r in ids.collect()}
    wanted = [(1, 0, 0.9), (2, 1, 0.7), (3, 0, 0.4), (4, 3, 0.69), (5, 2, 0.8), (5, 3, 0.95)]
    rows = [(known[a], known[b], p) for a, b, p in wanted]
    scores = spark.createDataFrame(rows, "mention_id_l string, mention_id_r string, match_probability double").persist()

    def scorer(new, stored):
        return scores.join(new.select(F.col("mention_id").alias("mention_id_l")), "mention_id_l", "left_semi")

    def batch(numbers, stored):
        raw = frame(spark, [message(n, f"Name {n}") for n in numbers])
        return process(raw, stored, settings, MAPPER, scorer=scorer)

    first = batch(range(3), nothing_stored(spark, settings))
    stored = Stored(cut(first.mentions), cut(first.links), cut(first.clusters))
    second = batch(range(3, 6), stored)
    found = {r.mention_id: r.cluster_id for f in (first, second) for r in f.clusters.collect()}
    assert {n: found[m] for n, m in known.items()} == {
        0: known[0], 1: known[0], 2: known[0], 3: known[3], 4: known[4], 5: known[3],
    }
    last = answers(second)[5]["candidates"]
    assert [(c["cluster_id"], round(c["confidence_score"], 4)) for c in last] == [(known[3], 0.95), (known[0], 0.8)]
    told = {r.mention_id: r.best_score for r in second.events.where("event = 'scored'").collect()}
    assert told == {known[3]: 0.4, known[4]: 0.69, known[5]: 0.95}


def run(spark, folder, checkpoint, settings):
    state = tables.StateTables(spark, f"{folder}/state", settings)
    resolver.start(resolver.message_stream(spark, f"{folder}/in"), state, MAPPER, f"{folder}/{checkpoint}", availableNow=True).awaitTermination()
    return state


def entries(spark):
    base = f"{shared_folder(spark)}/kinweave".removeprefix("file:")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_a_new_checkpoint_adds_to_the_state(spark, tmp_path):
    folder, settings = str(tmp_path), replace(config.shipped(), auto_train_threshold=0)
    frame(spark, [message(n, f"Acme {n}") for n in (1, 2)]).coalesce(1).write.json(f"{folder}/in")
    before = entries(spark)
    state = run(spark, folder, "first", settings)
    assert sorted(r.arrival_seq for r in state.mentions().collect()) == [1, 2]
    # the new stream reads both files: what is stored is answered, what is new is added
    frame(spark, [message(3, "Other words")]).coalesce(1).write.mode("append").json(f"{folder}/in")
    state = run(spark, folder, "second", settings)
    assert state.mentions().count() == 3 == state.clusters().count()
    assert state.commits().select("run").distinct().count() == 2
    assert state.number_of("another", 0) == state.commits().count()
    # every micro-batch has removed its intermediate tables
    assert entries(spark) == before


def test_a_committed_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    settings = replace(config.shipped(), auto_train_threshold=0)
    state = tables.StateTables(spark, str(tmp_path), settings)
    for _ in range(2):
        resolver.resolve_micro_batch(state, MAPPER, frame(spark, [message(1, "Acme")]), 0, "a")
    resolver.resolve_micro_batch(state, MAPPER, frame(spark, [message(2, "Beta")]), 0, "b")
    assert sorted(r.arrival_seq for r in state.mentions().collect()) == [1, 2]
    assert [r.batch_id for r in state.commits().orderBy("batch_id").collect()] == [0, 1]


def test_scratch_tables_are_removed(spark):
    before = entries(spark)
    with scratch(spark):
        kept = cut(spark.range(5)).count()
    assert kept == 5 and entries(spark) == before


@pytest.mark.parametrize("size", [0, 1, 2, 3, 300_000_007, 1_000_000_007, 4_000_000_000, 2**62 + 1])
def test_pairs_of_large_groups_are_exact(spark, size):
    assert int(spark.range(1).select(evaluation.pairs_of(F.lit(size).cast("long"))).first()[0]) == size * (size - 1) // 2


def test_given_scores_are_kept_and_compared_as_they_are(spark):
    mentions = spark.createDataFrame([(f"m{i}", i) for i in range(101)], "mention_id string, arrival_seq long")
    for score in (0.0, 0.07, 0.29, 0.57, 0.58, 0.73, 1.0):
        scores = spark.createDataFrame([("m1", "m0", score)], "mention_id_l string, mention_id_r string, match_probability double")
        done = resolve_scored(mentions.limit(2), scores, replace(config.shipped(), threshold=score))
        assert {r.cluster_id for r in done.clusters.collect()} == {"m0"}, score
        assert done.stored_links().first().match_probability == pytest.approx(score)


def test_members_are_numbered_across_slices(spark):
    rows = [(f"m{i}", 3 * i, "ab"[i % 5 == 0]) for i in range(200)]
    frame_ = spark.createDataFrame(rows, "mention_id string, arrival_seq long, cluster_id string")
    for slice_ in (7, 100_000):
        found = clustering.members(frame_, slice_).orderBy("cluster_id", "position").collect()
        for name in "ab":
            own = [m for m, _, c in rows if c == name]
            listed = [r for r in found if r.cluster_id == name]
            assert [r.mention_id for r in listed] == own and [r.position for r in listed] == list(range(1, len(own) + 1))
            assert {r.members for r in listed} == {len(own)}

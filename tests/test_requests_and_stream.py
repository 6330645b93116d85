import json

import pytest
from pyspark.sql import functions as F

from kinweave import config
from kinweave.operators import training
from kinweave.plans.requests import Stored, process
from kinweave.sources import mentions, rdf, requests, tables
from kinweave.streaming import resolver

MAPPED = rdf.shipped_hops()
MAPPER = rdf.turtle_mapper(MAPPED)
PAYLOAD = """@prefix org: <http://www.w3.org/ns/org#> .
@prefix cccev: <http://data.europa.eu/m8g/> .
@prefix epo: <http://data.europa.eu/a4g/ontology#> .
@prefix locn: <http://www.w3.org/ns/locn#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment with a <brace and "quote
<http://ex.org/o1> a org:Organization ;
    epo:hasLegalName "Комисия \\"за\\" защита"@bg ;
    epo:isCovered false , 4.5 ;
    epo:hasSite "http://x.org"^^xsd:anyURI ;
    cccev:registeredAddress [ epo:hasCountryCode <http://ex.org/BGR> ; locn:postCode '''10
00''' ; locn:postName "\\u0421офия" ; ] .
"""


def _message(number, request_id, name, country="DEU", entity_type="ORGANISATION", content=None):
    body = content
    if body is None:
        body = (
            "@prefix org: <http://www.w3.org/ns/org#> . @prefix epo: <http://data.europa.eu/a4g/ontology#> . "
            "@prefix cccev: <http://data.europa.eu/m8g/> . @prefix locn: <http://www.w3.org/ns/locn#> . "
            f'<http://ex.org/{request_id}> a org:Organization ; epo:hasLegalName "{name}" ; '
            f'cccev:registeredAddress [ epo:hasCountryCode "{country}" ; locn:postCode "10115" ; locn:postName "Berlin" ] .'
        )
    ids = {"request_id": request_id, "source_id": "t", "entity_type": entity_type}
    mention = {"identifiedBy": ids, "content": body, "content_type": "text/turtle"}
    raw = {"type": requests.REQUEST_TYPE, "entity_mention": mention, "timestamp": "2024-01-01T00:00:00+00:00", "ere_request_id": f"{request_id}:{number}"}
    return number, json.dumps(raw)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "arrival_seq long, raw string")


def _answers(frame):
    return {r.arrival_seq: json.loads(r.response) for r in frame.collect()}


def test_turtle_subset(spark):
    payloads = spark.createDataFrame(
        [(1, PAYLOAD), (2, "  "), (3, "not valid rdf"), (4, "<a> <b> c:d ."), (5, PAYLOAD.replace("org:Organization", "org:Site"))],
        "request_key long, content string",
    )
    wanted = payloads.select("request_key", F.when(F.col("request_key") == 6, "X").otherwise("ORGANISATION").alias("entity_type"))
    found = {r.request_key: r for r in rdf.attributes(wanted, rdf.triples(payloads), MAPPED).collect()}
    first = found[1]
    assert first.mapping_error is None and first.legal_name == 'Комисия "за" защита'
    assert (first.country_code, first.post_code, first.post_name, first.nuts_code) == ("http://ex.org/BGR", "10\n00", "София", None)
    assert all(found[k].mapping_error for k in (2, 3, 4, 5))


def test_mapping_configuration():
    with pytest.raises(ValueError, match="nope"):
        rdf.hop_table({}, {"T": {"rdf_type": "nope:T", "fields": {"a": "never:b"}}})
    empty = rdf.hop_table(rdf.NAMESPACES, {"P": {"rdf_type": "epo:Procedure", "fields": {"country_code": None}}})
    assert empty == [rdf.Hop("P", None, 0, rdf.NAMESPACES["epo"] + "Procedure"), rdf.Hop("P", "country_code", 0, None)]
    path = [h for h in MAPPED if h.field == "post_code"]
    assert [(h.hop, h.iri.rsplit("/", 1)[1]) for h in path] == [(0, "registeredAddress"), (1, "locn#postCode")]


def test_one_answer_per_request_in_order(spark):
    settings = config.shipped()
    stored = Stored(
        spark.createDataFrame([], tables.mention_layout(settings)),
        spark.createDataFrame([], tables.LINK_LAYOUT),
        spark.createDataFrame([], tables.CLUSTER_LAYOUT),
    )
    before = process(_frame(spark, [_message(0, "seen", "Acme Industries GmbH")]), stored, settings, MAPPER)
    stored = Stored(before.mentions, before.links, before.clusters.select("mention_id", "arrival_seq", "cluster_id"))
    rows = [
        _message(1, "fresh", "ACME-Industries GmbH."),
        _message(2, "seen", "Acme Industries GmbH"),
        _message(3, "seen", "Something else"),
        (4, "{broken"),
        _message(5, "fresh", "ACME-Industries GmbH."),
        _message(6, "fresh", "Other words"),
        _message(7, "typed", "x", entity_type="CONTRACT"),
        _message(8, "blank", "x", content=" "),
        (9, json.dumps({"type": "FullRebuildRequest"})),
    ]
    done = process(_frame(spark, rows), stored, settings, MAPPER)
    found = _answers(done.responses)
    assert sorted(found) == list(range(1, 10))
    errors = {n: a.get("error_type") for n, a in found.items()}
    assert errors == {
        1: None, 2: None, 3: "ConflictError", 4: "ProcessingError", 5: None, 6: "ConflictError",
        7: "ValueError", 8: "ValueError", 9: "ProcessingError",
    }
    founder = before.clusters.first().cluster_id
    assert found[1]["candidates"][0]["cluster_id"] == founder
    assert found[2]["candidates"] == [{"cluster_id": founder, "confidence_score": 0.0, "similarity_score": 0.0}]
    assert found[5]["candidates"][0]["cluster_id"] == founder
    assert found[5]["candidates"][0]["confidence_score"] == pytest.approx(found[1]["candidates"][0]["confidence_score"], abs=1e-6)
    assert done.mentions.count() == 1
    told = done.events.select([F.col(c).cast("string") for c in done.events.columns]).collect()
    assert not any("cme" in (v or "") for row in told for v in row)


def _stream(spark, folder, settings):
    state = tables.StateTables(spark, f"{folder}/state", settings)
    query = resolver.start(resolver.message_stream(spark, f"{folder}/in"), state, MAPPER, f"{folder}/checkpoint", availableNow=True)
    query.awaitTermination()
    return state


def test_restart_repeat_and_training(spark, tmp_path):
    folder = str(tmp_path)
    names = ["Acme Industries GmbH", "ACME Industries GmbH.", "Acme Industrie GmbH", "Beta Foods AG", "Beta Food AG", "Gamma Bank"]
    rows = [_message(n, f"r{n}", name) for n, name in enumerate(names)]
    from dataclasses import replace

    settings = replace(config.shipped(), auto_train_threshold=5)
    _frame(spark, rows[:3]).coalesce(1).write.json(f"{folder}/in")
    state = _stream(spark, folder, settings)
    assert state.stored_mentions() == 3 and state.load_model()[1] == training.COLD_START
    # Rows of an attempt without a commit stay invisible, and the batch's rerun replaces them.
    state.write(1, mentions=state.mentions(), clusters=state.clusters())
    assert state.mentions().count() == 3
    _frame(spark, [*rows[3:], (9, rows[0][1])]).coalesce(1).write.mode("append").json(f"{folder}/in")
    state = _stream(spark, folder, settings)
    assert state.mentions().count() == 6 == state.clusters().count()
    assert state.load_model()[1] == training.PERSISTED
    owners = {r.arrival_seq: r.cluster_id for r in state.clusters().collect()}
    assert owners[0] == owners[1] == owners[2] and owners[3] == owners[4] and len(set(owners.values())) == 3
    assert "candidates" in _answers(spark.read.parquet(f"{folder}/state/responses"))[9]


def test_unusable_model_keeps_cold_start(spark, tmp_path):
    settings = config.shipped()
    path = str(tmp_path / "model")
    assert tables.load_model(spark, settings, path)[1:] == (training.COLD_START, None)
    tables.save_model(spark, settings, path)
    again, source, problem = tables.load_model(spark, settings, path)
    assert (again.model, source, problem) == (settings.model, training.PERSISTED, None)
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part.json").write_text("no model")
    same, source, problem = tables.load_model(spark, settings, str(broken))
    assert (same, source) == (settings, training.COLD_START) and problem
    assert (broken / "part.json").read_text() == "no model"


def test_outdated_mentions_are_refused(spark, tmp_path):
    state = tables.StateTables(spark, str(tmp_path), config.shipped())
    state.write(0, mentions=spark.createDataFrame([("a", "b")], "mention_id string, legal_name string"))
    with pytest.raises(tables.OutdatedTableError, match="legal_name_norm"):
        state.mentions()


def test_files(spark, tmp_path):
    csv = tmp_path / "m.csv"
    csv.write_text('mention_id,arrival_seq,legal_name,post_code\na,1,"Acme, Inc",\nb,2,Beta,0123\n')
    found = mentions.read_csv(spark, str(csv), ["mention_id", "arrival_seq", "legal_name", "post_code"], ["legal_name", "post_code"])
    assert [tuple(r) for r in found.orderBy("arrival_seq").collect()] == [("a", 1, "Acme, Inc", None), ("b", 2, "Beta", "0123")]
    good = tmp_path / "m.json"
    good.write_text('{"name": "x", "mentions": [{"request_id": "1", "legal_name": "A"}, {"request_id": "2"}]}')
    assert [r.arrival_seq for r in mentions.read_json(spark, str(good), ["legal_name"]).collect()] == [0, 1]
    bad = tmp_path / "n.json"
    bad.write_text('{"name": "x"}')
    with pytest.raises(ValueError, match="mentions"):
        mentions.read_json(spark, str(bad), ["legal_name"])


def test_another_payload_format_needs_only_a_mapper(spark):
    settings = config.shipped().with_fields(["legal_name", "country_code"])
    stored = Stored(
        spark.createDataFrame([], tables.mention_layout(settings)),
        spark.createDataFrame([], tables.LINK_LAYOUT),
        spark.createDataFrame([], tables.CLUSTER_LAYOUT),
    )

    def plain(payloads):
        cells = F.split("content", ";")
        return payloads.select(
            "request_key", cells[0].alias("legal_name"), cells[1].alias("country_code"), F.lit(None).cast("string").alias("mapping_error")
        )

    rows = [_message(1, "a", "", content="Acme GmbH;DEU"), _message(2, "b", "", content="Acme GmbH.;DEU")]
    done = process(_frame(spark, rows), stored, settings, plain)
    assert done.clusters.select("cluster_id").distinct().count() == 1

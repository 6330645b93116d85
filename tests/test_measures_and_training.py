import math
import random

import pytest
from pyspark.sql import functions as F

from kinweave import config
from kinweave.operators import evaluation, guards, measures, training

LAYOUT = "mention_id string, arrival_seq long, legal_name string, country_code string, post_code string"


def test_order_statistics_are_exact(spark, monkeypatch):
    rng = random.Random(1)
    # A third of the values are equal, and one is far away.
    values = [7.25] * 200 + [rng.gauss(0, 10) for _ in range(399)] + [1e9]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    ordered = sorted(values)
    ranks = [0, 1, 150, 300, 420, 598, 599, 150]
    assert measures.order_statistics(frame, "v", ranks) == [ordered[rank] for rank in ranks]
    with pytest.raises(ValueError):
        measures.order_statistics(frame, "v", [0, 600])


def test_guards(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, None), ("b", 5, None), ("b", 6, ""), ("c", 7, "z"), ("d", 8, "q")]
    incoming = spark.createDataFrame(rows, "mention_id string, arrival_seq long, name string")
    stored = spark.createDataFrame([("c", "z"), ("d", "other")], "mention_id string, name string")
    found = {r.arrival_seq: r.guard for r in guards.guard(incoming, stored, ["name"]).collect()}
    assert found == {1: "new", 2: "repeat", 3: "conflict", 4: "new", 5: "repeat", 6: "conflict", 7: "idempotent", 8: "conflict"}
    assert [r.mention_id for r in guards.conflicts(incoming, stored, ["name"]).collect()] == ["d"]
    assert guards.unseen(incoming, stored).count() == 6 and guards.already_stored(incoming, stored).count() == 2


def test_rule_counts_equal_pair_lists(spark):
    rng = random.Random(3)
    rows = [(f"m{i}", i, *[rng.choice(["x", "y", "z", None]) for _ in range(3)]) for i in range(60)]
    mentions = spark.createDataFrame(rows, LAYOUT)
    rules = [["country_code"], ["post_code", "legal_name"], ["legal_name"]]
    place = {"legal_name": 2, "country_code": 3, "post_code": 4}
    expected = {0: 0, 1: 0, 2: 0}
    for i, l in enumerate(rows):
        for r in rows[:i]:
            hit = [n for n, rule in enumerate(rules) if all(l[place[f]] is not None and l[place[f]] == r[place[f]] for f in rule)]
            if hit:
                expected[hit[0]] += 1
    assert {r.match_key: r.pairs for r in evaluation.first_rule_counts(mentions, rules).collect()} == expected


def test_synthetic_corpus(spark):
    mentions = spark.createDataFrame([("a", 0, "Acme", "DEU", None), ("b", 1, "Beta", "DEU", "1")], LAYOUT)
    grown = evaluation.synthetic_corpus(mentions, 3).orderBy("arrival_seq").collect()
    assert [r.mention_id for r in grown] == ["a-0", "b-0", "a-1", "b-1", "a-2", "b-2"]
    assert grown[0].legal_name == "Acme" and len({r.legal_name for r in grown}) == 6
    assert all(len(r.legal_name.split()[0]) == 8 for r in grown[2:])


def test_random_pairs_stay_within_the_limit(spark):
    sample = spark.range(40).select(F.col("id").cast("string").alias("mention_id"), F.lit("x").alias("legal_name"))
    assert training.random_pairs(sample, ["legal_name"], 100).count() == 91
    assert training.sample_size_for(100) == 14 and training.sample_size_for(1_000_000) == 1414


def test_expectation_maximisation_finds_the_generating_shares():
    comparisons = (config.Comparison("exact_match", "a"), config.Comparison("exact_match", "b"))
    m, u, prior = {"a": 0.9, "b": 0.8}, {"a": 0.05, "b": 0.1}, 0.3
    rows = []
    for a in (0, 1):
        for b in (0, 1):
            def chance(p):
                return (p["a"] if a else 1 - p["a"]) * (p["b"] if b else 1 - p["b"])

            rows.append({"gamma_a": a, "gamma_b": b, "pairs": 1e6 * (prior * chance(m) + (1 - prior) * chance(u))})
    fixed = {f: {1: u[f], 0: 1 - u[f]} for f in u}
    found = training.expectation_maximisation(rows, comparisons, fixed, prior)
    assert found["a"][1] == pytest.approx(0.9, abs=0.01) and found["b"][1] == pytest.approx(0.8, abs=0.01)


def test_training_keeps_values_of_unseen_levels(spark):
    rng = random.Random(5)
    rows = [(f"m{i}", i, rng.choice(["acme ltd", "acme limited", "beta bank", "gamma foods"]), "DEU", None) for i in range(40)]
    settings = config.shipped().with_fields(["legal_name", "country_code", "post_code"])
    trained = training.train(spark.createDataFrame(rows, LAYOUT), settings)
    assert trained.model.parameters["post_code"] == settings.model.parameters["post_code"]
    names = trained.model.parameters["legal_name"]
    assert names[0].source == training.TRAINED and math.isclose(sum(p.u for p in names if p.source == training.TRAINED), 1, abs_tol=0.2)


def test_training_decision():
    settings = config.shipped()
    assert training.should_train(190, 240, settings, training.COLD_START)
    assert not training.should_train(200, 240, settings, training.COLD_START)
    assert not training.should_train(150, 199, settings, training.COLD_START)
    assert not training.should_train(190, 240, settings, training.PERSISTED)


def test_report_and_arrival_numbers(spark, tmp_path):
    records = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "v double")
    measures.write_report(measures.latency_summary(records, "v"), records, str(tmp_path))
    row = spark.read.json(str(tmp_path / "summary")).first()
    assert (row.records, row.median_ms, row.p95_ms, row.max_ms) == (3, 2.0, 9.0, 9.0)
    assert spark.read.json(str(tmp_path / "records")).count() == 3
    from kinweave.sources.mentions import number_arrivals

    numbered = number_arrivals(records, 10, F.desc("v")).orderBy("arrival_seq").collect()
    assert [(r.v, r.arrival_seq) for r in numbered] == [(9.0, 11), (2.0, 12), (1.0, 13)]


def test_registered_comparison(spark, monkeypatch):
    import copy

    from kinweave.operators import scoring
    from kinweave.plans.resolve import link

    monkeypatch.setattr(scoring, "LEVELS", dict(scoring.LEVELS))
    monkeypatch.setattr(config, "COMPARISON_KINDS", scoring.COMPARISON_KINDS)
    scoring.register("same_start", lambda l, r, c: F.when(F.left(l, F.lit(2)) == F.left(r, F.lit(2)), 1).otherwise(0))
    raw = copy.deepcopy(config.SHIPPED)
    raw["splink"]["comparisons"][2] = {"type": "same_start", "field": "post_code"}
    settings = config.ResolverConfig.from_dict(raw).with_fields(["legal_name", "country_code", "post_code"])
    rows = [("a", 0, "Acme", "DEU", "1011"), ("b", 1, "Acme", "DEU", "1099")]
    assert [r.gamma_post_code for r in link(spark.createDataFrame(rows, LAYOUT), settings).links.collect()] == [1]
    scoring.COMPARISON_KINDS.remove("same_start")


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, 3.0, float("nan")],
        [1.0, 2.0, 3.0, float("inf"), float("-inf")],
        [-0.0, 0.0, -1.5, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308],
        [4.25] * 9,
        [float("nan")] * 3,
        [float(v) for v in range(-40, 60, 7)] + [0.1, 0.1 + 2**-56, 0.1],
    ],
)
def test_order_statistics_of_any_doubles(spark, values):
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    wanted = sorted(values, key=lambda v: (v != v, v))
    found = measures.order_statistics(frame, "v", list(range(len(values))))
    assert [str(v + 0.0) for v in found] == [str(v + 0.0) for v in wanted]


def test_order_statistics_refuse_other_ranks(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert measures.order_statistics(frame, "v", []) == []
    for rank in (-1, 2):
        with pytest.raises(ValueError):
            measures.order_statistics(frame, "v", [0, rank])
    with pytest.raises(ValueError):
        measures.order_statistics(frame.where("v > 5"), "v", [0])

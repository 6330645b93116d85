"""Evaluation from one similarity join: narrower agreements equal what joins of their own, and all pairs, give."""

import random
from itertools import combinations

import pytest

from kinweave.operators import evaluation
from kinweave.sources import mentions

LAYOUT = "arrival_seq long, country_code string, post_code string, name string, cluster_id string"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = random.Random(11)
    names = [a + b for a in ("acme", "acmea", "bolt", "bolts", "granite", "granites") for b in ("", "holding", "holdings")]
    rows = []
    for i in range(160):
        country = rng.choice("xy")
        rows.append((i, country, rng.choice(["1", "2", None]), rng.choice([*names, None]), f"{country}{rng.randrange(6)}"))
    rows.append((160, None, "1", "acme", "alone"))
    return rows, spark.createDataFrame(rows, LAYOUT)


def jaro_winkler(a, b):
    import duckdb

    return duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]


def test_shared_similarity_gives_the_same_counts(clustered, monkeypatch):
    rows, frame = clustered
    cache = {}

    def close(a, b, least):
        key = tuple(sorted((a, b)))
        cache.setdefault(key, jaro_winkler(*key))
        return cache[key] >= least

    together = [(l, r) for l, r in combinations(rows, 2) if l[3] and r[3] and l[3] != r[3]]
    unrelated = {}
    for l, r in together:
        if l[4] == r[4] and not close(l[3], r[3], evaluation.UNRELATED_BELOW):
            unrelated[l[4]] = unrelated.get(l[4], 0) + 1
    variants = [(l, r) for l, r in together if l[1] and l[1] == r[1] and l[2] and l[2] == r[2] and close(l[3], r[3], evaluation.VARIANT_SIMILARITY)]
    for small in (evaluation.SMALL_BYTES, -1):  # names sent to every task, or merged
        monkeypatch.setattr(evaluation, "SMALL_BYTES", small)
        similar = evaluation.similar_names(evaluation.counted_values(frame, ["country_code"]), ["country_code"], evaluation.UNRELATED_BELOW)
        for found in (evaluation.unrelated_pairs(frame), evaluation.unrelated_pairs(frame, similar, ["country_code"])):
            assert {r.cluster_id: int(r.unrelated) for r in found.collect()} == unrelated
        near = similar.where(f"similarity >= {evaluation.VARIANT_SIMILARITY}")
        for also, expected in ((["post_code"], variants), (["post_code", "cluster_id"], [v for v in variants if v[0][4] == v[1][4]])):
            assert int(evaluation.agreeing_pairs(frame, near, ["country_code"], also).first().pairs) == len(expected)
    assert variants and unrelated


def test_nothing_to_evaluate(spark):
    none = spark.createDataFrame([], LAYOUT)
    similar = evaluation.similar_names(evaluation.counted_values(none, ["country_code"]), ["country_code"], 0.8)
    assert similar.collect() == [] and evaluation.unrelated_pairs(none, similar, ["country_code"]).collect() == []
    assert int(evaluation.agreeing_pairs(none, similar, ["country_code"], ["post_code"]).first().pairs) == 0


def test_only_bounded_batches_are_numbered(spark):
    rows = spark.range(5)
    assert [r.arrival_seq for r in mentions.number_arrivals(rows, 7, "id", most=5).orderBy("id").collect()] == [8, 9, 10, 11, 12]
    with pytest.raises(ValueError):
        mentions.number_arrivals(rows, 7, "id", most=4)

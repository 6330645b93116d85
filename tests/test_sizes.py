"""Work is dealt out whatever the groups: no task takes all pairs of a hot value, no list holds what no mention can use."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave import config
from kinweave.functions import similarity
from kinweave.operators import blocking, clustering, scoring
from kinweave.sources import rdf



@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("by_name", [True, False])
def test_pairs_of_a_hot_value_are_spread(spark, small, by_name):
    """1,500 profiles of one name: each pair once, by many tasks."""
    rows = [(i, i, "one name", "X", str(i)) for i in range(1500)]
    layout = "profile_id long, last_new long, legal_name string, country_code string, post_code string"
    known = spark.createDataFrame(rows, layout).withColumns({"legal_name_norm": F.col("legal_name"), "mentions": F.lit(1)})
    if by_name:
        pairs = blocking.pairs_by_name(known, ["country_code"], "legal_name_norm", 0.8, small)
    else:
        pairs = blocking.pairs_by_equality(known, ["country_code"], small)
    ends = pairs.select("a.profile_id", F.col("b.profile_id").alias("other"), F.spark_partition_id().alias("task"))
    tasks = ends.groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("profile_id", "other").alias("different")).collect()
    whole = 1500 * 1499 // 2
    assert sum(t.n for t in tasks) == sum(t.different for t in tasks) == whole
    assert ends.where("profile_id >= other").count() == 0
    assert max(t.n for t in tasks) <= whole // 2


def test_dropped_early_only_below_the_cutoff():
    rnd = random.Random(5)
    names = ["".join(rnd.choices("aabcdeé", k=rnd.choice([3, 9, 30, 47, 64]))) for _ in range(120)] + ["", "a"]
    enc = similarity.EncodedStrings(names)
    l, r = np.triu_indices(len(names), 1)
    whole = similarity.score_pairs(enc, l, r)
    for cutoff in (0.6, 0.75, 0.8, 0.9):
        quick = similarity.score_pairs(enc, l, r, cutoff)
        assert ((whole >= cutoff) == (quick >= cutoff)).all()
        assert (whole[whole >= cutoff] == quick[whole >= cutoff]).all()


def test_bags_are_only_made_for_the_filter():
    """Scores without a cut-off need no bitmaps, which cost more than the scores of short names."""
    enc = similarity.EncodedStrings(["abba", "abc", "", "ü" * 300])
    similarity.score_pairs(enc, np.array([0, 0]), np.array([1, 3]))
    assert not {"bag", "collapsed"} & set(vars(enc))
    assert enc.collapsed.tolist() == [int(n) - int(np.bitwise_count(b).sum()) for n, b in zip(enc.length, enc.bag)]


def test_best_links_of_repeated_mentions_travel_once(spark):
    """Best links equal brute force where profiles have many mentions, and what is kept for them does not grow with these."""
    rnd, top_n, profiles = random.Random(3), 4, 40
    owner = list(range(profiles)) + [rnd.randrange(profiles) for _ in range(600)]
    first = {}
    for seq, p in enumerate(owner):
        first.setdefault(p, seq)
    weight = {(p, q): rnd.choice([1.0, 2.0, 3.0, 4.5]) for p in first for q in first if rnd.random() < 0.7}
    mentions = spark.createDataFrame([(f"m{i}", i, first[p]) for i, p in enumerate(owner)], "mention_id string, arrival_seq long, profile_id long")
    links = spark.createDataFrame([(first[p], first[q], w) for (p, q), w in weight.items()], "new_profile long, stored_profile long, match_weight double")
    want = set()
    for seq, p in enumerate(owner):
        found = sorted((-weight[p, q], s) for s, q in enumerate(owner[:seq]) if (p, q) in weight)
        want |= {(f"m{seq}", f"m{s}", -w, rank) for rank, (w, s) in enumerate(found[:top_n], 1)}
    got = clustering.top_links(mentions, links, top_n).collect()
    assert {(r.mention_id_l, r.mention_id_r, r.match_weight, r.rank) for r in got} == want and len(got) == len(want)
    held = clustering.useful_links(links, top_n).collect()
    # the links to earlier profiles are the best ones only, and others end before the repeats begin
    assert sum(r.stored_profile < r.new_profile for r in held) <= top_n * profiles
    assert all(r.until is not None and r.until < profiles for r in held if r.new_profile > 3 * top_n and r.match_weight < 4.5)


def test_offers_of_one_cluster_are_combined(spark, monkeypatch):
    """Of 400 links of one weight to profiles of two clusters, two offers are shuffled for ranking."""
    seen, front = [], clustering._front
    monkeypatch.setattr(clustering, "_front", lambda offers, keys, top_n: [seen.append(offers.count()), front(offers, keys, top_n)][1])
    clusters = spark.createDataFrame([(i, i, f"m{i}", f"m{i % 2}") for i in range(401)], "profile_id long, arrival_seq long, mention_id string, cluster_id string")
    links = spark.createDataFrame([(400, i, 3.0) for i in range(400)], "new_profile long, stored_profile long, match_weight double")
    found = clustering.rank_candidates(clusters, links, clusters, 5).where("arrival_seq = 400").orderBy("rank").collect()
    assert [r.cluster_id for r in found] == ["m0", "m1"]
    assert seen == [2]


@pytest.mark.parametrize("cutoff", [0.3, 0.65, 0.8, 0.93])
def test_a_grid_equals_single_pairs(cutoff):
    """All pairs of many short strings at once: the links and scores that pairs have one by one, to the last bit."""
    rnd = random.Random(8)
    names = ["".join(rnd.choices("aabcdeé1", k=rnd.choice([1, 4, 9, 30, 47, 62]))) for _ in range(150)] + ["", "a", "b" * 64, "ab" * 32]
    names += [n[: len(n) // 2] + n[len(n) // 2 + 1 :] for n in names[:60]]
    names = list(dict.fromkeys(n for n in names if len(n.encode()) <= 64))
    enc, every = similarity.EncodedStrings(names), np.arange(len(names))
    l, r = np.repeat(every, len(names)), np.tile(every, len(names))
    score = similarity.score_pairs(enc, l, r)
    want = {(a, b, s) for a, b, s in zip(l.tolist(), r.tolist(), score.tolist()) if s >= cutoff}
    got = [t for part in similarity.similar_in_grid(enc, every, every, cutoff) for t in zip(*(x.tolist() for x in part))]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("stale", [0, 40])
def test_tiles_of_like_names_are_scored_in_grids(monkeypatch, stale):
    """Names of the same letters, long ones among them: few pairs are scored one by one, and each similar pair comes once."""
    rnd = random.Random(4)
    names = ["".join(rnd.sample("aabbccddeeffgghhiijj" * 2, 36)) for _ in range(170)]
    names += [n[:30] + "xy" for n in names[:20]] + ["".join(rnd.choices("abcdefghij", k=90)) for _ in range(6)]
    fresh = [i >= stale for i in range(len(names))]
    both = [(0, 0, 0, side, i, n, fresh[i], 1) for side in (0, 1) for i, n in enumerate(names) if side or fresh[i]]
    rows = pd.DataFrame(both, columns=["block", "l_tile", "r_tile", "side", "value_id", "name", "fresh_value", "value_tiles"])
    alone, score_pairs = [], similarity.score_pairs
    monkeypatch.setattr(similarity, "score_pairs", lambda enc, l, r, cutoff=None: [alone.append(len(l)), score_pairs(enc, l, r, cutoff)][1])
    found = pd.concat(similarity.similar_within_tiles(0.8)(iter([rows])))
    enc = similarity.EncodedStrings(names)
    l, r = np.triu_indices(len(names), 1)
    some = np.array(fresh)[r]
    l, r = l[some], r[some]
    score = score_pairs(enc, l, r)
    want = {(b, a, s) for a, b, s in zip(l.tolist(), r.tolist(), score.tolist()) if s >= 0.8}
    got = list(zip(found["l_value"], found["r_value"], found["similarity"]))
    assert set(got) == want and len(got) == len(want)
    assert sum(alone) < len(l) / 4


def test_long_payloads_are_read_once_by_many_tasks(spark):
    """200 payloads of one partition, a third of them unreadable: one pass of the reader, several tasks, errors beside fields."""
    good = '@prefix org: <http://www.w3.org/ns/org#> .\n@prefix epo: <http://data.europa.eu/a4g/ontology#> .\n<urn:a> a org:Organization ; epo:hasLegalName "n%d" .'
    rows = [(i, "ORGANISATION", good % i + (" [ " * 300 if i % 3 == 0 else "")) for i in range(200)]
    payloads = spark.createDataFrame(rows, "request_key long, entity_type string, content string").coalesce(1)
    read = rdf.triples(payloads).select("request_key", F.spark_partition_id().alias("task")).distinct()
    assert read.select("task").distinct().count() > 1
    mapped = rdf.turtle_mapper(rdf.shipped_hops())(payloads)
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan
    found = {r.request_key: (r.legal_name, r.mapping_error is None) for r in mapped.collect()}
    assert found == {i: (None, False) if i % 3 == 0 else (f"n{i}", True) for i in range(200)}


def test_payloads_become_strings_by_pieces(monkeypatch):
    """A batch of 40 long payloads is not turned into Python strings at once; keys may be missing."""
    monkeypatch.setattr(rdf, "BYTES_AT_ONCE", 50_000)
    batch = pa.RecordBatch.from_pydict({"request_key": [*range(39), None], "content": ["x" * 10_000] * 40})
    pieces = list(rdf._pieces(iter([batch, batch.slice(0, 0)])))
    assert max(len(p) for p in pieces) <= 5
    assert [k for p in pieces for k in p["request_key"]] == [*range(39), None]


@pytest.mark.parametrize("small", [True, False])
def test_links_of_a_hot_value_leave_their_tiles_as_few_rows(spark, small):
    """1,500 profiles of one name: all 1.1 million links are graded, and neither counts nor first links are as many."""
    rows = [(i, i, "one name", "X", f"n{i % 7}", str(1000 + i), 1) for i in range(1500)]
    layout = "profile_id long, last_new long, legal_name string, country_code string, nuts_code string, post_code string, mentions long"
    known = spark.createDataFrame(rows, layout).withColumn("legal_name_norm", F.col("legal_name"))
    settings = config.shipped().with_fields(["legal_name", "country_code", "nuts_code", "post_code"])
    pairs = blocking.candidate_pairs(known, settings, small)
    links = scoring.profile_links(pairs, settings)
    counts = scoring.link_patterns(known, settings, small, links)
    assert counts.agg(F.sum("links")).first()[0] == 1500 * 1499 // 2
    tiles = -(-1500 // blocking.PROFILES_PER_TILE)
    first = scoring.first_links(known, settings, small, links).toPandas()
    # at most one for each new profile, pattern of levels and tile, where each profile has 750 links on average
    assert len(first) <= 1500 * 6 * (tiles + 1)
    assert first.groupby("new_profile")["stored_profile"].min().to_dict() == {i: 0 for i in range(1, 1500)}

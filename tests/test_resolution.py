import random
from dataclasses import replace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave import config
from kinweave.functions.similarity import EncodedStrings, score_pairs
from kinweave.operators import blocking, clustering, scoring
from kinweave.plans import catalog
from kinweave.plans.resolve import link, resolve, resolve_scored

SCORES = "mention_id_l string, mention_id_r string, match_probability double"


def _mentions(spark, ids, new_from=None):
    rows = [(m, i) for i, m in enumerate(ids)]
    frame = spark.createDataFrame(rows, "mention_id string, arrival_seq long")
    return frame if new_from is None else frame.withColumn("is_new", F.col("arrival_seq") >= new_from)


@pytest.mark.parametrize(
    "arrivals, links, last, cluster, candidates",
    [
        (["m1"], [], "m1", "m1", [("m1", 0.0)]),
        (["m1", "m2"], [("m2", "m1", 0.95)], "m2", "m1", [("m1", 0.95)]),
        (["m1", "m2", "m3"], [("m2", "m1", 0.95), ("m3", "m2", 0.92)], "m3", "m1", [("m1", 0.92)]),
        (["m1", "m3", "m2"], [("m2", "m1", 0.66), ("m2", "m3", 0.95)], "m2", "m3", [("m3", 0.95), ("m1", 0.66)]),
        (["m1", "m2"], [("m2", "m1", 0.60)], "m2", "m2", [("m1", 0.60), ("m2", 0.0)]),
    ],
)
def test_fixed_similarity_scenarios(spark, arrivals, links, last, cluster, candidates):
    settings = replace(config.shipped(), threshold=0.8)
    done = resolve_scored(_mentions(spark, arrivals), spark.createDataFrame(links, SCORES), settings)
    owners = {r.mention_id: r.cluster_id for r in done.clusters.collect()}
    assert owners[last] == cluster
    ranked = done.candidates().where(F.col("mention_id") == last).orderBy("rank").collect()
    assert [(r.cluster_id, pytest.approx(r.score)) for r in ranked] == candidates


def _one_by_one(count, scores, threshold):
    clusters = {}
    for m in range(count):
        best, best_score = None, 0.0
        for other in range(m):
            score = scores.get((m, other), 0.0)
            if score > best_score:
                best, best_score = other, score
        clusters[m] = clusters[best] if best is not None and best_score >= threshold else m
    return clusters


def test_batches_give_the_clusters_of_one_at_a_time(spark):
    rng = random.Random(11)
    count, settings = 120, replace(config.shipped(), threshold=0.75)
    scores = {
        (a, b): rng.choice([0.6, 0.7, 0.76, 0.8, 0.9, 0.95]) for a in range(count) for b in range(a) if rng.random() < 0.08
    }
    table = spark.createDataFrame([(f"m{a}", f"m{b}", s) for (a, b), s in scores.items()], SCORES)
    expected = {f"m{m}": f"m{c}" for m, c in _one_by_one(count, scores, 0.75).items()}
    ids = [f"m{m}" for m in range(count)]
    whole = resolve_scored(_mentions(spark, ids), table, settings).clusters
    assert {r.mention_id: r.cluster_id for r in whole.collect()} == expected
    stored = spark.createDataFrame([], "mention_id string, cluster_id string")
    for start in range(0, count, 60):
        mentions = _mentions(spark, ids[: start + 60], start)
        fresh = table.where(F.substring("mention_id_l", 2, 9).cast("int") >= start)
        batch = resolve_scored(mentions, fresh.join(mentions.select(F.col("mention_id").alias("mention_id_l")), "mention_id_l", "left_semi"), settings, stored)
        stored = stored.unionByName(batch.clusters.select("mention_id", "cluster_id"))
    assert {r.mention_id: r.cluster_id for r in stored.collect()} == expected


def _corpus(rng, count):
    stems = ["alpha trading", "beta logistics", "gamma foods", "delta bank"]
    rows = []
    for seq in range(count):
        name = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            name[rng.randrange(len(name))] = rng.choice("abcdefghij")
        # One country and one exact record hold far more than a third of the rows.
        hot = rng.random() < 0.4
        rows.append(
            (
                f"m{seq}",
                seq,
                "hot record" if hot else "".join(name),
                "DEU" if hot or rng.random() < 0.7 else rng.choice(["FRA", "ESP", None]),
                None if hot else rng.choice(["N1", "N2", None]),
                None if hot else rng.choice(["10115", "10117", "80331", None]),
            )
        )
    return rows


LAYOUT = "mention_id string, arrival_seq long, legal_name string, country_code string, nuts_code string, post_code string"
FIELDS = ["legal_name", "country_code", "nuts_code", "post_code"]


def _brute(rows, settings):
    """Links by the definition, pair by pair."""
    names = {r[0]: "".join(ch for ch in r[2].lower() if ch.isalnum()) for r in rows}

    def similarity(a, b):
        enc = EncodedStrings([a, b])
        return score_pairs(enc, *(__import__("numpy").array([i]) for i in (0, 1)))[0]

    links = {}
    for l in rows:
        for r in rows[: l[1]]:
            if l[3] is None or l[3] != r[3] or similarity(names[l[0]], names[r[0]]) < 0.8:
                continue
            weight = settings.model.prior_weight
            for c in settings.comparisons:
                position = 2 + FIELDS.index(c.field)
                new, old = l[position], r[position]
                if old is None:
                    continue
                if new is None:
                    level = 0
                elif new == old:
                    level = c.levels[0]
                else:
                    score = similarity(new, old) if c.thresholds else 0.0
                    level = next((len(c.thresholds) - i for i, t in enumerate(c.thresholds) if score >= t), 0)
                weight += {p.level: p.weight for p in settings.model.parameters[c.field]}[level]
            if weight >= settings.match_weight_threshold:
                links[(l[0], r[0])] = round(weight, 6)
    return links


@pytest.mark.parametrize("tile_rows, profile_tile", [((512, 8192), 4096), ((2, 2), 2)])
def test_links_equal_brute_force_whatever_the_tiles(spark, monkeypatch, tile_rows, profile_tile):
    monkeypatch.setattr(blocking, "PROFILES_PER_TILE", profile_tile)
    monkeypatch.setattr(blocking.similar_values, "__defaults__", (tile_rows,))
    rows = _corpus(random.Random(2), 110)
    settings = config.shipped().with_fields(FIELDS)
    linked = link(spark.createDataFrame(rows, LAYOUT), settings)
    owner = linked.mentions.select("mention_id", "arrival_seq", "profile_id")
    new = owner.toDF("l", "ls", "new_profile")
    old = owner.toDF("r", "rs", "stored_profile")
    found = linked.links.join(new, "new_profile").join(old, "stored_profile").where("rs < ls").collect()
    assert {(r.l, r.r): round(r.match_weight, 6) for r in found} == _brute(rows, settings)
    assert len(found) == len(_brute(rows, settings))


@pytest.mark.parametrize("stored_share", [0.0, 0.6])
@pytest.mark.parametrize("wanted, tile_rows", [(64, (3, 3)), (4, (3, 3)), (64, (512, 8192))])
def test_tiles_in_reach_lose_no_pair(spark, monkeypatch, stored_share, wanted, tile_rows):
    """Names of very different lengths and first letters: the same pairs as by brute force, each once."""
    monkeypatch.setattr(blocking, "TILES_WANTED", wanted)
    rng = random.Random(11)
    names = {"", "é", "è", "ab"}
    while len(names) < 130:
        base = "".join(rng.choices("abcé 1", k=rng.choice([1, 3, 8, 30, 120, 700])))
        names |= {base, base + rng.choice("abc"), rng.choice("abcé") + base[1:], base[: len(base) // 2]}
    values = [(f"k{i % 2}", n, i, None if rng.random() < stored_share else i, 1) for i, n in enumerate(sorted(names))]
    frame = spark.createDataFrame(values, "key string, name string, value_id long, last_new long, profiles long")
    found = blocking.similar_values(frame, ["key"], 0.8, tile_rows).collect()
    left = [(a, b) for a in values for b in values if a[0] == b[0] and a[2] != b[2] and a[3] is not None]
    left = [(a, b) for a, b in left if b[3] is None or a[2] > b[2]]
    pairs = pd.DataFrame([(a[1], b[1]) for a, b in left], columns=["l", "r"])  # noqa: F841
    scores = duckdb.sql("SELECT jaro_winkler_similarity(l, r) AS s FROM pairs").df()["s"]
    assert sorted((r.l_value, r.r_value) for r in found) == sorted((a[2], b[2]) for (a, b), s in zip(left, scores) if s >= 0.8)
    if (wanted, tile_rows) == (64, (3, 3)):
        placed = blocking.placed_values(frame, ["key"], 0.8, tile_rows).selectExpr("max(tiles) AS t", "avg(size(in_reach) / tiles) AS share").first()
        assert placed["t"] > 20 and placed["share"] < 1


def test_stored_and_new_mentions_give_the_links_of_the_whole(spark):
    rows = _corpus(random.Random(4), 90)
    settings = config.shipped().with_fields(FIELDS)
    mentions = spark.createDataFrame(rows, LAYOUT)
    whole = {r.mention_id: r.cluster_id for r in resolve(mentions, settings).clusters.collect()}
    stored = spark.createDataFrame([], "mention_id string, cluster_id string")
    for start in (0, 50):
        part = mentions.where(F.col("arrival_seq") < (50 if start == 0 else 90)).withColumn("is_new", F.col("arrival_seq") >= start)
        stored = stored.unionByName(resolve(part, settings, stored).clusters.select("mention_id", "cluster_id"))
    assert {r.mention_id: r.cluster_id for r in stored.collect()} == whole


@pytest.mark.parametrize(
    "stored, new, scored",
    [
        (("Acme Industries GmbH", "DEU"), ("ACME-Industries GmbH.", "DEU"), True),
        (("Комисия за защита на конкуренцията", "BGR"), ("КОМИСИЯ ЗА ЗАЩИТА НА КОНКУРЕНЦИЯТА", "BGR"), True),
        (("Bäckerei Schmidt", "DEU"), ("Acme Industries GmbH", "DEU"), False),
        (("Acme Industries GmbH", "AUT"), ("Acme Industries GmbH", "DEU"), False),
        (("...", "DEU"), ("--- ---", "DEU"), False),
        (("Acme", None), ("Acme", None), False),
    ],
)
def test_which_stored_mentions_are_scored(spark, stored, new, scored):
    rows = [("a", 0, *stored), ("b", 1, *new)]
    mentions = spark.createDataFrame(rows, "mention_id string, arrival_seq long, legal_name string, country_code string")
    assert link(mentions, config.shipped().with_fields(["legal_name", "country_code"])).pairs.count() == int(scored)


def test_missing_values_depend_on_who_came_first(spark):
    settings = config.shipped().with_fields(["legal_name", "country_code", "post_code"])
    layout = "mention_id string, arrival_seq long, legal_name string, country_code string, post_code string"
    for first, second, level in (("1", None, 0), (None, "1", -1)):
        rows = [("a", 0, "Acme", "DEU", first), ("b", 1, "Acme", "DEU", second)]
        found = link(spark.createDataFrame(rows, layout), settings).links.collect()
        assert [r.gamma_post_code for r in found] == [level]


def test_each_pair_once_with_its_first_rule(spark):
    rules = [config.JoinRule(("nuts_code",)), config.shipped().rules[0], config.JoinRule(("post_code",))]
    rows = _corpus(random.Random(6), 60)
    settings = replace(config.shipped().with_fields(FIELDS), rules=tuple(rules), match_weight_threshold=-60.0)
    pairs = link(spark.createDataFrame(rows, LAYOUT), settings).pairs
    found = {}
    for r in pairs.select("a.profile_id", F.col("b.profile_id").alias("other"), "match_key").collect():
        assert (r.profile_id, r.other) not in found
        found[(r.profile_id, r.other)] = r.match_key
    profiles = {}
    for row in rows:
        profiles.setdefault(row[2:], []).append(row[1])
    heads = {seqs[0]: (key, len(seqs)) for key, seqs in profiles.items()}
    expected = {}
    for a in heads:
        for b in heads:
            if a > b or (a == b and heads[a][1] == 1):
                continue
            l, r = heads[a][0], heads[b][0]
            enc = EncodedStrings(["".join(filter(str.isalnum, l[0])), "".join(filter(str.isalnum, r[0]))])
            similar = score_pairs(enc, *(__import__("numpy").array([i]) for i in (0, 1)))[0] >= 0.8
            hits = [l[2] is not None and l[2] == r[2], l[1] is not None and l[1] == r[1] and similar, l[3] is not None and l[3] == r[3]]
            if any(hits):
                expected[(a, b)] = hits.index(True)
    assert found == expected


def test_large_profiles_are_merged_not_broadcast(spark, monkeypatch):
    rows = _corpus(random.Random(8), 60)
    settings = config.shipped().with_fields(FIELDS)
    mentions = spark.createDataFrame(rows, LAYOUT)
    expected = sorted(map(tuple, link(mentions, settings).links.select("new_profile", "stored_profile", F.round("match_weight", 6)).collect()))
    monkeypatch.setattr(blocking, "SMALL_BYTES", 0)
    merged = link(mentions, settings).links.select("new_profile", "stored_profile", F.round("match_weight", 6))
    assert sorted(map(tuple, merged.collect())) == expected and expected


def test_candidates_of_profiles_with_very_many_links_are_the_same(spark, small, monkeypatch):
    done = catalog._parts(spark, small, top_n=3)
    whole = sorted(map(tuple, done.candidates().collect()))
    monkeypatch.setattr(clustering, "HEAVY", 2)
    assert sorted(map(tuple, done.candidates().collect())) == whole


@pytest.mark.parametrize("missing, stored_until, small, profile_tile", [("penalise", None, 32 << 20, 512), ("neutral", 60, 0, 3)])
def test_tiles_graded_at_once_give_the_links_of_single_pairs(spark, monkeypatch, missing, stored_until, small, profile_tile):
    """Counts by levels and earliest links by weight, with missing values, copies, stored mentions and keys that repeat."""
    monkeypatch.setattr(blocking, "SMALL_BYTES", small)
    monkeypatch.setattr(blocking, "PROFILES_PER_TILE", profile_tile)
    rng, rows = random.Random(12), []
    names = ["red bolt", "red bolts", "red  Bolt", "Red b olt", "old ring", None, "", "old rings", "é" * 40 + "ring"]
    for i in range(150):
        seq = rng.choice([i, i, i, rng.randrange(150), None])
        codes = rng.choice(["n1", "n2", None]), rng.choice(["1000", "1001", "100", "", None, "2" * 300])
        rows.append((f"m{seq}", seq, rng.choice(names), rng.choice(["A", "A", None]), *codes))
    layout = "mention_id string, arrival_seq long, legal_name string, country_code string, nuts_code string, post_code string"
    mentions = spark.createDataFrame(rows + rng.sample(rows, 40), layout)
    if stored_until is not None:
        mentions = mentions.withColumn("is_new", F.col("arrival_seq") > stored_until)
    settings = replace(config.shipped().with_fields(["legal_name", "country_code", "nuts_code", "post_code"]), missing=missing)
    linked = link(mentions, settings)
    levels = [*scoring.gamma_columns(settings), "match_weight"]
    links = linked.links.select("new_profile", "stored_profile", *levels).toPandas()
    counts = links.groupby(levels).size()
    assert len(counts) > 20
    found = linked.patterns().toPandas().set_index(levels)["links"]
    assert found.to_dict() == counts.to_dict()
    ends = ["new_profile", "match_weight"]
    first = linked.first().toPandas()
    assert len(first) < len(links)
    assert first.groupby(ends)["stored_profile"].min().to_dict() == links.groupby(ends)["stored_profile"].min().to_dict()


def test_other_rules_and_kinds_of_comparison_count_single_pairs(spark):
    rows = _corpus(random.Random(6), 60)
    rules = (config.JoinRule(("nuts_code",)), config.JoinRule(("post_code",)))
    settings = replace(config.shipped().with_fields(FIELDS), rules=rules)
    linked = link(spark.createDataFrame(rows, LAYOUT), settings)
    levels = [*scoring.gamma_columns(settings), "match_weight"]
    counts = linked.links.select(levels).toPandas().groupby(levels).size()
    assert linked.patterns().toPandas().set_index(levels)["links"].to_dict() == counts.to_dict() and len(counts)
    assert linked.first().count() == counts.sum()

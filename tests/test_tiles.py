"""Pairs are graded, counted and chosen where tiles of profiles meet: the same results as from all pairs, and nothing that is
written or shuffled grows with the pairs."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinweave import config
from kinweave.functions import meetings
from kinweave.operators import blocking, scoring
from kinweave.plans import catalog, resolve as plans
from kinweave.plans.resolve import link, resolve

FIELDS = ["legal_name", "country_code", "nuts_code", "post_code"]
LAYOUT = "mention_id string, arrival_seq long, legal_name string, country_code string, nuts_code string, post_code string"


def rows_of(seed, n):
    """Names that are similar or repeat, copies of whole rows under later numbers, missing values, two blocks."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        if rows and rng.random() < 0.25:
            rows.append((f"m{i}", i, *rng.choice(rows)[2:]))
            continue
        name = rng.choice(["red bolt", "red bolts", "old ring", "", None, "é" * 30, "big blue ring of steel"])
        if name and rng.random() < 0.6:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("xyz") + name[at + 1 :]
        rows.append((f"m{i}", i, name, rng.choice(["A", "A", "B", None]), rng.choice(["n1", "n2", None]), rng.choice(["1000", "1001", "", None])))
    return rows


def settings_of(**changes):
    return replace(config.shipped().with_fields(FIELDS), **changes)


def alike(spark, n):
    rows = [(f"s{i}", i, f"supplier number {i:06d}", "X", "n", str(1000 + i)) for i in range(n)]
    return spark.createDataFrame(rows, LAYOUT)


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(blocking, "MEETING_ROWS", (5, 5))
    monkeypatch.setattr(blocking, "MEETING_TILES", 4)
    monkeypatch.setattr(blocking, "PROFILES_PER_TILE", 2)
    monkeypatch.setattr(meetings, "PAIRS_AT_ONCE", 40)
    monkeypatch.setattr(meetings, "TABLE", 60)
    monkeypatch.setattr(meetings, "HELD", 15)
    monkeypatch.setattr(meetings, "LEASTS", 50)


@pytest.mark.parametrize("stored_until", [None, 50])
def test_tiles_grade_the_pairs_that_are_formed_one_by_one(spark, tiny, stored_until):
    mentions = spark.createDataFrame(rows_of(3, 130), LAYOUT)
    if stored_until is not None:
        mentions = mentions.withColumn("is_new", F.col("arrival_seq") > stored_until)
    settings = settings_of()
    linked = link(mentions, settings)
    columns = ["new_profile", "stored_profile", *scoring.gamma_columns(settings)]
    want = sorted(map(tuple, scoring.graded_pairs(linked.pairs, settings).select(columns).collect()))
    assert sorted(map(tuple, linked.graded().select(columns).collect())) == want and len(want) > 200
    counts = {}
    for row in want:
        counts[row[2:]] = counts.get(row[2:], 0) + 1
    assert {tuple(r[:-1]): r.pairs for r in linked.graded_patterns().collect()} == counts


def pages_folder(spark, tmp_path, n):
    url, html = F.concat(F.lit("https://h.example.com/en/"), F.col("id") + 1000, F.lit("/x")), F.concat(F.lit("<title>Report number "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("</title>"))
    spark.range(n).select(F.col("id").alias("page_id"), url.alias("url"), html.alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_graded_pairs_of_pages_are_not_shuffled(spark, tmp_path):
    """300 similar titles: the pairs leave the tasks that find them as they are."""
    found = catalog.compare_levels(spark, pages_folder(spark, tmp_path, 300))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Repartition" not in plan[: plan.index("MapInArrow")] and "Join" not in plan[: plan.index("MapInArrow")]
    assert found.count() == 300 * 299 // 2


def test_pairs_of_pages_are_counted_where_they_are_found(spark, tmp_path):
    """300 similar titles: a handful of counts leave the tasks, not 44,850 pairs."""
    found = catalog.score_threshold(spark, pages_folder(spark, tmp_path, 300))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan[: plan.index("MapInArrow")]
    assert found.agg(F.sum("pairs")).first()[0] == 300 * 299 // 2


@pytest.mark.parametrize("stored_until, top_n", [(None, 3), (60, 2), (60, 100)])
def test_links_chosen_in_tiles_give_the_results_of_all_links(spark, tiny, monkeypatch, stored_until, top_n):
    """Clusters, stored links and candidates, with copies that arrive late and clusters of earlier batches."""
    mentions, settings, results = spark.createDataFrame(rows_of(9, 140), LAYOUT), settings_of(top_n=top_n), []
    stored = None
    if stored_until is not None:
        stored = resolve(mentions.where(F.col("arrival_seq") <= stored_until), settings).clusters.select("mention_id", "cluster_id")
        mentions = mentions.withColumn("is_new", F.col("arrival_seq") > stored_until)
    for most in (scoring.MOST_PATTERNS, 0):
        monkeypatch.setattr(scoring, "MOST_PATTERNS", most)
        done = resolve(mentions, settings, stored)
        frames = (done.clusters.select("mention_id", "cluster_id"), done.stored_links(), done.candidates())
        results.append([sorted(map(tuple, f.collect())) for f in frames])
    assert results[0] == results[1] and all(results[0])


def test_a_resolution_writes_few_links_of_alike_names(spark, monkeypatch):
    """500 similar names have 124,750 links, of which each name's best five are written, and one offer each."""
    written, plain = [], plans.cut

    def counted(frame, *more):
        table = plain(frame, *more)
        written.append((set(table.columns), table.count()))
        return table

    monkeypatch.setattr(plans, "cut", counted)
    monkeypatch.setattr("kinweave.operators.clustering.cut", counted)
    done = resolve(alike(spark, 500), settings_of(top_n=5))
    assert done.stored_links().count() == 5 * 500 - 15
    assert done.candidates().where("rank = 1").count() == 500
    sizes = [n for columns, n in written if "match_weight" in columns]
    assert len(sizes) == 2 and max(sizes) <= 5 * 500
    assert max(n for _, n in written) <= 5 * 500

"""State that many small batches build up: few files, few rows read, the same result as in one batch."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinweave import config
from kinweave.plans.resolve import resolve
from kinweave.sources import reach, tables

FIELDS = ("legal_name", "country_code")
COUNTRIES = ("DEU", "FRA", "ITA", "ESP", "POL")


def settings_of(top_n=3):
    return replace(config.shipped().with_fields(FIELDS), top_n=top_n)


def corpus(seed, n):
    """(id, arrival, name, country): a few names that come again and again, with slips, and many others."""
    rng = random.Random(seed)
    names = [f"{a} {b}" for a in ("Acme", "Beta", "Gamma", "Delta Foods") for b in ("Industries", "Holding")]
    rows = []
    for i in range(n):
        name = rng.choice(names)
        if rng.random() < 0.4:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("xyz") + name[at + 1 :]
        rows.append((f"m{i}", i, name, rng.choice(COUNTRIES) if rng.random() < 0.95 else None))
    return rows


def test_representatives_are_enough(spark):
    """Resolving against the representatives of what is stored gives clusters, links and candidates as against all of it."""
    from kinweave.operators import blocking

    settings, rows = settings_of(), corpus(5, 260)
    mentions = blocking.with_normalised(spark.createDataFrame(rows, "mention_id string, arrival_seq long, legal_name string, country_code string"), settings)
    stored, new = mentions.where("arrival_seq < 200"), mentions.where("arrival_seq >= 200")
    clusters = resolve(stored, settings).clusters.select("mention_id", "cluster_id").persist()
    owned = stored.join(clusters, "mention_id")
    kept = reach.representatives(owned, settings).persist()
    assert kept.count() < 200
    most = kept.groupBy("profile_key").count().agg(F.max("count")).first()[0]
    assert most <= 2 * settings.top_n
    results = []
    for before in (owned, kept):
        everything = before.select(*mentions.columns).withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
        done = resolve(everything, settings, before.select("mention_id", "cluster_id"))
        results.append([sorted(map(tuple, f.collect())) for f in (done.clusters.select("mention_id", "cluster_id"), done.stored_links(), done.candidates())])
    assert results[0] == results[1]
    # what a batch adds, given the stored ones near it, is what all mentions together have
    after = mentions.join(resolve(mentions, settings).clusters.select("mention_id", "cluster_id"), "mention_id").persist()
    near = kept
    grown = {r.mention_id for r in reach.added(near, after.where("arrival_seq >= 200"), settings).collect()}
    whole = {r.mention_id for r in reach.representatives(after, settings).collect()}
    assert {r.mention_id for r in kept.collect()} | grown == whole


def files(state):
    folder = state.folder

    def below(path):
        import os

        return sum(name.endswith(".parquet") for _, _, names in os.walk(f"{folder}/{path}") for name in names)

    return {n: below(n) + below(f"segments/{n}") for n in state._files("") if n not in ("segments", "segment_lists", "model")}


def write_batch(spark, state, number, rows):
    frame = spark.createDataFrame(rows, "mention_id string, arrival_seq long, legal_name string, country_code string, cluster_id string")
    from kinweave.operators import blocking

    frame = blocking.with_normalised(frame, state.config).coalesce(1).persist()
    near = state.reach(frame, number).persist()
    read = near.count()
    state.write_reach(number, reach.added(near, frame, state.config))
    state.write(number, mentions=frame.drop("cluster_id"), clusters=frame.select("mention_id", "arrival_seq", "cluster_id"))
    state.commit(number, len(rows), "cold_start", "run", number, rows[-1][1])
    state.merge(number)
    return read


def test_many_batches_keep_few_files_and_read_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MERGE_AT", 3)
    state = tables.StateTables(spark, str(tmp_path / "state"), settings_of())
    rows = [(f"m{i}", i, f"Acme {i % 4}", COUNTRIES[i % 2], f"m{i % 4}") for i in range(120)]
    seen, counts = [], []
    for number in range(20):
        seen.append(write_batch(spark, state, number, rows[6 * number : 6 * number + 6]))
        counts.append(files(state))
    # four profiles of at most 2 * top_n representatives each, whatever has been stored
    assert max(seen) <= 4 * 2 * state.config.top_n and seen[-1] == seen[8]
    for name in ("mentions", "clusters", "commits"):
        assert max(c[name] for c in counts) <= 3 * 4 + 3 * 4
    assert state.mentions().count() == state.clusters().count() == 120 and state.commits().count() == 20
    assert state.stored_mentions() == 120 and state.last_arrival() == 119 and state.number_of("run", 19) == 19
    assert state.mentions(19).count() == 114
    assert {tuple(r) for r in state.clusters().select("mention_id", "cluster_id").collect()} == {(r[0], r[4]) for r in rows}
    # other settings find their table made from all mentions; those of the first are made anew when they come back
    other = tables.StateTables(spark, state.folder, settings_of(2))
    asked = spark.createDataFrame([("Acme 1", "FRA")], "legal_name string, country_code string")
    assert other.reach(asked).select("country_code").distinct().collect() == [("FRA",)]
    assert [n for n in other._files("") if n.startswith("reach-")] == [reach.ReachLayout(other.config).name]
    assert state.reach(asked).count() == seen[-1] // 2


def test_buckets_of_other_blocks_are_not_read(spark):
    layout = reach.ReachLayout(settings_of())
    frame = spark.createDataFrame([("a", "DEU"), ("b", None)], "legal_name string, country_code string")
    assert len(layout.asked(frame)) == 1 and layout.asked(frame.where("country_code IS NULL")) == []
    assert layout.dealt(frame).count() == 1


@pytest.mark.parametrize("change", ["top_n", "buckets"])
def test_layouts_have_names_of_their_own(change):
    one, two = settings_of(), settings_of(4)
    names = {reach.ReachLayout(one).name, reach.ReachLayout(two).name if change == "top_n" else reach.ReachLayout(one, 7).name}
    assert len(names) == 2


def rows_scanned(frame):
    """Rows that the frame's one scan hands on, before any filter of Spark."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_lookups_by_id_read_what_may_hold_the_ids(spark, tmp_path, monkeypatch):
    state = tables.StateTables(spark, str(tmp_path), settings_of())
    stored = spark.range(400_000).select(
        F.md5(F.col("id").cast("string")).alias("mention_id"),
        F.col("id").alias("arrival_seq"),
        *[F.lit("x").alias(c) for c in ("legal_name", "country_code", "legal_name_norm")],
    )
    # in ranges of ids, as segments are
    state.write(0, mentions=stored.repartitionByRange(tables.MERGE_AT, "mention_id"))
    state.commit(0, 400_000, "cold_start", "run", 0, 399_999)
    numbers = [7, 250_000, 399_999]
    asked = spark.createDataFrame([(r.mention_id,) for r in stored.where(F.col("arrival_seq").isin(numbers)).collect()] + [(None,)], "mention_id string")
    found = tables.of_ids(state.mentions(), asked)
    assert sorted(r.arrival_seq for r in found.collect()) == numbers
    assert rows_scanned(found) <= 3 * 20_000
    # ids that are not stored lie in all ranges, and only the Bloom filters tell; about one in a hundred answers of theirs errs
    absent = spark.createDataFrame([(f"{n:x}" * 32,) for n in range(1, 15)], "mention_id string")
    assert rows_scanned(tables.of_ids(state.mentions(), absent)) < 400_000 / 4
    assert tables.of_ids(state.mentions(), asked.where("mention_id IS NULL")).count() == 0
    monkeypatch.setattr(tables, "LOOKUP", 2)
    joined = tables.of_ids(state.mentions(), asked)
    assert sorted(r.arrival_seq for r in joined.collect()) == numbers

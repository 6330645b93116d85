import zlib
from collections import Counter, defaultdict

import brute
import pytest

from kinweave.llm import mixing, sharding
from kinweave.llm.common import table


@pytest.mark.parametrize("which", ["odd", "small", "large"])
def test_mix(spark, odd, small, which):
    docs = odd if which == "odd" else table(spark, small if which == "small" else "/root/testdata/sf0.1", "documents")
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(brute.WORD.findall(r["text"] or ""))
    goal = brute.targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 * max(1, goal[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] + 1e-6, (s, taken[s], goal[s], largest[s])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)


def test_expected_copies_stay(spark):
    """Of many documents of one size and source as many are taken as their fraction says, whatever the size."""
    rows = [(i, " ".join("w" * (1 + i % 5)), "ab"[i % 2]) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    copies, goal = defaultdict(list), {}
    for r in mixing.mix(docs, weights=(3, 2)).collect():
        copies[r["source"], r["size"]].append(r["copies"])
        goal[r["source"]] = r["target"] / r["source_size"]
    assert len(copies) == 10
    for (source, _), taken in copies.items():
        assert abs(sum(taken) / len(taken) - goal[source]) < 0.04


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).collect() == []


@pytest.mark.parametrize("which,shards", [("odd", 8), ("small", 8), ("small", 5), ("large", 8)])
def test_shards(spark, odd, small, which, shards):
    docs = odd if which == "odd" else table(spark, small if which == "small" else "/root/testdata/sf0.1", "documents")
    rows = docs.select("doc_id", "text").collect()
    got = sharding.kd_shards(docs, shards=shards).collect()
    expected = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == expected
    slots, weight = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(weight.values()) / shards, max(r["size"] for r in got)
    assert max(abs(weight[s] - mean) for s in range(shards)) <= max(2.5 * largest if which != "large" else 0, 0.02 * mean)
    if which == "large":  # small groups of equal texts stay together, but for those a median falls into
        together = defaultdict(set)
        for r, t in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(rows, key=lambda r: r["doc_id"])):
            together[t["text"]].add(r["shard"])
        assert sum(len(s) > 1 for s in together.values()) <= shards


def test_a_group_larger_than_a_shard_is_split(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id int, text string")
    weight = Counter()
    for r in sharding.kd_shards(docs, shards=8).collect():
        weight[r["shard"]] += r["size"]
    assert max(weight.values()) < 1.03 * min(weight.values())


def test_target_bytes(spark, small, nothing):
    docs = table(spark, small, "documents")
    weight = Counter()
    for r in sharding.kd_shards(docs, target_bytes=60_000).collect():
        weight[r["shard"]] += r["size"]
    assert max(weight.values()) < 60_000 + 35_000 and len(weight) >= sum(weight.values()) // 60_000
    assert sharding.kd_shards(nothing, shards=8).collect() == []

"""Bounded intake, ordered answers, the stateful guard and the live report."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kinweave import config
from kinweave.operators import guards
from kinweave.sources import queue, tables
from kinweave.streaming import guarding, report, resolver
from test_requests_and_stream import MAPPER, _message


def _messages(spark, rows):
    return spark.createDataFrame(rows, queue.LAYOUT)


def _drain(query):
    query.processAllAvailable()
    sizes = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    query.stop()
    return sizes


def _copy(spark, folder, **bounds):
    """Copy the rows of a queue to a table, as far as they are there."""
    stream = queue.read_queue(spark, f"{folder}/q", **bounds)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out")
    return _drain(writer.start())


def test_batches_are_bounded_by_count_and_survive_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    queue.push(_messages(spark, [(n, f"m{n}") for n in range(25)]), f"{folder}/q")
    assert _copy(spark, folder, max_messages=10, max_bytes=10**6) == [10, 10, 5]
    queue.push(_messages(spark, [(n, f"m{n}") for n in range(25, 37)]), f"{folder}/q")
    assert _copy(spark, folder, max_messages=10, max_bytes=10**6) == [10, 2]
    found = [tuple(r) for r in spark.read.parquet(f"{folder}/out").orderBy("arrival_seq").collect()]
    assert found == [(n, f"m{n}") for n in range(37)]


def test_bytes_bound_whole_messages_and_an_oversized_one_comes_alone(tmp_path):
    path = str(tmp_path / "q")
    files = queue._Folder(path)
    lines = [json.dumps({"arrival_seq": n, "raw": "x" * size}).encode() + b"\n" for n, size in enumerate((10, 10, 900, 10, 10, 10))]
    short = len(lines[0])
    files.seal(0, [files.add_part(iter(lines[:4]))])
    files.seal(3, [files.add_part(iter(lines[4:5])), files.add_part(iter(lines[5:]))])
    reader, rows = queue._Reader(path, 100, 2 * short), []
    at = reader.initialOffset()
    while (end := reader.latestOffset()) != at:
        rows.append([m[0] for span in reader.partitions(at, end) for m in reader.read(span)])
        at = end
    assert rows == [[0, 1], [2], [3, 4], [5]]
    # A new reader that is told its place goes on there, whatever the bounds.
    again = queue._Reader(path, 1, 10**6)
    assert again.partitions(at, at) == [] and again.latestOffset() == at


def test_splits_cover_every_line_once(tmp_path, monkeypatch):
    path = str(tmp_path / "q")
    files = queue._Folder(path)
    lines = [json.dumps({"arrival_seq": n, "raw": "é" * (n % 13)}).encode() + b"\n" for n in range(50)]
    files.seal(0, [files.add_part(iter(lines[:20])), files.add_part(iter([b"no message\n", *lines[20:]]))])
    for split in (1, 7, 31, 100_000):
        monkeypatch.setattr(queue, "SPLIT", split)
        reader = queue._Reader(path, 1000, 10**6)
        spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
        read = [m[0] for span in spans for m in reader.read(span)]
        assert read == [*range(20), None, *range(20, 50)]


def test_nothing_is_visible_before_the_commit_and_once_after_it(spark, tmp_path):
    path = str(tmp_path / "q")
    writer = queue._StreamWriter(path)
    rows = [{"arrival_seq": n, "raw": None if n == 2 else str(n)} for n in range(3)]
    failed = writer.write(iter(rows))
    assert queue._Folder(path).numbers() == []
    writer.abort([failed, None], 4)
    assert os.listdir(f"{path}/parts") == []
    for _ in range(2):
        writer.commit([writer.write(iter(rows)), writer.write(iter([]))], 4)
    reader = queue._Reader(path, 100, 10**6)
    spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [m for span in spans for m in reader.read(span)] == [(0, "0"), (1, "1"), (2, None)]
    assert len(os.listdir(f"{path}/parts")) == 1


def test_queue_options(spark, tmp_path):
    with pytest.raises(Exception, match="max_messages"):
        queue.read_queue(spark, str(tmp_path), 0, 1).writeStream.format("noop").start().processAllAvailable()
    with pytest.raises(ValueError, match="max_mentions"):
        config.BatchSettings(max_mentions=0)


@pytest.fixture
def rocks(spark):
    key, value = guarding.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, before)


def test_stateful_guard_equals_the_batch_guard(spark, tmp_path, rocks):
    values = [None, "", "a", "b"]
    rows = [(n, None if n % 17 == 0 else f"id{n * n % 11}", values[n * 7 % 5 % 4]) for n in range(60)]
    stored = [("id1", "a"), ("id4", None)]
    layout = "arrival_seq long, mention_id string, name string"
    kept = spark.createDataFrame(stored, "mention_id string, name string")
    expected, known, cuts = {}, kept, (0, 13, 26, 39, 45, 58, 60)
    for a, b in zip(cuts, cuts[1:]):
        judged = guards.guard(spark.createDataFrame(rows[a:b], layout), known, ["name"]).collect()
        expected |= {r.arrival_seq: r.guard for r in judged}
        stored += [(r.mention_id, r.name) for r in judged if r.guard == guards.NEW]
        known = spark.createDataFrame(stored, "mention_id string, name string")
    folder = str(tmp_path)

    def run(part):
        message = F.to_json(F.struct("mention_id", "name"))
        queue.push(spark.createDataFrame(part, layout).select("arrival_seq", message.alias("raw")), f"{folder}/q")
        read = queue.read_queue(spark, f"{folder}/q", 13, 10**6)
        records = read.select("arrival_seq", F.from_json("raw", "mention_id string, name string").alias("r")).select("arrival_seq", "r.*")
        told = guarding.guard_stream(records, ["name"], kept)
        writer = told.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out")
        return _drain(writer.start())

    assert run(rows[:45]) == [13, 13, 13, 6]
    assert run(rows[45:]) == [13, 2]
    found = spark.read.parquet(f"{folder}/out").collect()
    assert {r.arrival_seq: r.guard for r in found} == expected and len(found) == len(expected)
    assert set(expected.values()) == {guards.NEW, guards.REPEAT, guards.IDEMPOTENT, guards.CONFLICT}


def test_answers_and_report_of_a_bounded_stream(spark, tmp_path):
    folder = str(tmp_path)
    names = ["Acme Industries GmbH", "ACME Industries GmbH.", "Beta Foods AG", "Beta Food AG", "Gamma Bank"]
    queue.push(_messages(spark, [_message(n, f"r{n}", name) for n, name in enumerate(names)]), f"{folder}/in")
    settings = config.shipped()
    state = tables.StateTables(spark, f"{folder}/state", settings)
    listener = report.RunReport(f"{folder}/report")
    spark.streams.addListener(listener)
    try:
        messages = resolver.queued_messages(spark, f"{folder}/in", config.BatchSettings(max_mentions=3))
        query = resolver.start(messages, state, MAPPER, f"{folder}/c", answers=f"{folder}/answers")
        query.processAllAvailable()
        query.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    owners = {r.arrival_seq: r.cluster_id for r in state.clusters().collect()}
    assert owners[0] == owners[1] and owners[2] == owners[3] and len(set(owners.values())) == 3
    reader = queue._Reader(f"{folder}/answers", 100, 10**6)
    spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [m[0] for span in spans for m in reader.read(span)] == list(range(5))
    # A batch that is run again, with whatever result, adds no answers.
    resolver.resolve_micro_batch(
        state, MAPPER, _messages(spark, [_message(3, "r3", "Beta Food AG"), _message(4, "r4", "Gamma Bank")]), 1,
        resolver.run_id(spark, f"{folder}/c"), f"{folder}/answers",
    )
    again = queue._Reader(f"{folder}/answers", 100, 10**6)
    assert again.latestOffset() == reader.last
    rows = {r.batch_id: r for r in report.read_report(spark, f"{folder}/report").collect()}
    events = spark.read.parquet(f"{folder}/state/events").where("event = 'dequeued'")
    wanted = events.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("payload_bytes").alias("size")).collect()
    assert {b: (r.batch_size, r.payload_bytes) for b, r in rows.items()} == {r.batch_id: (r.n, r["size"]) for r in wanted}
    assert sorted(rows) == [0, 1] and all(r.total_ms >= r.resolve_ms > 0 for r in rows.values())

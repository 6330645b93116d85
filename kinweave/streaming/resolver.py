"""Resolution of a request stream in micro-batches over committed state tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.config import BatchSettings
from kinweave.operators import training
from kinweave.plans.requests import Mapper, Stored, process
from kinweave.session import cut, scratch
from kinweave.sources import queue, reach
from kinweave.sources.tables import StateTables
from kinweave.streaming.report import INTAKE, intake

MESSAGE_LAYOUT = queue.LAYOUT
RESPONSE_LAYOUT = "arrival_seq long, ere_request_id string, response string"
TRAINED, FAILED, SKIPPED = "trained", "failed", "skipped"


def message_stream(spark: SparkSession, folder: str, batch: BatchSettings | None = None, files_per_batch: int = 1) -> DataFrame:
    """Request messages from JSON files with `arrival_seq` and `raw`; a batch is bounded by its settings or by files."""
    reader = spark.readStream.schema(MESSAGE_LAYOUT)
    if batch is not None:
        reader = reader.option("maxBytesPerTrigger", batch.max_bytes)
    else:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def queued_messages(spark: SparkSession, folder: str, batch: BatchSettings) -> DataFrame:
    """Request messages of a queue; a batch is bounded by messages and by bytes."""
    return queue.read_queue(spark, folder, batch.max_mentions, batch.max_bytes)


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that writes to a checkpoint folder; it outlives restarts, a new folder has a new one."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def train_once(tables: StateTables, source: str, load_error: str | None) -> str:
    """Estimate and save the parameters; skipped while a model, usable or not, is there.  Failures keep the old ones."""
    if source != training.COLD_START or load_error is not None:
        return SKIPPED
    try:
        tables.save_model(training.train(tables.mentions(), tables.config))
    except Exception:  # noqa: BLE001  training must never stop resolution
        return FAILED
    return TRAINED


def train_at_start(tables: StateTables) -> str:
    """Training decision at start-up: enough mentions and no model yet."""
    _, source, load_error = tables.load_model()
    limit = tables.config.auto_train_threshold
    if limit <= 0 or tables.stored_mentions() < limit:
        return SKIPPED
    return train_once(tables, source, load_error)


def resolve_micro_batch(
    tables: StateTables, mapper: Mapper, messages: DataFrame, stream_batch: int, run: str = "", answers: str | None = None
) -> None:
    """Resolve one batch all-or-nothing: a repeated batch sees the state before it and replaces its own rows.

    Intermediate tables are deleted when the batch is committed.  `answers` names a queue that gets the responses of a committed
    batch in arrival order as the segment of the batch's number; a batch that is repeated after that adds nothing.
    """
    with scratch(tables.spark):
        _resolve(tables, mapper, messages, stream_batch, run, answers)


def _resolve(tables: StateTables, mapper: Mapper, messages: DataFrame, stream_batch: int, run: str, answers: str | None) -> None:
    batch_id = tables.number_of(run, stream_batch)
    active, source, load_error = tables.load_model()
    before = tables.stored_mentions(batch_id)
    last = tables.last_arrival(batch_id)
    stored = Stored(
        tables.mentions(batch_id),
        tables.links(batch_id),
        tables.clusters(batch_id),
        last,
        lambda new: tables.reach(new, batch_id),
    )
    outcome = process(cut(messages.select("arrival_seq", "raw")), stored, active, mapper)
    counted = Observation()
    fresh = None
    if outcome.near is not None:
        owned = outcome.mentions.join(outcome.clusters.select("mention_id", "cluster_id"), "mention_id")
        fresh = reach.added(outcome.near, owned, tables.config)
    tables.write_reach(batch_id, fresh)
    tables.write(
        batch_id,
        mentions=outcome.mentions.observe(counted, F.count(F.lit(1)).alias("mentions"), F.max("arrival_seq").alias("last")),
        links=outcome.links,
        clusters=outcome.clusters,
        responses=outcome.responses.repartitionByRange("arrival_seq").sortWithinPartitions("arrival_seq"),
        events=outcome.events,
    )
    added = counted.get["mentions"]
    newest = counted.get["last"]
    tables.commit(batch_id, added, source, run, stream_batch, last if newest is None else newest)
    if answers is not None:
        written = tables.spark.read.schema(RESPONSE_LAYOUT).parquet(f"{tables.folder}/responses/batch_id={batch_id}")
        queue.push(written.select("arrival_seq", F.col("response").alias("raw")), answers, batch_id)
    if training.should_train(before, before + added, tables.config, source):
        train_once(tables, source, load_error)
    tables.merge(batch_id)


def start(
    messages: DataFrame,
    tables: StateTables,
    mapper: Mapper,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    answers: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the resolution stream; pass `availableNow=True` or another trigger instead of the configured interval.

    `answers` names a queue for the responses.  Sizes of batches are observed for `report.RunReport`.
    """
    train_at_start(tables)

    def handle(batch: DataFrame, batch_id: int) -> None:
        resolve_micro_batch(tables, mapper, batch, batch_id, run_id(tables.spark, checkpoint), answers)
        if on_batch is not None:
            on_batch(batch, batch_id)

    return (
        messages.observe(INTAKE, *intake("raw")).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{tables.config.batch.linger_ms} milliseconds"}))
        .start()
    )

"""Live report of a running stream: one JSON file for each batch, written when the batch is done."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

INTAKE = "intake"
#: Report column -> what Spark calls the stage of a batch.
STAGES = {
    "intake_ms": "latestOffset",
    "planning_ms": "queryPlanning",
    "resolve_ms": "addBatch",
    "log_ms": "walCommit",
    "commit_ms": "commitOffsets",
}
REPORT_LAYOUT = ", ".join(
    ["run string", "batch_id long", "batch_size long", "payload_bytes long", "total_ms long", *(f"{name} long" for name in STAGES)]
)


def intake(payload: str) -> list[Column]:
    """What a batch took in, to be observed as `INTAKE` on the stream: messages and bytes of their payloads."""
    return [
        F.count(F.lit(1)).alias("batch_size"),
        F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).cast("long").alias("payload_bytes"),
    ]


class RunReport(StreamingQueryListener):
    """Writes a row for each batch of the streams that observe `INTAKE`: its size, payload bytes, and milliseconds in total and by stage.

    Add it with `spark.streams.addListener`; the rows are read with `read_report`.  Triggers without messages have none, and a
    batch that a stream repeats replaces its row.
    """

    def __init__(self, folder: str):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        done = event.progress
        taken = done.observedMetrics.get(INTAKE)
        if taken is None or not taken["batch_size"]:
            return
        spent = done.durationMs
        row = {
            "run": str(done.id),
            "batch_id": done.batchId,
            "batch_size": taken["batch_size"],
            "payload_bytes": taken["payload_bytes"],
            "total_ms": spent.get("triggerExecution", done.batchDuration),
            **{name: spent.get(stage, 0) for name, stage in STAGES.items()},
        }
        with self.files.open_output_stream(f"{self.root}/{done.id}-{done.batchId:012d}.json") as stream:
            stream.write(json.dumps(row).encode())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a report."""
    return spark.read.schema(REPORT_LAYOUT).json(folder)

"""Session helpers: a local session for tests and benches, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def local_session(cores: int | str = 8, app: str = "kinweave") -> SparkSession:
    """A local session with adaptive execution, for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names for lineage cuts; a local one only where none is set and all tasks are local."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"Set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="kinweave-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def cut(frame: DataFrame, watch: Observation | None = None, *measures: Column) -> DataFrame:
    """Write the frame once to the shared folder and go on from the written table.

    Lost executors then cost no recomputation, and later plans see the real table size.  `measures` are
    aggregated into `watch` while writing.
    """
    if watch is not None:
        frame = frame.observe(watch, *measures)
    spark = frame.sparkSession
    path = "/".join([shared_folder(spark), "kinweave", *_SCRATCH.get(), uuid.uuid4().hex])
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are deleted at the end; everything read from them has to be written by then."""
    name = f"scratch-{uuid.uuid4().hex}"
    before = _SCRATCH.set((*_SCRATCH.get(), name))
    folder = "/".join([shared_folder(spark), "kinweave", *_SCRATCH.get()])
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` returns, written; the tables that it cuts on the way are deleted then."""
    outside = _SCRATCH.get()
    with scratch(spark):
        frame = build()
        inside = _SCRATCH.set(outside)
        try:
            return cut(frame)
        finally:
            _SCRATCH.reset(inside)


def task_slots(spark: SparkSession) -> int:
    """Partitions for stages whose work outgrows their input, which must not be coalesced by size."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

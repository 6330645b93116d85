"""State tables: Parquet folders per batch, visible once the batch's commit row is written, and merged later.

The state numbers its batches itself.  A commit row names the run (a stream's own id) and the run's batch, so a batch that
a run repeats replaces its rows, and a new run, whose batches start at 0 again, never touches those of another.

Folders of old batches are merged into segments, several of about one size into a larger one, so a table has a number of
files that grows with the logarithm of its batches.  A list of segments replaces the one before it when it is complete; until
then readers go on with the folders of the batches.  The newest batch is never merged, as it may be repeated.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.config import LevelParameters, Model, ResolverConfig
from kinweave.functions.text import NORMALISED_SUFFIX
from kinweave.operators import scoring
from kinweave.operators.training import COLD_START, PERSISTED
from kinweave.sources.reach import ReachLayout, representatives

COMMIT_LAYOUT = "batch_id long, mentions long, source string, run string, stream_batch long, last_seq long"
LINK_LAYOUT = "mention_id_l string, mention_id_r string, match_probability float"
CLUSTER_LAYOUT = "mention_id string, arrival_seq long, cluster_id string"
SEGMENT_LAYOUT = "name string, path string, upto long, level int"
#: Batch folders, and segments of one level, that are merged when there are as many.
MERGE_AT = 8
#: Ids up to which a lookup sends them to the scan.
LOOKUP = 2_000
#: Parquet settings of tables that are looked up by id: Bloom filters as large as the ids of a row group need.
ID_FILTERS = {"parquet.bloom.filter.enabled#mention_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
MODEL_LAYOUT = "field string, level int, label string, m double, u double, weight double, source string, prior double"


class OutdatedTableError(RuntimeError):
    """A stored table lacks columns the configuration needs."""


def mention_layout(config: ResolverConfig) -> T.StructType:
    """Schema of the mention table: id, arrival, fields, normalised copies."""
    names = [*config.entity_fields, *[f"{f}{NORMALISED_SUFFIX}" for f in config.normalised_fields if f in config.entity_fields]]
    return T.StructType(
        [T.StructField("mention_id", T.StringType()), T.StructField("arrival_seq", T.LongType())]
        + [T.StructField(name, T.StringType()) for name in names]
    )


def of_ids(table: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of a table with an id that `asked` holds.

    Up to `LOOKUP` ids are part of the scan's filter, which then opens only those row groups and pages whose Bloom filters,
    smallest and largest ids admit one of them; more are joined.  `asked` is read once for that, so it should be written.
    """
    ids = asked.select("mention_id").where(F.col("mention_id").isNotNull()).distinct()
    few = ids.limit(LOOKUP + 1).collect()
    if len(few) > LOOKUP:
        return table.join(ids, "mention_id", "left_semi")
    return table.where(F.col("mention_id").isin([r["mention_id"] for r in few]))


@dataclass(frozen=True)
class StateTables:
    """Tables of one resolver under a shared folder."""

    spark: SparkSession
    folder: str
    config: ResolverConfig

    def _read(self, name: str, last: int | None = None) -> DataFrame | None:
        """Rows of all segments and of the batches behind them, up to the last batch asked for."""
        segments = [r for r in self.segments() if r["name"] == name]
        upto = max([r["upto"] for r in segments], default=-1)
        parts = [self.spark.read.parquet(f"{self.folder}/{r['path']}") for r in segments]
        loose = self._folder(name)
        if loose is not None:
            # on the partition column as it is, so that other folders are not even listed for reading
            loose = loose.where(F.col("batch_id") > upto) if segments else loose
            parts.append(loose if last is None else loose.where(F.col("batch_id") <= last))
        if not parts:
            return None
        # a segment holds the batch numbers as a column like any other
        parts = [p.withColumn("batch_id", F.col("batch_id").cast("bigint")) for p in parts]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part, allowMissingColumns=True)
        return found

    def _folder(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as problem:
            if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _files(self, path: str) -> list[str]:
        """Names of the folders in a folder."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _segment_lists(self) -> list[int]:
        """Numbers of the complete lists of segments."""
        found = [int(n.removeprefix("list=")) for n in self._files("segment_lists") if n.startswith("list=")]
        return sorted(n for n in found if "_SUCCESS" in self._files(f"segment_lists/list={n}"))

    def segments(self) -> list:
        """(name, path, upto, level) of all segments; their number grows with the logarithm of the batches."""
        lists = self._segment_lists()
        if not lists:
            return []
        return self.spark.read.schema(SEGMENT_LAYOUT).json(f"{self.folder}/segment_lists/list={lists[-1]}").collect()

    def merge(self, newest: int) -> None:
        """Merge the folders of batches before the newest one wherever a table has `MERGE_AT` of them, and segments likewise."""
        segments, changed = self.segments(), False
        for name in sorted(n for n in self._files("") if n not in ("segments", "segment_lists", "model")):
            own = [r for r in segments if r["name"] == name]
            upto = max([r["upto"] for r in own], default=-1)
            numbers = [int(m[1]) for n in self._files(name) if (m := re.fullmatch(r"batch_id=(\d+)", n))]
            for stale in (n for n in numbers if n <= upto):
                self._delete(f"{name}/batch_id={stale}")
            if sum(upto < n < newest for n in numbers) < MERGE_AT:
                continue
            loose = self._folder(name)
            if loose is None:  # batches without rows for this table
                for empty in (n for n in numbers if n < newest):
                    self._delete(f"{name}/batch_id={empty}")
                continue
            # younger segments join as long as they are enough of one level
            level, joined = 0, []
            while len(same := [r for r in own if r["level"] == level]) >= MERGE_AT - 1:
                joined, level = [*joined, *same], level + 1
            rows = loose.where(F.col("batch_id").between(upto + 1, newest - 1))
            for r in joined:
                part = self.spark.read.parquet(f"{self.folder}/{r['path']}")
                rows = rows.unionByName(part.withColumn("batch_id", F.col("batch_id").cast(rows.schema["batch_id"].dataType)), allowMissingColumns=True)
            if name == "mentions":
                # not in `_write`: ranges are found by a run of their own, which would count a batch's rows twice
                rows = rows.repartitionByRange(MERGE_AT, "mention_id")
            path = f"segments/{name}/{uuid.uuid4().hex}"
            self._write(rows, name, f"{self.folder}/{path}")
            segments = [r for r in segments if r not in joined] + [Row(name=name, path=path, upto=newest - 1, level=level)]
            changed = True
        if not changed:
            return
        self._list_segments(segments)

    def _list_segments(self, segments: list) -> None:
        """Replace the list of segments and delete what neither it nor the one before it names."""
        lists = self._segment_lists()
        number = lists[-1] + 1 if lists else 0
        rows = [tuple(r[c] for c in ("name", "path", "upto", "level")) for r in segments]
        target = f"{self.folder}/segment_lists/list={number}"
        self.spark.createDataFrame(rows, SEGMENT_LAYOUT).coalesce(1).write.mode("overwrite").json(target)
        # whoever still reads by the list before this one is left its files; those before go
        kept = {r["path"] for r in segments}
        if lists:
            before = self.spark.read.schema(SEGMENT_LAYOUT).json(f"{self.folder}/segment_lists/list={lists[-1]}").collect()
            kept |= {r["path"] for r in before}
        for old in lists[:-1]:
            self._delete(f"segment_lists/list={old}")
        for name in self._files("segments"):
            for part in self._files(f"segments/{name}"):
                if f"segments/{name}/{part}" not in kept:
                    self._delete(f"segments/{name}/{part}")

    def _write(self, frame: DataFrame, name: str, path: str) -> None:
        """Tables in buckets have one file a bucket (more where a bucket is large), sorted by block; mentions lie by id."""
        writer = frame.write
        if "bucket" in frame.columns:
            writer = frame.repartition("bucket").sortWithinPartitions("bucket", "key_set").write.partitionBy("bucket")
        elif name == "mentions":
            writer = frame.coalesce(MERGE_AT).sortWithinPartitions("mention_id").write.options(**ID_FILTERS)
        elif name != "responses":
            writer = frame.coalesce(MERGE_AT).write
        writer.mode("overwrite").parquet(path)

    def commits(self) -> DataFrame:
        """Committed batches."""
        found = self._read("commits")
        empty = self.spark.createDataFrame([], COMMIT_LAYOUT)
        return empty if found is None else empty.unionByName(found, allowMissingColumns=True).select(*empty.columns)

    def number_of(self, run: str, stream_batch: int) -> int:
        """Number of a run's batch: the one it was committed under, else the next one."""
        same = (F.col("run") == run) & (F.col("stream_batch") == stream_batch)
        row = self.commits().agg(F.max("batch_id").alias("last"), F.max(F.when(same, F.col("batch_id"))).alias("known")).first()
        if row["known"] is not None:
            return row["known"]
        return 0 if row["last"] is None else row["last"] + 1

    def last_arrival(self, before: int | None = None) -> int | None:
        """The largest arrival number stored, from the commit rows."""
        committed = self.commits()
        if before is not None:
            committed = committed.where(F.col("batch_id") < before)
        return committed.agg(F.max("last_seq")).first()[0]

    def table(self, name: str, layout: T.StructType | str, before: int | None = None) -> DataFrame:
        """Rows of all committed batches (before a batch, to repeat that batch after a failure); their numbers have no gaps."""
        empty = self.spark.createDataFrame([], layout)
        last = self._last_batch(before)
        found = None if last is None else self._read(name, last)
        return empty if found is None else found.select(*empty.columns)

    def _last_batch(self, before: int | None) -> int | None:
        committed = self.commits()
        if before is not None:
            committed = committed.where(F.col("batch_id") < before)
        return committed.agg(F.max("batch_id")).first()[0]

    def mentions(self, before: int | None = None) -> DataFrame:
        self.check_compatible()
        return self.table("mentions", mention_layout(self.config), before)

    def links(self, before: int | None = None) -> DataFrame:
        return self.table("links", LINK_LAYOUT, before)

    def clusters(self, before: int | None = None) -> DataFrame:
        return self.table("clusters", CLUSTER_LAYOUT, before)

    def reach(self, new: DataFrame, before: int | None = None) -> DataFrame:
        """Stored representatives (with cluster_id and profile_key) in the blocks of some new mentions.

        Only the buckets of these blocks are read.  State without the table, or that was written by other settings, gets it
        from all its mentions, as rows of the last batch before `before`.
        """
        layout = ReachLayout(self.config)
        last = self._last_batch(before)
        if last is not None and self._read(layout.name) is None:
            owned = self.mentions(before).join(self.clusters(before).select("mention_id", "cluster_id"), "mention_id")
            self.write_reach(last, representatives(owned, self.config))
        names = ["mention_id", "cluster_id", "profile_key", *mention_layout(self.config).fieldNames()[2:]]
        fields = ", ".join(f"`{n}` string" for n in names) + ", arrival_seq long, key_set int, bucket int"
        stored = self.table(layout.name, fields, before).where(F.col("bucket").isin(layout.asked(new)))
        return layout.in_reach(stored, new)

    def write_reach(self, batch_id: int, fresh: DataFrame | None) -> None:
        """Write a batch's representatives; tables of other settings, which would miss them, go."""
        layout = ReachLayout(self.config)
        others = [n for n in self._files("") if n.startswith("reach-") and n != layout.name]
        if others:
            listed = self.segments()
            if any(r["name"] in others for r in listed):  # a table of that name may come back
                self._list_segments([r for r in listed if r["name"] not in others])
            for other in others:
                self._delete(other)
        if fresh is None:
            self._delete(f"{layout.name}/batch_id={batch_id}")
        else:
            self.write(batch_id, **{layout.name: layout.dealt(fresh)})

    def check_compatible(self) -> None:
        """Refuse stored mentions without a normalised column that the configuration needs."""
        found = self._read("mentions")
        if found is None:
            return
        lacking = [name for name in mention_layout(self.config).fieldNames() if name not in found.columns]
        if lacking:
            raise OutdatedTableError(f"The table {self.folder}/mentions lacks {', '.join(lacking)}; write it anew")

    def write(self, batch_id: int, **tables: DataFrame) -> None:
        """Write one batch's rows; a repeated batch replaces what an earlier attempt left."""
        for name, frame in tables.items():
            self._write(frame, name, f"{self.folder}/{name}/batch_id={batch_id}")

    def commit(
        self, batch_id: int, mentions: int, source: str, run: str = "", stream_batch: int | None = None, last_seq: int | None = None
    ) -> None:
        """Make the batch visible; written last."""
        row = self.spark.createDataFrame(
            [(mentions, source, run, stream_batch, last_seq)],
            "mentions long, source string, run string, stream_batch long, last_seq long",
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch_id={batch_id}")

    def stored_mentions(self, before: int | None = None) -> int:
        """Number of stored mentions, from the commit rows."""
        committed = self.commits()
        if before is not None:
            committed = committed.where(F.col("batch_id") < before)
        return committed.agg(F.coalesce(F.sum("mentions"), F.lit(0))).first()[0]

    def save_model(self, config: ResolverConfig) -> None:
        """Write the parameters as JSON rows."""
        save_model(self.spark, config, f"{self.folder}/model")

    def load_model(self) -> tuple[ResolverConfig, str, str | None]:
        """Settings with the saved parameters, where they come from, and why a saved model was unusable."""
        return load_model(self.spark, self.config, f"{self.folder}/model")


def save_model(spark: SparkSession, config: ResolverConfig, path: str) -> None:
    """Write the model's parameters as JSON rows."""
    rows = [(*row, config.model.prior) for row in scoring.parameter_rows(config.model, config.comparisons)]
    spark.createDataFrame(rows, MODEL_LAYOUT).coalesce(1).write.mode("overwrite").json(path)


def load_model(spark: SparkSession, config: ResolverConfig, path: str) -> tuple[ResolverConfig, str, str | None]:
    """Read a model; without one, or with an unusable one, the hand-set parameters stay and the files are untouched."""
    try:
        text = spark.read.text(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return config, COLD_START, None
        return config, COLD_START, type(problem).__name__
    try:
        # The model is a few rows per compared field.
        rows = text.select(F.from_json("value", MODEL_LAYOUT, {"mode": "FAILFAST"}).alias("row")).select("row.*").collect()
        return replace(config, model=_model_of(rows, config)), PERSISTED, None
    except Exception as problem:  # noqa: BLE001  an unusable file must not stop the resolver
        return config, COLD_START, type(problem).__name__


def _model_of(rows: list, config: ResolverConfig) -> Model:
    parameters = {}
    for comparison in config.comparisons:
        found = {row.level: row for row in rows if row.field == comparison.field}
        if set(found) != set(comparison.levels):
            raise ValueError(f"The model has other levels for {comparison.field}")
        for row in found.values():
            if not (0 < row.m <= 1 and 0 < row.u <= 1):
                raise ValueError(f"The model has impossible probabilities for {comparison.field}")
        parameters[comparison.field] = tuple(
            LevelParameters(level, found[level].m, found[level].u, found[level].source) for level in comparison.levels
        )
    prior = rows[0].prior
    if prior is None or not 0 < prior < 1:
        raise ValueError("The model has an impossible prior")
    return Model(prior, parameters)

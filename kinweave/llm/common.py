"""Helpers of the training-data operators: narrow inputs, text mappers over Arrow batches, bounded training samples.

Every operator first selects the few columns it needs under names of its own, so extra or clashing columns of the
caller's table never meet the operator's working columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a text mapper turns into Python objects at once; the result does not depend on it.
SLICE_ROWS = 128


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def narrow(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under working names: narrow(docs, doc_id="id", text="body")."""
    return frame.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def type_of(frame: DataFrame, name: str) -> str:
    return frame.schema[name].dataType.simpleString()


def map_texts(
    frame: DataFrame,
    prepare: Callable[[], Callable[[pa.RecordBatch, list[bytes]], Sequence]],
    schema: str,
    column: str = "text",
) -> DataFrame:
    """Map rows to rows, a slice of a batch at a time, with the text column as UTF-8 bytes (null: empty).

    `prepare` runs once per task and gives the function from (slice, texts) to the output columns in schema order.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = part.column(column).cast(pa.binary()).fill_null(b"").to_pylist()
                yield to_batch(work(part, texts), arrow)

    return frame.mapInArrow(run, schema)


def to_batch(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    """Python, numpy or Arrow columns as one batch of the schema."""
    arrays = [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def key_bucket(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`: the split between learned and held-out rows."""
    return F.crc32(F.col(key).cast("string")) % parts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, mark: str, learn: Column, per_class: int, max_chars: int
) -> list[tuple[int, str]]:
    """At most `per_class` (mark, text) rows for each mark, 0 and 1, with texts of at most `max_chars` characters.

    The rows with the smallest key hashes are taken, so the choice does not depend on the partitioning.  Only rows for
    which `learn` holds (a condition on doc_id) are looked at.  Null marks, null and empty texts teach nothing.  A
    document that is labelled more than once counts as often, and so do rows that repeat a doc_id; they are counted, not
    collected, so the driver gets at most `per_class` texts of a class whatever the tables repeat.
    """
    wanted = learn & F.col("doc_id").isNotNull()
    marked = labels.select("doc_id", F.col(mark).cast("int").alias("mark")).where(wanted)
    short = docs.select("doc_id", "text").where(wanted & F.length("text").between(1, max_chars)).withColumn("print", F.xxhash64("text"))
    times = F.least(F.count("*"), F.lit(per_class))  # of a repeated row, more are never used
    known = marked.groupBy("doc_id", "mark").agg(times.alias("labelled")).join(
        short.groupBy("doc_id", "print").agg(times.alias("repeated")), "doc_id"
    )
    known = known.select("mark", F.xxhash64("doc_id").alias("place"), "doc_id", "print", (F.col("labelled") * F.col("repeated")).alias("times"))
    chosen = [known.where(F.col("mark") == m).orderBy("place", "doc_id", "print").limit(per_class) for m in (0, 1)]
    # at most 2 * per_class rows without texts: a bounded side, whatever the size of the tables
    named = short.join(F.broadcast(chosen[0].unionAll(chosen[1])), ["doc_id", "print"])
    rows = named.groupBy("mark", "place", "doc_id", "print", "times").agg(F.min("text").alias("text")).collect()
    taken: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r["place"], r["doc_id"], r["print"])):
        own = taken[r["mark"]]
        own += [r["text"]] * min(r["times"], per_class - len(own))
    return sorted((m, text) for m, own in taken.items() for text in own)

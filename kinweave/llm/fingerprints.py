"""Document fingerprints by threshold-scaled sketches.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, and the smallest one if none is below.
Equal fractions make sketches comparable whatever the lengths of the documents, and the union of two sketches is the sketch
of both texts together, so containment of a short document in a very long one is estimated as well as likeness.

`edited_pairs` compares each document with its edited text and with the next document in descending doc_id.  Documents are
dealt once into buckets of consecutive doc_ids; the first document of a bucket is also sent to the bucket before it, so each
bucket can be read as one sorted stream that holds two texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import map_texts, narrow, to_batch, type_of
from kinweave.llm.simhash import shingle_digests
from kinweave.session import task_slots

WORDS, SEED = 5, 42
#: Hashes below 2**64 / SCALE are kept.
SCALE = 2
#: Documents of a bucket of consecutive doc_ids, about.
BUCKET_ROWS = 8_192


def sketch(text: bytes, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles below the threshold; empty for texts without words."""
    hashes = shingle_digests(text, WORDS, SEED).view(">u8").ravel().astype(np.uint64)
    kept = np.unique(hashes[hashes < np.uint64(2**64 // scale)])
    return kept if len(kept) or not len(hashes) else hashes.min()[None]


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes / all hashes; 1 for two empty sketches, 0 for one."""
    shared = common(a, b)
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Part of a's hashes that b has; 1 for an empty a."""
    return common(a, b) / len(a) if len(a) else 1.0


def to_text(hashes: np.ndarray) -> str:
    """16 lowercase hex digits of each hash, ascending."""
    return hashes.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def document_sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """One row per document: doc_id, fingerprint.  Null and empty texts have an empty one, equal texts equal ones."""
    rows = narrow(docs, doc_id=doc_id, text=text)

    def prepare():
        return lambda part, texts: (part.column("doc_id"), [to_text(sketch(t, scale)) for t in texts])

    return map_texts(rows, prepare, f"doc_id {type_of(rows, 'doc_id')}, fingerprint string")


def _in_buckets(rows: DataFrame) -> DataFrame:
    """doc_id, text, bucket, copied: descending doc_ids in ascending buckets, each followed by the first row of the next one.

    The last bucket is followed by the first.  One doc_id per bucket comes to the driver.  Text ids are dealt by their first
    six bytes, so those with one long common beginning share a bucket.
    """
    ids = rows.select("doc_id")
    total = ids.count()
    buckets = max(4 * task_slots(rows.sparkSession), -(-total // BUCKET_ROWS), 1)
    order = F.col("doc_id")
    if type_of(rows, "doc_id") == "string":
        order = F.conv(F.rpad(F.hex(F.encode(F.substring("doc_id", 1, 6), "UTF-8")), 12, "0"), 16, 10)
    order = F.coalesce(order.cast("double"), F.lit(float("-inf")))  # any monotone bucket will do
    tops = ids.select(order.alias("k")).repartitionByRange(buckets, "k").groupBy(F.spark_partition_id()).agg(F.max("k").alias("k"))
    bounds = sorted({r["k"] for r in tops.collect()} - {float("-inf")})
    splits = [float("-inf"), *bounds, float("inf")]
    dealer = Bucketizer(splits=splits, inputCol="k", outputCol="b") if bounds else None

    def dealt(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("k", order)
        frame = dealer.transform(frame) if dealer else frame.withColumn("b", F.lit(0.0))
        return frame.withColumn("bucket", (F.lit(len(splits)) - F.col("b")).cast("int")).drop("b", "k")

    firsts = dealt(ids).groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    goes = [(r["top"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]  # the first bucket follows the last
    extra = rows.sparkSession.createDataFrame(goes, f"top {type_of(rows, 'doc_id')}, before int")
    # one row per bucket, that is per BUCKET_ROWS documents and four per slot: 12 bytes each
    found = dealt(rows).join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("copied"))))
    places = places.otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(False).alias("copied")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copied")))
    )
    found = found.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.*")
    found = found.repartition(max(task_slots(rows.sparkSession), buckets // 4), "bucket")
    return found.sortWithinPartitions("bucket", "copied", F.col("doc_id").desc_nulls_last(), "text")


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """One row per document with its edited text's digest and sketch, and the likeness to that and to the next document.

    The last floor(n_chars / 3) code points are replaced by the first as many (or all) of the next document in descending
    doc_id; after the last comes the first, so a single document follows itself.  Null texts are empty; rows that repeat a
    doc_id follow each other in the order of their texts (null first); null doc_ids come last.  Empty sketches are alike.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, within_edited,
    within_next (containment of the document).  An empty table gives an empty result.
    """
    rows = narrow(docs, doc_id=doc_id, text=text)
    schema = (
        f"doc_id {type_of(rows, 'doc_id')}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, within_edited double, within_next double"
    )
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its next one: (bucket, doc_id, text, sketch)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part, out = batch.slice(start, 128), []
                texts = part.column("text").cast(pa.string()).to_pylist()
                keys = zip(*(part.column(c).to_pylist() for c in ("bucket", "copied", "doc_id")))
                for (bucket, copied, key), body in zip(keys, texts):
                    if copied and held is None:
                        continue  # further rows with the doc_id that begins the next bucket
                    body = body or ""
                    own = sketch(body.encode(), scale)
                    if held is not None:
                        out.append(_compared(held, body, own, scale))
                    held = None if copied else (bucket, key, body, own)
                if out:
                    yield to_batch(list(zip(*out)), arrow)

    return _in_buckets(rows).mapInArrow(run, schema)


def _compared(held: tuple, body: str, following: np.ndarray, scale: int) -> tuple:
    """A row of `edited_pairs` from a document and the next one."""
    _, key, text, own = held
    third = len(text) // 3
    edited = (text[: len(text) - third] + body[:third]).encode()
    changed = sketch(edited, scale)
    near = [likeness(own, changed), likeness(own, following), containment(own, changed), containment(own, following)]
    return key, len(text), hashlib.sha256(edited).hexdigest(), to_text(own), to_text(changed), *near

"""Exact duplicates by counting quotient filters.

Every task puts the 64-bit fingerprints of its documents into counting quotient filters: the upper bits of a fingerprint
(quotient) choose a run, the lower bits (remainder) are kept sorted within the run, each with a counter.  Filters of equal
shape merge without loss by merging their sorted remainders, so the filters travel in blocks of quotients, and the merged
block tells which fingerprints occur more than once anywhere.  Only documents with such fingerprints go on to the
verification, which compares the SHA-256 digest and the length of all bytes; texts themselves are never shuffled, and a
group that holds a third of all documents costs one counter per filter and one combined row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.common import map_texts, narrow, to_batch, type_of
from kinweave.session import cut

#: [\x20\x09-\x0D], deleted before texts are compared.
BLANKS = b" \t\n\x0b\x0c\r"
#: Fingerprints a task holds before it sends its filter off, and those expected in one merged block.
FILTER_KEYS, BLOCK_KEYS = 1 << 20, 1 << 15
#: Quotient bits of a block, so its runs have about eight remainders.
RUN_BITS = 12
BLOCK_LAYOUT = "block bigint, quotients binary, runs binary, remainders binary, places binary, counts binary"


class CountingQuotientFilter:
    """Counters of 64-bit fingerprints: quotients with a run, their run lengths, and each run's sorted remainders with counters."""

    def __init__(self, quotient_bits: int, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits, self.quotients, self.runs, self.remainders, self.counts = quotient_bits, quotients, runs, remainders, counts

    @classmethod
    def of(cls, quotient_bits: int, keys: np.ndarray) -> CountingQuotientFilter:
        """The filter of fingerprints in any order, repeats included."""
        distinct, counts = np.unique(np.asarray(keys, np.uint64), return_counts=True)
        return cls._of_sorted(quotient_bits, distinct, counts.astype(np.int64))

    @classmethod
    def _of_sorted(cls, quotient_bits: int, distinct: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        rest = np.uint64(64 - quotient_bits)
        upper = distinct >> rest if quotient_bits else np.zeros(len(distinct), np.uint64)
        starts = np.flatnonzero(np.r_[True, upper[1:] != upper[:-1]]) if len(upper) else np.zeros(0, np.int64)
        remainders = distinct & ((np.uint64(1) << rest) - np.uint64(1)) if quotient_bits else distinct
        return cls(quotient_bits, upper[starts], np.diff(np.r_[starts, len(upper)]), remainders, counts)

    def keys(self) -> np.ndarray:
        """The fingerprints, ascending: nothing is lost."""
        if not self.quotient_bits:
            return self.remainders
        return np.repeat(self.quotients, self.runs) << np.uint64(64 - self.quotient_bits) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters in one: each sorted remainder of the other finds its place in the run of its quotient; equal ones add up.

        Nothing is sorted again: runs lie in the order of their quotients, so places come from binary search over both.
        """
        own, new, counts = self.keys(), other.keys(), self.counts.copy()
        at = np.searchsorted(own, new)
        known = np.zeros(len(new), bool)
        within = at < len(own)
        known[within] = own[at[within]] == new[within]
        counts[at[known]] += other.counts[known]
        merged = np.insert(own, at[~known], new[~known])
        return self._of_sorted(self.quotient_bits, merged, np.insert(counts, at[~known], other.counts[~known]))

    @classmethod
    def merged(cls, parts: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter | None:
        """All filters in one; those that stand for about as many parts meet, so k parts cost log k passes."""
        held: list[tuple[int, CountingQuotientFilter]] = []
        for part in parts:
            weight = 1
            while held and held[-1][0] <= weight:
                before, last = held.pop()
                weight, part = weight + before, last.merge(part)
            held.append((weight, part))
        return reduce(lambda left, right: left.merge(right), (part for _, part in reversed(held))) if held else None

    def blocks(self, block_bits: int) -> Iterator[tuple]:
        """Rows of `BLOCK_LAYOUT`: the filter cut at multiples of quotients, empty blocks left out.

        A block has its runs as (quotient within the block, length), its remainders without their upper bytes, which are zero,
        and the counters above one with their places.
        """
        within = self.quotient_bits - block_bits
        block = (self.quotients >> np.uint64(within)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        ends = np.r_[0, np.cumsum(self.runs)].astype(np.int64)
        quotients = (self.quotients & np.uint64((1 << within) - 1)).astype("<u4")
        remainders = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _width(self.quotient_bits)]
        for start, end in zip(starts, np.r_[starts[1:], len(block)]):
            low, high = ends[start], ends[end]
            many = np.flatnonzero(self.counts[low:high] > 1)
            yield (
                int(block[start]),
                quotients[start:end].tobytes(),
                self.runs[start:end].astype("<u4").tobytes(),
                remainders[low:high].tobytes(),
                many.astype("<u4").tobytes(),
                self.counts[low:high][many].astype("<i8").tobytes(),
            )

    @classmethod
    def of_block(
        cls, quotient_bits: int, block_bits: int, block: int, quotients: bytes, runs: bytes, remainders: bytes, places: bytes, many: bytes
    ) -> CountingQuotientFilter:
        """The part of a filter that `blocks` made a row of."""
        width = _width(quotient_bits)
        packed = np.frombuffer(remainders, np.uint8).reshape(-1, width)
        full = np.zeros((len(packed), 8), np.uint8)
        full[:, :width] = packed
        counts = np.ones(len(packed), np.int64)
        counts[np.frombuffer(places, "<u4")] = np.frombuffer(many, "<i8")
        first = np.uint64(block << (quotient_bits - block_bits))
        upper = np.frombuffer(quotients, "<u4").astype(np.uint64) + first
        return cls(quotient_bits, upper, np.frombuffer(runs, "<u4").astype(np.int64), full.view("<u8").ravel().astype(np.uint64), counts)

    def repeated(self) -> np.ndarray:
        return self.keys()[self.counts > 1]


def _width(quotient_bits: int) -> int:
    """Bytes of a remainder."""
    return -(-(64 - quotient_bits) // 8)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the text as it is), n_bytes and text_sha256 of the normalised text, fingerprint."""

    def prepare():
        def work(part: pa.RecordBatch, texts: list[bytes]):
            plain = [t.translate(None, BLANKS) for t in texts]
            points = [len(t.decode("utf-8", "replace")) for t in texts]
            prints = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in plain), np.uint64, len(plain)).view(np.int64)
            return part.column("doc_id"), points, [len(t) for t in plain], [hashlib.sha256(t).hexdigest() for t in plain], prints

        return work

    kind = type_of(docs, "doc_id")
    schema = f"doc_id {kind}, n_chars bigint, n_bytes bigint, text_sha256 string, fingerprint bigint"
    return map_texts(docs, prepare, schema)


def repeated_fingerprints(prints: DataFrame, expected: int) -> DataFrame:
    """The values of `fingerprint` that occur more than once, by merged counting quotient filters."""
    block_bits = max(0, (max(expected, 1) // BLOCK_KEYS)).bit_length()
    quotient_bits = block_bits + RUN_BITS
    arrow = to_arrow_schema(StructType.fromDDL(BLOCK_LAYOUT))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def sent():
            own = CountingQuotientFilter.of(quotient_bits, np.concatenate(held))
            blocks = own.blocks(block_bits)
            while found := list(islice(blocks, 256)):
                yield to_batch(list(zip(*found)), arrow)

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += batch.num_rows
            if rows >= FILTER_KEYS:
                yield from sent()
                held, rows = [], 0
        if rows:
            yield from sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("fingerprint", pa.int64())])
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, parts in groupby(rows, key=lambda row: row[0]):
            merged = CountingQuotientFilter.merged(CountingQuotientFilter.of_block(quotient_bits, block_bits, *row) for row in parts)
            yield to_batch([merged.repeated().view(np.int64)], schema)

    parts = prints.select("fingerprint").mapInArrow(build, BLOCK_LAYOUT)
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "fingerprint bigint")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when they are identical after `BLANKS` are deleted; null counts as empty, so nulls, empty texts and
    texts of blanks form one group.  The row with the most code points stays, then the smallest doc_id (null first).
    Rows that repeat a doc_id count as rows of their own; those that also share the text share `kept`.  An empty table
    gives an empty result.
    """
    known = cut(digests(narrow(docs, doc_id=doc_id, text=text)))
    routed = known.join(repeated_fingerprints(known, known.count()), "fingerprint", "left_semi")
    first = F.min(F.struct((-F.col("n_chars")).alias("shorter"), "doc_id")).alias("first")
    # grouped without the fingerprint, so a large group is split in the join above and combined before this shuffle
    groups = routed.groupBy("n_bytes", "text_sha256").agg(F.count("*").alias("size"), first)
    groups = cut(groups.where("size > 1").select("n_bytes", "text_sha256", "size", F.col("first.doc_id").alias("head")))
    rows = known.join(groups, ["n_bytes", "text_sha256"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("head"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        "n_chars",
    )

"""Removal of repeated byte strings by hash-compared suffix sorting.

A byte is removed when a string of `LENGTH` bytes that covers it also starts anywhere else in the corpus.  Which strings
repeat is read off a sorted order of suffixes: equal neighbours share `LENGTH` bytes.  Suffixes are compared by their common
extension, found by binary search over prefix polynomial hashes, so a comparison costs the logarithm of `LENGTH`; the sort
is a mergesort whose merges find every suffix's rank in the sibling run.  Neighbours that agree by hash are compared byte by
byte before anything is removed.

Sorting every suffix of a corpus is needless where content already tells that two suffixes differ.  Starts are dealt out by
content in three steps, each of which loses no repeat and sends hashes before it sends text:

1.  Each start has an anchor, the gram of `GRAM` bytes with the smallest hash within its `LENGTH` bytes.  Equal strings have
    equal anchors at equal places.  Consecutive starts with one anchor form a run (about 1 per 130 bytes); runs whose anchor
    occurs once in the corpus are done.  Runs with equal bytes, by two independent 64-bit hashes, repeat as a whole.
2.  The other runs, typically the edges of repeated passages, are cut into blocks of `BLOCK` starts, aligned to the anchor.
    All strings of a block share a core, so only blocks with equal cores can repeat; equal blocks repeat as a whole.
3.  What is left, distinct blocks with a common core, is brought together by core and its suffixes are sorted.  A core with
    more than `HOT` distinct blocks is split into single starts, whose `LENGTH` bytes are their own core: step 2 decides them.

Group counts are combined before they are shuffled, and texts travel once; those with undecided runs travel again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.common import map_texts, narrow, to_batch, type_of
from kinweave.session import cut, task_slots

LENGTH, GRAM, BLOCK, HOT = 400, 144, 32, 2_048
#: Starts looked at together; runs end there, which changes the work, not the result.
PIECE = 1 << 18
#: Blocks sorted together, besides one whole core.
SORT_BLOCKS = 1_024
BASE = 0x9E3779B97F4A7C15
#: What a document's row says of some of its starts: the run repeats; is undecided; repeats and is shown to undecided ones.
WHOLE, OPEN, SHOWN = 0, 1, 2


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    with np.errstate(over="ignore"):
        up = np.full(n, BASE, np.uint64)
        down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class PrefixHashes:
    """Polynomial hashes of all substrings of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(1 << max(12, len(data).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters()[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def grams(self, length: int) -> np.ndarray:
        """Mixed hashes of all substrings of one length."""
        n = len(self.sums) - length
        h = (self.sums[length:] - self.sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b, up to `most`, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most)
        for _ in range(most.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.of(a, middle) == self.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, first start, number of starts, place of the anchor) of the runs of a text."""
    width = length - gram + 1
    for begin in range(0, len(data) - length + 1, PIECE):
        part = data[begin : begin + PIECE + length - 1]
        hashes = PrefixHashes(part).grams(gram)
        starts = len(part) - length + 1
        place_bits = np.uint64(20)
        coded = (hashes >> place_bits << place_bits) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
        padded = np.full(-(-len(coded) // width) * width + width, np.iinfo(np.uint64).max)
        padded[: len(coded)] = coded
        rows = padded.reshape(-1, width)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:starts], before[width - 1 : width - 1 + starts])
        anchor = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        counts = np.diff(np.r_[first, starts])
        yield hashes[anchor[first]], begin + first, counts, begin + anchor[first]


def sort_suffixes(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by (bucket, first `length` bytes), and whether each, in that order, equals the one before.

    Mergesort: runs of a bucket double in width; a suffix's place after a merge is its place in its own run plus its rank in
    the sibling run, found by binary search with common extensions, for all suffixes of all buckets at once.
    """
    hashes = PrefixHashes(data)
    order = np.argsort(bucket, kind="stable")
    owner = bucket[order]
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[heads, len(owner)])
    head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    local = np.arange(len(owner)) - head
    width = 1
    while width < sizes.max(initial=0):
        run = local // width
        other = (run ^ 1) * width
        active = np.flatnonzero(other < size)
        own, low = starts[order[active]], other[active]
        floor, high = low.copy(), np.minimum(low + width, size[active])
        left = run[active] % 2 == 0
        for _ in range(int(width).bit_length()):
            searching = np.flatnonzero(low < high)
            if not len(searching):
                break
            middle = (low[searching] + high[searching]) >> 1
            mine, its = own[searching], starts[order[head[active[searching]] + middle]]
            shared = hashes.extension(mine, its, length)
            end = shared == length
            smaller = np.where(end, 0, data[np.where(end, 0, its + shared)].astype(np.int64) - data[np.where(end, 0, mine + shared)]) < 0
            below = smaller | (end & ~left[searching])  # of equals the left run's come first
            low[searching] = np.where(below, middle + 1, low[searching])
            high[searching] = np.where(below, high[searching], middle)
        place = np.arange(len(order))
        place[active] = head[active] + (run[active] // 2) * 2 * width + (local[active] - run[active] * width) + (low - floor)
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, width * 2
    same = np.zeros(len(order), bool)
    next_ = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    a, b = starts[order[next_ - 1]], starts[order[next_]]
    alike = hashes.of(a, length) == hashes.of(b, length)
    next_, a, b = next_[alike], a[alike], b[alike]
    for i in range(0, len(next_), 4096):  # hashes may collide, bytes don't
        at = np.arange(length)
        same[next_[i : i + 4096]] = (data[a[i : i + 4096, None] + at] == data[b[i : i + 4096, None] + at]).all(1)
    return order, same


def _signed(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _run_table(docs: DataFrame) -> DataFrame:
    """doc_id, print, anchor, segment, first, starts, lead (from the first start to the anchor)."""

    def prepare():
        def work(part: pa.RecordBatch, texts: list[bytes]):
            rows: list[list] = [[], [], [], [], [], [], []]
            for key, text in zip(part.column("doc_id").to_pylist(), texts):
                if len(text) < LENGTH:
                    continue
                mark = _print(text)
                for anchor, first, count, place in runs(np.frombuffer(text, np.uint8)):
                    lead = place - first
                    segment = [
                        xxhash.xxh3_64_intdigest(text[s : s + n + LENGTH - 1], seed=q << 32 | n)
                        for s, n, q in zip(first.tolist(), count.tolist(), lead.tolist())
                    ]
                    rows[0] += [key] * len(first)
                    rows[1] += [mark] * len(first)
                    rows[2].append(_signed(anchor))
                    rows[3].append(_signed(np.array(segment, np.uint64)))
                    for column, values in zip(rows[4:], (first, count, lead)):
                        column.append(values)
            return rows[0], rows[1], *(np.concatenate(c) if c else [] for c in rows[2:])

        return work

    key = f"doc_id {type_of(docs, 'doc_id')}, print bigint"
    return map_texts(docs, prepare, f"{key}, anchor bigint, segment bigint, first bigint, starts int, lead bigint")


def _print(text: bytes) -> int:
    """Spark's xxhash64 of the text."""
    value = xxhash.xxh64_intdigest(text, 42)
    return value - (1 << 64) if value >> 63 else value


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, list[tuple[int, int]], str]:
    """n_bytes, n_removed, the maximal removed spans, digest of the rest."""
    merged: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(high, merged[-1][1])
        else:
            merged.append((low, high))
    digest, at = hashlib.sha256(), 0
    for low, high in merged:
        digest.update(text[at:low])
        at = high
    digest.update(text[at:])
    return len(text), sum(h - l for l, h in merged), merged, digest.hexdigest()


def _blocks(text: bytes, first: int, starts: int, lead: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(core, block hash, first start, number of starts, its place in the block, bytes) of the blocks of a run."""
    anchor, end, at = first + lead, first + starts, first
    while at < end:
        skip = (at - anchor) % BLOCK
        until = min(at - skip + BLOCK, end)
        core = xxhash.xxh3_64_intdigest(text[at - skip + BLOCK - 1 : at - skip + LENGTH], seed=(anchor - at + skip) & 0xFFFF)
        own = text[at : until + LENGTH - 1]
        yield core, xxhash.xxh3_64_intdigest(own, seed=skip << 32 | until - at), at, until - at, skip, own
        at = until


def _table_of(spans_kind: int, rows: DataFrame) -> DataFrame:
    """Rows of one kind as (doc_id, print, kind, first, starts, lead)."""
    return rows.select("doc_id", "print", F.lit(spans_kind).alias("kind"), "first", "starts", "lead")


def _windows(blocks: DataFrame) -> DataFrame:
    """Blocks of hot cores as single starts: (core, block, doc_id, print, at, starts = 1, many).  A start is its own core."""
    key = f"doc_id {type_of(blocks, 'doc_id')}, print bigint"

    def prepare():
        def work(part: pa.RecordBatch, texts: list[bytes]):
            owner, core, block, at = [], [], [], []
            for i, (first, n, text) in enumerate(zip(part.column("at").to_pylist(), part.column("starts").to_pylist(), texts)):
                for j in range(n):
                    window = text[j : j + LENGTH]
                    owner.append(i)
                    core.append(xxhash.xxh3_64_intdigest(window))
                    block.append(xxhash.xxh64_intdigest(window, 1))
                    at.append(first + j)
            rows = pa.array(owner, pa.int64())
            same = [part.column(c).take(rows) for c in ("doc_id", "print", "many")]
            hashes = [_signed(np.array(h, np.uint64)) for h in (core, block)]
            return *same[:2], *hashes, at, np.ones(len(at), np.int32), same[2]

        return work

    return map_texts(blocks, prepare, f"{key}, core bigint, block bigint, at bigint, starts int, many boolean", "bytes")


def _sorted_spans(blocks: DataFrame) -> DataFrame:
    """Distinct blocks that share cores -> (doc_id, print, first, starts) of the starts whose strings repeat.

    `many` blocks are known to repeat; they only serve to compare with.
    """
    columns = ["core", "doc_id", "print", "at", "starts", "skip", "many", "bytes"]
    dealt = blocks.select(*columns).repartition(task_slots(blocks.sparkSession), "core").sortWithinPartitions("core")
    schema = f"doc_id {type_of(blocks, 'doc_id')}, print bigint, first bigint, starts int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def found(rows: list[tuple]) -> pa.RecordBatch:
        core, doc, mark, at, count, skip, many, text = (list(c) for c in zip(*rows))
        data = np.frombuffer(b"".join(text), np.uint8)
        count, skip = np.array(count, np.int64), np.array(skip, np.int64)
        sizes = np.array([len(t) for t in text])
        begin = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(rows)), count)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        _, number = np.unique(np.array(core), return_inverse=True)
        bucket = number[piece] * BLOCK + skip[piece] + step
        order, same = sort_suffixes(data, begin[piece] + step, bucket, LENGTH)
        repeated = np.zeros(len(piece), bool)
        repeated[order[same]] = True
        repeated[order[np.flatnonzero(same) - 1]] = True
        repeated &= ~np.array(many, bool)[piece]
        hit = np.flatnonzero(repeated)
        if not len(hit):
            return to_batch([[], [], [], []], arrow)
        fresh = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (piece[hit[1:]] != piece[hit[:-1]])])
        length = np.diff(np.r_[fresh, len(hit)])
        where = piece[hit[fresh]]
        firsts = np.array(at, np.int64)[where] + step[hit[fresh]]
        return to_batch([[doc[i] for i in where], [mark[i] for i in where], firsts, length.astype(np.int32)], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, SORT_BLOCKS):
                held += zip(*(c.to_pylist() for c in batch.slice(start, SORT_BLOCKS).columns))
                if len(held) >= SORT_BLOCKS:
                    last = len(held) - 1
                    while last and held[last - 1][0] == held[-1][0]:
                        last -= 1
                    if last:
                        yield found(held[:last])
                        held = held[last:]
        if held:
            yield found(held)

    return dealt.mapInArrow(run, schema)


def _counted(blocks: DataFrame) -> DataFrame:
    """Distinct blocks with the number of their starts' owners, and the number of distinct blocks of their core."""
    one = blocks.groupBy("core", "block").agg(
        (F.count("*") + F.max(F.when(F.col("many"), 1).otherwise(0)) > 1).alias("many"),
        F.min(F.struct("doc_id", "print", "at")).alias("owner"),
    )
    return cut(one)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (maximal removed [low, high) byte ranges), kept_sha256.

    Whole texts as UTF-8 bytes; null counts as empty.  Matches never cross documents; overlaps and repeats within a document
    count, and strings are judged on the input.  Rows that repeat a doc_id, even with an equal text, are documents of their
    own.  Texts shorter than `LENGTH` bytes lose nothing.  An empty table gives an empty result.
    """
    rows = narrow(docs, doc_id=doc_id, text=text)
    kind = type_of(rows, "doc_id")
    key = [F.col("doc_id"), F.col("print")]
    table = cut(_run_table(rows))
    # written first: a join of two plain shuffles is split where one anchor has very many runs
    anchors = cut(table.groupBy("anchor").count().where("count > 1").select("anchor"))
    shared = cut(table.join(anchors, "anchor", "left_semi"))
    segments = shared.groupBy("anchor", "segment").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "print", "first", "starts", "lead")).alias("one")
    )
    segments = cut(segments)
    kinds = cut(segments.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"))
    mixed = segments.join(kinds, "anchor", "left_semi")
    whole = shared.join(segments.where("copies > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi")
    known = (
        _table_of(WHOLE, whole)
        .unionAll(_table_of(OPEN, mixed.where("copies = 1").select("one.*")))
        .unionAll(_table_of(SHOWN, mixed.where("copies > 1").select("one.*")))
    )
    # a document's runs are as many as its length allows
    per_doc = known.groupBy(*key).agg(F.collect_list(F.struct("kind", "first", "starts", "lead")).alias("runs"))
    texts = rows.withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = _by_key(texts, per_doc)

    # one pass over the texts: documents without undecided runs are finished; blocks and the other documents go on
    schema = (
        f"step string, doc_id {kind}, print bigint, n_bytes bigint, n_removed bigint, spans array<struct<low: bigint, high: bigint>>, "
        "kept_sha256 string, text binary, core bigint, block bigint, at bigint, starts int, skip int, many boolean"
    )
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part, out = batch.slice(start, 64), []
                texts_ = part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
                columns = (part.column(c).to_pylist() for c in ("doc_id", "print", "runs"))
                for doc, mark, own, body in zip(*columns, texts_):
                    own = own or []
                    spans = [(r["first"], r["first"] + r["starts"] + LENGTH - 1) for r in own if r["kind"] == WHOLE]
                    size, removed, merged, digest = _kept(body, spans)
                    ranges = [{"low": l, "high": h} for l, h in merged]
                    undecided = any(r["kind"] == OPEN for r in own)
                    if not undecided:
                        out.append(("done", doc, mark, size, removed, ranges, digest, *[None] * 7))
                    else:
                        out.append(("later", doc, mark, size, None, ranges, None, body, *[None] * 6))
                    for r in own:
                        if r["kind"] != WHOLE:
                            for core, block, at, n, skip, piece in _blocks(body, r["first"], r["starts"], r["lead"]):
                                core, block = (v - (1 << 64) if v >> 63 else v for v in (core, block))
                                out.append(("block", doc, mark, None, None, None, None, piece, core, block, at, n, skip, r["kind"] == SHOWN))
                yield to_batch(list(zip(*out)), arrow)

    steps = cut(joined.mapInArrow(passed, schema))
    blocks = steps.where("step = 'block'").select("core", "block", "doc_id", "print", "at", "starts", "skip", "many", F.col("text").alias("bytes"))
    one = _counted(blocks)
    cores = one.groupBy("core").agg(F.count("*").alias("kinds"))
    crowded = cores.where(F.col("kinds") > HOT).select("core")
    mixed_cores = cores.where((F.col("kinds") > 1) & (F.col("kinds") <= HOT)).select("core")
    owners = one.select("core", "block", F.col("many").alias("all_many"), F.col("owner.*"))

    def with_bytes(chosen: DataFrame) -> DataFrame:
        """One block of each kind in the chosen cores, with its bytes."""
        picked = owners.join(chosen, "core", "left_semi")
        names = ["core", "block", "doc_id", "print", "at"]
        same = [F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) if n == "doc_id" else F.col(f"x.{n}") == F.col(f"y.{n}") for n in names]
        both = blocks.alias("x").join(picked.alias("y"), same[0] & same[1] & same[2] & same[3] & same[4])
        both = both.select(*[f"x.{n}" for n in names], "x.starts", "x.skip", "x.bytes", F.col("y.all_many").alias("many"))
        return both.dropDuplicates(["core", "block"])

    repeated = blocks.where("NOT many").join(one.where("many").select("core", "block"), ["core", "block"], "left_semi")
    spans = repeated.select("doc_id", "print", F.col("at").alias("first"), "starts")
    spans = spans.unionAll(_sorted_spans(with_bytes(mixed_cores)))
    windows = cut(_windows(with_bytes(crowded)))
    twice = _counted(windows).where("many").select("core", "block")
    spans = spans.unionAll(
        windows.where("NOT many").join(twice, ["core", "block"], "left_semi").select("doc_id", "print", F.col("at").alias("first"), "starts")
    )
    more = spans.groupBy(*key).agg(F.collect_list(F.struct("first", "starts")).alias("runs"))
    later = steps.where("step = 'later'").select("doc_id", "print", "text", "spans")
    result = f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<low: bigint, high: bigint>>, kept_sha256 string"
    shape = to_arrow_schema(StructType.fromDDL(result))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                for row in zip(*(batch.slice(start, 64).column(c).to_pylist() for c in ("doc_id", "text", "spans", "runs"))):
                    doc, body, ranges, own = row
                    all_ = [(r["low"], r["high"]) for r in ranges] + [(r["first"], r["first"] + r["starts"] + LENGTH - 1) for r in own or []]
                    size, removed, merged, digest = _kept(body, all_)
                    out.append((doc, size, removed, [{"low": l, "high": h} for l, h in merged], digest))
                yield to_batch(list(zip(*out)), shape)

    done = steps.where("step = 'done'").select("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256")
    return done.unionAll(_by_key(later, more).mapInArrow(finished, result))


def _by_key(texts: DataFrame, runs_: DataFrame) -> DataFrame:
    """Texts with the runs of their (doc_id, print), null doc_ids included."""
    right = runs_.select(F.col("doc_id").alias("r_id"), F.col("print").alias("r_print"), "runs")
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("print") == F.col("r_print"))
    return texts.join(right, same, "left").drop("r_id", "r_print")

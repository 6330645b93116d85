"""Near copies by the Jaccard similarity of shingle sets: candidates from SimHash fingerprints and from MinHash bands, every
link verified on the sets.

The first candidates are the links of `simhash`: fingerprints that differ in at most 4 bits, by its inverted index over byte
positions, its count filter and its check of all bits.  Near copies of similarity 0.8 differ in about 10 bits, which that index
does not guarantee to see, so texts that share a band of minima are candidates as well.

A text is the set of its shingles (repeats count once).  `MINS` minima by as many hash functions agree in the share of the
similarity: texts of similarity 0.8 have all `ROWS` minima of at least one of 32 bands in common but for 6 of 10^5 pairs,
those of 0.85 but for 6 of 10^8, and texts of similarity 0.4 have a band in common once in 8 pairs.

The search by minima is built alike, an inverted index with a count filter over byte positions: a text is a string of `SKETCH` bytes, one of each
of the first minima.  Whoever shares a band is listed together, lists tally the positions at which two strings have the
same byte, and pairs with fewer than `AGREE` go (5 of 10^7 at similarity 0.8).  The components of the loose links of both
searches hold all pairs of the similarity asked for.

Loose components are small tables of their own: the sets of their members are computed again from the texts, meet once, and
are searched for the links whose sets really reach the similarity.  Only these make components.  Both searches return spanning
forests, never all pairs; long lists and large components are cut into tiles, and pairs of tiles are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import simhash
from kinweave.llm.common import map_texts, narrow, to_batch, type_of
from kinweave.llm.simhash import components, shingle_digests
from kinweave.session import cut, task_slots

WORDS, SEED, LEAST = 5, 42, Fraction(4, 5)
MINS, ROWS, SKETCH, AGREE = 192, 6, 128, 80
#: Shingles whose minima are taken at once.
AT_ONCE = 256
#: Members of a tile of a list, and shingles of a tile of a component.
TILE, SHINGLES = 2_048, 1 << 20
_FUNCTIONS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, MINS), np.uint32)
_FACTORS, _TERMS = _FUNCTIONS[0] | np.uint32(1), _FUNCTIONS[1]


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; none without words."""
    return np.unique(shingle_digests(text, words, SEED).view(">u8").ravel().astype(np.uint64))


def node_of(hashes: np.ndarray) -> int:
    """The number of a shingle set, signed: equal sets have equal ones, different sets in 1 of 2^64 pairs."""
    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), SEED), np.uint64).astype(np.int64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """`MINS` minima of a set; equal ones stand for a shared shingle."""
    low, out = hashes.astype(np.uint32), np.full(MINS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), AT_ONCE):
        np.minimum(out, (low[start : start + AT_ONCE, None] * _FACTORS + _TERMS).min(0), out=out)
    return out


def bands(mins: np.ndarray) -> list[int]:
    """A key for each band: its number and its minima, hashed."""
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(mins.reshape(-1, ROWS))]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """row, node, n (shingles), keys (of the bands), sketch (a byte of each of the minima), print0 (SimHash fingerprint)."""

    def prepare():
        def work(part: pa.RecordBatch, texts: list[bytes]):
            sets = [shingle_set(t, words) for t in texts]
            mins = [minima(s) for s in sets]
            bytes_ = [(m[:SKETCH] & np.uint32(255)).astype(np.uint8).tobytes() for m in mins]
            # a set without shingles is equal to its like only, which is one node
            keys = [bands(m) if len(s) else [] for m, s in zip(mins, sets)]
            listed = pa.array(keys, pa.list_(pa.field("element", pa.int64())))
            prints = np.frombuffer(b"".join([simhash.fingerprint(t) for t in texts]), ">i8").astype(np.int64)
            return part.column("row"), [node_of(s) for s in sets], [len(s) for s in sets], listed, bytes_, prints

        return work

    return map_texts(docs, prepare, f"row {type_of(docs, 'row')}, node bigint, n bigint, keys array<bigint>, sketch binary, print0 bigint")


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among 0 to n - 1; linked(at, rest) tells which of `rest` link to `at`."""
    left, right, rest = [], [], np.arange(n)
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
        at = queue.pop()
        which = linked(at, rest)
        found = rest[which].tolist()
        left += [at] * len(found)
        right += found
        queue += found
        rest = rest[~which]
    return left, right


def alike(sketch: np.ndarray) -> tuple[list[int], list[int]]:
    """Forest of the loose links among sketches (rows of `SKETCH` bytes)."""
    return forest(len(sketch), lambda at, rest: (sketch[rest] == sketch[at]).sum(1) >= AGREE)


def similar(sets: list[np.ndarray], least: Fraction = LEAST) -> tuple[list[int], list[int]]:
    """Forest of the links among shingle sets whose Jaccard similarity is at least `least`, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    ends = np.cumsum(np.bincount(codes))
    begins, starts = np.r_[0, ends[:-1]], np.cumsum(sizes) - sizes
    over, under = least.numerator, least.denominator

    def linked(at: int, rest: np.ndarray) -> np.ndarray:
        own = codes[starts[at] : starts[at] + sizes[at]]
        lengths = ends[own] - begins[own]
        places = np.repeat(begins[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[places], minlength=len(sets))[rest]
        return under * shared >= over * (sizes[at] + sizes[rest] - shared)

    return forest(len(sets), linked)


def dealt(listed: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of a list or component (with the number of its `tiles`) in each pair of tiles that has their own, sorted."""
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pair = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    rows = listed.withColumn("own", own).withColumn("other", other).select(key, *pair, "node", *columns)
    parts = max(task_slots(listed.sparkSession), 1)
    return rows.repartition(parts, key, "low", "high").sortWithinPartitions(key, "low", "high", "node")


def edges(rows: DataFrame, search: Callable[[list[bytes]], tuple[list[int], list[int]]]) -> DataFrame:
    """(a, b) nodes of the forests that `search` finds in each group of dealt rows (key, low, high, node, bytes)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array]] = []

        def found(parts: list[tuple[np.ndarray, pa.Array]]) -> pa.RecordBatch:
            nodes = np.concatenate([p[0] for p in parts])
            x, y = search([b for p in parts for b in p[1].to_pylist()]) if len(nodes) > 1 else ([], [])
            return to_batch([nodes[x], nodes[y]], schema) if x else to_batch([[], []], schema)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            starts = np.r_[0, np.flatnonzero((group[:3, 1:] != group[:3, :-1]).any(0)) + 1, batch.num_rows]
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                name = tuple(group[:3, s])
                if held and name != last:
                    yield found(held)
                    held = []
                held.append((group[3, s:e], batch.column(4).slice(s, e - s)))
                last = name
        if held:
            yield found(held)

    return rows.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def loose_links(nodes: DataFrame) -> DataFrame:
    """(a, b) edges between nodes of distinct (node, keys, sketch) rows that connect what shares a band and `AGREE` minima."""
    listed = nodes.select("node", F.explode("keys").alias("key"))
    # most lists have one member; only the others take sketches along
    shared = listed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    tiles = F.ceil(F.col("members") / TILE).cast("int").alias("tiles")
    slim = cut(listed.join(shared, "key").select("key", "node", tiles))
    rows = dealt(slim.join(nodes.select("node", "sketch"), "node"), "key", "sketch")
    return edges(rows, lambda held: alike(np.frombuffer(b"".join(held), np.uint8).reshape(-1, SKETCH)))


def print_links(known: DataFrame) -> DataFrame:
    """(a, b) edges between nodes of (node, print0) rows that connect what equal or linked SimHash fingerprints connect.

    A node has several fingerprints where texts of one shingle set repeat shingles differently.
    """
    held = cut(known.select("node", "print0").distinct())
    first = cut(held.groupBy("print0").agg(F.min("node").alias("first")))
    same = held.join(first, "print0").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = simhash.links(first.select("print0"), first.count())
    for end in ("a", "b"):
        ends = ends.join(first.select(F.col("print0").alias(end), F.col("first").alias(f"{end}_node")), end)
    return same.unionAll(ends.select("a_node", "b_node")).where("a <> b")


def verified_links(docs: DataFrame, members: DataFrame, words: int, least: Fraction) -> DataFrame:
    """(a, b) edges that connect what pairs of similarity `least` within a loose component (row, node, root, tiles) connect."""

    def prepare():
        def work(part: pa.RecordBatch, texts: list[bytes]):
            return *(part.column(c) for c in ("root", "node", "tiles")), [shingle_set(t, words).tobytes() for t in texts]

        return work

    sets = map_texts(docs.join(members, "row"), prepare, "root bigint, node bigint, tiles int, hashes binary")
    return edges(dealt(sets, "root", "hashes"), lambda held: similar([np.frombuffer(h, np.uint64) for h in held], least))


def near_copies(docs: DataFrame, row: str, text: str = "text", words: int = WORDS, least: Fraction = LEAST) -> DataFrame:
    """(row, component) for every row of docs, whose column `row` numbers the rows: no nulls, none twice.

    Rows link when the Jaccard similarity of their shingle sets is at least `least`; what links connect is one component.
    Bands and count filter are laid out for 0.8, so a lower `least` raises ValueError.  Every link is verified on the sets, as
    64-bit hashes of shingles; of the pairs at 0.8 fewer than 1 in 10^4 are not seen, of more similar ones fewer still.  Null
    and empty texts and texts of blanks are equal.
    """
    if least < LEAST:
        raise ValueError(f"links below a similarity of {LEAST} would be lost")
    docs = narrow(docs, row=row, text=text)
    known = cut(sketches(docs, words))
    nodes = cut(known.dropDuplicates(["node"]).select("row", "node", "n", "keys", "sketch"))
    loose = components(cut(print_links(known).unionAll(loose_links(nodes))))
    loose = loose.unionAll(loose.select(F.col("root").alias("node"), "root").distinct())  # roots have no row of their own
    members = nodes.select("row", "node", "n").join(loose, "node")
    tiles = members.groupBy("root").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("tiles"))
    members = cut(members.join(tiles, "root").select("row", "node", "root", "tiles"))
    found = components(cut(verified_links(docs, members, words, least)))
    return known.select("row", "node").join(found, "node", "left").select("row", F.coalesce("root", "node").alias("component"))

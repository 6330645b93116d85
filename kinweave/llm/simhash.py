"""Near duplicates by SimHash fingerprints and an inverted index over their bytes.

Two 64-bit fingerprints that differ in at most `BITS` = 4 bits agree in at least 8 - 4 = 4 of their 8 byte positions.  The
index lists fingerprints by (positions, bytes there).  Single positions have only 256 lists each, so positions are indexed
in groups: a family of position sets such that every 4 positions contain one of them (a covering, so no pair is missed).
Whoever shares a list is counted: the positions at which both have the same byte are tallied, pairs with fewer than the
guaranteed 4 are dropped, and the others are verified on all bits.  Equal fingerprints are one entry of the index.

Near copies of similarity 0.8 differ in about 10 of 64 bits, which leaves no position equal for sure.  A search for them takes
several fingerprints of one document by different hash functions as one of 8 positions each, indexes triples of positions
that overlap little (`spread`), tallies over all positions and verifies the sum of the differing bits.

A list never yields all its pairs: a search from fingerprint to fingerprint inside the list gives a spanning forest of its
links, which has fewer edges than the list has entries.  Long lists are cut into tiles, and pairs of tiles are dealt out.
Components come from the union of all forests by rounds of large-star and small-star joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinweave.llm.common import map_texts, narrow, to_batch, type_of
from kinweave.session import cut, task_slots

WORDS, SEED, BITS = 4, 42, 4
#: Multiplier that makes other hash functions of the first.
MIX = 0xBF58476D1CE4E5B9
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 15
#: Fingerprints of one tile; lists beyond are cut.
TILE = 2_048
#: Equal positions that a pair needs at least to be verified.
SHARED = 4


def shingle_digests(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle as rows of 8 bytes, the most significant first; repeats included.

    Words are runs of anything but [\\x20\\x09-\\x0D], A-Z lower-cased, joined by one space; fewer words than a shingle has
    are one shingle; without words there is none.
    """
    found = text.lower().split()
    plain, digest = b" ".join(found), xxhash.xxh64_digest
    if len(found) <= words:
        return np.frombuffer(digest(plain, seed) if found else b"", np.uint8).reshape(-1, 8)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1].tolist()
    hashed = b"".join([digest(plain[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist())])
    return np.frombuffer(hashed, np.uint8).reshape(-1, 8)


def remixed(rows: np.ndarray, turn: int) -> np.ndarray:
    """Rows of 8 hash bytes as those of another hash function; turn 0 leaves them."""
    if not turn:
        return rows
    h = rows.view(">u8").ravel().astype(np.uint64) + np.uint64(turn * MIX % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX)
    return (h ^ (h >> np.uint64(31))).astype(">u8").view(np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED, turns: int = 1) -> bytes:
    """8 bytes a turn: each bit set where more than half of the shingle hashes have it; zero without shingles."""
    rows = shingle_digests(text, words, seed)
    counts = np.zeros((turns, 64), np.int64)
    for start in range(0, len(rows), AT_ONCE):
        for turn in range(turns):
            bits = np.unpackbits(remixed(rows[start : start + AT_ONCE], turn), axis=1)
            counts[turn] += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(rows)).tobytes()


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, turns: int = 1) -> DataFrame:
    """doc_id, print0, print1 ... (fingerprints as signed 64-bit numbers, one a turn)."""

    def prepare():
        def work(part: pa.RecordBatch, texts: list[bytes]):
            prints = b"".join([fingerprint(t, words, seed, turns) for t in texts])
            return part.column("doc_id"), *np.frombuffer(prints, ">i8").astype(np.int64).reshape(-1, turns).T

        return work

    columns = ", ".join(f"print{turn} bigint" for turn in range(turns))
    return map_texts(docs, prepare, f"doc_id {type_of(docs, 'doc_id')}, {columns}")


def covering(size: int) -> list[tuple[int, ...]]:
    """Sets of `size` of the 8 byte positions such that any 4 positions contain one of them.

    The positions are dealt to three groups (0-2, 3-5, 6-7).  For 2: the pairs within a group, as 4 positions put two into
    one group.  For 3: the triples within a group, and those with two of a group and one of the next, in a circle.
    """
    group = (0, 0, 0, 1, 1, 1, 2, 2)
    if size == 2:
        return [c for c in combinations(range(8), 2) if group[c[0]] == group[c[1]]]
    if size == 4:
        return list(combinations(range(8), 4))
    chosen = []
    for c in combinations(range(8), 3):
        members = [group[i] for i in c]
        if len(set(members)) == 1 or any(members.count(g) == 2 and members.count((g + 1) % 3) == 1 for g in range(3)):
            chosen.append(c)
    return chosen


def spread(turns: int) -> list[tuple[int, ...]]:
    """Triples of the 8 * turns positions; no two of them have more than one position in common (from 3 turns on).

    The steps within the three kinds of triples, 1 to 7, 9 and 13, all differ.
    """
    places = 8 * turns
    return [(i, (i + x) % places, (i + y) % places) for x, y in ((1, 3), (4, 9), (6, 13)) for i in range(places)]


def _keys(sets: list[tuple[int, ...]]) -> Column:
    """Array of the lists of a row of fingerprints: number of the position set, then the bytes there."""
    keys = []
    for number, places in enumerate(sets):
        key = F.lit(number).cast("bigint")
        for place in places:
            key = key * 256 + F.shiftrightunsigned(f"print{place // 8}", 8 * (place % 8)).bitwiseAND(F.lit(255))
        keys.append(key)
    return F.array(*keys)


def near(differ: np.ndarray, bits: int) -> np.ndarray:
    """Which columns of differences (a row a turn) stay: the count filter over byte positions, then all bits."""
    turns, n = differ.shape
    differ = np.ascontiguousarray(differ)
    same = (differ.view(np.uint8).reshape(turns, n, 8) == 0).sum((0, 2))
    found = same >= max(8 * turns - bits, SHARED)
    found[found] = np.bitwise_count(differ[:, found]).sum(0, dtype=np.int64) <= bits
    return found


def forest(prints: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among the columns of fingerprints (a row a turn)."""
    left, right, rest = [], [], np.arange(prints.shape[1])
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
        at = queue.pop()
        linked = near(prints[:, rest] ^ prints[:, at, None], bits)
        found = rest[linked].tolist()
        left += [at] * len(found)
        right += found
        queue += found
        rest = rest[~linked]
    return left, right


def links(prints: DataFrame, expected: int, bits: int = BITS, turns: int = 1) -> DataFrame:
    """(a, b) edges between values of print0 of distinct rows (print0, print1 ...), with equal components as the links.

    With one turn the edges connect exactly what links of at most `bits` differing bits connect; `expected`, the number of
    rows, then chooses how many bytes a list has, so that lists of chance stay short at any size, and the edges connect
    alike for every choice.  With more turns, `bits` counts over all of them, and pairs that have no triple of `spread` and
    fewer than `SHARED` positions in common are not seen; neither depends on the size of the table.
    """
    if turns == 1 and bits > 8 - SHARED:
        raise ValueError("the position sets guarantee links of at most 4 differing bits")
    size = 2 if expected <= 1 << 12 else 3 if expected <= 1 << 24 else 4
    spark, columns = prints.sparkSession, [f"print{turn}" for turn in range(turns)]
    listed = prints.select(*columns, F.explode(_keys(covering(size) if turns == 1 else spread(turns))).alias("key"))
    # long lists: tiles by a hash, each row in every pair of tiles that has its own
    lengths = listed.groupBy("key").count().where(F.col("count") > TILE)
    # written first: the planner then knows the size of these few keys before it would shuffle all lists for the join
    tiles = cut(lengths.select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    tiled = listed.join(tiles, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64(*columns), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = tiled.withColumn("own", own).withColumn("other", other)
    pair = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    dealt = dealt.select("key", *pair, *columns)
    parts = max(task_slots(spark), 1)
    dealt = dealt.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", *columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        kept: list[np.ndarray] = []

        def found(rows: np.ndarray) -> pa.RecordBatch:
            group, prints_ = rows[:3], rows[3:].view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(0)])
            lengths_ = np.diff(np.r_[starts, rows.shape[1]])
            twos = starts[lengths_ == 2]  # most lists, all at once
            twos = twos[near(prints_[:, twos] ^ prints_[:, twos + 1], bits)]
            a, b = [twos], [twos + 1]
            for s, n in zip(starts[lengths_ > 2].tolist(), lengths_[lengths_ > 2].tolist()):
                x, y = forest(prints_[:, s : s + n], bits)
                a.append(np.array(x, np.int64) + s)
                b.append(np.array(y, np.int64) + s)
            return to_batch([rows[3][np.concatenate(a)], rows[3][np.concatenate(b)]], schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            kept.append(rows)
            changed = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(0))
            if len(changed) and (whole := changed[-1] + 1):
                yield found(np.concatenate([*kept[:-1], rows[:, :whole]], axis=1))
                kept = [rows[:, whole:]]
        if kept:
            yield found(np.concatenate(kept, axis=1))

    return dealt.mapInArrow(search, "a bigint, b bigint").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge, by alternating large-star and small-star joins.

    Each round keeps at most as many edges as there were and ends with stars.  Only the counts and a hash of the edges come
    to the driver.  A node with very many edges is a skewed key of a join whose other side is unique.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = state.unionAll(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "root"), F.struct(F.col("b").alias("a"), "root"))).alias("e"))
        watch = Observation()
        small = small.select(F.col("e.a").alias("a"), F.col("e.root").alias("b")).where("a <> b").distinct()
        state = cut(small, watch, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        now = (watch.get["n"], watch.get["h"])
        if now == before or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    seed: int = SEED,
    bits: int = BITS,
    turns: int = 1,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component_size.

    Documents link when their fingerprints differ in at most `bits` bits; component_id is the smallest doc_id reachable.
    With more `turns`, the fingerprints of the same shingles by that many hash functions count as one long fingerprint, for
    similarities too low for one of 64 bits (`links` tells what is seen); `fingerprint` is the first.  Documents whose first
    fingerprints are equal always link.
    Null and empty texts and texts of blanks have fingerprint zero and link like any other.  Rows that repeat a doc_id are
    rows of their own; null doc_ids take part but never name a component unless it has no other.  An empty table gives an
    empty result.
    """
    known = cut(fingerprints(narrow(docs, doc_id=doc_id, text=text), words, seed, turns))
    columns = [f"print{turn}" for turn in range(turns)]
    distinct = cut(known.groupBy(*columns).agg(F.count("*").alias("n")))
    edges = cut(links(distinct, distinct.count(), bits, turns))
    found = components(edges)
    known = known.select("doc_id", F.col("print0").alias("print"))
    first = known.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    rooted = first.join(found, first["print"] == found["node"], "left").select(
        "print", "first", "copies", F.coalesce("root", "print").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("component_size"))
    # written first: the join of two plain shuffles is split where one fingerprint has very many documents
    named = cut(rooted.select("print", "root").join(named, "root").drop("root"))
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return known.join(named, "print").select("doc_id", hexed.alias("fingerprint"), "component_id", "component_size")

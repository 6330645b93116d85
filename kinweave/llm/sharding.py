"""Sharding by a K-d tree over document metadata.

Every node of the tree is split along its widest dimension at the weighted median (a quantile, where an odd number of leaves
remains), weighted by document sizes, until each leaf holds about the target bytes.  Medians are found by counting: sizes are
summed over a few hundred ranges of the node's keys, then over the parts of the range that holds the median, for all nodes of
a level at once.  The driver sees one row per node and round, and never a document.

The order along a dimension is its value, then a hash of the text; so equal texts stay together unless a median falls into a
group too large to go to either side, and then that group alone is split, by a hash of its doc_ids.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import narrow
from kinweave.session import cut

#: Ranges counted per node and round; a split may miss its quantile by this part of a leaf.
RANGES, MISS = 256, 0.001
#: Rows numbered by one task, about.
SLOT_ROWS = 16_384


@dataclass(frozen=True)
class Search:
    """The search for one node's split: rows below `low` weigh `below`; the quantile lies in [low, high]."""

    node: int
    leaves: int
    weight: int
    dimension: int
    low: int
    high: int
    below: int = 0
    key: int | None = None  # the group that has to be split; low and high are then salts
    at: int | None = None  # found: rows below `at` go left

    @property
    def target(self) -> float:
        return self.weight * (self.leaves // 2) / self.leaves


def dimensions(doc: str = "text") -> dict[str, Column]:
    """Metadata of a document that equal texts share: its length in powers of two, its bytes per code point."""
    size, points = F.octet_length(doc), F.char_length(doc)
    return {"length": F.log2(F.coalesce(size, F.lit(0)) + 1), "script": F.coalesce(size / F.nullif(points, F.lit(0)), F.lit(1.0))}


def _measured(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """id, size, text_crc32, keys (one per dimension), salt; and the number of dimensions."""
    rows = narrow(docs, id=doc_id, text=text)
    values = dimensions()
    plain = rows.select(
        "id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 33).alias("digest"),
        F.xxhash64("id", F.lit(1)).alias("salt"),
        *[v.cast("double").alias(name) for name, v in values.items()],
    )
    plain = cut(plain)
    ends = plain.agg(*[f(n).alias(f"{n}_{f.__name__}") for n in values for f in (F.min, F.max)]).first()
    keys = []
    for name in values:
        low, high = ends[f"{name}_min"], ends[f"{name}_max"]
        share = (F.col(name) - F.lit(low)) / F.lit(high - low) if high is not None and high > low else F.lit(0.0)
        keys.append(F.shiftleft(F.floor(share * F.lit(2.0**31 - 1)).cast("bigint"), 31).bitwiseOR(F.col("digest")))
    return plain.select("id", "size", "text_crc32", F.array(*keys).alias("keys"), "salt"), len(values)


def _round(rows: DataFrame, searches: list[Search]) -> list[Search]:
    """One round of counting for all searches that go on."""
    spark = rows.sparkSession
    names = "node int, dimension int, key bigint, low bigint, high bigint, step bigint, below bigint, target double"
    values = [
        (s.node, s.dimension, s.key, s.low, s.high, max(1, -(-(s.high - s.low + 1) // RANGES)), s.below, s.target) for s in searches
    ]
    open_ = spark.createDataFrame(values, names)
    own = F.element_at("keys", F.col("dimension") + 1)
    at = F.when(F.col("key").isNull(), own).otherwise(F.col("salt"))
    inside = rows.join(F.broadcast(open_), "node").withColumn("own", own).withColumn("at", at)  # one row per node of the level
    inside = inside.where("(key IS NULL OR own = key) AND at BETWEEN low AND high")
    # differences of salts may exceed a long
    place = F.floor((F.col("at").cast("decimal(38,0)") - F.col("low")) / F.col("step")).cast("int")
    sums = inside.groupBy("node", place.alias("place"), "below", "target").agg(
        F.sum("size").alias("size"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    upto = F.col("below") + F.sum("size").over(Window.partitionBy("node").orderBy("place"))
    hit = F.row_number().over(Window.partitionBy("node").orderBy("place"))
    sums = sums.withColumn("upto", upto).where("upto >= target").withColumn("nth", hit).where("nth = 1")
    found = {r["node"]: r for r in sums.select("node", "size", "first", "last", "upto").collect()}
    return [_narrowed(s, found.get(s.node)) for s in searches]


def _narrowed(search: Search, hit) -> Search:
    if hit is None:  # nothing weighs enough: all rows go left
        return replace(search, at=search.high + 1)
    before, upto = hit["upto"] - hit["size"], hit["upto"]
    allowed = MISS * search.weight / search.leaves
    if min(search.target - before, upto - search.target) <= allowed or (hit["first"] == hit["last"] and search.key is not None):
        left = search.target - before <= upto - search.target
        return replace(search, at=hit["first"] if left else hit["last"] + 1)
    if hit["first"] == hit["last"]:
        return replace(search, key=hit["first"], low=-(2**63), high=2**63 - 1, below=before)
    return replace(search, low=hit["first"], high=hit["last"], below=before)


def _leaves(rows: DataFrame, dims: int, leaves: int) -> DataFrame:
    """The rows with `node`, the number of their leaf from 0."""
    rows, open_ = rows.withColumn("node", F.lit(0)), {0: leaves}
    while any(n > 1 for n in open_.values()):
        upper = [F.shiftright(F.element_at("keys", d + 1), 31) for d in range(dims)]
        spans = rows.groupBy("node").agg(
            F.sum("size").alias("weight"),
            *[f(F.element_at("keys", d + 1)).alias(f"{f.__name__}{d}") for d in range(dims) for f in (F.min, F.max)],
            *[(F.max(u) - F.min(u)).alias(f"width{d}") for d, u in enumerate(upper)],
        )
        searches, done = [], []
        for r in spans.collect():  # one row per node
            if open_.get(r["node"], 1) > 1:
                widest = max(range(dims), key=lambda d: r[f"width{d}"])
                searches.append(Search(r["node"], open_[r["node"]], r["weight"], widest, r[f"min{widest}"], r[f"max{widest}"]))
        while searches:
            searches = _round(rows, searches)
            done += [s for s in searches if s.at is not None]
            searches = [s for s in searches if s.at is None]
        splits = [(s.node, s.dimension, s.key, s.at, s.leaves // 2) for s in done]
        if not splits:
            break
        # a leaf's number is that of its leftmost leaf: the right half begins `left` leaves later; the salts' end may exceed a long
        splits = [(n, d, k, min(at, 2**63 - 1), at > 2**63 - 1, left) for n, d, k, at, left in splits]
        named = rows.sparkSession.createDataFrame(splits, "node int, dimension int, key bigint, at bigint, all boolean, left int")
        own = F.element_at("keys", F.col("dimension") + 1)
        goes_left = F.when(F.col("key").isNull() | (own == F.col("key")), F.col("all") | (F.when(F.col("key").isNull(), own).otherwise(F.col("salt")) < F.col("at")))
        goes_left = goes_left.otherwise(own < F.col("key"))
        moved = rows.join(F.broadcast(named), "node", "left")
        node = F.when(F.col("dimension").isNull() | goes_left, F.col("node")).otherwise(F.col("node") + F.col("left"))
        rows = cut(moved.select("id", "size", "text_crc32", "keys", "salt", node.alias("node")))
        open_ = open_ | {s.node: s.leaves // 2 for s in done} | {s.node + s.leaves // 2: s.leaves - s.leaves // 2 for s in done}
    return rows


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot; sizes of shards are near equal.

    Either the number of shards is given, or as many are made as hold `target_bytes` each.  The size is the text's UTF-8
    bytes plus 1; null texts have size 1 and share the place of empty ones.  `slot` numbers the rows of a shard from 0
    without gaps.  Rows that repeat a doc_id and its text stay together.  With fewer distinct rows than shards some shards
    stay empty; an empty table gives an empty result.
    """
    rows, dims = _measured(docs, doc_id, text)
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if (shards is None) == (target_bytes is None):
        raise ValueError("either shards or target_bytes")
    shards = max(1, -(-facts["bytes"] // target_bytes)) if shards is None else shards
    placed = _leaves(rows, dims, shards)
    # numbered in parts of a shard, with the sizes of the parts before
    parts = max(1, -(-facts["n"] // (shards * SLOT_ROWS)))
    placed = placed.withColumn("part", F.pmod("salt", F.lit(parts)))
    sizes = placed.groupBy("node", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("node").orderBy("part")) - F.col("n")
    sizes = sizes.select("node", "part", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("node", "part").orderBy("salt", "id", "size", "text_crc32")) - 1
    placed = placed.withColumn("nth", nth).join(sizes, ["node", "part"])
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.col("node").cast("int").alias("shard"),
        (F.col("nth") + F.col("before")).cast("bigint").alias("slot"),
    )

"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

A document's copies are the ratio target / size of its source: the whole part is certain, the fractional part is rounded.
Rounding is dependent: two documents with open fractions exchange mass, weighted by their sizes, until one fraction is 0
or 1; the direction is drawn so that every document keeps its expected number of copies, and the source keeps its words.
Documents meet in chunks of about `CHUNK` by a hash of their key, a chunk folds its documents in the order of their sizes
and passes on the one that is still open; the open ones of all chunks meet again, level by level, as in a reduction tree.
So a source misses its target by less than one document, however large it is, and no task sees more than a chunk of it.
All draws are hashes of the keys: a rerun, or a task that runs again after a lost executor, decides alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import narrow, type_of
from kinweave.session import cut

#: Relative weights of the sources in the order of their names, repeating; a source is repeated at most MOST times.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents that meet in one fold, on average.
CHUNK = 64
WORD = r"[^\x20\x09-\x0D]+"
OPEN = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, ratio (target / source_size) of (source, size) rows.

    Targets share the total by weight.  A target above `most` times its source's size stops there, and the excess is
    shared again by weight among the others until none is above.  With sources in the order of size / weight, those that
    stop are the first ones, so one pass with running totals finds the fixed point: the level of the first that goes on.  Sources without words get 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight)
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    stops = level * F.col("weight") >= most * F.col("source_size")
    ranked = ranked.withColumn("level", level).withColumn("stops", stops)
    shared = F.max(F.when(~F.col("stops"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("stops"), F.col("source_size") * F.lit(float(most))).otherwise(F.col("weight") * shared)
    ratio = F.when(F.col("source_size") == 0, 0.0).when(F.col("stops"), F.lit(float(most))).otherwise(target / F.col("source_size"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"), ratio.alias("ratio"))


def _drawn(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) * F.lit(2.0**-53)


def _fold(items: Column, seed: int) -> Column:
    """struct(open document, array of decided documents) of one chunk: a left fold of weighted pivotal steps.

    With fractions p and q and sizes a and b, words a*p + b*q stay: p may rise by up = min(1 - p, q * b / a) or fall by
    down = min(p, (1 - q) * b / a).  It rises with probability down / (up + down), so its expectation stays, too.
    """

    def met(state: Column, item: Column) -> Column:
        held = state["held"]
        p, q, a, b = held["p"], item["p"], held["size"], item["size"]
        up, down = F.least(1 - p, q * b / a), F.least(p, (1 - q) * b / a)
        rises = _drawn(seed, held["id"], item["id"], held["copy"], item["copy"]) * (up + down) < down
        step = F.when(rises, up).otherwise(-down)
        x, y = p + step, q - step * a / b

        def snapped(value: Column) -> Column:
            return F.when(value < OPEN, 0.0).when(value > 1 - OPEN, 1.0).otherwise(value)

        def with_p(doc: Column, value: Column) -> Column:
            return doc.withField("p", value)

        pair = F.struct(snapped(x).alias("x"), snapped(y).alias("y"))
        # an inner transform of one element names the pair, so its expressions are evaluated once
        return F.element_at(
            F.transform(
                F.array(pair),
                lambda m: F.when(
                    (m["x"] == 0.0) | (m["x"] == 1.0),
                    F.struct(with_p(item, m["y"]).alias("held"), F.concat(state["done"], F.array(with_p(held, m["x"]))).alias("done")),
                ).otherwise(
                    F.struct(with_p(held, m["x"]).alias("held"), F.concat(state["done"], F.array(with_p(item, m["y"]))).alias("done"))
                ),
            ),
            1,
        )

    start = F.struct(F.element_at(items, 1).alias("held"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, met)


def pivotal_round(open_docs: DataFrame, largest: int, seed: int) -> DataFrame:
    """(source, id, copy, size, p) with 0 < p < 1 and size > 0 -> the same rows with p rounded to 0 or 1.

    `largest` is at least the number of rows of one source; it fixes the number of levels of the tree.
    """
    decided, level, chunks = [], 0, largest
    state = open_docs
    while True:
        chunks = -(-chunks // CHUNK)
        chunk = F.pmod(F.xxhash64(F.lit(seed + level), "source", "id", "copy"), F.lit(max(chunks, 1)))
        doc = F.struct(F.col("size"), F.col("id"), F.col("copy"), F.col("p"))
        folded = (
            state.groupBy("source", chunk.alias("chunk"))
            .agg(F.sort_array(F.collect_list(doc)).alias("items"))
            .select("source", _fold(F.col("items"), seed + 1000 + level).alias("state"))
        )
        folded = cut(folded)
        done = folded.select("source", F.explode("state.done").alias("doc")).select("source", "doc.*")
        state = folded.select("source", "state.held.*")
        decided.append(done)
        level += 1
        if chunks <= 1:
            break
        # fractions that have become whole meanwhile leave the tree
        decided.append(state.where("p = 0 or p = 1"))
        state = state.where("p > 0 and p < 1")
    last = F.when(_drawn(seed + 2000, F.col("id"), F.col("copy")) < F.col("p"), 1.0).otherwise(0.0)
    decided.append(state.withColumn("p", last))
    result = decided[0].select("source", "id", "copy", "size", "p")
    for part in decided[1:]:
        result = result.unionAll(part.select("source", "id", "copy", "size", "p"))
    return result


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = 20,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken (= size * copies).

    Null texts have size 0, as have empty ones; they add nothing and get the whole part of the ratio as copies.  A null
    source is a source of its own, last in order.  Rows that repeat a doc_id within a source are numbered by size and
    rounded each on its own.  An empty table gives an empty result.
    """
    rows = narrow(docs, id=doc_id, text=text, source=source)
    sizes = cut(rows.select("id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")))
    # documents that share key, source and size are one row with a number of copies of its own
    rows = sizes.groupBy("id", "source", "size").agg(F.count("*").alias("times"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
    targets = cut(source_targets(sizes, weights, most))
    # few sources or many: the planner broadcasts the targets only when their measured size allows it
    rows = rows.join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    whole = F.floor("ratio")
    rows = cut(rows.withColumn("whole", whole).withColumn("p", F.col("ratio") - whole))
    ready = (F.col("size") == 0) | (F.col("p") < OPEN) | (F.col("p") > 1 - OPEN)
    open_docs = rows.where(~ready).select("source", "id", "copy", "size", "p")
    counts = open_docs.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    fixed = rows.where(ready).withColumn("extra", F.when(F.col("size") == 0, 0).otherwise(F.round("p")).cast("bigint"))
    base = ["id", "source", "size", "source_size", "target", "whole", "extra"]
    result = fixed.select(base)
    if counts:
        rounded = pivotal_round(open_docs, counts, seed)
        facts = targets.select(F.col("source").alias("name"), "source_size", "target", F.floor("ratio").alias("whole"))
        rounded = rounded.join(facts, F.col("source").eqNullSafe(F.col("name")))
        result = result.unionAll(rounded.withColumn("extra", F.col("p").cast("bigint")).select(base))
    copies = F.col("whole") + F.col("extra")
    kind = type_of(docs, doc_id)
    return result.select(
        F.col("id").cast(kind).alias("doc_id"),
        "size",
        "source",
        "source_size",
        "target",
        copies.cast("bigint").alias("copies"),
        (F.col("size") * copies).cast("bigint").alias("taken"),
    )

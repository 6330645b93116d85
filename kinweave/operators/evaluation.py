"""How well blocking and clustering do on a corpus, from counts of equal values instead of lists of pairs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinweave.functions.text import normalise_name
from kinweave.operators.blocking import SMALL_BYTES, similar_values
from kinweave.session import cut

PREFIX_LENGTH = 4
VARIANT_SIMILARITY = 0.95
UNRELATED_BELOW = 0.8


#: Bytes of a row of names in a hash map beside its texts.
ROW_BYTES = 64
#: Counts of pairs are decimals: products of counts of rows, exact beyond 64 bits.
COUNT, PAIRS = "decimal(19,0)", "decimal(38,0)"


def product(left: Column, right: Column) -> Column:
    """Exact product of two counts of rows."""
    return (left.cast(COUNT) * right.cast(COUNT)).cast(PAIRS)


def pairs_of(size: Column) -> Column:
    """Number of unordered pairs in a group: the even one of n and n - 1 is halved before they are multiplied."""
    even = size % 2 == 0
    half = F.when(even, F.shiftright(size, 1)).otherwise(F.shiftright(size - 1, 1))
    return product(half, F.when(even, size - 1).otherwise(size))


def with_name_keys(mentions: DataFrame) -> DataFrame:
    """Add the normalised name and its four-character prefix, the keys of the blocking variants."""
    return mentions.withColumn("name", normalise_name(F.col("legal_name"))).withColumn(
        "prefix", F.nullif(F.substring("name", 1, PREFIX_LENGTH), F.lit(""))
    )


def blocks(mentions: DataFrame, fields: list[str]) -> DataFrame:
    """Blocks of an equality rule: members, first member and the number of pairs it admits."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fields])
    return (
        mentions.where(present)
        .groupBy(*fields)
        .agg(
            F.count("*").alias("mentions"),
            F.min_by("mention_id", "arrival_seq").alias("first_mention"),
        )
        .withColumn("pairs", pairs_of(F.col("mentions")))
    )


def equal_pairs(mentions: DataFrame, fields: list[str]) -> DataFrame:
    """One row with the number of mention pairs that agree on all fields."""
    return blocks(mentions, fields).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def first_rule_counts(mentions: DataFrame, rules: list[list[str]]) -> DataFrame:
    """Pairs admitted by OR-ed equality rules, each counted under the first rule that admits it.

    Agreeing on two rules is agreeing on the fields of both, so inclusion and exclusion of group counts is exact
    and no pair is ever formed.
    """
    every = sorted({field for rule in rules for field in rule})
    signs: dict[tuple[str, ...], dict[int, int]] = {}
    for number, rule in enumerate(rules):
        for size in range(number + 1):
            for earlier in combinations(rules[:number], size):
                fields = tuple(sorted({field for r in (rule, *earlier) for field in r}))
                counted = signs.setdefault(fields, {})
                counted[number] = counted.get(number, 0) + (-1) ** size
    # One scan: equal rows are combined first, then grouped by all sets of fields at once.  The grouping id tells the set,
    # one bit per field, set where the field is left out; groups that lack a value of their set admit nothing.
    rows = mentions.groupBy(*every).agg(F.count("*").alias("n"))
    sets = [[F.col(f) for f in fields] for fields in signs]
    grouped = rows.groupingSets(sets, *[F.col(f) for f in every]).agg(F.grouping_id().alias("set"), F.sum("n").alias("n"))
    terms = []
    for fields, counted in signs.items():
        number = sum(1 << (len(every) - 1 - i) for i, f in enumerate(every) if f not in fields)
        present = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
        for match_key, sign in counted.items():
            if sign:
                terms.append(F.when((F.col("set") == number) & present, F.struct(F.lit(match_key).alias("match_key"), F.lit(sign).alias("sign"))))
    signed = grouped.select(pairs_of(F.col("n")).alias("pairs"), F.explode(F.array_compact(F.array(*terms))).alias("term"))
    found = signed.groupBy("term.match_key").agg(F.sum(F.col("pairs") * F.col("term.sign")).alias("pairs"))
    keys = mentions.sparkSession.createDataFrame([(i,) for i in range(len(rules))], "match_key int")
    return keys.join(found, "match_key", "left").select("match_key", F.coalesce(F.col("pairs"), F.lit(0)).cast(PAIRS).alias("pairs"))


def counted_values(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, name) with the number of mentions, ready for the similarity join."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "name")])
    return (
        mentions.where(present)
        .groupBy(*keys, "name")
        .agg(
            F.min("arrival_seq").alias("value_id"),
            F.max("arrival_seq").alias("last_new"),
            F.lit(1).alias("profiles"),
            F.count("*").alias("mentions"),
        )
    )


def similar_names(values: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """Pairs of different similar names within equal keys, earlier value left, with the mention pairs they stand for.

    Names are sent to every task only where their size, measured while the values are written, is at most `SMALL_BYTES`; else
    pairs and names are sorted and merged, as the planner cannot foresee the number of pairs.
    """
    measured = Observation()
    held = reduce(lambda a, b: a + b, [F.octet_length(F.col(c).cast("string")) for c in (*keys, "name")]) + ROW_BYTES
    values = cut(values, measured, F.coalesce(F.sum(held), F.lit(0)).alias("bytes"))
    way = "broadcast" if measured.get["bytes"] <= SMALL_BYTES else "merge"
    found = similar_values(values, keys, cutoff).select("l_value", "r_value", "similarity")
    l = values.select(*keys, F.col("value_id").alias("r_value"), F.col("name").alias("l_name"), F.col("mentions").alias("l_n"))
    r = values.select(F.col("value_id").alias("l_value"), F.col("name").alias("r_name"), F.col("mentions").alias("r_n"))
    return (
        found.join(l.hint(way), "r_value")
        .join(r.hint(way), "l_value")
        .select(
            *keys,
            F.col("r_value").alias("l_value"),
            F.col("l_value").alias("r_value"),
            "l_name",
            "r_name",
            "similarity",
            product(F.col("l_n"), F.col("r_n")).alias("pairs"),
        )
    )


def exact_pairs(mentions: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Number of reference pairs with one country and one normalised name (and further agreements)."""
    return equal_pairs(mentions, ["country_code", "name", *(also or [])])


def variant_names(mentions: DataFrame) -> DataFrame:
    """Reference pairs spelled differently: near-identical names at one post code, as name pairs."""
    keys = ["country_code", "post_code"]
    return similar_names(counted_values(mentions, keys), keys, VARIANT_SIMILARITY)


def agreeing_pairs(mentions: DataFrame, similar: DataFrame, keys: list[str], also: list[str], by: list[str] | None = None) -> DataFrame:
    """Number of mention pairs (per `by`, some of `also`) whose names are among the `similar` ones of `keys` and that agree on `also`.

    So one similarity join over wide blocks answers for every narrower agreement.
    """
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "name", *also)])
    counts = mentions.where(present).groupBy(*keys, "name", *also).agg(F.count("*").alias("n"))
    l = counts.withColumnsRenamed({"name": "l_name", "n": "l_n"})
    r = counts.withColumnsRenamed({"name": "r_name", "n": "r_n"})
    return (
        similar.select(*keys, "l_name", "r_name")
        .join(l, [*keys, "l_name"])
        .join(r, [*keys, "r_name", *also])
        .groupBy(*(by or []))
        .agg(F.coalesce(F.sum(product(F.col("l_n"), F.col("r_n"))), F.lit(0)).alias("pairs"))
    )


def co_clustered(clusters: DataFrame) -> DataFrame:
    """Clusters with several members and the number of pairs they hold."""
    return (
        clusters.groupBy("cluster_id")
        .agg(F.count("*").alias("members"))
        .where("members > 1")
        .withColumn("pairs", pairs_of(F.col("members")))
    )


def unrelated_pairs(clustered: DataFrame, similar: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Per cluster, the co-clustered pairs whose names are not similar.

    `clustered` has cluster_id, name and arrival_seq.  All pairs of different names minus the similar ones.  Where clusters
    lie within blocks of `keys`, the `similar` names of these blocks are used; else names are compared within clusters.
    """
    values = counted_values(clustered, ["cluster_id"])
    different = values.groupBy("cluster_id").agg(
        # all pairs minus those of equal names
        (pairs_of(F.sum("mentions")) - F.sum(pairs_of(F.col("mentions")))).cast(PAIRS).alias("different")
    )
    if similar is None:
        close = similar_names(values, ["cluster_id"], UNRELATED_BELOW).groupBy("cluster_id").agg(F.sum("pairs").alias("pairs"))
    else:
        close = agreeing_pairs(clustered, similar, keys, ["cluster_id"], ["cluster_id"])
    return (
        different.join(close, "cluster_id", "left")
        .select("cluster_id", (F.col("different") - F.coalesce("pairs", F.lit(0))).alias("unrelated"))
        .where("unrelated > 0")
    )


def synthetic_corpus(mentions: DataFrame, cycles: int) -> DataFrame:
    """Grow a corpus: every cycle after the first repeats the rows with a pseudo-random word before the name."""
    words = F.translate(F.substring(F.md5(F.concat_ws("-", "mention_id", "cycle")), 1, 8), "0123456789", "ghijklmnop")
    last = mentions.agg(F.max("arrival_seq")).first()[0]
    offset = F.col("cycle") * (last + 1)
    return (
        mentions.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
        .withColumn("legal_name", F.when(F.col("cycle") == 0, F.col("legal_name")).otherwise(F.concat_ws(" ", words, "legal_name")))
        .withColumn("arrival_seq", F.col("arrival_seq") + offset)
        .withColumn("mention_id", F.concat_ws("-", "mention_id", "cycle"))
        .drop("cycle")
    )

"""A corpus from documents to token ids: toxicity filter, exact and near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame, which `run` writes
as Parquet into the shared folder and reads again for the next stage.  All stages but the last return the columns of
`docs`; columns of other names and types pass through them untouched, since decisions come back by row.  Tables that a stage
needs on its way are deleted when its decision is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, exact, mixing, nearcopies, toxicity
from kinweave.llm.common import narrow, table
from kinweave.llm.queries import vocabulary_path
from kinweave.session import cut, settled

#: Documents that score as high as this are rejected.
TOXIC = 0.5
#: Words of a shingle of the near-copy stage, and how many copies of a document one row stands for on the way.
SHINGLE, COPIES_AT_ONCE = 5, 1_024


def _unused(docs: DataFrame, name: str) -> str:
    """The name, or the name with underscores behind it, such that docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart, repeated ones too, and the name of that column.

    A row is known by its file and its place there; what was not read from files is written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = cut(docs)
    at, row = docs.metadataColumn("_metadata"), _unused(docs, "row")
    return docs.withColumn(row, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place"))), row


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _without(docs: DataFrame, rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """docs without the rows listed in `gone` (one column).

    Both sides are dealt out by row at every size, as the list grows with the corpus; only the short one is put into hash maps.
    """
    return rows.join(gone.toDF(row).hint("shuffle_hash"), row, "left_anti").select(*_columns(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted to labels of `sf_dir`, does not find toxic; no shuffle of texts."""
    model = toxicity.fit(narrow(docs, doc_id="doc_id", text="text"), table(spark, sf_dir, "labels"))
    return docs.where(model.score()("text") < TOXIC)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, blanks aside: the longest, then the smallest doc_id, null first."""
    rows, row = _numbered(docs)

    def gone() -> DataFrame:
        keyed = rows.select(F.struct("doc_id", F.col(row).alias("row")).alias("key"), "text")
        return exact.exact_duplicates(keyed, "key").where("NOT kept").select("doc_id.row")

    return _without(docs, rows, row, settled(spark, gone))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that of the smallest doc_id, null last.

    Candidates are the links of the SimHash index, and of MinHash bands what its 4 bits cannot see; shingle sets decide.
    """
    rows, row = _numbered(docs)

    def gone() -> DataFrame:
        found = cut(nearcopies.near_copies(rows, row, words=SHINGLE))
        # most rows are alone in their component, where nothing goes
        shared = found.groupBy("component").count().where(F.col("count") > 1).select("component")
        shared = cut(found.join(shared, "component", "left_semi"))
        named = shared.join(rows.select("doc_id", F.col(row).alias("row")), "row")
        order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
        heads = named.groupBy("component").agg(F.min(order)["row"].alias("head"))
        return shared.join(heads, "component").where("row <> head").select("row")

    return _without(docs, rows, row, settled(spark, gone))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents it does not take go.

    Rows that repeat in all columns are one row here, which is taken as often as all of them.
    """
    rows, row = _numbered(docs)
    told = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    key = F.struct("doc_id", F.xxhash64(*told).alias("content"))

    def taken() -> DataFrame:
        keyed = rows.select(key.alias("key"), F.col(row).alias("row"), "text", "source")
        times = mixing.mix(keyed, "key").where("copies > 0").groupBy("doc_id").agg(F.sum("copies").alias("times"))
        first = keyed.groupBy("key").agg(F.min("row").alias("row"))
        times = times.withColumnRenamed("doc_id", "key").join(first, "key")
        start = F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(COPIES_AT_ONCE)))
        return times.select("row", "times", start.alias("start")).select(
            "row", F.least(F.col("times") - F.col("start"), F.lit(COPIES_AT_ONCE)).cast("int").alias("times")
        )

    times = _unused(docs, "times")
    joined = rows.join(settled(spark, taken).toDF(row, times).hint("shuffle_hash"), row)
    return joined.select(*_columns(docs), F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(times)).select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded_sha256 (of the text that the ids decode to)."""
    decoded = bpe.encode(docs, vocabulary_path(), decoded=True)
    return decoded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models and drawn copies have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs

"""From raw documents to packed sequences: quality, exact and near duplicates, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom.llm import exact_dedup, mixing, ngram_join, quality
from copyloom.llm.common import numbered, stored
from copyloom.llm.queries import packed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest doc_id, and any one of those that repeat it."""
    rows = numbered(docs.select(*COLUMNS))
    kept = exact_dedup.exact_dedup(rows.withColumn("id_", F.struct("doc_id", "row_")), id_col="id_").where("kept").select("doc_id.row_")
    return rows.join(kept, "row_", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies, null last; of those that repeat it, one by a hash of their texts."""
    rows = numbered(docs.select(*COLUMNS))
    found = ngram_join.ngram_join(rows, id_col="row_").select(F.col("doc_id").alias("row_"), F.col("component_id").alias("group_"))
    found = stored(found.join(rows.select("row_", F.struct(F.isnull("doc_id"), "doc_id", F.xxhash64("text"), "row_").alias("order_")), "row_"), "grouped-rows")
    first = found.groupBy("group_").agg(F.min("order_").getField("row_").alias("first_"), F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    gone = found.join(first, "group_").where("row_ != first_").select("row_")
    return rows.join(gone, "row_", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mixture draws, whole, as often as it draws them, each at its own place: shard by shard in shuffled order.

    The order depends on doc_id and text. Each partition, and each file that it is written to, holds a range of it in order; a
    reader that takes files in another order permutes whole ranges."""
    rows = numbered(docs.select(*COLUMNS))
    keyed = rows.withColumn("key_", F.struct("doc_id", F.xxhash64("text")))
    _, _, draws = mixing.mix(keyed, block_words=None, id_col="key_", row_col="row_")
    drawn = stored(draws.select(F.col("uid").alias("row_"), "shard", "position"), "drawn")
    return mixing.shuffled(rows.join(drawn, "row_")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packed(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the hashed order and the tokenizer are not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs

"""A corpus pipeline: quality, duplicate lines, near-duplicates, benchmark passages, packing.

Each stage takes the documents that its predecessor kept, as (spark, docs,
sf_dir), and all but the last return the columns of documents. Every stage's
result is written as Parquet in the shared folder and read again, so a lost
executor costs one stage at most.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import ensure_checkpoint_dir, table
from terrane.llm.decontaminate import remove_leaks
from terrane.llm.line_dedup import dedup_lines
from terrane.llm.packing import best_fit_pack
from terrane.llm.quality import keep_quality
from terrane.llm.simhash import simhash_components

#: The classifier and the fuzzy line classes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that repeat a kept line; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: the one with the smallest id, rows without an id last.

    A row is known by its id and hashes of its text, so rows that share an id and not a text are told apart; of rows equal in both one stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")))
    stays = simhash_components(keyed, "__row").where("doc_id = component_id").groupBy(F.col("doc_id").alias("__stays")).agg(F.count(F.lit(1)).alias("__n"))
    meet = lambda some: keyed.join(stays.where(some), F.col("__row") == F.col("__stays"), "left_semi")
    return meet("__n = 1").unionByName(meet("__n > 1").dropDuplicates(["__row"])).drop("__row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return best_fit_pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs

"""Exact deduplication: 128-bit content hash, then byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_and_text, table


def content_hash(text: Column) -> Column:
    """128-bit hash of the UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_fn=content_hash) -> DataFrame:
    """Group equal texts and name the row of each group that stays.

    Rows are pre-aggregated on (hash, text) before the shuffle, so a text that
    a third of all rows hold is one row per map task. Grouping on the text beside
    its hash compares bytes: a hash with two different texts makes two groups.
    Rows then find their group by the hash alone; only texts whose hash is
    ambiguous are joined by (hash, text).

    keep: "min" or "max", the id of each group that stays. hash_fn: a Column
    function, replaceable to test collisions.

    Returns doc_id, keep_id, group_size, kept, text_sha256: one row per input row.
    Null text counts as empty. A null id never wins over another id; in a group
    of null ids only, keep_id is null and all are kept. Rows that repeat the
    winning id are all kept, as nothing tells them apart. An empty table gives
    no rows; other columns are ignored.
    """
    best = {"min": F.min, "max": F.max}[keep]
    docs = id_and_text(df, id_col, text_col).withColumn("h", hash_fn(F.col("text")))
    texts = docs.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    groups = checkpointed(
        texts.groupBy("h").agg(
            F.count(F.lit(1)).alias("n_texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.first("sha").alias("sha")
        )
    )
    ids = docs.select("doc_id", "h")
    found = ids.join(groups.where("n_texts = 1").drop("n_texts"), "h").select("doc_id", "keep_id", "group_size", "sha")
    ambiguous = groups.where("n_texts > 1").select("h")
    if not ambiguous.isEmpty():
        several = texts.join(ambiguous, "h", "left_semi")
        found = found.unionByName(docs.join(several, ["h", "text"]).select("doc_id", "keep_id", "group_size", "sha"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op5(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP5_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
     g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""

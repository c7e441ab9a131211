"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_and_text


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of about `most` labelled rows, chosen by a hash of the id, held-out rows left out.

    At most 2 * most label rows are broadcast to the scan of docs, so neither
    table is shuffled. Null labels and null ids are ignored; a document
    labelled twice counts twice.
    """
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
    share = min(1.0, most / max(1, usable.count()))
    some = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < math.ceil(1e6 * share)).limit(2 * most)
    return id_and_text(docs, id_col, text_col).join(F.broadcast(some), "doc_id")

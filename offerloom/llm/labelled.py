"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import crc_fold, id_and_text


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document is kept from learning."""
    return crc_fold(doc_id, folds) == fold


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold: doc_id, text, label.

    The ids with the smallest hashes are taken, so the sample is the same for every layout of the tables.  A
    document with several labels has the largest; null ids and labels are not learnt from.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    # The bound on the rows is the proof that the list of ids is small.
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_and_text(docs, doc_id, text).join(F.broadcast(taken), "doc_id")

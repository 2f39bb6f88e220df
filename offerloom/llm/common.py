"""Helpers the operators of this package share."""

from __future__ import annotations

import string
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word in the word contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send a module's functions to the workers by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` does that on plain ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def crc_fold(key: Column, folds: int) -> Column:
    """Fold of a row: crc32 of the key as text, modulo ``folds``.  A null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def keep_rows(docs: DataFrame, text: str, keep) -> DataFrame:
    """Rows whose text passes: ``keep`` maps a list of texts to a list of booleans.  No row is moved."""
    at = docs.columns.index(text)

    def pick(batches):
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(pick, docs.schema)


def shuffle_tasks(spark: SparkSession) -> int:
    """The number of partitions that the session gives a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

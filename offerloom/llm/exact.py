"""Exact duplicates through an extendible-hash index on shared files.

The index maps a 64-bit key of the normalised text to its entries.  Buckets are ranges of keys: a bucket that
holds too many entries is split by doubling its part of the directory.  Entries with equal keys and different
bytes are chained.  Everything is DataFrame work.

Defined cases: a null text is empty; equal means equal bytes after lower-casing A-Z.  Of a group the row with
the largest id stays; a null id is below every other id, and a group of null ids keeps null.  Rows that repeat
both id and text count in ``group_size`` and are all marked ``kept``; ``drop_duplicates`` leaves one of them.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import id_and_text, lower_az
from offerloom.session import cut_lineage

#: Entries a bucket holds before its part of the directory is doubled.
BUCKET_ENTRIES = 65_536


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = id_and_text(docs, doc_id, text).select("doc_id", lower_az(F.col("text")).alias("norm"))
    return rows.select("doc_id", "norm", F.xxhash64("norm").alias("key"))


def _slot(key: Column, depth: int) -> Column:
    """Directory slot of a key: its first ``depth`` bits."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_entries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One entry per distinct text: key, sha, n_bytes, keep_id, group_size.

    Grouping by key and text compares the bytes of texts whose keys collide, and counts copies before the
    shuffle, so a text that a third of the rows hold is one row per map task.
    """
    groups = _keyed(docs, doc_id, text).groupBy("key", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    return groups.select(
        "key", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").alias("n_bytes"), "keep_id", "group_size"
    )


def build_directory(entries: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, int]:
    """Directory with one row per slot (slot, bucket) and its depth.

    A bucket with more than ``bucket_entries`` entries is split unless all have one key; such a bucket chains.
    """
    total = entries.count()
    depth = max(0, math.floor(math.log2(max(total, 1) / bucket_entries)))
    left, parts = entries.select("key"), []
    while True:
        counted = left.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(
            F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        buckets = cut_lineage(counted.withColumn("full", (F.col("n") > bucket_entries) & (F.col("low") != F.col("high"))))
        parts.append((depth, buckets.where("not full")))
        if buckets.where("full").isEmpty():
            break
        full = buckets.where("full").select("slot")
        left = left.withColumn("slot", _slot(F.col("key"), depth)).join(full, "slot", "left_semi").select("key")
        depth += 1
    directory = None
    for local, buckets in parts:
        span = 2 ** (depth - local)
        slots = F.sequence(F.col("slot") * span, F.col("slot") * span + (span - 1))
        part = buckets.select(F.explode(slots).alias("slot"), (F.col("slot") * span).alias("bucket"))
        directory = part if directory is None else directory.unionByName(part)
    return directory, depth


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """The index on shared files: bucket, key, chain, sha, n_bytes, keep_id, group_size.

    Each task owns a range of buckets and keys; ``chain`` numbers the entries of one key.
    """
    entries = cut_lineage(build_entries(docs, doc_id, text))
    directory, depth = build_directory(entries, bucket_entries)
    placed = entries.withColumn("slot", _slot(F.col("key"), depth)).join(directory, "slot").drop("slot")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha"))
    return cut_lineage(placed.repartitionByRange("bucket", "key").withColumn("chain", chain))


def find_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_entries: int = BUCKET_ENTRIES
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and its place in the index."""
    index = build_index(docs, doc_id, text, bucket_entries)
    probes = _keyed(docs, doc_id, text).select("doc_id", "key", F.sha2("norm", 256).alias("sha"))
    return probes.join(index, ["key", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "chain",
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever these are called.

    Null texts count as empty; of rows that repeat an id and its text one stays; a null id is an id like another.
    """
    key = f"key_{uuid.uuid4().hex}"
    marked = find_duplicates(docs, doc_id, text).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept", "group_size")
    marked = cut_lineage(marked.where("group_size > 1"))
    rows = docs.withColumn(key, F.sha2(lower_az(F.coalesce(docs[text], F.lit(""))), 256))

    def matching(part: DataFrame, how: str) -> DataFrame:
        return rows.join(part, rows[doc_id].eqNullSafe(part["__id"]) & (rows[key] == part["__sha"]), how)

    dropped = marked.where("not kept").select("__id", "__sha")
    repeated = marked.where("kept").groupBy("__id", "__sha").count().where("count > 1").select("__id", "__sha")
    if repeated.isEmpty():
        return matching(dropped, "left_anti").drop(key)
    once = matching(repeated, "left_semi").dropDuplicates([doc_id, key])
    return matching(dropped.unionByName(repeated), "left_anti").unionByName(once).drop(key)

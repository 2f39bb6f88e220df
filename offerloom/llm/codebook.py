"""Vector codes by codebooks whose nearest entries are found with bit masks.

A vector is cut into equal parts and every part is replaced by the number of the nearest entry of its codebook.  To
find it, the entries are sorted along every dimension, and each place of a sorted order carries a mask of the entries
before it, one bit an entry in 64-bit words.  A radius selects a range of places per dimension, two masks give the
entries of the range, and the masks of all dimensions ANDed are the entries of a cube around the part.  Distances are
worked out for those only.  An entry outside a cube of radius r is farther than r, so the nearest one is settled when
its distance is at most r; else the radius becomes that distance (or twice as large, where the cube was empty) and
the part is looked up again.  The first radius follows from the spread of the entries.  Results are exact.

Codebooks are fitted in rounds over all rows: tasks add up the parts of every entry and send one row per entry, Spark
adds these, and the driver gets one row per entry, whatever the number of vectors.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are dropped; codebooks start from
the smallest ids (nulls last, equal ids by vector), fewer than asked for if there are fewer rows; vectors of another
length than the first row's, or if that length cannot be cut, get a null code and error; components are held within
2^28; repeated rows are coded each; a label that is null is a label of its own; an empty table has no rows.  Columns
are taken by the names given, others are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.llm.common import ship
from offerloom.session import cut_lineage

ship(__name__)

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts looked up at once, and the largest absolute component.
BLOCK, LIMIT = 1024, 1 << 28


class MaskIndex:
    """Exact nearest entries of a codebook (entries x dimensions, integers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, np.int64)
        count, dims = self.entries.shape
        words = -(-count // 64)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, 0).T.copy()
        #: before[d, k]: the entries of the first k places along dimension d.
        self.before = np.zeros((dims, count + 1, words), np.uint64)
        for d in range(dims):
            for k, e in enumerate(order[:, d].tolist()):
                self.before[d, k + 1] = self.before[d, k]
                self.before[d, k + 1, e >> 6] |= np.uint64(1 << (e & 63))
        spread = self.entries.astype(float).var(0).sum() if count else 0.0
        self.radius = max(1, math.isqrt(int(spread)))

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and an entry in the cube of that radius around it, by rows and then by entries."""
        mask = None
        for d in range(parts.shape[1]):
            x, line = parts[:, d], self.sorted[d]
            high = self.before[d, np.searchsorted(line, x + radius, "right")]
            found = high & ~self.before[d, np.searchsorted(line, x - radius, "left")]
            mask = found if mask is None else mask & found
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(bits)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of every part (the lower one of equals) and its squared distance."""
        parts = np.ascontiguousarray(parts, np.int64)
        found, away = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for low in range(0, len(parts), BLOCK):
            todo = np.arange(low, min(low + BLOCK, len(parts)))
            radius = np.full(len(todo), self.radius, np.int64)
            while len(todo):
                rows, entries = self.candidates(parts[todo], radius)
                apart = parts[todo][rows] - self.entries[entries]
                far = np.einsum("ij,ij->i", apart, apart)
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
                met = rows[starts]
                least = np.minimum.reduceat(far, starts) if len(rows) else far
                best = np.full(len(todo), -1, np.int64)
                best[met] = least
                at = np.flatnonzero(far == best[rows])
                first = at[np.r_[True, rows[at][1:] != rows[at][:-1]]] if len(at) else at
                found[todo[met]], away[todo[met]] = entries[first], least
                done = (best >= 0) & (best <= radius * radius)
                root = np.sqrt(np.maximum(best, 0).astype(float)).astype(np.int64) + 1
                radius = np.where(best >= 0, root, radius * 2)[~done]
                todo = todo[~done]
        return found, away


def to_integers(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled integer components of the vectors of that length, and the rows they stand in."""
    sizes = np.diff(vectors.offsets.to_numpy())
    at = np.flatnonzero(sizes == length)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = vectors.offsets.to_numpy()[:-1] - vectors.offsets.to_numpy()[0]
    picked = flat[starts[at][:, None] + np.arange(length)] if len(at) else np.zeros((0, length))
    return np.clip(np.floor(picked * SCALE), -LIMIT, LIMIT).astype(np.int64), at


def whole_vectors(vector: Column) -> Column:
    """Vectors without null and non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks (part, entry, component) of the smallest ids; None where no row can be cut."""
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    vectors = [r["vector"] for r in head]
    length = len(vectors[0]) if vectors else 0
    if not length or length % parts:
        return None
    whole, _ = to_integers(pa.array(vectors, pa.list_(pa.float64())), length)
    return np.stack(np.split(whole, parts, axis=1))


def _assign(indexes: list[MaskIndex], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, part) and squared distances."""
    cut = np.split(whole, len(indexes), axis=1)
    pairs = [index.nearest(part) for index, part in zip(indexes, cut)]
    return np.stack([p[0] for p in pairs], 1), np.stack([p[1] for p in pairs], 1)


def refine(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the mean (rounded down) of the parts nearest to it."""
    parts, entries, width = books.shape
    kinds = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(width))
    names = [k.split()[0] for k in kinds.split(", ")]

    def add(batches):
        indexes = [MaskIndex(book) for book in books]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            whole, _ = to_integers(batch.column(0), parts * width)
            codes, _ = _assign(indexes, whole)
            for p, cut in enumerate(np.split(whole, parts, axis=1)):
                np.add.at(sums[p], codes[:, p], cut)
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    told = rows.select("vector").mapInArrow(add, kinds).groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names[2:]))
    new = books.copy()
    for r in told.collect():
        new[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return new


def encode_vectors(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code (two hex digits a part) and error (squared distance) of every whole vector; and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits names up to 256 entries")
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(whole_vectors(F.col("vector")))
    books = first_books(rows, parts, entries)
    if books is None:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    for _ in range(rounds):
        books = refine(rows, books)
    kinds = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def code(batches):
        indexes = [MaskIndex(book) for book in books]
        for batch in batches:
            whole, at = to_integers(batch.column(2), books.shape[0] * books.shape[2])
            codes, away = _assign(indexes, whole)
            told, error = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64)
            told[at] = [bytes(c).hex() for c in codes.astype(np.uint8)]
            error[at] = away.sum(1)
            missing = np.ones(batch.num_rows, bool)
            missing[at] = False
            columns = [batch.column(0), batch.column(1), pa.array(told, pa.string()), pa.array(error, mask=missing)]
            yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

    return rows.mapInArrow(code, kinds), books


def books_digest(books: np.ndarray | None) -> str:
    """SHA-256 of the entries' components, by part, entry and place, joined by commas."""
    values = [] if books is None else books.reshape(-1).tolist()
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def compress(table: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (errors of the same label added up) and codebooks_sha256.

    Labels are added up before the join, so a label of very many rows is one row on one side of it.
    """
    coded, books = encode_vectors(table, **options)
    coded = cut_lineage(coded)
    per_label = coded.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(per_label, F.col("label").eqNullSafe(F.col("its_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))

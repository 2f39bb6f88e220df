"""Fill-in-the-middle order of documents by a piece table.

A document is a list of descriptors (buffer, start, end) over buffers that never change: its text in UTF-8 and the
sentinels.  Cutting splits a descriptor in two, an arrangement permutes descriptors and puts sentinels between them,
the inverse permutation restores the document.  Texts are not copied on the way: digests are taken descriptor by
descriptor, and only an output that is asked for is put together.

A text is cut after units, words with the white space before them (white space at the end is a unit of its own), at
places that a digest of the seed and the document's id names.  The same digest says whether the document is
rearranged and in which form: ``psm`` prefix, suffix, middle; ``spm`` suffix, prefix, middle; ``plain`` untouched.
A text that holds a sentinel stays plain, so that in every output each sentinel stands once and ``restore`` finds the
parts again.

Defined cases: null and empty texts are plain with no units; a null id counts as an empty one; repeated rows get the
same form each; texts of any length are cut as a whole; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.llm.common import id_and_text, ship

ship(__name__)

SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 42, 50, 80
#: Order of the parts in the output, and their sentinels, by form.
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Bytes of outputs in one block of results.
BLOCK_BYTES = 8 << 20


class PieceTable:
    """Descriptors over buffers; the first buffer is the document."""

    def __init__(self, text: bytes, others: tuple[bytes, ...] = ()):
        self.buffers = (memoryview(text), *(memoryview(o) for o in others))
        self.pieces: list[tuple[int, int, int]] = [(0, 0, len(text))] if text else []

    def cut(self, at: int) -> int:
        """Split the descriptor that holds place ``at``; the number of the descriptor that begins there."""
        for k, (buffer, start, end) in enumerate(self.pieces):
            if at == 0:
                return k
            if at < end - start:
                self.pieces[k : k + 1] = [(buffer, start, start + at), (buffer, start + at, end)]
                return k + 1
            at -= end - start
        return len(self.pieces)

    def arrange(self, parts: list[list[tuple[int, int, int]]]) -> None:
        """Put groups of descriptors in a new order."""
        self.pieces = [piece for part in parts for piece in part]

    def digest(self) -> str:
        """SHA-256 of the document as the descriptors show it."""
        state = hashlib.sha256()
        for buffer, start, end in self.pieces:
            state.update(self.buffers[buffer][start:end])
        return state.hexdigest()

    def bytes(self) -> bytes:
        return b"".join([self.buffers[buffer][start:end] for buffer, start, end in self.pieces])


def unit_ends(text: bytes) -> np.ndarray:
    """Places after which a unit ends.  White space is ASCII, so places in bytes never split a letter."""
    codes = np.frombuffer(text, np.uint8)
    if not len(codes):
        return np.zeros(0, np.int64)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    last = ~blank
    last[:-1] &= blank[1:]
    last[-1] = True
    return np.flatnonzero(last) + 1


def letters(text: bytes) -> int:
    """Code points of a piece of UTF-8."""
    codes = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((codes & 0xC0) != 0x80))


def choices(doc_id: str, seed: int) -> tuple[int, int, int, int]:
    """The first four groups of eight digits of the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


class Infill:
    """How documents are cut and arranged."""

    def __init__(self, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS):
        if len(set(sentinels)) != 3 or not all(sentinels):
            raise ValueError("three different sentinels are needed")
        # An end of one that begins another (or itself) could be found where no sentinel was put.
        if any(b.startswith(a[i:]) for a in sentinels for b in sentinels for i in range(1, len(a))) or any(a != b and a in b for a in sentinels for b in sentinels):
            raise ValueError("sentinels must not overlap")
        self.seed, self.rate, self.spm_rate = seed, rate, spm_rate
        self.marks = dict(zip(("prefix", "suffix", "middle"), (s.encode() for s in sentinels)))
        self.buffer = {part: k + 1 for k, part in enumerate(self.marks)}

    def apply(self, doc_id: str, text: bytes) -> tuple[int, str, int | None, int | None, PieceTable]:
        """Units, form, code points of prefix and middle, and the arranged document."""
        table, ends = PieceTable(text, tuple(self.marks.values())), unit_ends(text)
        n = len(ends)
        h1, h2, h3, h4 = choices(doc_id, self.seed)
        if not text or h3 % 100 >= self.rate or any(mark in text for mark in self.marks.values()):
            return n, "plain", None, None, table
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        low, high = (int(ends[k - 1]) if k else 0 for k in (a, b))
        table.cut(low)
        second = table.cut(high)
        first = table.cut(low)
        parts = {"prefix": table.pieces[:first], "middle": table.pieces[first:second], "suffix": table.pieces[second:]}
        form = "spm" if h4 % 100 < self.spm_rate else "psm"
        table.arrange([[(self.buffer[part], 0, len(self.marks[part])), *parts[part]] for part in ORDER[form]])
        return n, form, letters(text[:low]), letters(text[low:high]), table

    def restore(self, output: bytes, form: str) -> PieceTable:
        """The document again: descriptors between the sentinels, in the order they came from."""
        table = PieceTable(output)
        if form not in ORDER:
            return table
        starts = {part: output.index(self.marks[part]) for part in ORDER[form]}
        parts, end = {}, len(output)
        for part in reversed(ORDER[form]):
            parts[part] = [(0, starts[part] + len(self.marks[part]), end)]
            end = starts[part]
        table.arrange([parts["prefix"], parts["middle"], parts["suffix"]])
        return table


def _blocks(rows: DataFrame, kinds: T.StructType, work, weigh: int) -> DataFrame:
    """Rows through ``work`` (a row's values to the new values); results leave in blocks by the bytes of column ``weigh``."""

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for row in zip(*batch.columns):
                held.append(work(*(v.as_py() for v in row)))
                size += len(held[-1][weigh])
                if size >= BLOCK_BYTES:
                    yield _batch(held, schema)
                    held, size = [], 0
            if held:
                yield _batch(held, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kinds)
    return rows.mapInArrow(run, kinds)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def fill_in_middle(docs: DataFrame, how: Infill | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output, output_sha256."""
    how = how or Infill()
    rows = id_and_text(docs, doc_id, text)
    rows = rows.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.encode("text", "UTF-8").alias("text"))

    def work(own_id, key, content):
        n, form, prefix, middle, table = how.apply(key, content)
        return own_id, n, form, prefix, middle, (table.bytes() if form != "plain" else content).decode(), table.digest()

    kinds = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n", T.LongType(), False),
            T.StructField("form", T.StringType(), False),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType(), False),
            T.StructField("output_sha256", T.StringType(), False),
        ]
    )
    return _blocks(rows, kinds, work, 5)


def restore_documents(outputs: DataFrame, how: Infill | None = None, output: str = "output", form: str = "form", with_text: bool = True) -> DataFrame:
    """All columns but the output, and the document rebuilt from output and form: ``restored`` (if asked for) and ``restored_sha256``."""
    how = how or Infill()
    others = [c for c in outputs.columns if c != output]
    rows = outputs.select(*others, F.encode(F.col(output), "UTF-8").alias("__output"))
    at = others.index(form)

    def work(*values):
        table = how.restore(values[-1], values[at])
        content = (table.bytes().decode(),) if with_text else ()
        return *values[:-1], *content, table.digest()

    added = [T.StructField("restored", T.StringType(), False)] if with_text else []
    kinds = T.StructType([*(outputs.schema[c] for c in others), *added, T.StructField("restored_sha256", T.StringType(), False)])
    return _blocks(rows, kinds, work, -2 if with_text else -1)

"""Add-one word model over all training texts, scored without a word ever being a hot key.

Words are compared by a 64-bit hash.  Words that are frequent in some piece of the input are the head: at most
``HEAD_WORDS`` of them, so their counts can be sent everywhere.  All other words are rare by that bound; their
occurrences go, packed, to the task that owns the word, which counts them and sends back one partial sum per text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import ship, shuffle_tasks
from offerloom.llm.wordhash import text_slices, word_hashes

ship(__name__)

#: Words whose counts are sent everywhere, at most.
HEAD_WORDS = 60_000
#: Text a worker packs at once, about.
PIECE = 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Stands for the end of a text.
END = np.uint64(0xE5D)

PACKED = "part int, piece long, words binary, texts binary, counts binary, learns binary, own binary, ids binary, tags binary"
PARTIAL = "piece long, own binary, ids binary, tags binary, logs binary, known binary, word long, count long, kinds long"
SUMS = "doc_id long, tag long, logs double, known long"


def frequent(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with more than their share of a piece, and their counts.  A word that is frequent in all texts is
    frequent in some piece."""
    found, counts = np.unique(words, return_counts=True)
    often = counts > max(1, len(words) // HEAD_WORDS)
    return found[often], counts[often]


def choose_head(candidates: DataFrame) -> np.ndarray:
    """The head from candidate rows (word, n): the most frequent ones, sorted.  The limit bounds what is collected."""
    top = candidates.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(HEAD_WORDS)
    return np.sort(np.array([r["word"] for r in top.collect()], np.int64).view(np.uint64))


def in_head(head: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the head and whether the word is there."""
    if not len(head):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(head, words), len(head) - 1)
    return at, head[at] == words


def _packer(head, parts: int):
    names = [c.split()[0] for c in PACKED.split(", ")]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The same for every attempt of a task, so that pieces keep their number when a task is run again.
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, tags, learn = (batch.column(i).to_pylist() for i in range(3))
            for a, b, texts in text_slices(batch.column(3), PIECE):
                words, text = word_hashes([t.translate(LOWER) for t in texts])
                learns = np.array(learn[a:b], bool)
                at, known = in_head(head.value, words)
                counted = np.bincount(at[known & learns[text]], minlength=len(head.value))
                some = np.flatnonzero(counted)
                # Rare words: one entry per text and word, sorted by the part that owns the word.
                rare = ~known
                words, text = words[rare], text[rare]
                order = np.lexsort((words, text))
                words, text = words[order], text[order]
                new = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (text[1:] != text[:-1])][: len(words)])
                times = np.diff(np.r_[new, len(words)])
                words, text = words[new], text[new]
                part = words % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                words, text, times, part = words[order], text[order], times[order], part[order]
                head_part = head.value[some] % np.uint64(parts)
                rows, piece = [], piece + 1
                for p in range(parts):
                    lo, hi = np.searchsorted(part, [p, p + 1])
                    mine = some[head_part == p]
                    if lo == hi and not len(mine):
                        continue
                    own, short = np.unique(text[lo:hi], return_inverse=True)
                    rows.append((
                        p,
                        piece,
                        np.r_[words[lo:hi], head.value[mine]].tobytes(),
                        short.astype(np.uint32).tobytes(),
                        np.r_[times[lo:hi], counted[mine]].astype(np.uint32).tobytes(),
                        learns[own].tobytes(),
                        own.astype(np.uint32).tobytes(),
                        np.array([0 if ids[a + i] is None else ids[a + i] for i in own], np.int64).tobytes(),
                        np.array([tags[a + i] for i in own], np.int64).tobytes(),
                    ))
                if rows:
                    types = [pa.int32(), pa.int64()] + [pa.binary()] * 7
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return pack


def _count(part: pa.Table) -> pa.Table:
    """Counts of one part's words.  Per piece: sums for its texts; then head counts; then the part's totals."""
    rows = list(zip(*(part.column(i).to_pylist() for i in range(1, 9)), strict=True))
    load = lambda k, kind: [np.frombuffer(r[k], kind) for r in rows]
    words, texts, times = load(1, np.uint64), load(2, np.uint32), load(3, np.uint32)
    learns = np.concatenate(load(4, bool))
    # Entries behind the texts' entries are head counts.
    heads = np.concatenate([w[len(t) :] for w, t in zip(words, texts, strict=True)])
    head_times = np.concatenate([n[len(t) :] for n, t in zip(times, texts, strict=True)])
    sizes = [len(r[5]) // 4 for r in rows]
    shift = np.cumsum([0, *sizes])
    owner = np.concatenate([t.astype(np.int64) + s for t, s in zip(texts, shift, strict=False)])
    word = np.concatenate([w[: len(t)] for w, t in zip(words, texts, strict=True)])
    n = np.concatenate([n[: len(t)] for n, t in zip(times, texts, strict=True)]).astype(np.int64)
    _, at = np.unique(word, return_inverse=True)
    total = np.bincount(at, n * learns[owner])
    logs = np.bincount(owner, n * np.log10(total[at] + 1), shift[-1]).astype(np.float64)
    known = np.bincount(owner, n * (total[at] > 0), shift[-1]).astype(np.int64)
    found, back = np.unique(heads, return_inverse=True)
    sums = np.bincount(back, head_times, len(found)).astype(np.int64)
    out = []
    for r, a, b in zip(rows, shift[:-1], shift[1:], strict=True):
        if a < b:
            out.append((r[0], r[5], r[6], r[7], logs[a:b].tobytes(), known[a:b].tobytes(), None, None, None))
    out += [(*[None] * 6, w, c, None) for w, c in zip(found.view(np.int64).tolist(), sums.tolist(), strict=True)]
    out.append((*[None] * 7, int(total.sum()), int((total > 0).sum())))
    types = [pa.int64()] + [pa.binary()] * 5 + [pa.int64()] * 3
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _sum_piece(piece: pa.Table) -> pa.Table:
    """Sums of the texts of a piece over all parts."""
    load = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in piece.column(name).to_pylist()])
    _, first, back = np.unique(load("own", np.uint32), return_index=True, return_inverse=True)
    columns = [
        load("ids", np.int64)[first], load("tags", np.int64)[first], np.bincount(back, load("logs", np.float64)),
        np.bincount(back, load("known", np.int64)).astype(np.int64),
    ]
    return pa.table([pa.array(c) for c in columns], [c.split()[0] for c in SUMS.split(", ")])


def text_sums(partial: DataFrame) -> DataFrame:
    """Sums over rare words by text: doc_id, tag, logs, known.  Equal rows have equal sums, and one row here."""
    sums = partial.where("piece is not null").groupBy("piece").applyInArrow(_sum_piece, SUMS)
    return sums.groupBy("doc_id", "tag").agg(F.max("logs").alias("logs"), F.max("known").alias("known"))


def count_words(rows: DataFrame, head: np.ndarray) -> DataFrame:
    """Partial results for rows (doc_id, tag, learns, text): sums over rare words by piece, counts of head words,
    and per part the number of tokens and of different words among rare words."""
    spark = rows.sparkSession
    parts, shared = shuffle_tasks(spark), spark.sparkContext.broadcast(head)
    packed = rows.select("doc_id", "tag", "learns", "text").mapInArrow(_packer(shared, parts), PACKED)
    return packed.groupBy("part").applyInArrow(_count, PARTIAL)

"""Words covered by passages that another document has too, found by doubling the length of windows.

A window of ``length`` words can repeat only if the windows of half that length inside it repeat.  Every window is
therefore filed under one of its half-length windows, its anchor: the one with the smallest hash.  Equal windows
have equal anchors, so one exchange by anchor brings all copies of a window together.  There the half-length level
is looked at first: anchors that one document alone has are dropped at once, and only windows whose anchor is
repeated are compared at full, twice the, length.  ``repeated_passages`` goes on from there: windows repeated at
one length are candidates for twice that length, until none is left.

Tasks exchange packed arrays of hashes.  Copies within a task's piece of the input are settled before the
exchange (only the smallest document's window is sent), so a passage that a third of the documents hold is one
entry per piece.  Windows are compared by about 110 bits of hash (the anchor's, 48 of them the window's).

Defined cases: a null text has no words; a text of fewer words than a window has none and keeps all.  A document
with the smallest id keeps its words; rows that repeat an id are one document as far as windows go, and repeats
inside one document do not count.  A null id is above every other id.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import id_and_text, ship, shuffle_tasks
from offerloom.llm.wordhash import pieces, run_hashes, word_hashes
from offerloom.session import cut_lineage

ship(__name__)

LENGTH = 13
NO_ID = np.iinfo(np.int64).max
PACKED = "part int, anchors binary, texts binary, firsts binary, counts binary, low binary, high binary, ids binary, tags binary"
FLAGS = "doc_id long, tag long, starts binary"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _anchored(words: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Starts of the windows, their hash, and place and hash of their anchor."""
    half = (length + 1) // 2
    n = max(len(words) - length + 1, 0)
    starts = np.flatnonzero(text[:n] == text[length - 1 : length - 1 + n])
    halves = run_hashes(words, half, 11)
    best, place = halves[starts], starts.copy()
    for k in range(1, length - half + 1):
        other = halves[starts + k]
        lower = other < best
        best = np.where(lower, other, best)
        place[lower] = starts[lower] + k
    return starts, run_hashes(words, length, 23)[starts], place, best


def _smallest(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: whether a smaller id has the same key, and whether another id has it."""
    order = np.argsort(keys, kind="stable")
    k, i = keys[order], ids[order]
    new = np.r_[True, k[1:] != k[:-1]]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(i, first), np.maximum.reduceat(i, first)
    later, shared = np.empty(len(keys), bool), np.empty(len(keys), bool)
    later[order] = i > low[group]
    shared[order] = (low != high)[group]
    return later, shared


def _seven_bytes(x: np.ndarray) -> bytes:
    """The low seven bytes of numbers."""
    return np.ascontiguousarray(x.astype("<u8")[:, None].view(np.uint8)[:, :7]).tobytes()


def _from_seven_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view("<u8")[:, 0]


def _halves(x: np.ndarray) -> bytes:
    """All low halves, then all high halves, which are mostly zero and shrink to nothing in the exchange."""
    return np.concatenate([x.astype(np.uint16), (x >> np.uint32(16)).astype(np.uint16)]).tobytes()


def _from_halves(raw: bytes) -> np.ndarray:
    low, high = np.split(np.frombuffer(raw, np.uint16).astype(np.uint32), 2)
    return low | (high << np.uint32(16))


def _by_owner(entries: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Entries by the text they belong to."""
    entries = entries[np.argsort(owner[entries], kind="stable")]
    mine = owner[entries]
    cuts = np.flatnonzero(mine[1:] != mine[:-1]) + 1
    for part in np.split(entries, cuts) if len(entries) else []:
        yield int(owner[part[0]]), part


def _packer(parts: int, length: int, offsets: bool, both: bool):
    """Map side: windows of every text, packed by part; what is settled already goes along as flags."""

    def rows_of(ids: list, texts: list[bytes], allowed: list) -> Iterator[tuple]:
        words, text = word_hashes(texts)
        starts, full, place, anchor = _anchored(words, text, length)
        first_word = np.searchsorted(text, np.arange(len(texts)))
        owner = text[starts]
        at = starts - first_word[owner]
        if offsets:  # only windows that are candidates: both their halves repeat
            keep = np.zeros(len(starts), bool)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i, blob in enumerate(allowed):
                part = slice(bounds[i], bounds[i + 1])
                keep[part] = np.isin(at[part], np.frombuffer(blob, np.uint32))
            starts, full, place, anchor, owner, at = (x[keep] for x in (starts, full, place, anchor, owner, at))
        if not len(starts):
            return
        numbers = np.array([NO_ID if i is None else i for i in ids], np.int64)
        tags = np.array([zlib.crc32(t) for t in texts], np.int64)
        later, shared = _smallest(full ^ (anchor << np.uint64(1)), numbers[owner])
        for i, mine in _by_owner(np.flatnonzero(shared if both else later), owner):
            yield int(tags[i] % parts), None, None, at[mine].astype(np.uint32).tobytes(), None, None, None, numbers[[i]].tobytes(), tags[[i]].tobytes()
        send = np.flatnonzero(~later)
        part = (anchor[send] % np.uint64(parts)).astype(np.int64)
        send = send[np.argsort(part, kind="stable")]
        part = (anchor[send] % np.uint64(parts)).astype(np.int64)
        for p in np.unique(part):
            lo, hi = np.searchsorted(part, [p, p + 1])
            w = send[lo:hi]
            new = np.r_[True, (place[w][1:] != place[w][:-1]) | (starts[w][1:] != starts[w][:-1] + 1)]
            run = np.flatnonzero(new)
            own, short = np.unique(owner[w[run]], return_inverse=True)
            yield (
                int(p),
                _seven_bytes(anchor[w[run]] // np.uint64(parts)),
                short.astype(np.uint32).tobytes(),
                _halves(at[w[run]].astype(np.uint32)),
                np.diff(np.r_[run, len(w)]).astype(np.uint8 if length < 500 else np.uint32).tobytes(),
                full[w].astype(np.uint32).tobytes(),
                (full[w] >> np.uint64(48)).astype(np.uint16).tobytes(),
                numbers[own].tobytes(),
                tags[own].tobytes(),
            )

    names = [c.split()[0] for c in PACKED.split(", ")]
    types = [pa.int32()] + [pa.binary()] * 8

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [h[1] for h in held]
            for a, b in pieces(texts):
                rows = list(rows_of([h[0] for h in held[a:b]], texts[a:b], [h[2] for h in held[a:b]]))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            held.clear()

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((row[0], row[1].encode(), row[2] if offsets else None))
                size += len(held[-1][1])
                if size >= 4 << 20:
                    yield from flush()
                    size = 0
        yield from flush()

    return pack


def _compare(length: int, both: bool):
    """Reduce side: anchors first, then the windows of repeated anchors."""
    types = [pa.int64(), pa.int64(), pa.binary()]
    counts_type = np.uint8 if length < 500 else np.uint32

    def compare(part: pa.Table) -> pa.Table:
        columns = [part.column(i).to_pylist() for i in range(1, 9)]
        settled = [(f, i, t) for a, _, f, _, _, _, i, t in zip(*columns, strict=True) if a is None]
        rows = [r for r in zip(*columns, strict=True) if r[0] is not None]
        out = [(int(np.frombuffer(i, np.int64)[0]), int(np.frombuffer(t, np.int64)[0]), f) for f, i, t in settled]
        if rows:
            load = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in rows])
            shift = np.cumsum([0] + [len(r[6]) // 8 for r in rows])
            anchors = np.concatenate([_from_seven_bytes(r[0]) for r in rows])
            firsts, counts = np.concatenate([_from_halves(r[2]) for r in rows]), load(3, counts_type).astype(np.int64)
            texts = np.concatenate([np.frombuffer(r[1], np.uint32) + s for r, s in zip(rows, shift, strict=False)]).astype(np.int64)
            full = load(4, np.uint32).astype(np.uint64) | (load(5, np.uint16).astype(np.uint64) << np.uint64(32))
            ids, tags = load(6, np.int64), load(7, np.int64)
            _, shared = _smallest(anchors, ids[texts])
            window = np.flatnonzero(np.repeat(shared, counts))
            if len(window):
                run = np.repeat(np.arange(len(counts)), counts)[window]
                start = firsts[run] + (window - (np.cumsum(counts) - counts)[run])
                # Equal anchors and equal windows: numbered anchors beside the window's 48 bits.
                _, number = np.unique(anchors[run], return_inverse=True)
                order = np.lexsort((full[window], number))
                same = (number[order][1:] == number[order][:-1]) & (full[window][order][1:] == full[window][order][:-1])
                key = np.empty(len(window), np.int64)
                key[order] = np.cumsum(np.r_[True, ~same])
                owner = texts[run]
                later, shared = _smallest(key, ids[owner])
                for i, mine in _by_owner(np.flatnonzero(shared if both else later), owner):
                    out.append((int(ids[i]), int(tags[i]), start[mine].astype(np.uint32).tobytes()))
        found = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(found, types, strict=True)], ["doc_id", "tag", "starts"])

    return compare


def repeated_windows(rows: DataFrame, length: int = LENGTH, candidates: bool = False, both: bool = False) -> DataFrame:
    """Starts of the windows that a document with a smaller id has too: doc_id, tag, starts (list of binaries).

    ``both``: of all windows that another document has.  ``rows`` has doc_id and text, with ``candidates`` also
    ``starts``, the only windows to look at.
    """
    parts = 3 * shuffle_tasks(rows.sparkSession)
    columns = ["doc_id", "text", "starts"] if candidates else ["doc_id", "text"]
    packed = rows.select(*columns).mapInArrow(_packer(parts, length, candidates, both), PACKED)
    found = packed.groupBy("part").applyInArrow(_compare(length, both), FLAGS)
    return found.groupBy("doc_id", "tag").agg(F.collect_list("starts").alias("starts"))


def _with_flags(rows: DataFrame, flags: DataFrame, how: str) -> DataFrame:
    """Texts and the starts flagged in them."""
    marked = flags.select(F.col("doc_id").alias("flag_id"), F.col("tag").alias("flag_tag"), "starts")
    mine = F.coalesce(rows["doc_id"], F.lit(int(NO_ID))) == marked["flag_id"]
    same = F.crc32(rows["text"].cast("binary")) == marked["flag_tag"]
    return rows.join(marked, mine & same, how).select(rows["doc_id"], rows["text"], "starts")


def _cover(length: int):
    names = [c.split()[0] for c in KEPT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def cover(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().split()
                kept = words
                if starts:
                    at = np.concatenate([np.frombuffer(s, np.uint32) for s in starts]).astype(np.int64)
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + length, -1)
                    kept = [w for w, n in zip(words, np.cumsum(steps)[:-1].tolist(), strict=True) if not n]
                joined = b" ".join(kept)
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return cover


def remove_repeated(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and the kept words joined by blanks."""
    rows = id_and_text(docs, doc_id, text)
    flags = repeated_windows(rows, length)
    return _with_flags(rows, flags, "left").mapInArrow(_cover(length), KEPT)


def repeated_passages(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How long the repeated passages are: doc_id, length (of the level), n_windows that repeat at that length.

    Windows repeated at one length are alone extended to twice that length, until no candidate is left.
    """
    rows = id_and_text(docs, doc_id, text)
    found, flags = None, repeated_windows(rows, length, both=True)
    while True:
        flags = cut_lineage(flags.mapInArrow(_one_list, "doc_id long, tag long, starts array<binary>"))
        part = flags.select(
            F.nullif("doc_id", F.lit(int(NO_ID))).alias("doc_id"),
            F.lit(length).alias("length"),
            (F.octet_length(F.col("starts")[0]) / 4).cast("long").alias("n_windows"),
        )
        found = part if found is None else found.unionByName(part)
        if flags.isEmpty():
            return found
        twice = _with_flags(rows, flags, "inner").mapInArrow(_both_halves(length), "doc_id long, text string, starts binary")
        length *= 2
        flags = repeated_windows(twice, length, candidates=True, both=True)


def _one_list(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts without repeats."""
    for batch in batches:
        lists = [[np.unique(np.concatenate([np.frombuffer(s, np.uint32) for s in x])).tobytes()] for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "tag", "starts"])


def _both_halves(length: int):
    """Keeps the starts at which the window and the one right behind it repeat."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for starts in batch.column(2).to_pylist():
                at = np.frombuffer(starts[0], np.uint32)
                kept.append(at[np.isin(at + np.uint32(length), at)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], ["doc_id", "text", "starts"])

    return keep

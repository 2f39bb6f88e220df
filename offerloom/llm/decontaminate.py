"""Passages of a benchmark in documents: one Aho-Corasick automaton over all windows of the test items.

Items become windows of consecutive words (an item that is shorter is one window).  Every text is scanned once;
hit words are mapped back to character spans of the text as given.

Defined cases: null and empty texts and items have no words; items without words occur nowhere; items that repeat
an id count once; an item without id is looked for, but is in no list of items.  Rows of documents that repeat are
scanned each.  With an empty benchmark nothing is hit.  Words are hit once, however many windows cover them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import id_and_text, keep_rows, ship
from offerloom.llm.phrases import Phrases, char_spans, words_of

ship(__name__)

WINDOW = 10
#: Benchmark text one automaton holds; a larger benchmark is scanned for in several automata of this size.
AUTOMATON_BYTES = 8 << 20

SCAN = "doc_id long, text_key string, n_words long, hits array<struct<first:long,last:long>>, items array<string>"
FOUND = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start:long,end:long>>"
)

FIELDS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first, last + 1) without overlaps, in order."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(s) for s in out]


class Windows:
    """The windows of some items and which items hold each."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        holders: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            for window in windows(words_of(text), size):
                held = holders.setdefault(window, set())
                if item_id is not None:
                    held.add(item_id)
        self.phrases = Phrases([list(w) for w in holders])
        self.items = [sorted(h) for h in holders.values()]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans, items = [], set()
        for number, first in self.phrases.find(words):
            spans.append((first, first + len(self.phrases.phrases[number])))
            items.update(self.items[number])
        return merged(spans), items


def _digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _row(doc_id, text: str, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> tuple:
    places = []
    if spans:
        chars = char_spans(text)
        places = [{"start": chars[a][0], "end": chars[b - 1][1]} for a, b in spans]
    n_hit = sum(b - a for a, b in spans)
    return doc_id, len(words), n_hit, len(items), _digest(items), n_hit > 0, sorted(items), places


def _scanner(wanted):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), span]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                spans, items = wanted.value.find(words)
                rows.append(_row(doc_id, text, words, spans, items))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], FIELDS)

    return scan


def _merger():
    """Joins what the automata of several blocks found in each text."""
    import pandas as pd

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text, found in zip(frame["doc_id"], frame["text"], frame["found"], strict=True):
                found = found if found is not None else []
                spans = merged((s["first"], s["last"]) for f in found for s in f["hits"])
                items = {i for f in found for i in f["items"]}
                rows.append(_row(None if pd.isna(doc_id) else int(doc_id), text, words_of(text), spans, items))
            yield pd.DataFrame(rows, columns=FIELDS).astype({"doc_id": "Int64"})

    return merge


def _block_scanner(wanted):
    def scan(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for doc_id, text, key in zip(frame["doc_id"], frame["text"], frame["text_key"], strict=True):
                words = words_of(text)
                spans, items = wanted.value.find(words)
                if spans:
                    hits = [{"first": a, "last": b} for a, b in spans]
                    rows.append((None if pd.isna(doc_id) else int(doc_id), key, len(words), hits, sorted(items)))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_words", "hits", "items"]).astype({"doc_id": "Int64"})

    return scan


def _automata(benchmark: DataFrame, item_id: str, item_text: str, size: int, automaton_bytes: int):
    """Broadcast windows of the benchmark's items: one automaton, or one per block of a larger benchmark."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).dropna(subset=["text"])
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // automaton_bytes))
    for n in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        yield context.broadcast(Windows([tuple(r) for r in block.toLocalIterator()], size))


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """One row per document: counts, the items found, and character spans of the hit words.

    The benchmark's size is measured first.  Up to ``automaton_bytes`` it is one automaton and one map over the
    texts; beyond that its items are dealt into blocks of about that size, each with its own automaton and scan,
    and what the scans found is joined by document.
    """
    rows = id_and_text(docs, doc_id, text)
    wanted = list(_automata(benchmark, item_id, item_text, size, automaton_bytes))
    if len(wanted) == 1:
        return rows.mapInArrow(_scanner(wanted[0]), FOUND)
    rows = rows.withColumn("text_key", F.sha2("text", 256))
    found = None
    for one in wanted:
        part = rows.mapInPandas(_block_scanner(one), SCAN)
        found = part if found is None else found.unionByName(part)
    grouped = found.dropDuplicates(["doc_id", "text_key", "items", "hits"]).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("hits", "items")).alias("found")
    )
    same = rows["doc_id"].eqNullSafe(grouped["doc_id"]) & (rows["text_key"] == grouped["text_key"])
    joined = rows.join(grouped, same, "left").select(rows["doc_id"], "text", "found")
    return joined.mapInPandas(_merger(), FOUND)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """The documents in which no window occurs, with all their columns; one scan for each automaton."""

    def clean(wanted):
        return lambda texts: [next(wanted.value.phrases.find(words_of(t)), None) is None for t in texts]

    for wanted in _automata(benchmark, item_id, item_text, size, automaton_bytes):
        docs = keep_rows(docs, text, clean(wanted))
    return docs

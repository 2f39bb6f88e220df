"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens.  It starts as one state on which every byte loops, and takes up the merges in the order
of their ranks.  A merge of u and v changes it by one gadget: the state that u leads to is split, the copy has no arc
v, all arcs u lead to the copy; every state with an arc u gets an arc uv to where v led.  After the last merge the
paths from the start are exactly the token sequences that merging can give, so a word has one path that spells it.

All arcs of a token lead to one state, hence a state for every token at most.  Arcs are not listed: a state holds the
state it was split from, when, and the arcs it lost; an arc uv was made where the arc u was at that time.  Whether a
state has an arc is read from these tables, along the left parts of the token.  At most one state and one lost arc a
merge are kept, whatever the number of arcs is.

Words are encoded by walking the two tables, labels byte by byte and arcs token by token: the longest label first,
and back where no arc goes on.  As paths are unique, no place of a word is entered twice, so time grows with its
length.  Decoding puts the labels of the arcs together.

Defined cases: null and empty texts have no tokens; strings of added tokens become their ids, as in the library;
repeated rows are encoded each; further columns are not read.  Code points that Python's own tables do not know are
classed differently by different libraries, so texts that hold one are cut by the tokenizer's own splitter.  A
tokenizer file with other parts than byte-level BPE (normalizer, dropout, prefixes, added tokens that strip) is
refused.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from offerloom.llm.common import id_and_text, ship

ship(__name__)

#: White space and words as the tokenizer's pattern means them.
SPACES = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Words a task remembers the ids of, the length up to which, and the bytes of text in one block of results.
HELD_WORDS, HELD_LENGTH, BLOCK_BYTES = 300_000, 64, 8 << 20
#: Arcs a task remembers having looked up.
HELD_ARCS = 1_000_000
START = 0


def byte_letters() -> dict[str, int]:
    """The letter a byte is written as in byte-level files: itself where it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeAutomaton:
    """Gadgets of all merges, and the walk through them.  ``labels``: bytes of every token; ``merges``: pairs of ids and the id they make."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        merged_at = {token: time for time, (_, _, token) in enumerate(merges)}
        if len(merged_at) != len(merges):
            raise ValueError("a token is made by two merges")
        single = [i for i, label in enumerate(labels) if len(label) == 1 and i not in merged_at]
        if len({labels[i] for i in single}) != 256:
            raise ValueError("every byte must be a token")
        #: Of a token: its left part, the time it was made (-1: a byte, None: not yet or never) and the state it leads to.
        self.left: list[int | None] = [None] * len(labels)
        self.made: list[int | None] = [None] * len(labels)
        self.target = [START] * len(labels)
        for token in single:
            self.made[token] = -1
        #: Of a state: the state it was split from and when; and the times at which states lost arcs.
        self.parent, self.born, self.lost = [START], [-1], {}
        into, has, size = {START: 256}, self.arc_test(), len(labels)
        for time, (u, v, token) in enumerate(merges):
            if max(merged_at.get(u, -1), merged_at.get(v, -1)) > time:
                raise ValueError("a merge comes before the merges of its parts")
            if self.made[u] is None or self.made[v] is None:
                continue
            split, follow = self.target[u], self.target[v]
            if not has(split, v, time):
                continue
            if split == START or into[split] > 1 or u == v:
                into[split] -= 1
                self.parent.append(split)
                self.born.append(time)
                split = self.target[u] = len(self.parent) - 1
                into[split] = 1
            self.lost[split * size + v] = time
            self.left[token], self.made[token], self.target[token] = u, time, follow
            into[follow] = into.get(follow, 0) + 1

    def arc_test(self):
        """A function that says whether a state, or the one it was split from later, has an arc at a time."""
        left, made, born, parent, size, lost = self.left, self.made, self.born, self.parent, len(self.labels), self.lost.get

        def has(state: int, token: int, time: int) -> bool:
            since = made[token]
            if since is None:
                return False
            while True:
                while True:
                    gone = lost(state * size + token)
                    if gone is not None and gone <= time:
                        return False
                    start = born[state]
                    if start <= since:
                        break
                    state, time = parent[state], start - 1
                if since < 0:
                    return True
                token, time = left[token], since
                since = made[token]

        return has

    def walker(self):
        """A function from a word's bytes to the tokens of the path that spells it; its tables are made where it runs."""
        root: tuple[dict, int | None] = ({}, None)
        for token, label in enumerate(self.labels):
            if self.made[token] is not None:
                node = root
                for byte in label[:-1]:
                    node = node[0].setdefault(byte, ({}, None))
                last = node[0].get(label[-1])
                node[0][label[-1]] = (last[0] if last else {}, token)
        first, target, size, end = root[0], self.target, len(self.labels), len(self.labels) + 1
        lengths = [len(label) for label in self.labels]
        #: Arcs that were asked for, by state and token.
        arcs, has = {}, self.arc_test()

        def encode(word: bytes) -> list[int]:
            path: list[int] = []
            at, state, turns, stop = 0, START, [], len(word)
            while at < stop:
                nodes, options = first, []
                for byte in memoryview(word)[at:]:
                    node = nodes.get(byte)
                    if node is None:
                        break
                    nodes, token = node
                    if token is not None:
                        options.append(token)
                while True:
                    if not options:
                        options, state = turns.pop()
                        at -= lengths[path.pop()]
                        continue
                    token = options.pop()
                    key = state * size + token
                    found = arcs.get(key)
                    if found is None:
                        if len(arcs) >= HELD_ARCS:
                            arcs.clear()
                        found = arcs[key] = has(state, token, end)
                    if found:
                        break
                turns.append((options, state))
                path.append(token)
                at += lengths[token]
                state = target[token]
            return path

        return encode

    def decode(self, path: list[int]) -> bytes:
        """The labels of the arcs one after another."""
        labels = self.labels
        return b"".join([labels[token] for token in path])


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class OddLetters:
    """Finds code points that this Python's tables do not know; those that they know are looked up once."""

    def __init__(self):
        self.known: set[str] = set()

    def within(self, text: str) -> bool:
        if text.isascii():
            return False
        new = set(text) - self.known
        odd = {c for c in new if unicodedata.category(c) == "Cn"}
        self.known |= new - odd
        return bool(odd)


class Tokenizer:
    """A byte-level BPE tokenizer file, compiled."""

    def __init__(self, path: str):
        self.path = path
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        strips = any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        if not plain or not level or strips or spec["normalizer"]:
            raise ValueError(f"{path} is not plain byte-level BPE")
        letters, vocabulary = byte_letters(), model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocabulary.values(), *self.added.values()]) + 1
        labels = [b""] * size
        for word, i in vocabulary.items():
            if word not in self.added:
                labels[i] = bytes(letters[c] for c in word)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs]
        self.automaton = MergeAutomaton(labels, merges)
        for word, i in self.added.items():
            labels[i] = word.encode()

    def splitter(self):
        """A function that cuts a text into words."""
        import regex

        words, path, own, odd = regex.compile(PATTERN), self.path, [], OddLetters()

        def split(text: str) -> list[str]:
            if not odd.within(text):
                return words.findall(text)
            if not own:
                from tokenizers import Tokenizer as Library

                own.append(Library.from_file(path).pre_tokenizer)
            return [text[start:end] for _, (start, end) in own[0].pre_tokenize_str(text)]

        return split

    def encoder(self):
        """A function from a text to its ids, packed as little-endian unsigned 32-bit integers."""
        walk, split, added = self.automaton.walker(), self.splitter(), self.added

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                packed = pack(walk(word.encode()))
                if len(word) <= HELD_LENGTH:
                    if len(self) >= HELD_WORDS:
                        self.clear()
                    self[word] = packed
                return packed

        held = Words().__getitem__
        marks = re.compile("|".join(f"({re.escape(w)})" for w in sorted(added, key=len, reverse=True))) if added else None

        def encode(text: str) -> bytes:
            if marks is None or not marks.search(text):
                return b"".join(map(held, split(text)))
            out, at = [], 0
            for mark in marks.finditer(text):
                out.extend(map(held, split(text[at : mark.start()])))
                out.append(pack([added[mark[0]]]))
                at = mark.end()
            out.extend(map(held, split(text[at:])))
            return b"".join(out)

        return encode


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", listed: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, tokens array<int> (only if ``listed``), ids (packed little-endian), decoded.

    No row is moved, a task holds one block of texts and at most ``HELD_WORDS`` words.
    """
    rows = id_and_text(docs, doc_id, text)
    tokenizer = Tokenizer(path)
    kinds = [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType(), False)]
    if listed:
        kinds.append(T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False))
    kinds += [T.StructField("ids", T.BinaryType(), False), T.StructField("decoded", T.StringType(), False)]

    def work(batches):
        encode, decode = tokenizer.encoder(), tokenizer.automaton.decode
        for batch in batches:
            start, size, packed, decoded = 0, 0, [], []
            for i, value in enumerate(batch.column(1)):
                ids = encode(value.as_py())
                packed.append(ids)
                decoded.append(decode(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace"))
                size += len(ids) + len(decoded[-1])
                if size >= BLOCK_BYTES or i == batch.num_rows - 1:
                    counts = np.array([len(p) // 4 for p in packed])
                    columns = [batch.column(0).slice(start, len(packed)), pa.array(counts, pa.int64())]
                    if listed:
                        flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(flat)))
                    columns += [pa.array(packed, pa.binary()), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=[k.name for k in kinds])
                    start, size, packed, decoded = i + 1, 0, [], []

    return rows.mapInArrow(work, T.StructType(kinds))

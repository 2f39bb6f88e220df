"""Byte-level BPE in Spark's higher-order functions.

A text is split into words by the tokenizer's pattern.  A word that is a token is that token; any other word is an
array of byte tokens on which a fold merges, step by step, the neighbours of the lowest rank (the leftmost first).
Ranks come from a literal map; as a map literal is searched from its start, the map is laid out as two literal
arrays, a displaced table of rows, in which one rank is two array reads.  Words that are frequent in a sample are
folded once, and with the vocabulary form a literal word list that is read the same way; all other words are
folded where they stand.  The list only saves time: ids are the same for every sample.  The literals are session
variables, which become constants of the plan without being printed in its text.

Decoding puts the tokens' bytes together.  Spark has no function that joins an array of binaries in one go, so the
pieces are literals in base 16 and the joined text is turned into bytes.

Defined cases: null and empty texts have no tokens; strings of special tokens are ordinary text; repeated rows are
encoded each.  A single word of tens of kilobytes takes time by its length times the number of different merges.
"""

from __future__ import annotations

import base64
import functools
import random
import uuid
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.text import let
from offerloom.llm.common import id_and_text, shuffle_tasks

#: White space as the tokenizer's pattern means it.
SPACES = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The pattern that splits words before merging, in Java's spelling.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Texts whose words are counted for the word list, about, and words the list takes besides the vocabulary.
LIST_TEXTS, LIST_WORDS = 30_000, 250_000
#: Words of more bytes merge all places of the lowest rank in one step where that is the same.
LONG_WORD = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one token in base 64 and its rank a line."""
    lines = Path(path).read_bytes().split(b"\n")
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


class Constants:
    """Literal arrays: session variables, whose values every plan that mentions them holds as constants.

    The names are this object's own.  ``release`` drops the variables; plans that were made before keep their values,
    which go when the plans go.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.prefix, self.names = spark, f"offerloom_{uuid.uuid4().hex}", []

    def array(self, name: str, kind: str, values: list | np.ndarray, made: str = "v", of: str | None = None) -> Column:
        """``made``: what the values become, ``of`` which kind that is."""
        name = f"{self.prefix}_{name}"
        items = pa.array(values, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind])
        self.spark.createDataFrame(pa.table({"v": pa.ListArray.from_arrays([0, len(items)], items)})).createOrReplaceTempView(name)
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {name} ARRAY<{of or kind}>")
        self.names.append(name)
        self.spark.sql(f"SET VARIABLE {name} = (SELECT {made} FROM {name})")
        self.spark.catalog.dropTempView(name)
        return F.expr(f"system.session.{name}")

    def release(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")
        self.names.clear()


class RankMap:
    """Ranks of pairs of tokens in a displaced table.

    The row of a left token is laid over the table at ``shift[left]``, so that its right tokens fall on free
    places.  A place holds left and merged token; another left token there means that the pair does not merge.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        rows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.several = set()
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    rows[left].append((right, rank))
                    # A merge that makes a part of a token of lower rank: its places must be merged one by one.
                    self.several.update(part for part in (left, right) if rank <= part)
        size = max(ranks.values()) + 1
        used, self.shift = np.zeros(size * 40, bool), np.zeros(size, np.int64)
        owner, merged, low = np.full(size * 40, -1, np.int32), np.zeros(size * 40, np.int32), 0
        for left, row in sorted(rows.items(), key=lambda x: -len(x[1])):
            rights = np.array([r for r, _ in row])
            rights_at, start, reach = rights - rights.min(), max(low, int(rights.min())), 64 if len(row) == 1 else 4096
            while True:  # places where the first right token could go, some at a time
                free = start + np.flatnonzero(~used[start : start + reach])
                fits = free[~used[free[:, None] + rights_at].any(1)]
                if len(fits):
                    break
                start += reach
            at = int(fits[0]) - int(rights.min())
            used[at + rights], self.shift[left] = True, at
            owner[at + rights], merged[at + rights] = left, [rank for _, rank in row]
            while used[low]:
                low += 1
        end = int(np.flatnonzero(used).max(initial=0)) + size + 1
        self.owner, self.merged = owner[:end].copy(), merged[:end].copy()

    def columns(self, constants: Constants) -> dict[str, Column]:
        byte = [self.ranks[bytes([b])] for b in range(256)]
        single = np.zeros(len(self.shift), np.int64)
        single[list(self.several)] = 1
        arrays = {"shift": self.shift, "owner": self.owner, "merged": self.merged, "byte": byte, "single": single}
        return {name: constants.array(name, "int", values) for name, values in arrays.items()}


@functools.lru_cache(maxsize=2)
def rank_map(path: str) -> RankMap:
    """The map of a rank file, laid out once per process."""
    return RankMap(load_ranks(path))


def _pair_ranks(ids: Column, m: dict[str, Column]) -> Column:
    """Rank of every token and the next one; null where they do not merge."""
    places = F.transform(ids, lambda left, i: F.get(m["shift"], left) + F.get(ids, i + 1))
    return F.zip_with(ids, places, lambda left, p: F.when(F.get(m["owner"], p) == left, F.get(m["merged"], p)))


def _merge_first(ids: Column, ranks: Column, low: Column) -> Column:
    """The leftmost pair of the lowest rank becomes one token."""

    def merged(p: Column) -> Column:
        return F.filter(
            F.transform(ids, lambda x, i: F.when(i == p, F.lit(None)).when(i == p - 1, low).otherwise(x)), lambda x: x.isNotNull()
        )

    return let(F.array_position(ranks, low).cast("int"), merged)


def _merge_all(ids: Column, ranks: Column, low: Column) -> Column:
    """All pairs of the lowest rank become tokens, from the left, without sharing a token."""
    flags = F.array_join(F.transform(ranks, lambda r: F.when(r == low, F.lit("1")).otherwise(F.lit("0"))), "")

    def merged(picked: Column) -> Column:
        def token(x: Column, i: Column) -> Column:
            first, second = F.get(picked, i) == "1", (i > 0) & (F.get(picked, i - 1) == "1")
            return F.when(first, low).when(second, F.lit(-1)).otherwise(x)

        return F.filter(F.transform(ids, token), lambda x: x >= 0)

    return let(F.split(F.regexp_replace(flags, "11", "10"), ""), merged)


def fold_word(word: Column, m: dict[str, Column]) -> Column:
    """Token ids of a word: a fold over at most as many merges as the word has bytes."""
    letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    start = F.transform(letters, lambda c: F.get(m["byte"], F.ascii(c)))

    def state(ids: Column, unfinished: bool) -> Column:
        return F.struct(ids.alias("ids"), F.lit(unfinished).alias("unfinished"))

    def fold(ids: Column, merge) -> Column:
        def step(held: Column) -> Column:
            def with_ranks(ranks: Column) -> Column:
                return let(
                    F.array_min(ranks),
                    lambda low: F.when(low.isNull(), state(held["ids"], False)).otherwise(state(merge(held["ids"], ranks, low), True)),
                )

            return let(_pair_ranks(held["ids"], m), with_ranks)

        steps = F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1)))
        return F.aggregate(
            steps, state(ids, True), lambda held, _: F.when(held["unfinished"], step(held)).otherwise(held), lambda held: held["ids"]
        )

    def long_merge(ids: Column, ranks: Column, low: Column) -> Column:
        alone = F.get(m["single"], low) == 1
        return F.when(alone, _merge_first(ids, ranks, low)).otherwise(_merge_all(ids, ranks, low))

    return let(start, lambda ids: F.when(F.size(ids) <= LONG_WORD, fold(ids, _merge_first)).otherwise(fold(ids, long_merge)))


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


class WordList:
    """Words and their ids in literal arrays: a word's hash names a displacement, both together its place."""

    def __init__(self, constants: Constants, hashes: np.ndarray, words: list[str], ids: list[str]):
        """``ids``: the ids of a word, joined by commas."""
        # Small groups of words, and a table with a third of its places free.
        self.groups, self.room = max(1, len(words) // 3), max(1, len(words) * 3 // 2) | 1
        group = hashes % self.groups
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        bounds = np.r_[0, cuts, len(order)]
        turns, taken = np.zeros(self.groups, np.int64), np.full(self.room, -1)
        dice = random.Random(1)
        for k in np.argsort(-np.diff(bounds), kind="stable").tolist() if len(order) else []:
            members = order[bounds[k] : bounds[k + 1]].tolist()
            keys = [int(hashes[i]) for i in members]
            while True:
                turn = dice.getrandbits(62)
                places = [(h ^ turn) % self.room for h in keys]
                if len(set(places)) == len(keys) and (taken[places] < 0).all():
                    break
            turns[group[members[0]]] = turn
            taken[places] = members
        parsed = "transform(v, x -> cast(split(x, ',') AS array<int>))"
        self.columns = {
            "turn": constants.array("turn", "bigint", turns),
            "words": constants.array("words", "string", [words[i] if i >= 0 else None for i in taken.tolist()]),
            "ids": constants.array("ids", "string", [ids[i] if i >= 0 else None for i in taken.tolist()], parsed, "array<int>"),
        }

    def places(self, words: Column) -> Column:
        """Place of every word of an array."""
        turn, room = self.columns["turn"], F.lit(self.room).cast("long")

        def place(h: Column) -> Column:
            group = F.pmod(h, F.lit(self.groups).cast("long")).cast("int")
            return F.pmod(h.bitwiseXOR(F.get(turn, group)), room).cast("int")

        return F.transform(F.transform(words, lambda w: F.xxhash64(w)), place)


def _frequent_words(docs: DataFrame, texts: int, words: int) -> DataFrame:
    """Words that are frequent in about ``texts`` of the texts."""
    every = max(1, docs.count() // texts)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    seen = some.select(F.explode(split_words(F.col("text"))).alias("word")).groupBy("word").count()
    return seen.where("count > 1").orderBy(F.desc("count"), "word").limit(words).select("word")


class Codec:
    """Encoder and decoder for one rank file; the word list is the vocabulary and frequent words of ``docs``."""

    def __init__(self, ranks_path: str, docs: DataFrame, texts: int = LIST_TEXTS, words: int = LIST_WORDS):
        spark, ranks = docs.sparkSession, rank_map(ranks_path)
        self.constants = Constants(spark)
        self.ranks, self.map = ranks.ranks, ranks.columns(self.constants)
        whole = {}
        for token, rank in self.ranks.items():
            try:
                whole[token.decode()] = str(rank)
            except UnicodeDecodeError:
                continue
        hashes, listed, ids = [], [], []
        vocabulary = spark.createDataFrame(list(whole.items()), "word string, ids string").select(F.xxhash64("word"), "word", "ids")
        folded = F.array_join(fold_word(F.col("word"), self.map).cast("array<string>"), ",")
        frequent = _frequent_words(docs, texts, words).repartition(shuffle_tasks(spark)).select(F.xxhash64("word"), "word", folded)
        for rows, others in ((vocabulary, ()), (frequent, whole)):
            for h, word, joined in rows.toLocalIterator():
                if word not in others:
                    hashes.append(h)
                    listed.append(word)
                    ids.append(joined)
        self.list = WordList(self.constants, np.array(hashes, np.int64), listed, ids)

    def encode(self, docs: DataFrame) -> DataFrame:
        """doc_id and ``tokens``, the token ids of the text."""
        words, ids = self.list.columns["words"], self.list.columns["ids"]

        def encoded(word: Column, place: Column) -> Column:
            return F.when(F.get(words, place) == word, F.get(ids, place)).otherwise(fold_word(word, self.map))

        split = docs.select("doc_id", split_words(F.col("text")).alias("words"))
        placed = split.select("doc_id", "words", self.list.places(F.col("words")).alias("places"))
        return placed.select("doc_id", F.flatten(F.zip_with("words", "places", encoded)).alias("tokens"))

    def release(self) -> None:
        """Drop the constants; plans that were made with them go on working."""
        self.constants.release()

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of token ids."""
        pieces = [""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.hex()
        literal = self.constants.array("pieces", "string", pieces)
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""))


def encode_documents(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", words: int = LIST_WORDS) -> DataFrame:
    """One row per document: doc_id, tokens array<int>, ids (joined by commas), decoded (the bytes).

    ``words``: how many words the list takes at most; the ids are the same for every number.
    """
    rows = id_and_text(docs, doc_id, text)
    codec = Codec(ranks_path, rows, words=words)
    encoded = codec.encode(rows)
    ids = F.btrim(F.to_json("tokens"), F.lit("[]"))
    out = encoded.select("doc_id", "tokens", ids.alias("ids"), codec.decode(F.col("tokens")).alias("decoded"))
    codec.release()
    return out

"""Toxicity: class-conditional Kneser-Ney models of words, compared by length-normalised log-likelihood.

Each class (toxic, ordinary) has counts of word beginnings: how often a byte follows the beginning of a word.
Discounted mass goes to one backoff that both classes share: an interpolated Kneser-Ney trigram over bytes whose
continuation counts come from the distinct words of all classes.  A word that is rare or new therefore has nearly
the same likelihood in both classes, while beginnings that only one class uses tell the classes apart.

A text is judged by the difference of its two log-likelihoods, per word: over the whole text, over the best
stretch of a few words, and for the most telling word.  A logistic function, fitted on texts that the models
behind the figures have not seen, turns these into a score.

Defined cases: null and empty texts have no words and get the score of a text without evidence; with no labelled
rows every score is 0.5, with one class it is that class; repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import id_and_text, keep_rows, ship
from offerloom.llm.labelled import held_out, labelled_sample
from offerloom.llm.phrases import words_of
from offerloom.session import cut_lineage

ship(__name__)

#: Labelled rows that are learnt from, at most.
TRAIN_ROWS = 12_000
#: Words of a stretch.
STRETCH = 8
#: Kneser-Ney discount.
DISCOUNT = 0.75
#: Words whose figures a worker keeps at hand.
KEPT_WORDS = 300_000
END = 0
#: Hash of the empty beginning.
EMPTY = np.uint64(7)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hash of a beginning made one byte longer."""
    x = (before ^ (byte.astype(np.uint64) + np.uint64(1))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Words:
    """Words as columns of bytes: position p of all words that are long enough, ends included."""

    def __init__(self, words: list[bytes]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]] if words else np.zeros(0, np.int64)
        self.raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        self.order = np.argsort(-self.lengths, kind="stable")

    def positions(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, their byte) per position; the byte behind a word is END."""
        sorted_lengths = -self.lengths[self.order]
        for p in range(int(self.lengths.max(initial=-1)) + 1):
            live = self.order[: np.searchsorted(sorted_lengths, -p, side="right")]
            at = np.minimum(self.starts[live] + p, len(self.raw) - 1)
            yield live, np.where(self.lengths[live] > p, self.raw[at], END)


class ClassModels:
    """Both class models over a shared backoff.  Column 0 of the tables is ordinary, column 1 toxic."""

    def __init__(self, keys, count, contexts, total, kinds, trigrams: list[tuple[int, int]]):
        """``keys``/``count``: beginnings of words; ``contexts``/``total``/``kinds``: what follows a beginning;
        ``trigrams``: three bytes as one number, and behind how many beginnings they occur."""
        order, other = np.argsort(keys), np.argsort(contexts)
        self.keys, self.count = keys[order], count[order].astype(np.float32)
        self.contexts = contexts[other]
        self.total, self.kinds = total[other].astype(np.float32), kinds[other].astype(np.float32)
        codes = np.array([t for t, _ in trigrams], np.int64)
        bytes_of = np.stack([codes >> 16, (codes >> 8) & 255, codes & 255]) if len(codes) else np.zeros((3, 0), np.int64)
        used = np.zeros(256, bool)
        used[bytes_of.ravel()] = True
        used[END] = True
        self.symbol = np.where(used, np.cumsum(used) - 1, 0)
        a = int(used.sum())
        counts = np.zeros((a, a, a))
        counts[tuple(self.symbol[bytes_of])] = [n for _, n in trigrams]
        self.shared = self._backoff(counts).astype(np.float32)

    @staticmethod
    def _backoff(trigrams: np.ndarray) -> np.ndarray:
        """Interpolated Kneser-Ney from continuation counts: P(byte | two bytes before)."""
        a = trigrams.shape[0]
        bigrams = (trigrams > 0).sum(0).astype(float)
        unigrams = (bigrams > 0).sum(0).astype(float)
        p1 = (unigrams + 0.5) / (unigrams + 0.5).sum()

        def interpolated(counts, lower):
            total = counts.sum(-1, keepdims=True)
            kinds = (counts > 0).sum(-1, keepdims=True)
            held = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)
            return np.where(total > 0, held + DISCOUNT * kinds / np.maximum(total, 1) * lower, lower)

        p2 = interpolated(bigrams, np.broadcast_to(p1, (a, a)))
        return interpolated(trigrams, np.broadcast_to(p2, (a, a, a)))

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def differences(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary)."""
        columns, n = _Words(words), len(words)
        hashes, before = np.full(n, EMPTY, np.uint64), np.zeros((2, n), np.int64)
        out = np.zeros(n)
        for live, byte in columns.positions():
            s = self.symbol[byte]
            lower = self.shared[before[0][live], before[1][live], s]
            before[:, live] = np.stack([before[1][live], s])
            context, known = self._find(self.contexts, hashes[live])
            hashes[live] = _hash(hashes[live], byte)
            at, seen = self._find(self.keys, hashes[live])
            logs = []
            for k in (0, 1):
                total = np.where(known, self.total[context, k], 0) if len(self.contexts) else np.zeros(len(live))
                kinds = np.where(known, self.kinds[context, k], 0) if len(self.contexts) else total
                count = np.where(seen, self.count[at, k], 0) if len(self.keys) else total
                some = np.maximum(total, 1)
                p = np.where(total > 0, np.maximum(count - DISCOUNT, 0) / some + DISCOUNT * kinds / some * lower, lower)
                logs.append(np.log(np.maximum(p, 1e-12)))
            out[live] += logs[1] - logs[0]
        return out


class WordFigures:
    """Differences of words, kept for words seen before."""

    def __init__(self, models: ClassModels):
        self.models, self.kept = models, {}

    def __getstate__(self):
        return {"models": self.models, "kept": {}}

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        new = list({w for words in texts for w in words if w not in self.kept})
        if new:
            self.kept.update(zip(new, self.models.differences(new).tolist(), strict=True))
        get = self.kept.__getitem__
        return [np.fromiter(map(get, words), float, len(words)) for words in texts]


def evidence(x: np.ndarray) -> list[float]:
    """What a text's word differences say: whole text, best stretch, most telling word, telling words, length."""
    if not len(x):
        return [0.0] * 5
    sums = np.cumsum(np.r_[0.0, x])
    k = min(STRETCH, len(x))
    return [x.mean(), ((sums[k:] - sums[:-k]) / k).max(), x.max(), np.log1p((x > 2).sum()), np.log1p(len(x))]


def pieces(texts: list[str], size: int = 128) -> Iterator[list[list[bytes]]]:
    for i in range(0, len(texts), size):
        yield [words_of(t) for t in texts[i : i + size]]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (the first is the constant), by Newton steps."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    w, hold = np.zeros(z.shape[1]), np.r_[0.0, np.full(x.shape[1], ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold + 1e-6), z.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def _beginnings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings of the words of a batch: hash, hash without the last byte, last three bytes, and counts by label
    and half of the sample."""
    names = ["node", "parent", "trigram", "n0", "n1", "n2", "n3"]
    for batch in batches:
        kinds: dict[bytes, list[int]] = {}
        for label, half, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for w, n in Counter(words_of(text)).items():
                kinds.setdefault(w, [0, 0, 0, 0])[2 * (label > 0) + half] += n
        if not kinds:
            continue
        columns, counts = _Words(list(kinds)), np.array(list(kinds.values()), np.int64)
        hashes, before = np.full(len(kinds), EMPTY, np.uint64), np.zeros(len(kinds), np.int64)
        for live, byte in columns.positions():
            parent = hashes[live]
            hashes[live] = _hash(parent, byte)
            before[live] = ((before[live] << 8) | byte) & 0xFFFFFF
            node, first, back = np.unique(hashes[live], return_index=True, return_inverse=True)
            sums = [pa.array(np.bincount(back, counts[live, k], len(node)).astype(np.int64)) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), pa.array(parent[first].view(np.int64)), pa.array(before[live][first]), *sums], names
            )


def _count_beginnings(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Beginnings that occur more than once, what follows them, and continuation counts of trigrams.

    A beginning that occurs once tells nothing; its mass is the backoff's.
    """
    found = rows.mapInArrow(_beginnings, "node long, parent long, trigram long, n0 long, n1 long, n2 long, n3 long")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]
    nodes = cut_lineage(found.groupBy("node").agg(F.min("parent").alias("parent"), F.min("trigram").alias("trigram"), *sums))
    often = (F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")) > 1
    keys = nodes.where(often).select("node", *[F.col(f"n{k}").cast("int") for k in range(4)])
    kinds = [F.count_if(F.col(f"n{k}") > 0).alias(f"k{k}") for k in range(4)]
    both = [F.count_if(F.col(f"n{k}") + F.col(f"n{k + 1}") > 0).alias(f"b{k // 2}") for k in (0, 2)]
    contexts = nodes.groupBy("parent").agg(*sums, *kinds, *both).where(often)
    contexts = contexts.select("parent", *[F.col(c).cast("int") for c in contexts.columns[1:]])
    return keys, contexts, nodes.groupBy("trigram").count()


def _fetch(table: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The first column as hashes in order, and the counts of the others."""
    held = table.toArrow()
    hashes = held.column(0).to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], {c: held.column(c).to_numpy()[order] for c in held.column_names[1:]}


def _evidence_under(figures):
    """Evidence of labelled texts."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(figures.value.of([words_of(text)])[0]) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["label", "x"])

    return rows


class Judge:
    """Word figures and the logistic function; ``constant`` if there was nothing to tell apart."""

    def __init__(self, figures: WordFigures | None, logistic, constant: float = 0.5):
        self.figures, self.logistic, self.constant = figures, logistic, constant

    def score(self, texts: list[str]) -> np.ndarray:
        if self.figures is None:
            return np.full(len(texts), self.constant)
        x = np.array([evidence(d) for part in pieces(texts) for d in self.figures.of(part)], float).reshape(-1, 5)
        mean, spread, w = self.logistic
        return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / spread) @ w[1:], -30, 30)))


def train(sample: DataFrame) -> Judge:
    """Judge of a bounded sample (doc_id, text, label).  Words are counted and texts judged on the cluster."""
    spark = sample.sparkSession
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    rows = cut_lineage(sample.select("label", half.alias("half"), "text"))
    labels = [r[0] for r in rows.select((F.col("label") > 0).cast("int")).distinct().collect()]
    if len(labels) < 2:
        return Judge(None, None, float(labels[0]) if labels else 0.5)
    keys, contexts, trigrams = _count_beginnings(rows)
    (node, n), (parent, of), trigrams = _fetch(keys), _fetch(contexts), trigrams.toArrow()
    shared = list(zip(trigrams.column(0).to_pylist(), trigrams.column(1).to_pylist(), strict=True))

    def models(halves: list[int]) -> WordFigures:
        """Without what these halves do not hold: it has no count, as if it were not known."""

        def pick(table, name):
            return np.stack([sum(table[f"{name}{2 * label + h}"] for h in halves) for label in (0, 1)], 1)

        count, total = pick(n, "n"), pick(of, "n")
        kinds = pick(of, "k") if len(halves) == 1 else np.stack([of["b0"], of["b1"]], 1)
        held, follows = count.any(1), total.any(1)
        return WordFigures(ClassModels(node[held], count[held], parent[follows], total[follows], kinds[follows], shared))

    x, y = [], []
    for half in (0, 1):  # one after the other: the driver holds one model beside the counts
        figures = spark.sparkContext.broadcast(models([half]))
        judged = rows.where(F.col("half") == 1 - half).select("label", "text")
        seen = judged.mapInArrow(_evidence_under(figures), "label int, x array<double>").toArrow()
        figures.destroy()
        del figures
        x += seen.column("x").to_pylist()
        y += seen.column("label").to_pylist()
    x, y = np.array(x, float).reshape(-1, 5), (np.array(y) > 0).astype(float)
    order = np.lexsort((*x.T, y))
    return Judge(models([0, 1]), fit_logistic(x[order], y[order]))


def _scorer(judge):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(judge.value.score(batch.column(1).to_pylist()))], ["doc_id", "score"]
            )

    return score


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 3,
    fold: int = 1,
    train_rows: int = TRAIN_ROWS,
    reject: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  Only the text enters the score."""
    judge = train(labelled_sample(docs, labels, label, folds, fold, train_rows, doc_id, text))
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    scored = id_and_text(docs, doc_id, text).mapInArrow(_scorer(shared), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= reject).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 3,
    fold: int = 1,
    train_rows: int = TRAIN_ROWS,
    reject: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    judge = train(labelled_sample(docs, labels, label, folds, fold, train_rows, doc_id, text))
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    return keep_rows(docs, text, lambda texts: (shared.value.score(texts) < reject).tolist())

"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text are cut into bins.  Cyclic boosting visits one feature after the other and adds a shallow
tree over its bins to that feature's lookup table; the strongest pairs of features then get tables over pairs of
bins in the same way.  A score is the sum of the table entries of a text's bins, through the logistic function.

Defined cases: null and empty texts have features too and get a score; with no labelled rows every score is 0.5,
with one class it is that class; labels are read as ``labelled_sample`` says; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import id_and_text, ship
from offerloom.llm.labelled import held_out, labelled_sample

ship(__name__)

#: Labelled rows that are learnt from, at most.
TRAIN_ROWS = 20_000
FEATURES = [
    "log_words", "mean_word", "sd_word", "longest_word", "upper", "symbols", "bars", "exclamations", "digits", "blanks",
    "lines_per_word", "distinct_words", "top_word", "repeated_lines", "non_ascii", "stops_per_word", "entropy",
    "marked_words", "log_bytes",
]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _class("abcdefghijklmnopqrstuvwxyz")
SYMBOLS = _class("#$%&*+<=>@\\^_`{|}~[]/")
STOPS = _class(".,;:?")
DIGITS = _class("0123456789")
HIGH = np.r_[np.zeros(128), np.ones(128)]


def features(text: str) -> list[float]:
    """The features of one whole text."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    size = max(len(raw), 1)
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(counts @ (UPPER + LOWER), 1.0)
    share = counts[counts > 0] / size
    marked = sum(w[-1] in "!#$%&*|" for w in words)
    return [
        np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()), counts @ UPPER / letters,
        counts @ SYMBOLS / size, counts[124] / size, counts[33] / size, counts @ DIGITS / size, counts[32] / size,
        len(lines) / n, len(seen) / n, max(seen.values(), default=0) / n, 1 - len(set(lines)) / max(len(lines), 1),
        counts @ HIGH / size, counts @ STOPS / n, -(share * np.log2(share)).sum(), marked / n, np.log1p(len(raw)),
    ]


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 4) -> np.ndarray:
    """Step per bin of a tree with few leaves over the bins of one feature."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in parts]
        gain, k, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and step of a tree over a grid: one cut of the first feature, then one of the second on either side."""
    best, step = 0.0, np.zeros_like(g)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for cut in range(1, g.shape[0]):
        gain, trial = -whole, np.zeros_like(g)
        for side in (slice(0, cut), slice(cut, None)):
            gs, hs = g[side].sum(0), h[side].sum(0)
            more, k = _best_cut(gs, hs, ridge)
            gain += gs.sum() ** 2 / (hs.sum() + ridge) + more
            for cols in (slice(0, k), slice(k, None)):
                if hs[cols].size:
                    trial[side, cols] = gs[cols].sum() / (hs[cols].sum() + ridge)
        if gain > best:
            best, step = gain, trial
    return best, step


class AdditiveModel:
    """Lookup tables per feature and per pair of features."""

    def __init__(self, bins: int = 48, pair_bins: int = 10, rounds: int = 120, pairs: int = 8, rate: float = 0.1, ridge: float = 5.0):
        self.bins, self.pair_bins, self.rounds = bins, pair_bins, rounds
        self.n_pairs, self.rate, self.ridge = pairs, rate, ridge
        self.base, self.edges, self.coarse, self.tables, self.pairs = 0.0, [], [], [], {}

    def _binned(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if len(y) == 0 or y.min() == y.max():
            self.base = 0.0 if len(y) == 0 else (20.0 if y[0] else -20.0)
            return self

        def cuts(n):
            return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(x.shape[1])]

        self.edges, self.coarse = cuts(self.bins), cuts(self.pair_bins)
        fine, coarse = self._binned(x, self.edges), self._binned(x, self.coarse)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        total = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for j, b in enumerate(fine):
                g, h = slopes()
                n = len(self.tables[j])
                step = self.rate * shallow_tree(np.bincount(b, g, n), np.bincount(b, h, n), self.ridge)
                self.tables[j] += step
                total += step[b]
        grids = {}
        g, h = slopes()
        for j in range(x.shape[1]):
            for k in range(j + 1, x.shape[1]):
                shape = (len(self.coarse[j]) + 1, len(self.coarse[k]) + 1)
                cell = coarse[j] * shape[1] + coarse[k]
                n = shape[0] * shape[1]
                gain, _ = pair_tree(np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape), self.ridge)
                grids[j, k] = gain, cell, shape
        chosen = sorted(grids, key=lambda p: -grids[p][0])[: self.n_pairs]
        self.pairs = {p: np.zeros(grids[p][2]) for p in chosen if grids[p][0] > 0}
        for _ in range(self.rounds // 2):
            for p, held in self.pairs.items():
                _, cell, shape = grids[p]
                g, h = slopes()
                n = shape[0] * shape[1]
                _, step = pair_tree(np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape), self.ridge)
                held += self.rate * step
                total += self.rate * step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: sums of table entries."""
        total = np.full(len(x), self.base)
        for b, held in zip(self._binned(x, self.edges), self.tables, strict=True):
            total += held[b]
        if self.pairs:
            coarse = self._binned(x, self.coarse)
            for (j, k), held in self.pairs.items():
                total += held[coarse[j], coarse[k]]
        return 1 / (1 + np.exp(-total))


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column(1).to_pylist()]
        values = pa.array(rows, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(2), values], ["label", "x"])


def train(sample: DataFrame) -> AdditiveModel:
    """Model of a bounded sample (doc_id, text, label): features on the cluster, tables on the driver."""
    rows = sample.select("doc_id", "text", "label").mapInArrow(_feature_rows, "label int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["label"].to_numpy()))
    return AdditiveModel().fit(x[order], rows["label"].to_numpy(float)[order])


def _scorer(model):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    return score


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 4,
    fold: int = 2,
    train_rows: int = TRAIN_ROWS,
    accept: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  Only features of the text enter the score."""
    model = train(labelled_sample(docs, labels, label, folds, fold, train_rows, doc_id, text))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = id_and_text(docs, doc_id, text).mapInArrow(_scorer(shared), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )

"""Scores of texts under a causal self-attention model over subword ids, beside an add-one word model.

Words (A-Z lower-cased) become subword ids of a public rank file; a text is its ids and one end.  The next id is
predicted in two steps: its class, then the id within the class.  The class comes from one layer of causal
self-attention: log-odds of the class after the current id, plus what attention over the window's earlier ids adds.
The id within its class comes from counts, given the class of the current id.  Counts of all training texts give
the classes and vectors of the ids, the class log-odds and the id probabilities; the weights of the attention layer are
fitted by gradient descent in numpy on the windows of all training texts: every task goes through its texts from the same
start, and the weights they arrive at are averaged.

Texts are cut into overlapping windows: every id is predicted exactly once, in the first window where it has at
least ``WINDOW - STRIDE`` ids before it (or the text's beginning).  Windows are scored in batches with a mask.

Defined cases: null and empty texts consist of the end alone; without training texts all counts are 0 and ids are
equally likely; repeated rows are scored each and count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.bpe import load_ranks
from offerloom.llm.common import id_and_text, ship
from offerloom.llm.labelled import held_out
from offerloom.llm.unigram import LOWER, choose_head, count_words, frequent, in_head, text_sums
from offerloom.llm.wordhash import text_slices, word_hashes
from offerloom.session import cut_lineage

ship(__name__)

#: Ids of a window, and how far the next one is moved.
WINDOW, STRIDE = 16, 13
#: Classes of ids, and numbers that stand for an id in the attention layer.
CLASSES, WIDTH = 32, 16
#: Frequent ids beside which other ids are told apart.
ANCHORS = 127
#: Windows of a step of the fit; steps with the first rate, which a task makes at least; and the rates.
BATCH, STEPS, RATES = 256, 240, (0.01, 0.002)
#: Pairs of ids within words whose counts are sent everywhere, at most (counts of the others are joined to the texts that
#: hold them); and the weight of the attention model beside them.
INNER_PAIRS, INNER_WEIGHT = 400_000, 2.0
#: Words whose ids a worker keeps at hand.
KEPT_WORDS = 400_000
#: Text a worker scores at once, about.
PIECE = 1 << 20
#: Counts a worker hands on at once, and pairs of ids and different pairs it holds, about.
CELLS_AT_ONCE, HELD_PAIRS, HELD_CELLS = 200_000, 2_000_000, 4_000_000


class _Numbers(dict):
    """Numbers of words from 1; a word that is asked for first gets the next one and is ``new``."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        self.new.append(word)
        return number


class Subwords:
    """Subword ids of words; the encoder is made where it is used."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.end = max(ranks.values()) + 1
        #: Ids that begin a word or end a text: a word is encoded with a blank before it and holds no other.
        self.first = np.zeros(self.end + 1, bool)
        self.first[[r for t, r in ranks.items() if t.startswith(b" ")] + [self.end]] = True
        self._forget()
        self._encoder = None

    def __getstate__(self):
        return {name: self.__dict__[name] for name in ("ranks", "pattern", "end", "first")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()
        self._encoder = None

    def _forget(self) -> None:
        """No word but the end of a text (number 0) is known."""
        self.number = _Numbers()
        self.flat, self.sizes = np.array([self.end], np.int32), np.array([1])

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words, in the order of their numbers."""
        if self._encoder is None:
            import tiktoken

            self._encoder = tiktoken.Encoding("subwords", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        encode = self._encoder.encode_ordinary
        found = [encode(" " + w.decode()) for w in words]
        self.sizes = np.r_[self.sizes, [len(f) for f in found]]
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(found), np.int32)]

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, an end behind each text; how many ids each has with its end; which ids go on in a word."""
        if len(self.number) > KEPT_WORDS:
            self._forget()
        total = np.cumsum([len(words) + 1 for words in texts])
        word = np.zeros(total[-1] if len(total) else 0, np.int64)
        inner = np.ones(len(word), bool)
        inner[total - 1] = False
        word[inner] = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(inner.sum()))
        if self.number.new:
            self._learn(self.number.new)
            self.number.new = []
        sizes = self.sizes[word]
        ends = np.cumsum(sizes)
        # Place in the list of all known ids, for every id of every word.
        shift = (np.cumsum(self.sizes) - self.sizes)[word] - (ends - sizes)
        ids = self.flat[np.repeat(shift, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        goes_on = np.ones(len(ids), bool)
        goes_on[ends - sizes] = False
        return ids, np.diff(np.r_[0, ends[total - 1]]) if len(total) else np.zeros(0, np.int64), goes_on


def words_of(text: bytes) -> list[bytes]:
    """Words of a text whose A-Z is lower-cased."""
    return text.translate(LOWER).split()


class Attention:
    """Class model.  ``base``: log-odds of classes by id; ``vectors``: ids as numbers; weights of the layer."""

    def __init__(self, base: np.ndarray, vectors: np.ndarray):
        dice = np.random.default_rng(7)
        self.base, self.vectors = base.astype(np.float32), vectors.astype(np.float32)
        width, classes = vectors.shape[1], base.shape[1]
        draw = lambda *shape: (dice.standard_normal(shape) * 0.1).astype(np.float32)
        self.weights = {
            "query": draw(width, width), "key": draw(width, width), "value": draw(width, classes),
            "place": np.zeros(WINDOW, np.float32), "scale": np.ones(1, np.float32), "shift": np.zeros(classes, np.float32),
        }
        at = np.arange(WINDOW)
        self.back = np.clip(at[:, None] - at[None, :], 0, WINDOW - 1)
        self.mask = np.where(at[:, None] >= at[None, :], 0, -1e9).astype(np.float32)

    def _slopes(self, layer: np.ndarray, x: np.ndarray, base: np.ndarray, want: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient over a batch of windows.  ``layer``: products that make query, key, value and a one from ``x``, the
        vectors of the ids and a one; ``share``: weight of every place."""
        width, classes = self.vectors.shape[1], base.shape[1]
        y = (x @ layer).reshape(-1, WINDOW, layer.shape[1])
        q, k, v = y[..., :width], y[..., width : 2 * width], y[..., 2 * width :]
        ones = np.ones(classes, np.float32)
        for shifted in (False, True):
            # Without the shift first: it is needed only where the exponentials leave the numbers' range.
            e = np.matmul(q, k.transpose(0, 2, 1))
            e += self.weights["place"][self.back] + self.mask
            if shifted:
                e -= e.max(2, keepdims=True)
            # The last column of the values is one, so it sums what the weights of a place are divided by.
            o = np.matmul(np.exp(e, out=e), v).reshape(-1, classes + 1)
            sums = o[:, -1:]
            parts = 1 / sums
            o = o[:, :-1] * parts
            z = base * self.weights["scale"]
            z += o
            z += self.weights["shift"]
            if shifted:
                z -= z.max(1, keepdims=True)
            total = np.exp(z, out=z) @ ones
            if all(1e-30 < t.min() and t.max() < 1e30 for t in (sums, total)):
                break
        z *= (share / total)[:, None]
        z[np.arange(len(z)), want] -= share
        d = np.empty((len(z), classes + 1), np.float32)
        np.multiply(z, parts, out=d[:, :-1])
        d[:, -1] = -np.einsum("ij,ij->i", d[:, :-1], o)
        d = d.reshape(-1, WINDOW, classes + 1)
        ds = np.matmul(d, v.transpose(0, 2, 1))
        ds *= e
        g = np.empty((len(d), WINDOW, 2 * width + classes), np.float32)
        np.matmul(ds, k, out=g[..., :width])
        np.matmul(ds.transpose(0, 2, 1), q, out=g[..., width : 2 * width])
        np.matmul(e.transpose(0, 2, 1), d[..., :-1], out=g[..., 2 * width :])
        g = x[:, :width].T @ g.reshape(len(x), -1)
        return {
            "query": g[:, :width] / np.float32(np.sqrt(width)), "key": g[:, width : 2 * width], "value": g[:, 2 * width :],
            "place": np.bincount(self.back.ravel(), (ds.sum(0) * (self.mask == 0)).ravel(), WINDOW).astype(np.float32),
            "scale": np.array([np.vdot(z, base)], np.float32), "shift": z.sum(0),
        }

    def fit(self, windows: np.ndarray, targets: np.ndarray, known: np.ndarray, steps: int = 240, batch: int = 256, rate: float = 0.01) -> Attention:
        """Adam on windows of ids; ``targets`` are classes, ``known`` says which places count."""
        w, dice = self.weights, np.random.default_rng(11)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
        width = self.vectors.shape[1]
        layer = np.zeros((width + 1, 2 * width + w["value"].shape[1] + 1), np.float32)
        layer[width, -1] = 1
        ones = np.ones((batch * WINDOW, 1), np.float32)
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1 if len(windows) else 1):
            # Every window has its turn before one comes again.
            if not len(order):
                order = dice.permutation(len(windows))
            pick, order = order[:batch], order[batch:]
            ids, share = windows[pick].ravel(), known[pick].ravel().astype(np.float32)
            share /= max(share.sum(), 1)
            layer[:width, :-1] = np.hstack([w["query"] / np.float32(np.sqrt(width)), w["key"], w["value"]])
            x = np.hstack([self.vectors.take(ids, 0), ones[: len(ids)]])
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                slope = self._slopes(layer, x, self.base.take(ids, 0), targets[pick].ravel(), share)
            for name, g in slope.items():
                m, s = moments[name]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def started(self, weights: dict[str, np.ndarray]) -> Attention:
        """The same layer with a copy of the weights."""
        new = Attention.__new__(Attention)
        new.__dict__.update(self.__dict__)
        new.weights = {name: value.copy() for name, value in weights.items()}
        return new

    def ready(self) -> Attention:
        """One table by id, so that scoring a window takes no product by the weights: query, key, value, one, base."""
        w, root = self.weights, np.float32(1 / np.sqrt(self.vectors.shape[1]))
        parts = [self.vectors @ w["query"] * root, self.vectors @ w["key"], self.vectors @ w["value"], self.base * w["scale"] + w["shift"]]
        # Attention adds a mean of values; with small tables the exponentials need no shift.
        self.small = float(np.abs(parts[2]).max() + np.abs(parts[3]).max()) < 80
        longest = [float(np.sqrt((t**2).sum(1).max())) for t in parts[:2]]
        self.calm = longest[0] * longest[1] + float(np.abs(w["place"]).max()) < 80
        self.table = np.hstack([*parts[:3], np.ones((len(self.base), 1), np.float32), parts[3]])
        self.vectors = self.base = None
        return self

    def class_logs(self, ids: np.ndarray, targets: np.ndarray, skip: int = 0) -> np.ndarray:
        """Natural log of the probability of the target classes at every place of the windows but the first ``skip``."""
        width, classes = self.weights["query"].shape[0], len(self.weights["shift"])
        rows = self.table.take(ids.ravel(), 0).reshape(*ids.shape, -1)
        q, k, v = rows[:, skip:, :width], rows[..., width : 2 * width], rows[..., 2 * width : 2 * width + classes + 1]
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += (self.weights["place"][self.back] + self.mask)[skip:]
        if not self.calm:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        o = np.matmul(s, v).reshape(-1, classes + 1)
        o = o[:, :-1] / o[:, -1:]
        o.reshape(len(ids), -1, classes)[...] += rows[:, skip:, 2 * width + classes + 1 :]
        if not self.small:
            o -= o.max(1, keepdims=True)
        want = o[np.arange(len(o)), targets[:, skip:].ravel()]
        np.exp(o, out=o)
        return (want - np.log(o @ np.ones(classes, np.float32))).reshape(len(ids), -1)


def window_table(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts that follow each other: first place, last place of the text, first place that is scored.

    A place p of a text stands for predicting its p-th id.
    """
    more = np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), more + 1)
    number = np.arange(len(text)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    start = np.cumsum(sizes) - sizes
    first = start[text] + number * STRIDE
    return first, (start + sizes)[text], first + np.where(number > 0, WINDOW - STRIDE, 0)


class Model:
    """Everything a worker needs to score texts."""

    def __init__(
        self, attention: Attention, classes: np.ndarray, within: np.ndarray, subwords: Subwords, inner: tuple[np.ndarray, np.ndarray],
        after: np.ndarray | None = None,
    ):
        """``after``: how often an id is followed within a word, where ``inner`` does not hold all pairs."""
        self.attention, self.classes, self.within, self.subwords = attention, classes, within.astype(np.float32), subwords
        self.pairs, self.times = inner
        self.whole = after is None
        self.after = np.bincount(self.pairs // len(classes), self.times, len(classes)) if self.whole else after

    def _inside_words(self, logs: np.ndarray, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts of pairs with the model's probabilities as their prior; and places, pairs and priors of pairs whose
        counts are not here (taken for 0)."""
        pair = before * np.int64(len(self.classes)) + ids
        times, known = np.zeros(len(pair)), np.zeros(len(pair), bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = self.pairs[at] == pair
            times = np.where(known, self.times[at], 0)
        prior = INNER_WEIGHT * np.exp(logs)
        open_ = np.zeros(0, np.int64) if self.whole else np.flatnonzero(~known)
        return np.log((times + prior) / (self.after[before] + INNER_WEIGHT)), open_, pair[open_], prior[open_]

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 of the probability of every text."""
        return self.score_ids(*self.subwords.of(texts))

    def score_ids(self, ids: np.ndarray, sizes: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """The same for texts that are ids already."""
        return self.score_parts(ids, sizes, goes_on)[0]

    def score_parts(self, ids: np.ndarray, sizes: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same, and of pairs whose counts are not here: text, pair, prior."""
        starts = np.cumsum(sizes) - sizes
        before = np.roll(ids, 1)
        before[starts] = self.subwords.end
        target = self.classes[ids]
        logs = self.within[self.classes[before], ids].astype(np.float64)
        first, stop, scored = window_table(sizes)
        later = scored > first
        for skip, some in ((0, np.flatnonzero(~later)), (WINDOW - STRIDE, np.flatnonzero(later))):
            for a in range(0, len(some), 256):
                at = first[some[a : a + 256], None] + np.arange(WINDOW)
                use = at[:, skip:] < stop[some[a : a + 256], None]
                at = np.minimum(at, len(ids) - 1)
                found = self.attention.class_logs(before[at], target[at], skip)
                logs[at[:, skip:][use]] += found[use]
        logs[goes_on], at, pair, prior = self._inside_words(logs[goes_on], before[goes_on], ids[goes_on])
        text = np.searchsorted(starts, np.flatnonzero(goes_on)[at], side="right") - 1
        return np.add.reduceat(logs, starts) / np.log(10), text, pair, prior


def _anchor_columns(total: np.ndarray) -> np.ndarray:
    """A column for each of the most frequent ids; all others share the last one."""
    column = np.full(len(total), ANCHORS)
    anchors = np.argsort(-total, kind="stable")[:ANCHORS]
    column[anchors] = np.arange(len(anchors))
    return column


def _clusters(total: np.ndarray, behind: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and vectors of ids, by their neighbours: k-means on a spectral embedding.

    ``total``: how often each id is predicted; ``behind`` and ``ahead``: how often it stands after and before each anchor.
    """
    n, seen = len(total), np.flatnonzero(total)
    x = np.empty((len(seen), 2 * (ANCHORS + 1)), np.float32)
    x[:, : ANCHORS + 1], x[:, ANCHORS + 1 :] = behind[seen], ahead[seen]
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    x -= x.mean(0)
    _, vectors = np.linalg.eigh(x.T @ x)
    x = x @ vectors[:, ::-1][:, :WIDTH]
    spread = np.zeros((n, WIDTH), np.float32)
    spread[seen] = x / (x.std() + 1e-9)
    heavy = np.sqrt(total[seen].astype(np.float64))
    centres = spread[seen][np.argsort(-heavy, kind="stable")[:CLASSES]].astype(np.float64)
    for _ in range(12):
        near = ((spread[seen] ** 2).sum(1)[:, None] - 2 * spread[seen] @ centres.T + (centres**2).sum(1)).argmin(1)
        mass = np.bincount(near, heavy, len(centres))
        sums = np.stack([np.bincount(near, heavy * spread[seen, j], len(centres)) for j in range(WIDTH)], 1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres)
    classes = np.arange(n) % CLASSES
    classes[seen] = near
    return classes.astype(np.int64), spread


def _counted(cell: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different cells and the sums of their counts."""
    found, at = np.unique(cell, return_inverse=True)
    return found, np.bincount(at, times, len(found)).astype(np.int64)


def _told(kind: int, cell: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(cell), CELLS_AT_ONCE):
        part = cell[a : a + CELLS_AT_ONCE]
        columns = [np.full(len(part), kind, np.int32), part.astype(np.int64), times[a : a + CELLS_AT_ONCE].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], COUNTS)


TOKENS = "doc_id long, tag long, learns boolean, text string, ids binary"


def _tokeniser(shared):
    """Rows with the ids of their text, ends included, in 16 bits each where the vocabulary allows it."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = shared.value
        kind = id_kind(subwords)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(3), PIECE):
                ids, sizes, _ = subwords.of([words_of(t) for t in texts])
                cuts = np.r_[0, np.cumsum(sizes)] * kind.itemsize
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), packed], [c.split()[0] for c in TOKENS.split(", ")])

    return encode


def id_kind(subwords: Subwords) -> np.dtype:
    return np.dtype(np.uint16 if subwords.end < 1 << 16 else np.int32)


def told_ids(subwords: Subwords, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, ids, ids of each text, which ids go on in a word) of stretches of a column of ids, or of texts."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        for a, b, texts in text_slices(column, PIECE):
            yield a, b, *subwords.of([words_of(t) for t in texts])
        return
    kind = id_kind(subwords)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    number = (np.cumsum(sizes) - 1) // PIECE
    cuts = np.r_[0, np.flatnonzero(number[1:] != number[:-1]) + 1, len(column)] if len(column) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        ids = np.frombuffer(b"".join(column.slice(a, b - a).to_pylist()), kind).astype(np.int32)
        yield a, b, ids, sizes[a:b] // kind.itemsize, ~subwords.first[ids]


def _corpus_counts(shared):
    """Of training texts: how often an id follows another (``kind`` 0; the cell is twice the pair, one more within a
    word), cells that occur only; and frequent words (-1)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = shared.value
        n = subwords.end + 1
        held: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        known = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def often() -> Iterator[pa.RecordBatch]:
            word, times = frequent(np.concatenate([np.zeros(0, np.uint64), *held]))
            held.clear()
            yield from _told(-1, word.view(np.int64), times)

        def settled() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_counts=True)
            pairs.clear()
            return _counted(np.r_[known[0], new], np.r_[known[1], times])

        for batch in batches:
            for _, _, texts in text_slices(batch.column(0), PIECE):
                held.append(word_hashes([t.translate(LOWER) for t in texts])[0])
                if sum(map(len, held)) > 1_000_000:
                    yield from often()
            for _, _, ids, sizes, goes_on in told_ids(subwords, batch.column(batch.num_columns - 1)):
                before = np.roll(ids, 1)
                before[np.cumsum(sizes) - sizes] = n - 1
                pairs.append((before * np.int64(n) + ids) * 2 + goes_on)
                if sum(map(len, pairs)) > HELD_PAIRS:
                    known = settled()
                    if len(known[0]) > HELD_CELLS:
                        yield from _told(0, *known)
                        known = known[0][:0], known[1][:0]
        yield from often()
        yield from _told(0, *settled())

    return count


def _grouped_counts(shared):
    """Of pair counts: how often an id follows an id of a group (``kind`` 0), how often a group follows an id (1), cells
    that occur only."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, groups = shared.value
        n = len(group)
        tables = [np.zeros(groups * n), np.zeros(groups * n)]
        for batch in batches:
            pair, times = batch.column(0).to_numpy() >> 1, batch.column(1).to_numpy()
            before, ids = pair // n, pair % n
            for table, cell in zip(tables, (group[before] * n + ids, before * groups + group[ids]), strict=True):
                found, sums = _counted(cell, times)
                table[found] += sums
        for kind, table in enumerate(tables):
            cell = np.flatnonzero(table)
            yield from _told(kind, cell, table[cell])

    return count


COUNTS = ["kind", "cell", "n"]


def _pack_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], COUNTS)


def _pack_inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).to_numpy().tobytes()], pa.binary()) for i in range(2)], ["cell", "n"])


def _summed(counts: DataFrame, cells: int) -> np.ndarray:
    """The two tables (kind, cell), added up by Spark; as large as there are cells, whatever the corpus."""
    total = np.zeros((2, cells), np.int64)
    sums = counts.where("kind in (0, 1)").groupBy("kind", "cell").agg(F.sum("n").alias("n"))
    for row in sums.mapInArrow(_pack_cells, "kind binary, cell binary, n binary").toLocalIterator():
        kind, cell, n = (np.frombuffer(b, t) for b, t in zip(row, (np.int32, np.int64, np.int64)))
        total[kind, cell] = n
    return total


def _by_group(pairs: DataFrame, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of ids after a group (groups x ids) and of groups after an id (ids x groups)."""
    shared = pairs.sparkSession.sparkContext.broadcast((group.astype(np.int64), groups))
    counts = pairs.select("cell", "n").mapInArrow(_grouped_counts(shared), "kind int, cell long, n long")
    after, ahead = _summed(counts, groups * len(group))
    shared.unpersist()
    return after.reshape(groups, -1), ahead.reshape(-1, groups)


def _windows(ids: np.ndarray, sizes: np.ndarray, classes: np.ndarray, end: int, pick: np.ndarray | None = None) -> tuple:
    """Current ids, classes of the next ones, and places within the text, of the windows (picked ones only)."""
    first, stop, _ = window_table(sizes)
    if pick is not None:
        first, stop = first[pick], stop[pick]
    at = first[:, None] + np.arange(WINDOW)
    known, at = at < stop[:, None], np.minimum(at, max(0, len(ids) - 1))
    before = np.roll(ids, 1)
    before[np.cumsum(sizes) - sizes] = end
    return before[at], classes[ids[at]], known


def _fitter(shared):
    """Weights a task arrives at on its texts, times the windows it saw."""

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, classes, attention = shared.value
        own, seen, steps = attention.started(attention.weights), 0, 0
        few: list[tuple] = []
        for batch in batches:
            for _, _, ids, sizes, _ in told_ids(subwords, batch.column(0)):
                told = _windows(ids, sizes, classes, subwords.end)
                more = -(-len(told[0]) // BATCH)
                own.fit(*told, steps=more, batch=BATCH, rate=RATES[steps >= STEPS])
                seen, steps = seen + len(told[0]), steps + more
                few = [*few, told] if steps < STEPS else []
        if few:
            # All there is, at most ``STEPS`` batches: it is gone through again.
            own.fit(*map(np.concatenate, zip(*few, strict=True)), steps=STEPS - steps, batch=BATCH, rate=RATES[0])
        flat = np.concatenate([own.weights[k].ravel() for k in sorted(own.weights)]).astype(np.float64)
        if seen:
            columns = [np.arange(len(flat), dtype=np.int32), flat * seen, np.full(len(flat), seen, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "value", "n"])

    return fit


def _fit_on(rows: DataFrame, subwords: Subwords, classes: np.ndarray, attention: Attention) -> Attention:
    """The layer fitted on all texts; the average of what the tasks arrive at."""
    shared = rows.sparkSession.sparkContext.broadcast((subwords, classes, attention))
    column = "ids" if "ids" in rows.columns else "text"
    if column == "ids":
        # Texts are not dealt over more tasks than have enough of them for their steps.
        size = F.octet_length("ids") / id_kind(subwords).itemsize
        windows = rows.agg(F.sum(1 + F.greatest(F.lit(0), F.ceil((size - WINDOW) / STRIDE)))).first()[0] or 0
        rows = rows.coalesce(max(1, int(windows) // (STEPS * BATCH)))
    told = rows.select(column).mapInArrow(_fitter(shared), "place int, value double, n long").groupBy("place").agg(F.sum("value").alias("v"), F.sum("n").alias("n"))
    mean = {r["place"]: r["v"] / r["n"] for r in told.collect()}  # one row a weight
    shared.unpersist()
    if not mean:
        return attention
    flat, weights, at = np.array([mean[i] for i in range(len(mean))], np.float32), {}, 0
    for name in sorted(attention.weights):
        old = attention.weights[name]
        weights[name] = flat[at : at + old.size].reshape(old.shape)
        at += old.size
    return attention.started(weights)


def train(rows: DataFrame, subwords: Subwords) -> tuple[Model, np.ndarray, DataFrame | None]:
    """Model and head words of the word model, from training texts (columns text and ids); and counts (cell, n) of pairs
    within words that the model does not hold, if there are more than it holds."""
    spark, n = rows.sparkSession, subwords.end + 1
    shared = spark.sparkContext.broadcast(subwords)
    counts = rows.select("text", "ids").mapInArrow(_corpus_counts(shared), "kind int, cell long, n long")
    found = cut_lineage(counts.groupBy("kind", "cell").agg(F.sum("n").alias("n")))
    shared.unpersist()
    head = choose_head(found.where("kind < 0").select(F.col("cell").alias("word"), "n"))
    followed = found.where("kind = 0")
    inside = followed.where("cell % 2 = 1").select(F.shiftright("cell", 1).alias("cell"), "n")
    often = inside.orderBy(F.desc("n"), "cell").limit(INNER_PAIRS)
    told = often.coalesce(1).mapInArrow(_pack_inner, "cell binary, n binary").collect()
    cell, times = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[i], np.int64) for r in told)]) for i in range(2))
    after, rest = None, None
    if len(cell) == INNER_PAIRS:
        least, last = int(times[-1]), int(cell[-1])  # in falling order
        rest = inside.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("cell") > last)))
        sums = inside.groupBy(F.floor(F.col("cell") / n).alias("id")).agg(F.sum("n").alias("n")).toArrow()  # one row an id
        after = np.bincount(sums.column("id").to_numpy(), sums.column("n").to_numpy(), n)
    order = np.argsort(cell)
    total = _by_group(followed, np.zeros(n), 1)[0][0]
    if not total.any():
        total[subwords.end] = 1
    behind, ahead = _by_group(followed, _anchor_columns(total), ANCHORS + 1)
    classes, vectors = _clusters(total, behind.T, ahead)
    del behind, ahead
    pairs, nexts = _by_group(followed, classes, CLASSES)
    # Classes after an id, backed by classes after any id; ids of a class, backed by ids after any class.
    anyhow = (nexts.sum(0) + 1.0) / (nexts.sum() + CLASSES)
    base = np.log((nexts + 4 * anyhow) / (nexts.sum(1, keepdims=True) + 4))
    one = pairs.sum(0) + 0.1
    alone = one / np.bincount(classes, one, CLASSES)[classes]
    of_class = np.stack([np.bincount(classes, row, CLASSES) for row in pairs])
    within = np.log((pairs + 20 * alone) / (of_class + 20)[:, classes])
    attention = _fit_on(rows, subwords, classes, Attention(base, vectors)).ready()
    return Model(attention, classes, within, subwords, (cell[order], times[order]), after), head, rest


SCORED = "doc_id long, tag long, n_tokens long, score double, head_known long, head_logs double, pairs array<long>, priors array<double>"


def _scorer(shared):
    names = [c.split()[0] for c in SCORED.split(", ")]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head, counts = shared.value
        logs = np.log10(counts + 1.0)
        for batch in batches:
            parts = [(a, *model.score_parts(*told)) for a, _, *told in told_ids(model.subwords, batch.column(3))]
            scores = np.concatenate([np.zeros(0), *(p[1] for p in parts)])
            cuts = np.searchsorted(np.concatenate([np.zeros(0, np.int64), *(a + text for a, _, text, _, _ in parts)]), np.arange(len(scores) + 1))
            lists = [
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)])))
                for k, kind in ((3, np.int64), (4, float))
            ]
            for a, b, texts in text_slices(batch.column(2), PIECE):
                texts, k = [t.translate(LOWER) for t in texts], b - a
                hashes, text = word_hashes(texts)
                at, known = in_head(head, hashes)
                if len(head):
                    held, sums = np.bincount(text, known & (counts[at] > 0), k), np.bincount(text, np.where(known, logs[at], 0), k)
                else:
                    held, sums = np.zeros(k), np.zeros(k)
                columns = [
                    batch.column(0).slice(a, k), batch.column(1).slice(a, k), pa.array(np.bincount(text, minlength=k) + 1, pa.int64()),
                    pa.array(scores[a:b]), pa.array(held.astype(np.int64)), pa.array(sums.astype(float)),
                    *(c.slice(a, k) for c in lists),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return score


def with_rare_pairs(scored: DataFrame, rest: DataFrame) -> DataFrame:
    """Scores with the counts of the pairs that no worker holds: these are joined to the texts that name them."""
    scored = cut_lineage(scored)
    key = [F.coalesce("doc_id", F.lit(0)).alias("pair_id"), F.col("tag").alias("pair_tag")]
    # Equal rows have equal pairs.
    once = scored.where(F.size("pairs") > 0).select(*key, "pairs", "priors").dropDuplicates(["pair_id", "pair_tag"])
    each = once.select("pair_id", "pair_tag", F.explode(F.arrays_zip("pairs", "priors")).alias("p"))
    each = each.select("pair_id", "pair_tag", F.col("p.pairs").alias("cell"), F.col("p.priors").alias("prior"))
    gain = F.log10((F.col("n") + F.col("prior")) / F.col("prior"))
    gains = each.join(rest, "cell").groupBy("pair_id", "pair_tag").agg(F.sum(gain).alias("gain"))
    same = (F.coalesce("doc_id", F.lit(0)) == F.col("pair_id")) & (F.col("tag") == F.col("pair_tag"))
    found = scored.join(gains, same, "left").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0)))
    return found.drop("pair_id", "pair_tag", "gain")


def score_texts(
    docs: DataFrame, ranks_path: str, pattern: str, folds: int = 7, fold: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = id_and_text(docs, doc_id, text)
    rows = rows.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("tag"), (~held_out(F.col("doc_id"), folds, fold)).alias("learns"), "text")
    subwords = Subwords(load_ranks(ranks_path), pattern)
    known = spark.sparkContext.broadcast(subwords)
    # Texts are cut into ids once and kept beside them; every later step reads them there.
    rows = cut_lineage(rows.mapInArrow(_tokeniser(known), TOKENS))
    known.unpersist()
    model, head, rare_pairs = train(rows.where("learns"), subwords)
    partial = cut_lineage(count_words(rows, head))
    found = {r["word"]: r["count"] for r in partial.where("word is not null").select("word", "count").collect()}
    counts = np.array([found.get(int(w), 0) for w in head.view(np.int64)], np.int64)
    rest = partial.where("kinds is not null").agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = rows.where("learns").count()
    tokens = int(counts.sum()) + int(rest[0]) + ends
    kinds = int((counts > 0).sum()) + int(rest[1]) + (ends > 0)
    shared = spark.sparkContext.broadcast((model, head, counts))
    scored = rows.select("doc_id", "tag", "text", "ids").mapInArrow(_scorer(shared), SCORED)
    if rare_pairs is not None:
        scored = with_rare_pairs(scored, rare_pairs)
    rare = text_sums(partial).withColumnsRenamed({"doc_id": "rare_id", "tag": "rare_tag"})
    same = (F.coalesce("doc_id", F.lit(0)) == F.col("rare_id")) & (F.col("tag") == F.col("rare_tag"))
    joined = scored.join(rare, same, "left")
    logs = F.col("head_logs") + F.coalesce("logs", F.lit(0.0)) + F.lit(float(np.log10(ends + 1)))
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1)))).alias("base_score"),
        "score",
    )

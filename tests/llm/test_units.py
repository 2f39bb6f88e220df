"""Parts of the operators against plain definitions, on random input that hits their rarer paths."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from offerloom.llm import lm, neardup, substring, toxicity
from offerloom.llm.components import merge_components
from offerloom.llm.phrases import Phrases, words_of
from offerloom.llm.quality import AdditiveModel


def brute_groups(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        words = t.lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    comp = {i: i for i in texts}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in texts:
        for b in texts:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                comp[high] = low
    return {i: root(i) for i in texts}


@pytest.mark.parametrize("small", [4, 1024])
def test_groups_equal_brute_force(spark, monkeypatch, small):
    """Families of copies with few and with many edits, exact copies, and a passage that all texts share."""
    monkeypatch.setattr(neardup, "SMALL_NODE", small)
    dice = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    shared = " ".join(dice.choice(vocabulary) for _ in range(12))
    texts = {}
    for family in range(6):
        words = [dice.choice(vocabulary) for _ in range(dice.choice([40, 120]))]
        for _ in range(20):
            mine = list(words)
            for _ in range(dice.choice([0, 1, 2, 3, 8])):
                mine[dice.randrange(len(mine))] = dice.choice(vocabulary)
            texts[len(texts)] = f"{' '.join(mine)} {shared}" if family % 2 else " ".join(mine)
    for _ in range(40):
        texts[len(texts)] = f"{shared} {' '.join(dice.choice(vocabulary) for _ in range(30))}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.find_groups(df, size=2).collect()}
    want = brute_groups(texts, 2, 80)
    assert got == want
    assert len(set(want.values())) > 50


def test_texts_that_extend_each_other_are_linked(spark):
    """X in B in A, where X has the smallest id and is too short to be like A: A hangs on B alone."""
    texts = {}
    for family in range(60):
        words = [f"f{family}w{i}" for i in range(102)]
        for length in (81, 89, 102):  # 80, 88 and 101 shingles
            texts[len(texts)] = " ".join(words[:length])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.find_groups(df, size=2).collect()}
    assert got == {i: i - i % 3 for i in texts} == brute_groups(texts, 2, 80)


def test_components(spark):
    dice = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(dice.randrange(100, 200), dice.randrange(100, 200)) for _ in range(60)] + [(5, 300), (300, 7)]
    links = [(min(x), max(x)) for x in links if x[0] != x[1]]
    comp = {}

    def root(i):
        while comp.setdefault(i, i) != i:
            i = comp[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        comp[high] = low
    nothing = spark.createDataFrame([], "id long, comp long")
    first = merge_components(nothing, spark.createDataFrame(links[:50], "a long, b long"))
    both = merge_components(first, spark.createDataFrame(links[50:], "a long, b long"))
    got = {r["id"]: r["comp"] for r in both.collect()}
    assert {i: got.get(i, i) for i in comp} == {i: root(i) for i in comp}


@pytest.mark.parametrize("length", [2, 5, 13])
def test_windows_equal_brute_force(spark, length):
    dice = random.Random(length)
    texts = {i: [dice.choice("abcdefgh") + dice.choice("xyz") for _ in range(dice.randrange(60))] for i in range(40)}
    passage = [f"p{i}" for i in range(30)]
    for i in range(0, 40, 2):
        at, n = dice.randrange(len(texts[i]) + 1), dice.randrange(length - 1, 30)
        texts[i] = texts[i][:at] + passage[:n] + texts[i][at:]
    texts[41], texts[42] = texts[4], texts[4] + texts[6]
    low = {}
    for i in sorted(texts, reverse=True):
        for k in range(len(texts[i]) - length + 1):
            low[tuple(texts[i][k : k + length])] = i
    want = {}
    for i, words in texts.items():
        gone = set()
        for k in range(len(words) - length + 1):
            if low[tuple(words[k : k + length])] < i:
                gone |= set(range(k, k + length))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    df = spark.createDataFrame([(i, " \n".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeated(df, length).collect()}
    assert got == want


def test_every_id_is_scored_once():
    sizes = np.array([1, 5, lm.WINDOW, lm.WINDOW + 1, 3 * lm.WINDOW + 7, 1])
    first, stop, scored = lm.window_table(sizes)
    seen = collections.Counter()
    for a, b, s in zip(first, stop, scored, strict=True):
        seen.update(p for p in range(a, min(a + lm.WINDOW, b)) if p >= s)
    assert seen == collections.Counter(range(sizes.sum()))


def test_attention_learns_what_lies_further_back():
    """The class two places back decides; only attention can see it."""
    dice = np.random.default_rng(1)
    ids = dice.integers(0, 4, (400, lm.WINDOW))
    target = np.roll(ids, 1, axis=1)
    target[:, 0] = 0
    classes = 4
    old = lm.CLASSES
    try:
        lm.CLASSES = classes
        model = lm.Attention(np.zeros((4, classes)), np.eye(4) * 2)
        plain = np.log(1 / classes)
        model.fit(ids, target, np.ones(ids.shape, bool), steps=300)
        logs = model.ready().class_logs(ids, target)
    finally:
        lm.CLASSES = old
    assert logs[:, 1:].mean() > plain / 2
    assert logs.max() <= 1e-6


def test_scores_by_hand():
    """Every id of every text, one at a time: attention over its window, id within the class, pairs within words."""
    dice = np.random.default_rng(6)
    n, old = 9, lm.CLASSES
    ends = {b"a": [0], b"b": [1, 2], b"c": [3, 4, 5], b"d": [6, 7, 7, 1]}

    class Words(lm.Subwords):
        def __init__(self):
            self.ranks, self.pattern, self.end = {}, "", n - 1
            self._forget()
            self._encoder = self

        def encode_ordinary(self, word):
            return ends[word.strip().encode()]

    try:
        lm.CLASSES = 3
        layer = lm.Attention(dice.standard_normal((n, 3)), dice.standard_normal((n, 4)))
        layer.weights = {k: dice.standard_normal(v.shape).astype(np.float32) for k, v in layer.weights.items()}
        w, base, vectors, back = dict(layer.weights), layer.base, layer.vectors, layer.back
        classes = np.arange(n) % 3
        within = dice.standard_normal((3, n))
        within -= np.log(np.array([[np.exp(within[c][classes == k]).sum() for k in classes] for c in range(3)]))
        inner = {(1, 2): 5, (3, 4): 2, (7, 1): 1}
        pairs = np.array(sorted(a * n + b for a, b in inner))
        model = lm.Model(layer.ready(), classes, within, Words(), (pairs, np.array([inner[p // n, p % n] for p in pairs.tolist()])))
        texts = [[b"a", b"d", b"c"], [], [dice.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]]
        got = model.score(texts)
    finally:
        lm.CLASSES = old

    def class_log(ids, place, start):
        """log of the class of ids[place], seen from the window that starts at ``start`` (an end stands before a text)."""
        seen = [n - 1, *ids][start : place + 1]
        q = vectors[seen[-1]] @ w["query"] / np.sqrt(4)
        s = np.array([q @ (vectors[x] @ w["key"]) + w["place"][back[len(seen) - 1, i]] for i, x in enumerate(seen)])
        a = np.exp(s - s.max())
        z = base[seen[-1]] * w["scale"] + w["shift"] + (a / a.sum()) @ np.array([vectors[x] @ w["value"] for x in seen])
        return z[classes[ids[place]]] - np.log(np.exp(z - z.max()).sum()) - z.max()

    for text, score in zip(texts, got, strict=True):
        ids, goes_on = [], []
        for word in text:
            ids += ends[word]
            goes_on += [False, *[True] * (len(ends[word]) - 1)]
        ids, goes_on, total = [*ids, n - 1], [*goes_on, False], 0.0
        for place, x in enumerate(ids):
            start = 0 if place < lm.WINDOW else -(-(place - lm.WINDOW + 1) // lm.STRIDE) * lm.STRIDE
            before = ids[place - 1] if place else n - 1
            log = class_log(ids, place, start) + within[classes[before], x]
            if goes_on[place]:
                held = sum(v for (a, _), v in inner.items() if a == before)
                log = np.log((inner.get((before, x), 0) + lm.INNER_WEIGHT * np.exp(log)) / (held + lm.INNER_WEIGHT))
            total += log
        assert score == pytest.approx(total / np.log(10), rel=1e-4)


def test_sums_of_counts(spark):
    """Counts of all tasks are added up, cell by cell."""
    rows = [(0, 3, 2), (0, 3, 5), (1, 0, 7), (-1, 3, 9), (2, 1, 1), (0, 9, 1)]
    total = lm._summed(spark.createDataFrame(rows, "kind int, cell long, n long").repartition(3), 10)
    assert {(k, c): n for (k, c), n in np.ndenumerate(total) if n} == {(0, 3): 7, (1, 0): 7, (0, 9): 1}


def test_additive_model_finds_an_interaction():
    dice = np.random.default_rng(2)
    x = dice.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = AdditiveModel().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_phrases_find_every_place():
    dice = random.Random(4)
    phrases = [p.encode().split() for p in ("a b", "b", "b a b", "c", "a b c", "é a")]
    words = [dice.choice(["a", "b", "c", "d", "é"]) for _ in range(400)]
    raw = [w.encode() for w in words]
    want = sorted((n, i) for n, p in enumerate(phrases) for i in range(len(raw)) if raw[i : i + len(p)] == p)
    assert sorted(Phrases(phrases).find(words_of(" ".join(words).upper().replace("É", "é")))) == want


def test_rare_toxic_words_are_learnt_from_all_labels(spark):
    """9,000 labels; each of 300 toxic words is in two learnt texts and in one that is held out."""
    dice = random.Random(9)
    word = lambda: "".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    plain, bad = [word() for _ in range(200)], [word() for _ in range(300)]
    texts, toxic, fold = {}, {}, {False: iter(bad), True: iter(bad * 2)}
    for i in range(9_000):
        words = [dice.choice(plain) for _ in range(12)]
        learnt = zlib.crc32(str(i).encode()) % 3 != 1
        if (w := next(fold[learnt], None)) is not None:
            words += [w] * 4
        texts[i], toxic[i] = " ".join(words), int(w is not None)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    judged = [r for r in toxicity.score_toxicity(docs, labels).collect() if r["held_out"]]
    found = [r["predicted"] for r in judged if toxic[r["doc_id"]]]
    assert len(found) == 300 and sum(found) / len(found) > 0.95
    assert sum(r["predicted"] for r in judged) == sum(found)


def test_all_of_8000_labels_are_learnt_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda sample: seen.append(sample.count()) or toxicity.Judge(None, None))
    docs = spark.range(12_000).selectExpr("id AS doc_id", "'a b' AS text")
    toxicity.drop_toxic(docs, docs.selectExpr("doc_id", "0 AS toxic"))
    assert seen == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(12_000))]


def test_slopes_are_those_of_the_loss():
    """The gradient of the mean loss, beside differences of the loss, with small and with very large numbers."""
    dice = np.random.default_rng(2)
    n = 6
    layer = lm.Attention(dice.standard_normal((n, 3)), dice.standard_normal((n, 4)))
    layer.weights = {k: dice.standard_normal((4, 3) if k == "value" else 3 if k == "shift" else v.shape) for k, v in layer.weights.items()}
    layer.base, layer.vectors = layer.base.astype(float), layer.vectors.astype(float)
    ids, want = dice.integers(0, n, (5, lm.WINDOW)), dice.integers(0, 3, (5, lm.WINDOW))
    known = np.ones(ids.shape, bool)
    known[2, 7:] = False

    def loss(w):
        x, b = layer.vectors[ids], layer.base[ids]
        s = (x @ w["query"] / 2) @ (x @ w["key"]).transpose(0, 2, 1) + w["place"][layer.back] + layer.mask
        s = np.exp(s - s.max(2, keepdims=True))
        z = b * w["scale"] + (s / s.sum(2, keepdims=True)) @ (x @ w["value"]) + w["shift"]
        z -= z.max(2, keepdims=True)
        logs = np.take_along_axis(z, want[..., None], 2)[..., 0] - np.log(np.exp(z).sum(2))
        return -logs[known].mean()

    for size in (1, 12):
        w = {k: v * size for k, v in layer.weights.items()}
        layer.weights = w
        product = np.zeros((5, 12))
        product[4, -1] = 1
        product[:4, :-1] = np.hstack([w["query"] / 2, w["key"], w["value"]])
        x = np.hstack([layer.vectors[ids.ravel()], np.ones((ids.size, 1))])
        with np.errstate(all="ignore"):
            got = layer._slopes(product, x, layer.base[ids.ravel()], want.ravel(), (known / known.sum()).ravel().astype(np.float32))
        for name in w:
            at = tuple(dice.integers(0, k) for k in w[name].shape)
            step = {k: v.copy() for k, v in w.items()}
            step[name][at] += 1e-5
            back = {k: v.copy() for k, v in w.items()}
            back[name][at] -= 1e-5
            assert got[name][at] == pytest.approx((loss(step) - loss(back)) / 2e-5, rel=2e-2, abs=2e-4), (size, name)

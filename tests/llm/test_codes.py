"""Tokenization automaton, piece table and vector codes against libraries, SQL-free definitions and brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from offerloom.llm import automaton, codebook, infill
from offerloom.llm.queries import QUERIES

tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def compiled():
    return automaton.Tokenizer(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_same_ids_as_the_library(compiled, library):
    dice = random.Random(3)
    ranges = [(32, 127), (0x80, 0x800), (0x3000, 0xA000), (0x1F300, 0x1FAFF), (9, 33)]
    texts = ["".join(chr(dice.randrange(*dice.choice(ranges))) for _ in range(120)) for _ in range(400)]
    texts += ["".join(dice.choice("abeinst'") for _ in range(200)) for _ in range(200)]
    texts += ["a" * 3000, "ab" * 1500, " " * 700 + "x", "é" * 300, "\x1c\x1f x", "\r\n\r\n\t\t", "it's we'll I'M", "", "\x00 a\x00b"]
    texts += ["a<|endoftext|>b <|endoftext|><|endoftext|> x", "<|endoftext", "ՠ֌x \U0003d000 1"]
    encode = compiled.encoder()
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(encode(text)) == want
        assert compiled.automaton.decode(want).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def merged(word, merges):
    """Merging by definition: the lowest rank first, the leftmost of equals."""
    parts = list(word)
    while True:
        ranks = [(merges[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]
        if not ranks:
            return parts
        _, i = min(ranks)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_of_random_merges(seed):
    """Small alphabets, where merges overlap themselves and each other, and some never apply."""
    dice = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    tokens, merges = list(letters), {}
    while len(merges) < 14:
        pair = (dice.choice(tokens), dice.choice(tokens))
        if "".join(pair) not in tokens:
            merges[pair] = len(merges)
            tokens.append("".join(pair))
    labels = [bytes([b]) for b in range(256)] + [t.encode() for t in tokens[len(letters) :]]
    number = {label: i for i, label in enumerate(labels)}
    triples = [(number[a.encode()], number[b.encode()], number[(a + b).encode()]) for a, b in merges]
    machine = automaton.MergeAutomaton(labels, triples)
    walk = machine.walker()
    for _ in range(400):
        word = "".join(dice.choice(letters) for _ in range(dice.randrange(1, 25)))
        assert [labels[i].decode() for i in walk(word.encode())] == merged(word, merges)


def test_refused_files(tmp_path):
    with pytest.raises(ValueError):
        automaton.MergeAutomaton([bytes([b]) for b in range(256)] + [b"ab"], [(97, 98, 256), (97, 98, 256)])
    with pytest.raises(ValueError):
        automaton.MergeAutomaton([bytes([b]) for b in range(256)] + [b"abc", b"ab"], [(257, 99, 256), (97, 98, 257)])
    with pytest.raises(ValueError):
        automaton.Tokenizer(tokenizers.path("word_bpe_49k.json"))


def test_automaton_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_automaton_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


EDGE = [(1, "Alpha beta\tgamma  "), (2, None), (3, ""), (4, " \n "), (5, "one"), (6, "x <P> y"), (7, "word " * 30_000), (8, "é　日 🙂"), (8, "é　日 🙂"), (None, "no id")]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "a", "b", "c", "d", 7) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, tokens string, output string, form string, n long").cache()


def test_automaton_edges(edge, library):
    rows = automaton.encode_documents(edge, VOCABULARY).collect()
    want = sorted((str(i), tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in EDGE)
    assert sorted((str(r["doc_id"]), tuple(r["tokens"]), r["decoded"]) for r in rows) == want
    assert all(ids_of(r["ids"]) == r["tokens"] and r["n_tokens"] == len(r["tokens"]) for r in rows)
    assert automaton.encode_documents(edge.where("false"), VOCABULARY).count() == 0


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def infilled(doc_id, text, rate=50):
    """The contract read out: cut, form, output."""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k * 8 : k * 8 + 8], 16) for k in range(4))
    if not text or any(s in text for s in infill.SENTINELS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), out


def test_infill_edges(edge):
    for rate in (50, 100):
        how = infill.Infill(rate=rate)
        arranged = infill.fill_in_middle(edge, how)
        got = collections.Counter((r["doc_id"], *(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output"))) for r in arranged.collect())
        assert got == collections.Counter((i, *infilled("" if i is None else i, t or "", rate)) for i, t in EDGE)
        back = infill.restore_documents(arranged, how).collect()
        assert sorted((str(r["doc_id"]), r["restored"]) for r in back) == sorted((str(i), t or "") for i, t in EDGE)
        assert all(r["restored_sha256"] == hashlib.sha256(r["restored"].encode()).hexdigest() for r in back)
    assert infill.restore_documents(infill.fill_in_middle(edge.where("false"))).count() == 0


def test_infill_random_texts():
    """All forms, hard texts around the sentinels, digests taken piece by piece."""
    dice, how, forms = random.Random(4), infill.Infill(rate=100), collections.Counter()
    for i in range(3000):
        text = "".join(dice.choice(["<", "P", ">", "<S", "M>", " ", "\n", "é", "word"]) for _ in range(dice.randrange(0, 14)))
        n, form, prefix, middle, table = how.apply(str(i), text.encode())
        assert (n, form, prefix, middle, table.bytes().decode()) == infilled(i, text, 100)
        assert table.digest() == hashlib.sha256(table.bytes()).hexdigest()
        assert how.restore(table.bytes(), form).bytes().decode() == text
        forms[form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 50
    for wrong in (("<P>", "<P>", "<M>"), ("<P>", "P", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.Infill(sentinels=wrong)


def test_masks_find_the_nearest():
    dice = np.random.default_rng(1)
    for count, dims, spread in ((256, 16, 300), (256, 2, 4), (70, 3, 5), (1, 5, 10), (256, 8, 1 << 28)):
        entries = dice.integers(-spread, spread + 1, (count, dims))
        entries[count // 2 :] = entries[: count - count // 2]  # equal entries: the lower number counts
        parts = np.r_[dice.integers(-2 * spread, 2 * spread + 1, (300, dims)), entries[:40]]
        found, away = codebook.MaskIndex(entries).nearest(parts)
        far = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (found == far.argmin(1)).all() and (away == far.min(1)).all()


def coded(rows):
    """Rounds over all rows, by definition; rows sorted by id."""
    whole = np.array([[math.floor(1024 * x) for x in v] for _, v, _ in rows])
    width = whole.shape[1] // 4
    cut = [whole[:, p * width : (p + 1) * width] for p in range(4)]
    books = [c[:256].copy() for c in cut]
    for last in (False, False, False, False, True):
        far = [((c[:, None] - b[None]) ** 2).sum(2) for c, b in zip(cut, books)]
        codes = [f.argmin(1) for f in far]
        for c, b, k in zip(cut, books, codes) if not last else ():
            for e in set(k.tolist()):
                b[e] = [int(s) // int((k == e).sum()) for s in c[k == e].sum(0)]
    error = sum(f.min(1) for f in far)
    per_label = collections.Counter()
    for (_, _, label), e in zip(rows, error):
        per_label[label] += int(e)
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k[r]:02x}" for k in codes), int(error[r]), per_label[label], sha) for r, (i, _, label) in enumerate(rows))


def test_codes_edges(spark):
    dice = random.Random(9)
    rows = [(i, [dice.gauss(0, 0.1) for _ in range(8)], dice.choice([1, 2, None])) for i in range(700)]
    rows += [(10, rows[3][1], 1), (701, rows[5][1], None), (None, rows[6][1], 2)]
    bad = [(5000, None, 1), (5001, [None, *rows[0][1][1:]], 1), (5002, [float("nan")] * 8, 1), (5003, [float("-inf"), *rows[0][1][1:]], 1)]
    odd = [(6000, [0.5] * 6, 3), (6001, [], 3)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows + bad + odd], "vec_id long, embedding array<double>, label int, vector string, error string")
    got = codebook.compress(table.repartition(5)).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = coded(rows)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got if r["code"]) == want
    assert sorted((r["vec_id"], r["error"], r["label_error"]) for r in got if not r["code"]) == [(6000, None, None), (6001, None, None)]
    assert codebook.compress(table.where("false")).count() == 0
    few = codebook.compress(table.where("vec_id < 3")).collect()
    assert sorted((r["code"], r["error"]) for r in few) == [("00000000", 0), ("01010101", 0), ("02020202", 0)]
    assert [r["code"] for r in codebook.compress(table.where("vec_id >= 6000")).collect()] == [None, None]


def test_codes_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()]
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in QUERIES["op13_vector_codes"](spark, sf_dir).collect())
    assert got == coded(rows)

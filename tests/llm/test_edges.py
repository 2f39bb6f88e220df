"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from offerloom.llm import bpe, decontaminate, exact, licenses, lm, neardup, quality, substring, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")

LONG = " ".join(f"word{i % 97}x{i}" for i in range(20_000))
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "one"),
    (7, LONG),
    (8, "é ü　日本語 \U0001f642 it's 42%%% !!!"),
    (8, "é ü　日本語 \U0001f642 it's 42%%% !!!"),
    (None, "no id here"),
]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, key string, tag string, sha string, id string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "key", None, "a", "b", "c", "d") for i, t in TEXTS]
    return spark.createDataFrame(rows, EXTRA).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, None, None), (None, 1, 1), (6, 1, 0), (7, 0, 1), (7, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted(((r["doc_id"] is None, r["doc_id"]) for r in rows), key=str)


ALL = sorted(((i is None, i) for i, _ in TEXTS), key=str)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers(docs, nothing, labels, score):
    rows = score(docs, labels).collect()
    assert ids(rows) == ALL
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert {r["score"] for r in score(docs, labels.where("false")).collect()} == {0.5}
    assert score(nothing, labels).count() == 0
    one = {r["score"] for r in score(docs, labels.where("doc_id in (1, 6)")).collect()}
    assert len(one) == 1 and (max(one) > 0.9 or min(one) < 0.1)


def test_archives(spark):
    page = "<p>" + "x" * 200 + "</p>"
    rows = [
        (1, "http://a/\r\nx y", page, 9), (2, None, page, 9), (3, "", None, 9), (4, "u", "", 9), (5, "u", "short", 9), (6, "u", "short", 9),
        (7, "u", "é\r\n\r\n" + "y" * 300_000, 9), (7, "u", page, 9), (1, "u", page, 9), (None, "u", page, 9),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.plan_records(pages), folder, archive_bytes=1000)
    got = sorted(warc.read_records(index, folder).collect(), key=str)
    assert len(got) == len(rows)
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"])) for r in got) == sorted(
        str((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest())) for i, _, h, _ in rows
    )
    kinds = sorted(str((r["page_id"], r["record_type"], r["refers_to"])) for r in got if r["payload_bytes"] == len(page))
    assert kinds == sorted(
        map(str, [(1, "response", None), (1, "response", None), (2, "revisit", 1), (7, "revisit", 1), (None, "response", None)])
    )
    one = index.where("page_id = 5")
    assert [bytes(r["payload"]) for r in warc.read_records(one, folder).collect()] == [b"short"]
    empty = warc.write_archives(warc.plan_records(pages.where("false")), folder)
    assert warc.read_records(empty, folder).count() == 0


def test_substring(spark, docs, nothing):
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(1, f"a {passage} b"), (2, f"{passage}"), (3, f"{passage} {passage}"), (None, f"z {passage}"), (4, " ".join(passage.split()[:12]))]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeated(some).collect()}
    assert got == {1: (15, 0, f"a {passage} b"), 2: (13, 13, ""), 3: (26, 26, ""), None: (14, 13, "z"), 4: (12, 0, rows[4][1])}
    again = substring.remove_repeated(docs).collect()
    assert ids(again) == ALL
    assert {r["doc_id"]: r["n_removed"] for r in again}[7] == 0
    assert substring.remove_repeated(nothing).count() == 0
    levels = {(r["doc_id"], r["length"]): r["n_windows"] for r in substring.repeated_passages(some).collect()}
    assert levels[1, 13] == 1 and levels[3, 13] == 2 and not [k for k in levels if k[1] > 13]


def test_exact(docs, nothing):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.find_duplicates(docs, bucket_entries=2).collect()}
    assert got[1] == (2, 2, False) and got[2] == (2, 2, True) and got[4] == (4, 2, True) and got[3] == (4, 2, False)
    assert got[8] == (8, 2, True) and got[None] == (None, 1, True)
    assert exact.find_duplicates(nothing).count() == 0
    stay = exact.drop_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(["2", "4", "5", "6", "7", "8", "None"])
    assert exact.drop_duplicates(nothing).count() == 0


def test_clashing_columns(spark):
    """Columns called as the operators call theirs come back as they were."""
    rows = [(1, "a b c", "x", "y", "z"), (2, "A b c", "p", "q", "r"), (3, "other", "s", "t", "u"), (3, "other", "s", "t", "u")]
    some = spark.createDataFrame(rows, "doc_id long, text string, __key string, __id string, __sha string")
    for drop, left in ((exact.drop_duplicates, [2, 3]), (neardup.drop_near_duplicates, [1, 3, 3])):
        stay = drop(some)
        assert stay.columns == some.columns
        assert sorted(map(tuple, stay.collect())) == sorted(r for k, r in enumerate(rows) if r[0] in left and (k < 3 or left.count(3) == 2))


def test_language_model(docs, nothing):
    rows = lm.score_texts(docs, RANKS, tokenizers.PATTERN).collect()
    assert ids(rows) == ALL
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert lm.score_texts(nothing, RANKS, tokenizers.PATTERN).count() == 0
    alone = lm.score_texts(docs.where("crc32(cast(doc_id as string)) % 7 = 2"), RANKS, tokenizers.PATTERN).collect()
    assert {r["train_tokens"] for r in alone} <= {0}


def test_decontamination(spark, docs, nothing):
    items = [(1, TEXTS[0][1]), (1, TEXTS[0][1]), (2, None), (3, ""), (None, "one"), (4, "ONE!"), (5, "日本語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):
        got = {r["doc_id"]: r for r in decontaminate.find_passages(docs, bench, automaton_bytes=block).collect()}
        assert (got[2]["n_hit"], got[2]["items"], got[6]["items"]) == (15, ["1"], ["4"])
        assert [TEXTS[7][1][s["start"] : s["end"]] for s in got[8]["spans"]] == []
        assert not got[7]["contaminated"] and not got[3]["contaminated"] and got[3]["n_words"] == 0
        clean = decontaminate.drop_contaminated(docs, bench, automaton_bytes=block)
        assert clean.columns == docs.columns
        assert ids(clean.collect()) == [x for x in ALL if x[1] not in (1, 2, 6)]
    assert decontaminate.find_passages(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.find_passages(nothing, bench).count() == 0


def test_near(spark, docs, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.find_groups(docs, size=2).collect()}
    assert got[1] == (14, 1, True) and got[2] == (14, 1, False) and got[6] == (1, 6, True)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[8][1:] == (8, True) and got[None][1:] == (None, True)
    assert neardup.find_groups(nothing).count() == 0
    assert neardup.drop_near_duplicates(docs).columns == docs.columns
    assert ids(neardup.drop_near_duplicates(docs).collect()) == [x for x in ALL if x[1] != 2]


def test_licenses(spark, docs, nothing):
    texts = {
        1: "Released under the MIT License. Apache License",
        2: "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\nGeneral Public License",
        3: "SPDX-License-Identifier: MIT AND (",
        4: None,
        5: "",
    }
    some = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(some).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 3, 5, "apache,mit")
    assert got[2]["labels"] == "apache-2.0,gpl,gpl-2.0 with classpath-exception-2.0,mit"
    assert (got[3]["labels"], got[3]["score"], got[3]["n_base"], got[3]["first_word"]) == ("mit", 0.5, 0, None)
    assert (got[4]["n_words"], got[4]["labels"], got[4]["score"], got[5]["labels"]) == (0, "", 0.0, "")
    assert ids(licenses.scan_licenses(docs).collect()) == ALL
    assert licenses.scan_licenses(nothing).count() == 0


def test_expressions():
    assert licenses.to_postfix("a or b and c with d".split()) == "a b c d with and or".split()
    assert licenses.to_postfix("( a or b ) and c".split()) == "a b or c and".split()
    assert licenses.evaluate(["mit", "and", "own"]) == ({"mit", "own"}, 0.5)
    assert licenses.evaluate(["mit", "or", "own"])[1] == 1.0
    assert licenses.evaluate(["and", "mit"]) == ({"mit"}, 0.5)
    assert licenses.evaluate([]) == (set(), 0.0)


def test_bpe(docs, nothing, spark):
    codec = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    hard = ["a" * 500, " " * 300 + "x", "ab" * 300, "é" * 200, "\x00\x00 a\x00b", "\x1c\x1f x", "​ \u0085 z", "===" * 100, "\r\n\r\n\t\t"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    want = {i: t or "" for i, t in [*TEXTS, *[(100 + i, t) for i, t in enumerate(hard)]]}
    rows = bpe.encode_documents(docs.select("doc_id", "text").unionByName(more), RANKS).collect()
    assert len(rows) == len(TEXTS) + len(hard)
    for r in rows:
        tokens = codec.encode_ordinary(want[r["doc_id"]])
        assert r["tokens"] == tokens and r["ids"] == ",".join(map(str, tokens))
        assert bytes(r["decoded"]).decode() == want[r["doc_id"]]
    assert bpe.encode_documents(nothing, RANKS).count() == 0
    listed = {r["doc_id"]: r["tokens"] for r in bpe.encode_documents(more, RANKS).collect()}
    assert {r["doc_id"]: r["tokens"] for r in bpe.encode_documents(more, RANKS, words=1).collect()} == listed


def test_stages(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns
        assert got.where("doc_id = 7").count() == 1
        assert stage(spark, docs.where(F.lit(False)), sf_dir).count() == 0
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == len(TEXTS)


def test_fit_and_pair_counts_leave_nothing_out(spark, monkeypatch):
    """Only the windows of all training texts are fitted, from the same start; pairs that no worker holds count all the same."""
    texts = [f"unbelievable wonderfulness {chr(97 + i % 26) * 3}ification reorganisations number{i}" for i in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[5]), (None, None)], "doc_id long, text string").coalesce(1)  # the fit follows the order of the texts
    fitted, fit_on = [], lm._fit_on

    def watched(rows, subwords, classes, attention):
        fitted.append(({r[0] for r in rows.select("text").collect()}, attention.weights["value"].copy()))
        return fit_on(rows, subwords, classes, attention)

    monkeypatch.setattr(lm, "_fit_on", watched)
    columns = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def scores():
        return sorted(lm.score_texts(docs, RANKS, tokenizers.PATTERN).select(*columns).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    whole = scores()
    monkeypatch.setattr(lm, "INNER_PAIRS", 7)
    few = scores()
    assert len(whole) == len(texts) + 3
    assert [r[:4] for r in few] == [r[:4] for r in whole]
    assert [r[4] for r in few] == pytest.approx([r[4] for r in whole], rel=1e-6)
    learns = {"" if t is None else t for i, t in [*enumerate(texts), (None, texts[5]), (None, None)] if i is None or zlib.crc32(str(i).encode()) % 7 != 2}
    classes = lm.CLASSES
    fresh = lm.Attention(np.zeros((2, classes)), np.zeros((2, lm.WIDTH))).weights["value"]
    for seen, start in fitted:
        assert seen == learns and np.array_equal(start, fresh)


def test_every_training_text_is_learnt_from(spark):
    """One text of a corpus changes the attention weights, whichever it is; pair counts are those of all texts."""
    subwords = lm.Subwords(lm.load_ranks(RANKS), tokenizers.PATTERN)
    n = subwords.end + 1
    dice = np.random.default_rng(4)
    layer = lm.Attention(dice.standard_normal((n, lm.CLASSES)), dice.standard_normal((n, lm.WIDTH)))
    classes = np.arange(n) % lm.CLASSES
    texts = ["one small step", "another text of some words", "the last one"]
    for text in texts:
        fitted = lm._fit_on(spark.createDataFrame([(text,)], "text string"), subwords, classes, layer)
        assert not np.array_equal(fitted.weights["value"], layer.weights["value"])
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    shared = spark.sparkContext.broadcast(subwords)
    found = rows.mapInArrow(lm._corpus_counts(shared), "kind int, cell long, n long").where("kind = 0").groupBy("cell").agg(F.sum("n").alias("n"))
    ids, sizes, goes_on = subwords.of([lm.words_of(t.encode()) for t in texts])
    before = np.roll(ids, 1)
    before[np.cumsum(sizes) - sizes] = n - 1
    want = collections.Counter(((before * np.int64(n) + ids) * 2 + goes_on).tolist())
    assert {r["cell"]: r["n"] for r in found.collect()} == want
    after, ahead = lm._by_group(found, classes, lm.CLASSES)
    assert after.sum() == ahead.sum() == len(ids)
    assert all(after[classes[b], i] and ahead[b, classes[i]] for b, i in zip(before, ids, strict=True))


def test_texts_are_cut_into_ids_once(spark):
    """Ids kept beside the text give back what the text gives."""
    subwords = lm.Subwords(lm.load_ranks(RANKS), tokenizers.PATTERN)
    texts = ["", "One small step  for   x　y 'sx", "word " * 50, "中文 текст 12!"]
    rows = spark.createDataFrame([(i, 0, True, t) for i, t in enumerate(texts)], "doc_id long, tag long, learns boolean, text string").coalesce(1)
    kept = rows.mapInArrow(lm._tokeniser(spark.sparkContext.broadcast(subwords)), lm.TOKENS).orderBy("doc_id").toArrow()
    column = kept.column("ids").combine_chunks()
    want = subwords.of([lm.words_of(t.encode()) for t in texts])
    (a, b, *got), = lm.told_ids(subwords, column)
    assert (a, b) == (0, len(texts)) and kept.column("text").to_pylist() == texts
    assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))

"""Registered queries over the small tables, against SQL, brute force or held-out labels."""

import collections
import hashlib
import math
import re
import sys
import zlib
from pathlib import Path

import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

from check_oracles import duck, rows_of  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from offerloom.llm import bpe, decontaminate, licenses  # noqa: E402
from offerloom.llm.common import table  # noqa: E402
from offerloom.llm.queries import ORACLES, QUERIES  # noqa: E402

tokenizers = pytest.importorskip("public_tokenizers")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_items_without_id(spark, tmp_path):
    """Their passages are hit as the SQL says; only the list of items has no place for them."""
    duckdb = pytest.importorskip("duckdb")
    words = " ".join(f"w{i}" for i in range(14))
    spark.createDataFrame([(1, f"a {words} b"), (2, f"{words} p q r"), (3, "p q r"), (4, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, words), (7, "p q r"), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    df = QUERIES["op7_decontamination"](spark, str(tmp_path))
    cur = con.execute(ORACLES["op7_decontamination"])
    got = [tuple(r) for r in df.collect()]
    assert rows_of(df.columns, got) == rows_of([c[0] for c in cur.description], cur.fetchall())
    assert sorted((r[0], r[2], r[3]) for r in got) == [(1, 14, 0), (2, 17, 1), (3, 3, 1), (4, 0, 0)]
    kept = decontaminate.drop_contaminated(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "benchmark"))
    assert [r["doc_id"] for r in kept.collect()] == [4]


@pytest.mark.parametrize(("name", "label", "folds", "fold", "least"), [("op1_quality", "quality", 4, 2, 0.9), ("op2_toxicity", "toxic", 3, 1, 0.85)])
def test_held_out(spark, name, label, folds, fold, least):
    sf_dir = "/root/testdata/sf0.1"
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
    judged = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in judged) / len(judged) > least


def test_language_model(spark, sf_dir, texts):
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(UPPER)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = collections.Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, kinds = sum(counts.values()), len(counts)
    for r in QUERIES["op6_lm_score"](spark, sf_dir).collect():
        mine = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(mine), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in mine)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + kinds + 1)) for w in mine), rel=1e-9)
        assert r["score"] < 0


def test_language_model_beats_the_word_model(spark):
    """Texts it has not learnt from, on the largest of the small tables."""
    rows = [r for r in QUERIES["op6_lm_score"](spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.8 * len(rows)


def base_places(words):
    out = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        want = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return out


def test_licenses(spark, sf_dir, texts):
    for r in QUERIES["op9_licenses"](spark, sf_dir).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(UPPER))
        places = base_places(words)
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert {x for x in r["base_labels"].split(",") if x} <= set(r["labels"].split(","))
        text = f" {' '.join(words)} "
        named = {label for notice, (label, _) in licenses.NOTICES.items() if f" {notice} " in text}
        if licenses.TAG not in text:
            assert {x for x in r["labels"].split(",") if x} == named | {label for _, label in places}


def test_bpe(spark, sf_dir, texts):
    ranks = bpe.load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = QUERIES["op10_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = codec.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def shingles(text, size=5):
    words = text.translate(UPPER)
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def test_pipeline(spark, sf_dir, texts):
    """Every stage on what the one before kept, against brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = dict(texts)
    toxic = {r["doc_id"] for r in QUERIES["op2_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    kept = {k: t for k, t in kept.items() if k not in toxic}
    groups = collections.defaultdict(list)
    for k, t in kept.items():
        groups[t.translate(UPPER)].append(k)
    kept = {max(g): kept[max(g)] for g in groups.values()}
    sets, comp = {k: shingles(t) for k, t in kept.items()}, {k: k for k in kept}
    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    common = collections.Counter((a, b) for ks in holders.values() for a in ks for b in ks if a < b)

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((root(a), root(b)))
            comp[high] = low
    kept = {k: t for k, t in kept.items() if root(k) == k}
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(UPPER))
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()

    def clean(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(UPPER))
        return not any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words)))

    kept = {k: t for k, t in kept.items() if clean(t)}
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in kept.items()}
    assert 0 < len(got) < docs.count()

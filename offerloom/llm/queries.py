"""Queries over the operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import automaton, bpe, codebook, decontaminate, exact, infill, licenses, lm, neardup, quality, substring, toxicity, warc
from offerloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can say the same, its oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op5_exact_dedup",
    f"""WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)""",
)
def op5_exact_dedup(spark, sf_dir):
    found = exact.find_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op3_warc",
    """WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
    FROM m""",
)
def op3_warc(spark, sf_dir):
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), folder)
    records = warc.read_records(index, folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CONTRACT_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op7_decontamination",
    f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {CONTRACT_WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {CONTRACT_WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark),
    cut AS (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
    win AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM cut),
    places AS (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
    hits AS (SELECT rid, i, p.n, item FROM places p JOIN win ON win.n = p.n AND win.w = array_to_string(ws[i:i + p.n - 1], ' ')),
    hit_words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rid),
    hit_items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)""",
)
def op7_decontamination(spark, sf_dir):
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op9_licenses")
def op9_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("notices")


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), path)
    return encoded.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op1_quality")
def op1_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SPACED_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


@query(
    "op4_substring_dedup",
    f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SPACED_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
    starts AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
    windows AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM starts),
    lowest AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
    hit AS (SELECT DISTINCT rid, i + k AS pos FROM windows JOIN lowest USING (w), range(13) AS r(k) WHERE doc_id > low),
    words AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
    kept AS (SELECT rid, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS joined FROM words ANTI JOIN hit USING (rid, pos) GROUP BY rid)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (rid)""",
)
def op4_substring_dedup(spark, sf_dir):
    return substring.remove_repeated(table(spark, sf_dir, "documents")).drop("kept")


@query(
    "op8_near_dedup",
    f"""WITH RECURSIVE d AS (SELECT doc_id, {SPACED_WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, b FROM reach JOIN edges ON a = other),
    comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM comp LEFT JOIN n USING (doc_id)""",
)
def op8_near_dedup(spark, sf_dir):
    return neardup.find_groups(table(spark, sf_dir, "documents"), size=2)


@query("op6_lm_score")
def op6_lm_score(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return lm.score_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op11_automaton_bpe")
def op11_automaton_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = automaton.encode_documents(table(spark, sf_dir, "documents"), path, listed=False)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(
    "op12_fill_in_middle",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us FROM documents),
    c AS (SELECT doc_id, text, us, CAST(len(us) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
    f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
          WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
    p AS (SELECT doc_id, text, n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
    FROM p""",
)
def op12_fill_in_middle(spark, sf_dir):
    arranged = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return infill.restore_documents(arranged, with_text=False)


def _codebook_sql(rounds: int = codebook.ROUNDS) -> str:
    """Assignments and means round by round.  Part distance is x.x - 2 x.c + c.c, whole numbers below 2^53."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT rid, x.p AS p, any_value(x.x) AS x,
            min(CAST(list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) * 256 + c.e) AS best
          FROM parts x JOIN book{k} c ON x.p = c.p GROUP BY rid, x.p)"""
        )
        if k < rounds:
            steps.append(
                f"""mean{k + 1} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (
            SELECT p, best % 256 AS e, i, floor(sum(v) / count(*)) AS m FROM (
              SELECT p, best, unnest(x) AS v, unnest(range(len(x))) AS i FROM near{k}) GROUP BY ALL) GROUP BY p, e),
          book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k + 1} m ON m.p = b.p AND m.e = b.e)"""
            )
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      size AS (SELECT len(v) // 4 AS w FROM kept ORDER BY vec_id LIMIT 1),
      parts AS MATERIALIZED (SELECT rid, p, v[p * w + 1 : p * w + w] AS x FROM kept, size, range(4) r(p)),
      firsts AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 256),
      book0 AS MATERIALIZED (SELECT p, e, x FROM parts JOIN firsts USING (rid)),
      {", ".join(steps)},
      coded AS (SELECT rid, string_agg(lpad(hex(CAST(best % 256 AS BIGINT)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error
        FROM near{rounds} GROUP BY rid),
      said AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (rid), said"""


@query("op13_vector_codes", _codebook_sql())
def op13_vector_codes(spark, sf_dir):
    return codebook.compress(table(spark, sf_dir, "embeddings"))

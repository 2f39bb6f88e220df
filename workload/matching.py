"""Entity resolution: parts against a catalogue of part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import cluster, match
from offerloom.sources.tables import spread
from workload.base import query, sql_round, table
from workload.scalars import GTIN_SQL, SKU_SQL, sql_brand, sql_model, sql_tokens

# Candidates: every part under a noisy name.  Catalogue: parts under a cleaner one.
CAND_MODEL = (
    "concat(p_name, ' ', p_type, CASE WHEN p_size % 3 = 0 THEN ' Running Shoes' WHEN p_size % 3 = 1 THEN concat(' ', cast(p_size % 7 as string)) ELSE ' v2' END)"
)
CAND_BRAND = "CASE WHEN p_size % 4 > 0 THEN p_brand END"
CAND_SKU = "CASE WHEN p_partkey % 5 = 0 THEN concat('k-', cast(p_partkey % 400 as string)) END"
CAND_GTIN = "CASE WHEN p_partkey % 7 = 0 THEN concat('77', cast(p_partkey % 300 as string)) END"
SHOE_MODEL = "concat(p_type, ' ', p_name, CASE WHEN p_size % 2 = 0 THEN concat('-', cast(p_size % 7 as string)) ELSE '' END)"
SHOE_SKU = "CASE WHEN p_partkey % 3 = 0 THEN concat('K', cast(p_partkey % 500 as string)) END"
SHOE_GTIN = "CASE WHEN p_partkey % 4 = 0 THEN concat('77-', cast(p_partkey % 250 as string)) END"
KIND = "CASE WHEN p_size % 5 = 0 THEN 'trail' ELSE 'running' END"


def candidates(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("cand_id"),
        F.expr(CAND_BRAND).alias("brand"),
        F.expr(CAND_MODEL).alias("model"),
        F.expr(KIND).alias("category"),
        F.expr(CAND_SKU).alias("sku"),
        F.expr(CAND_GTIN).alias("gtin"),
    )


def catalog(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("shoe"), F.col("p_partkey").cast("string")).alias("shoe_id"),
        F.col("p_brand").alias("brand"),
        F.replace(F.lower(F.expr(SHOE_MODEL)), F.lit(" "), F.lit("-")).alias("model"),
        F.expr(KIND).alias("category"),
        F.expr(SHOE_SKU).alias("sku"),
        F.expr(SHOE_GTIN).alias("gtin"),
    )


def _ids_sql(sku: str, gtin: str) -> str:
    return (
        f"{SKU_SQL.replace('raw', f'({sku})')} AS sku, "
        + GTIN_SQL.replace("digits", f"nullif(regexp_replace(({gtin}), '[^0-9]', '', 'g'), '')")
        + " AS gtin"
    )


SIDES_SQL = f"""cand AS (SELECT p_partkey AS cand_id, {sql_brand(f'({CAND_BRAND})')} AS brand, {KIND} AS category,
    list_distinct({sql_tokens(sql_model(CAND_MODEL))}) AS a, {_ids_sql(CAND_SKU, CAND_GTIN)} FROM part),
  shoes AS (SELECT p_partkey AS ord, 'shoe' || p_partkey AS shoe_id, p_brand AS brand, {KIND} AS category,
    list_distinct({sql_tokens(f"replace(lower({SHOE_MODEL}), ' ', '-')")}) AS b, {_ids_sql(SHOE_SKU, SHOE_GTIN)} FROM part)"""
EXACT_SQL = """exact AS (SELECT cand_id, min(ord) AS ord FROM (
    SELECT cand_id, ord FROM cand JOIN shoes ON cand.sku = shoes.sku
    UNION ALL SELECT cand_id, ord FROM cand JOIN shoes ON cand.gtin = shoes.gtin) GROUP BY cand_id)"""
# Every pair of a block, scored: the plain definition.
SCORED_SQL = f"""scored AS (SELECT cand_id, c.brand IS NOT NULL AS branded, shoe_id, ord,
    {sql_round('(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))))', 2)} AS score
  FROM cand c JOIN shoes s ON c.category = s.category AND (c.brand IS NULL OR c.brand = s.brand))"""


@query("match_exact", f"WITH {SIDES_SQL}, {EXACT_SQL} SELECT cand_id, 'shoe' || ord AS shoe_id, ord FROM exact")
def match_exact(spark, d):
    return match.match_exact(candidates(spark, d), catalog(spark, d))


@query(
    "match_fuzzy",
    f"""WITH {SIDES_SQL}, c AS (SELECT coalesce('=' || brand || '/' || category, '*/' || category) AS block, list_sort(a) AS a, count(*) AS candidates FROM cand GROUP BY ALL),
      s AS (SELECT block, b, count(*) AS shoes FROM (SELECT '=' || brand || '/' || category AS block, list_sort(b) AS b FROM shoes UNION ALL SELECT '*/' || category, list_sort(b) FROM shoes) GROUP BY ALL),
      p AS (SELECT *, {sql_round('(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))))', 2)} AS score FROM c JOIN s USING (block))
      SELECT block, array_to_string(a, ' ') AS cand_tokens, array_to_string(b, ' ') AS shoe_tokens, score, candidates, shoes FROM p
      WHERE score >= CASE WHEN block LIKE '=%' THEN 0.56e0 ELSE 0.64e0 END""",
)
def match_fuzzy(spark, d):
    return match.match_fuzzy(candidates(spark, d), catalog(spark, d))


@query(
    "match_resolve",
    f"""WITH {SIDES_SQL}, {EXACT_SQL}, {SCORED_SQL},
      placed AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0e0) AS runner_up FROM scored
        WINDOW w AS (PARTITION BY cand_id ORDER BY score DESC, ord)),
      fuzzy AS (SELECT cand_id, shoe_id, score FROM placed WHERE rn = 1 AND score >= CASE WHEN branded THEN 0.6e0 ELSE 0.72e0 END
        AND score - runner_up >= CASE WHEN branded THEN 0.04e0 ELSE 0.08e0 END)
      SELECT c.cand_id, coalesce('shoe' || e.ord, f.shoe_id) AS shoe_id,
        CASE WHEN e.ord IS NOT NULL THEN 1e0 ELSE coalesce(f.score, 0e0) END AS confidence,
        CASE WHEN e.ord IS NOT NULL THEN 'exact-id' WHEN f.shoe_id IS NOT NULL THEN 'model-fallback' ELSE 'none' END AS reason
      FROM cand c LEFT JOIN exact e USING (cand_id) LEFT JOIN fuzzy f USING (cand_id)""",
)
def match_resolve(spark, d):
    return match.resolve_matches(candidates(spark, d), catalog(spark, d))


# One offer a step, as the definition says; ``p`` is the list of products founded so far.
ALIKE_SQL = sql_round("(len(list_intersect(e.words, words))::DOUBLE / len(list_distinct(list_concat(e.words, words))))", 2)
CLUSTER_SQL = f"""WITH RECURSIVE named AS (SELECT *, {sql_model(CAND_MODEL)} AS model FROM part),
  o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_partkey AS ord, {CAND_BRAND} AS brand, model, {KIND} AS category,
    list_distinct({sql_tokens('model')}) AS words, {_ids_sql(CAND_SKU, CAND_GTIN)} FROM named),
  run AS (SELECT 0::BIGINT AS n, 0::BIGINT AS ord, ''::VARCHAR AS shoe_id, ''::VARCHAR AS reason, 0e0::DOUBLE AS confidence,
      []::STRUCT(id VARCHAR, brand VARCHAR, words VARCHAR[], category VARCHAR, sku VARCHAR, gtin VARCHAR)[] AS p
    UNION ALL
    SELECT n, ord, shoe_id, reason, confidence,
      CASE WHEN reason = 'none' THEN list_append(p, {{'id': shoe_id, 'brand': coalesce(brand, 'Unknown'), 'words': words, 'category': category, 'sku': sku, 'gtin': gtin}})
        WHEN sku IS NULL AND gtin IS NULL THEN p
        ELSE list_transform(p, lambda e: CASE WHEN e.id = shoe_id THEN {{'id': e.id, 'brand': e.brand, 'words': e.words, 'category': e.category,
          'sku': coalesce(e.sku, sku), 'gtin': coalesce(e.gtin, gtin)}} ELSE e END) END
    FROM (SELECT *, CASE WHEN exact IS NOT NULL THEN 'exact-id' WHEN named IS NOT NULL THEN 'model-fallback' ELSE 'none' END AS reason,
        CASE WHEN exact IS NOT NULL THEN 1e0 WHEN named IS NOT NULL THEN top[1] ELSE 0e0 END AS confidence,
        coalesce(exact, named, 'shoe_' || substr(sha1(coalesce(brand, 'unknown') || '|' || model || '|' || category || '|' || coalesce(sku, '') || '|' || coalesce(gtin, '') || '|'), 1, 12)) AS shoe_id
      FROM (SELECT *, CASE WHEN top[1] >= CASE WHEN brand IS NULL THEN 0.72e0 ELSE 0.6e0 END
            AND top[1] - coalesce(top[2], 0e0) >= CASE WHEN brand IS NULL THEN 0.08e0 ELSE 0.04e0 END
          THEN list_filter(rivals, lambda x: x.score = top[1])[1].id END AS named
        FROM (SELECT *, list_reverse_sort(list_transform(rivals, lambda x: x.score))[1:2] AS top
          FROM (SELECT o.*, p, list_filter(p, lambda e: coalesce(e.sku = sku, false) OR coalesce(e.gtin = gtin, false))[1].id AS exact,
              list_transform(list_filter(p, lambda e: e.category = category AND (brand IS NULL OR e.brand = brand)),
                lambda e: {{'id': e.id, 'score': CASE WHEN len(words) = 0 OR len(e.words) = 0 THEN 0e0 ELSE {ALIKE_SQL} END}}) AS rivals
            FROM run JOIN o ON o.n = run.n + 1)))))
  SELECT ord, shoe_id, reason AS match_reason, confidence AS match_confidence FROM run WHERE n > 0"""


@query("cluster_offers", CLUSTER_SQL)
def cluster_offers(spark, d):
    """Ordered clustering, beside a query that takes the offers one by one."""
    from offerloom.functions.ids import norm_gtin, norm_sku
    from offerloom.functions.names import norm_model

    offers = spread(candidates(spark, d)).select(
        F.col("cand_id").alias("ord"), "brand", norm_model("model").alias("model"), "category",
        norm_sku("sku").alias("sku"), norm_gtin("gtin").alias("gtin"),
    )
    return cluster.cluster_offers(offers).select("ord", "shoe_id", "match_reason", "match_confidence")

"""Contracts, foreign keys and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import validate
from offerloom.operators.rollup import table_counts
from workload.base import query, sql_round, table

BAD = {
    "offer_id": "CASE WHEN l_linenumber = 1 THEN '' ELSE 'o' END",
    "retailer_id": "CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE 's' END",
    "url": "CASE WHEN l_linenumber = 2 THEN 'not a url' ELSE 'https://a.example.com/x' END",
    "title_raw": "'t'",
    "model_normalized": "CASE WHEN l_partkey % 90 = 0 THEN '' ELSE 'm' END",
    "gender": "CASE WHEN l_linenumber = 3 THEN 'other' WHEN l_linenumber = 4 THEN 'kids' END",
    "category": "CASE WHEN l_returnflag = 'A' THEN 'running' WHEN l_returnflag = 'R' THEN 'road' END",
    "price_current": "l_extendedprice - 2000e0",
    "price_original": "CASE WHEN l_linenumber = 5 THEN -1e0 END",
    "discount_pct": "l_discount * 1050e0",
    "in_stock": "CASE WHEN l_linenumber = 6 THEN NULL ELSE true END",
    "scraped_at": "CASE WHEN l_quantity > 45 THEN NULL ELSE l_shipdate END",
    "source_confidence": "l_tax * 14e0",
}
LI_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "contract_violations",
    f"""SELECT {LI_KEY}, concat_ws('|', CASE WHEN offer_id IS NULL OR offer_id = '' THEN 'offer_id:non-empty' END, CASE WHEN retailer_id IS NULL THEN 'retailer_id:non-empty' END,
        CASE WHEN NOT regexp_matches(url, '^[a-z]+:[^ ]+$') THEN 'url:url' END, CASE WHEN model_normalized = '' THEN 'model_normalized:non-empty' END,
        CASE WHEN gender NOT IN ('men', 'women', 'unisex', 'kids') THEN 'gender:one-of' END, CASE WHEN category IS NULL OR category NOT IN ('running', 'trail') THEN 'category:one-of' END,
        CASE WHEN price_current < 0 THEN 'price_current:range' END, CASE WHEN price_original < 0 THEN 'price_original:range' END, CASE WHEN discount_pct < 0 OR discount_pct > 100 THEN 'discount_pct:range' END,
        CASE WHEN in_stock IS NULL THEN 'in_stock:required' END, CASE WHEN scraped_at IS NULL THEN 'scraped_at:required' END, CASE WHEN source_confidence > 1 THEN 'source_confidence:range' END) AS violations
      FROM (SELECT {LI_KEY}, {', '.join(f'{e} AS {n}' for n, e in BAD.items())} FROM lineitem)""",
)
def contract_violations(spark, d):
    rows = table(spark, d, "lineitem").select(*LI_KEY.split(", "), *[F.expr(e).alias(n) for n, e in BAD.items()])
    checked = validate.CONTRACTS["offers"].report(rows)
    return checked.select(*LI_KEY.split(", "), F.array_join("violations", "|").alias("violations"))


@query(
    "fk_check",
    """SELECT 'offer->retailer' AS check_name, CAST(k AS VARCHAR) AS missing_key, count(*) AS child_rows FROM (SELECT l_suppkey + l_linenumber AS k FROM lineitem)
        WHERE k NOT IN (SELECT s_suppkey FROM supplier) GROUP BY ALL
      UNION ALL SELECT 'deal->shoe', CAST(2 * l_partkey AS VARCHAR), count(DISTINCT l_partkey) FROM lineitem WHERE 2 * l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY ALL
      UNION ALL SELECT 'deal->offer', CAST(o AS VARCHAR), count(*) FROM (SELECT l_partkey, max(l_orderkey) + 1 AS o FROM lineitem GROUP BY 1)
        WHERE o NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL""",
)
def fk_check(spark, d):
    li = table(spark, d, "lineitem")
    # Keys that are shifted against their parents' keys, so that some have none.
    offers = li.select((F.col("l_suppkey") + F.col("l_linenumber")).alias("retailer_id"))
    known = li.select(F.col("l_orderkey").alias("offer_id")).distinct()
    deals = li.groupBy((2 * F.col("l_partkey")).alias("shoe_id")).agg((F.max("l_orderkey") + 1).alias("best_offer_id"))
    retailers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("retailer_id"))
    shoes = table(spark, d, "part").select(F.col("p_partkey").alias("shoe_id"))
    return (
        validate.orphans(offers, "retailer_id", retailers, "retailer_id", "offer->retailer")
        .unionByName(validate.orphans(deals, "shoe_id", shoes, "shoe_id", "deal->shoe"))
        .unionByName(validate.orphans(deals, "best_offer_id", known, "offer_id", "deal->offer"))
    )


@query(
    "label_fk",
    """SELECT 'label->document' AS check_name, CAST(2 * doc_id AS VARCHAR) AS missing_key, count(*) AS child_rows FROM labels
      WHERE 2 * doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY ALL
      UNION ALL SELECT 'order->customer', CAST(2 * o_custkey AS VARCHAR), count(*) FROM orders WHERE 2 * o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY ALL""",
)
def label_fk(spark, d):
    labels = table(spark, d, "labels").select((2 * F.col("doc_id")).alias("doc_id"))
    orders = table(spark, d, "orders").select((2 * F.col("o_custkey")).alias("o_custkey"))
    return validate.orphans(labels, "doc_id", table(spark, d, "documents"), "doc_id", "label->document").unionByName(
        validate.orphans(orders, "o_custkey", table(spark, d, "customer"), "c_custkey", "order->customer")
    )


@query(
    "count_reconcile",
    """WITH a AS (SELECT 'offers' AS table_name, count(*) AS n FROM lineitem UNION ALL SELECT 'shoes', count(*) FROM part UNION ALL SELECT 'deals', count(DISTINCT l_partkey) FROM lineitem),
      e AS (SELECT 'offers' AS table_name, count(*) AS n FROM lineitem UNION ALL SELECT 'shoes', count(*) FROM customer UNION ALL SELECT 'extra', count(*) FROM region)
      SELECT table_name, e.n AS expected_count, a.n AS actual_count FROM e FULL JOIN a USING (table_name) WHERE e.n IS DISTINCT FROM a.n""",
)
def count_reconcile(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    actual = table_counts({"offers": li, "shoes": part, "deals": li.select("l_partkey").distinct()})
    expected = table_counts({"offers": li, "shoes": table(spark, d, "customer"), "extra": table(spark, d, "region")})
    return validate.count_reconcile(expected, actual)


RATE_SQL = sql_round("(avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END))", 4)


@query(
    "report_reconcile",
    f"""WITH r AS (SELECT {RATE_SQL} AS x FROM lineitem) SELECT 'aggregate_recall' AS figure, x AS in_metadata, x + 0.5e0 AS in_report FROM r
      UNION ALL SELECT 'fixture_usage_threshold', NULL, 0.1e0""",
)
def report_reconcile(spark, d):
    from offerloom.functions.money import js_round

    rate = table(spark, d, "lineitem").agg(
        js_round(F.avg(F.when(F.col("l_returnflag") == "R", F.lit(1.0)).otherwise(F.lit(0.0))), 4).alias("x")
    )
    x = F.col("x")
    metadata = rate.select(x.alias("aggregate_recall"), x.alias("fixture_usage_rate"), F.lit(None).cast("double").alias("fixture_usage_threshold"))
    report = rate.select((x + 0.5).alias("aggregate_recall"), x.alias("fixture_usage_rate"), F.lit(0.1).alias("fixture_usage_threshold"))
    return validate.report_reconcile(metadata, report)


@query(
    "duplicate_ids",
    "SELECT 'lines' AS table_name, l_orderkey || '-' || l_linenumber AS key, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_ids(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return validate.duplicate_keys(rows, "id", "lines")

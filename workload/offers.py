"""Offer pipeline, rollups, search and ranking over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import labels
from offerloom.functions.names import decide_category
from offerloom.operators import classify, dedupe, overrides, rollup, search
from offerloom.plans import ingest
from offerloom.sources.tables import union_sources
from workload.base import (
    DEALS_SQL,
    HEALTH_SQL,
    OFFERS_SQL,
    PRODUCTS_SQL,
    RETAILERS_SQL,
    SEQ,
    SEQ_SQL,
    health_view,
    offers_view,
    products_view,
    query,
    quoted,
    retailers_view,
    spread_table,
    sql_discount,
    sql_id,
    sql_round,
    sql_token,
    sql_ts,
    table,
    titled_offers,
    ts_text,
)
from workload.scalars import SKU_SQL, sql_brand, sql_model



@query("src_load", f"SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_load(spark, d):
    from offerloom.sources.tables import load_table

    nation = load_table(spark, f"{d}/nation.parquet", schema="n_nationkey int, n_name string, n_regionkey int")
    region = load_table(spark, f"{d}/region.parquet")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


@query(
    "union_sources",
    "SELECT l_returnflag AS flag, l_suppkey, l_extendedprice AS price, CASE WHEN l_returnflag = 'A' THEN l_tax END AS tax FROM lineitem",
)
def _union(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_suppkey", F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    a, rest = li.filter("flag = 'A'"), li.drop("tax")
    return union_sources(a, rest.filter("flag = 'N'"), rest.filter("flag = 'R'"))


@query(
    "valid_offers",
    """SELECT l_orderkey, l_linenumber, l_partkey, price FROM (
      SELECT *, l_extendedprice - 40000e0 AS price, CASE WHEN l_linenumber = 1 THEN '' ELSE 'u' END AS url FROM lineitem)
      WHERE price > 0 AND url <> ''""",
)
def valid_offers(spark, d):
    raw = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_extendedprice") - 40000).alias("price_current"),
        F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(F.lit("u")).alias("url"),
    )
    return ingest.valid_offers(raw).select("l_orderkey", "l_linenumber", "l_partkey", F.col("price_current").alias("price"))


# --- classifier ---------------------------------------------------------------
ITEM_TITLE = (
    "CASE WHEN p_size % 10 = 0 THEN concat(p_name, ' Shoes') WHEN p_size % 10 = 1 THEN concat('Add to Wish List ', p_name) "
    "WHEN p_size % 10 = 2 THEN concat(p_name, ' Tee') WHEN p_size % 10 = 3 THEN concat('Tee and Sneakers ', p_type) "
    "WHEN p_size % 10 = 4 THEN concat('Endorphin Pro ', cast(p_size as string)) WHEN p_size % 10 = 5 THEN concat(p_name, ' trail ', cast(p_size as string)) "
    "WHEN p_size % 10 = 6 THEN concat(p_name, ' ', cast(p_size as string)) WHEN p_size % 10 = 7 THEN '4.75 stars &amp; up' "
    "WHEN p_size % 10 = 8 THEN '' ELSE concat('{', p_name, '}') END"
)
ITEM_URL = (
    "CASE WHEN p_partkey % 7 = 0 THEN concat('https://x.example.com/p/', p_type) WHEN p_partkey % 7 = 1 THEN '#' "
    "WHEN p_partkey % 7 = 2 THEN 'https://x.example.com/cart' WHEN p_partkey % 7 = 3 THEN 'https://x.example.com/a?sku=1' "
    "WHEN p_partkey % 7 = 4 THEN '' ELSE 'https://x.example.com/list' END"
)


def _any(x: str, patterns: list[str]) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({x}, {quoted('(?i)' + joined)})"


ITEM_REASON_SQL = f"""CASE WHEN t = '' THEN 'empty' WHEN {_any('t', rules.REJECT_TEXT)} THEN 'reject-text'
  WHEN u <> '' AND {_any('u', rules.REJECT_URL)} THEN 'reject-url' WHEN {_any('t', [rules.FOOTWEAR_TERMS])} THEN 'keep-footwear'
  WHEN {_any('t', rules.ACCESSORY_TERMS)} THEN 'accessory' WHEN {_any('t', [rules.MODEL_FAMILIES])} THEN 'keep-family'
  WHEN {_any('t', [rules.VERSIONED_MODEL])} AND ({_any('t', [rules.RUNNING_CONTEXT])} OR {_any('u', rules.PRODUCT_URL)}) THEN 'keep-version'
  ELSE 'no-signal' END"""


@query(
    "item_filter",
    f"""SELECT id, reason, reason LIKE 'keep%' AS keep FROM (SELECT id, {ITEM_REASON_SQL} AS reason FROM (
      SELECT p_partkey AS id, trim(replace(lower({ITEM_TITLE}), '&amp;', '&')) AS t, lower({ITEM_URL}) AS u FROM part
      UNION ALL SELECT -1 - doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '' FROM documents))""",
)
def item_filter(spark, d):
    rows = (
        table(spark, d, "part")
        .select(F.col("p_partkey").alias("id"), F.expr(ITEM_TITLE).alias("t"), F.expr(ITEM_URL).alias("u"))
        .union(spread_table(spark, d, "documents").select(-1 - F.col("doc_id"), "text", F.lit("")))
    )
    return classify.classify_items(rows, "t", None, "u", None).select("id", "reason", "keep")


FORCED = [("ring", "trail"), ("GIZMO", "running"), ("speedgoat", "trail")]
RAW_CATEGORY = "CASE WHEN p_size % 3 = 0 THEN 'trail' WHEN p_size % 3 = 1 THEN 'running' END"
FORCE_TITLE = "concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' Trail' ELSE '' END)"


@query(
    "category_override",
    f"""SELECT p_partkey, coalesce(CASE WHEN contains(t, 'ring') THEN 'trail' WHEN contains(t, 'gizmo') THEN 'running'
      WHEN contains(t, 'speedgoat') THEN 'trail' END, c, CASE WHEN contains(t, 'trail') THEN 'trail' ELSE 'running' END) AS category
      FROM (SELECT p_partkey, {sql_token(FORCE_TITLE)} AS t, {RAW_CATEGORY} AS c FROM part)""",
)
def category_override(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", decide_category(F.expr(FORCE_TITLE), F.expr(RAW_CATEGORY), FORCED).alias("category")
    )


@query(
    "category_rules",
    f"""WITH r AS (SELECT n_nationkey AS pos, {sql_token('n_name[1:2]')} AS token, CASE WHEN n_nationkey % 2 = 0 THEN 'trail' ELSE 'running' END AS category FROM nation)
      SELECT p_partkey, coalesce((SELECT arg_min(r.category, pos) FROM r WHERE contains(t, token)), c, CASE WHEN contains(t, 'trail') THEN 'trail' ELSE 'running' END) AS category
      FROM (SELECT p_partkey, {sql_token(FORCE_TITLE)} AS t, {RAW_CATEGORY} AS c FROM part)""",
)
def category_rules(spark, d):
    """The rules are a table: the first two letters of every nation name a category."""
    kind = F.when(F.col("n_nationkey") % 2 == 0, F.lit("trail")).otherwise(F.lit("running"))
    listed = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.substring("n_name", 1, 2).alias("token"), kind.alias("category"))
    return table(spark, d, "part").select(
        "p_partkey", decide_category(F.expr(FORCE_TITLE), F.expr(RAW_CATEGORY), listed).alias("category")
    )


@query(
    "offer_patches",
    """SELECT p_partkey, CASE WHEN s.p_size % 2 = 0 THEN 'patched' ELSE p_name END AS p_name,
        CASE WHEN s.p_size % 2 = 1 THEN NULL ELSE p_brand END AS p_brand,
        CASE WHEN s.p_size % 2 = 1 THEN 1.5e0 ELSE p_retailprice END AS p_retailprice
      FROM part LEFT JOIN (SELECT p_partkey AS k, p_size FROM part WHERE p_size % 5 = 0) s ON k = p_partkey""",
)
def offer_patches(spark, d):
    part = table(spark, d, "part")
    hit = part.filter("p_size % 5 = 0").select("p_partkey", "p_size")
    even = F.col("p_size") % 2 == 0
    entry = F.when(even, F.create_map(F.lit("p_name"), F.lit("patched"))).otherwise(
        F.create_map(F.lit("p_brand"), F.lit(None).cast("string"), F.lit("p_retailprice"), F.lit("1.5"))
    )
    # Two patches per offer: only the last one counts.
    patches = hit.select("p_partkey", F.lit(2).alias("pos"), entry.alias("set")).union(
        hit.select("p_partkey", F.lit(1), F.create_map(F.lit("p_type"), F.lit("lost")))
    )
    return overrides.apply_patches(part, patches, "p_partkey").select("p_partkey", "p_name", "p_brand", "p_retailprice")


# --- working offers -------------------------------------------------------------
WORK_TITLE = (
    "concat(p_brand, ' ', p_name, CASE WHEN p_size % 3 = 0 THEN ' &amp; Trail' ELSE '' END, ' Shoes m', cast(p_size as string))"
)
WORK_MODEL = "CASE WHEN p_size % 4 = 0 THEN '' ELSE concat(p_name, '  ', p_type, ' size ', cast(p_size as string)) END"
WORK_SKU = "CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '-', cast(p_partkey as string)) END"
WORK_BRAND = "CASE WHEN p_size % 5 > 0 THEN p_brand END"
WORK_CAT = "CASE WHEN p_size % 7 = 0 THEN 'trail' END"
WORK_CLEAN_SQL = "CASE WHEN p_size % 4 = 0 THEN regexp_replace(title, ' m[0-9]+$', '') ELSE concat(p_name, ' ', p_type) END"
WORK_SIZE_SQL = "CASE WHEN p_size % 4 = 0 THEN 'M' || p_size ELSE 'Size ' || p_size END"


@query(
    "working_offers",
    f"""WITH j AS (SELECT *, l_extendedprice AS org, {sql_round('(l_extendedprice * (1e0 - l_discount))', 2)} AS cur,
        replace({WORK_TITLE}, '&amp;', '&') AS title, {WORK_SKU} AS raw FROM lineitem JOIN part ON p_partkey = l_partkey),
      k AS (SELECT *, {SKU_SQL} AS sku, {sql_model(WORK_CLEAN_SQL)} AS model_normalized FROM j)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_id('ofr', "('s' || l_suppkey)", "('u' || l_partkey)", 'model_normalized', "printf('%.2f', cur)", "coalesce(sku, '')", "''")} AS offer_id,
        title AS title_raw, {sql_brand(f"({WORK_BRAND})")} AS brand, model_normalized, {WORK_SIZE_SQL} AS size_range, sku,
        coalesce({WORK_CAT}, CASE WHEN contains(title, 'Trail') THEN 'trail' ELSE 'running' END) AS category,
        {sql_discount('cur', 'org')} AS discount_pct,
        {sql_round("(0.45e0 + CASE WHEN p_size % 5 > 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN p_size % 4 > 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN sku IS NOT NULL THEN 0.2e0 ELSE 0e0 END + CASE WHEN org > cur THEN 0.1e0 ELSE 0e0 END)", 2)} AS source_confidence
      FROM k""",
)
def working_offers(spark, d):
    from offerloom.functions.money import js_round

    raw = (
        spread_table(spark, d, "lineitem")
        .join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("retailer_id"),
            F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"),
            F.expr(WORK_TITLE).alias("title_raw"),
            F.expr(WORK_BRAND).alias("brand"),
            F.expr(WORK_MODEL).alias("model_raw"),
            F.lit(None).cast("string").alias("gender"),
            F.expr(WORK_CAT).alias("category"),
            F.lit(None).cast("string").alias("size_range"),
            js_round(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")), 2).alias("price_current"),
            F.col("l_extendedprice").alias("price_original"),
            F.expr(WORK_SKU).alias("sku"),
            F.lit(None).cast("string").alias("gtin"),
            F.lit(False).alias("used_fixture"),
        )
    )
    return ingest.working_offers(raw).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "offer_id", "title_raw", "brand", "model_normalized",
        "size_range", "sku", "category", "discount_pct", "source_confidence",
    )


# --- dedupe ------------------------------------------------------------------------
@query(
    "dedupe_offers",
    f"""WITH {OFFERS_SQL}, {PRODUCTS_SQL}
      SELECT offer_id, {SEQ_SQL.replace('l_shipdate', sql_ts('l_shipdate') + ' AS l_shipdate')} FROM (
        SELECT o.*, row_number() OVER (PARTITION BY retailer_id, lower(regexp_replace(url, '[?].*$', '')), model, category,
          gender, size_range, printf('%.2f', round(price_current / 1000e0) * 1000e0) ORDER BY {SEQ_SQL}) AS rn
        FROM offers o JOIN products USING (shoe_id)) WHERE rn = 1""",
)
def dedupe_offers(spark, d):
    rows = (
        titled_offers(spark, d)
        .withColumn("price_current", F.round(F.col("price_current") / 1000.0) * 1000.0)
        .withColumn("sku", F.lit(None).cast("string"))
        .withColumn("gtin", F.lit(None).cast("string"))
    )
    first = dedupe.dedupe_offers(rows)
    return first.select("offer_id", *[F.col(f"seq.{c}").alias(c) for c in SEQ[:-1]], ts_text("seq.l_shipdate").alias("l_shipdate"))


@query(
    "dedupe_raw",
    """SELECT page_key, url, title_raw, price_current, pos FROM (SELECT *, row_number() OVER (
        PARTITION BY page_key, url, title_raw, printf('%.2f', price_current) ORDER BY pos, tie) AS rn FROM (
        SELECT l_suppkey AS page_key, 'u' || l_partkey % 50 AS url, 't' || l_linenumber AS title_raw, floor(l_quantity / 10e0) AS price_current,
          l_orderkey AS pos, l_partkey AS tie FROM lineitem)) WHERE rn = 1""",
)
def dedupe_raw(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("page_key"),
        F.concat(F.lit("u"), (F.col("l_partkey") % 50).cast("string")).alias("url"),
        F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("title_raw"),
        F.floor(F.col("l_quantity") / 10.0).cast("double").alias("price_current"),
        F.col("l_orderkey").alias("pos"),
        F.col("l_partkey").alias("tie"),
    )
    return dedupe.dedupe_raw(rows, ["pos", "tie"], within=["page_key"]).drop("tie")


# --- rollups --------------------------------------------------------------------------
DEAL_COLS = "shoe_id, best_offer_id, best_price, offers_count, max_discount_pct"


def deals_view(spark, d):
    return rollup.deal_rollup(offers_view(spark, d))


@query("deal_rollup", f"WITH {OFFERS_SQL}, {DEALS_SQL} SELECT {DEAL_COLS}, {sql_ts('updated_at')} AS updated_at FROM deals")
def deal_rollup(spark, d):
    return deals_view(spark, d).select(*DEAL_COLS.split(", "), ts_text("updated_at").alias("updated_at"))


@query(
    "canonical_products",
    f"""WITH o AS (SELECT *, 'c' || l_partkey % 500 AS shoe_id, CASE WHEN l_linenumber % 3 = 0 THEN p_brand END AS brand, p_name AS model_normalized,
        {'CASE WHEN p_size % 3 = 0 THEN ' + quoted('trail') + ' ELSE ' + quoted('running') + ' END'} AS category,
        CASE WHEN l_tax > 0.05e0 THEN 'S' || l_suppkey END AS sku,
        row_number() OVER (PARTITION BY l_partkey % 500 ORDER BY {SEQ_SQL}) AS nth FROM lineitem JOIN part ON p_partkey = l_partkey),
      m AS (SELECT shoe_id, model_normalized, min(nth) AS seen FROM o GROUP BY 1, 2)
      SELECT shoe_id, coalesce(max(CASE WHEN nth = 1 THEN brand END), 'Unknown') AS brand, max(CASE WHEN nth = 1 THEN model_normalized END) AS model,
        max(CASE WHEN nth = 1 THEN category END) AS category, arg_min(sku, nth) FILTER (sku IS NOT NULL) AS sku,
        (SELECT string_agg(model_normalized, '|' ORDER BY seen) FROM m WHERE m.shoe_id = o.shoe_id) AS aliases
      FROM o GROUP BY shoe_id""",
)
def canonical_products(spark, d):
    rows = (
        table(spark, d, "lineitem")
        .join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .select(
            F.struct(*SEQ).alias("seq"),
            F.concat(F.lit("c"), (F.col("l_partkey") % 500).cast("string")).alias("shoe_id"),
            F.when(F.col("l_linenumber") % 3 == 0, F.col("p_brand")).alias("brand"),
            F.col("p_name").alias("model_normalized"),
            F.when(F.col("p_size") % 3 == 0, F.lit("trail")).otherwise(F.lit("running")).alias("category"),
            F.when(F.col("l_tax") > 0.05, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("sku"),
            F.lit(None).cast("string").alias("gtin"),
        )
    )
    return rollup.with_aliases(rollup.canonical_products(rows), rollup.product_aliases(rows)).select(
        "shoe_id", "brand", "model", "category", F.col("identifiers.sku").alias("sku"), F.array_join("aliases", "|").alias("aliases")
    )


@query(
    "product_sorted",
    f"WITH {PRODUCTS_SQL} SELECT shoe_id, brand, model FROM products ORDER BY model, shoe_id",
)
def product_sorted(spark, d):
    return search.sort_products(products_view(spark, d).withColumn("first_seq", F.col("shoe_id"))).select("shoe_id", "brand", "model")


@query(
    "product_summary",
    f"""WITH {OFFERS_SQL} SELECT shoe_id, max(CASE WHEN rn = 1 THEN offer_id END) AS cheapest_offer_id, min(price_current) AS lowest_price, count(*) AS offers_count,
        count(*) FILTER (in_stock) AS in_stock_count, count(*) FILTER (NOT in_stock) AS out_of_stock_count, {sql_ts('max(scraped_at)')} AS latest_scraped_at
      FROM (SELECT *, row_number() OVER (PARTITION BY shoe_id ORDER BY price_current, NOT in_stock, {SEQ_SQL}) AS rn FROM offers) GROUP BY shoe_id""",
)
def product_summary(spark, d):
    out = rollup.product_summary(offers_view(spark, d))
    return out.withColumn("latest_scraped_at", ts_text("latest_scraped_at"))


@query("brand_facet", "SELECT DISTINCT p_brand AS brand FROM part ORDER BY brand")
def brand_facet(spark, d):
    return rollup.brand_facet(products_view(spark, d))


AS_OF = "2001-06-01 00:00:00"


@query(
    "run_metadata",
    f"""SELECT (SELECT count(*) FROM supplier) AS retailers_count, (SELECT count(*) FROM lineitem) AS offers_count,
      (SELECT count(*) FROM part) AS shoes_count, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS deals_count,
      {sql_ts('max(l_shipdate)')} AS newest_scrape, TIMESTAMP '{AS_OF}' - max(l_shipdate) > INTERVAL 36 HOUR AS stale, '{AS_OF}' AS generated_at, 36e0 AS stale_after_hours
      FROM lineitem""",
)
def run_metadata(spark, d):
    offers = offers_view(spark, d)
    tables = {
        "retailers": table(spark, d, "supplier"), "offers": offers, "shoes": table(spark, d, "part"),
        "deals": offers.groupBy("shoe_id").agg(F.count("*")),
    }
    as_of = F.lit(AS_OF).cast("timestamp")
    out = rollup.run_metadata(tables, offers, as_of)
    return out.withColumn("newest_scrape", ts_text("newest_scrape")).withColumn("generated_at", ts_text("generated_at"))


@query(
    "freshness",
    """SELECT event_id, late AS stale, CASE WHEN bad THEN CASE WHEN late THEN 'Stale snapshot' ELSE 'Snapshot available' END
        ELSE CASE WHEN late THEN 'Stale snapshot' ELSE 'Fresh snapshot' END || ' - ' || strftime(ts, '%b %-d, %H:%M') END AS label
      FROM (SELECT event_id, ts, event_id % 7 = 0 AS bad,
        event_type = 'error' OR (event_id % 7 <> 0 AND TIMESTAMP '2024-01-20 12:00:00' - date_trunc('second', ts) > INTERVAL 36 HOUR) AS late FROM events)""",
)
def freshness(spark, d):
    generated = F.when(F.col("event_id") % 7 == 0, F.lit("never")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    fresh = labels.freshness_label(
        generated, F.col("event_type") == "error", F.lit("2024-01-20 12:00:00").cast("timestamp"), rules.STALE_AFTER_HOURS
    )
    return table(spark, d, "events").select("event_id", fresh["stale"].alias("stale"), fresh["label"].alias("label"))


# --- search and ranking ------------------------------------------------------------------
BASE_SQL = f"{OFFERS_SQL}, {PRODUCTS_SQL}, {DEALS_SQL}"
SEARCH = search.DealFilter(query="Ring-ECONOMY", category="running", gender="women", min_price=1000.0, max_price=30000.0)
JOINED_SQL = "deals JOIN products p USING (shoe_id) JOIN (SELECT DISTINCT offer_id, retailer_id, url FROM offers) o ON o.offer_id = best_offer_id"
SEARCH_SQL = f"""{JOINED_SQL} WHERE category = 'running' AND gender = 'women' AND best_price >= 1000 AND best_price <= 30000
  AND contains({sql_token("concat_ws(' ', brand, model, title_raw, coalesce(size_range, ''))")}, 'ring-economy')"""


def best_offers(spark, d):
    """Offers with product attributes, one row per id (line items repeat)."""
    return dedupe.first_rows(titled_offers(spark, d), ["offer_id"], ["seq"])


def deal_parts(spark, d):
    p = products_view(spark, d)
    o = dedupe.first_rows(offers_view(spark, d), ["offer_id"], ["seq"]).join(
        p.select("shoe_id", "title_raw", "gender", "size_range"), "shoe_id"
    )
    return deals_view(spark, d), o, p.select("shoe_id", "brand", "model", "category")


SHOWN = ["shoe_id", "brand", "model", "retailer_id", "best_offer_id", "best_price", "offers_count", "max_discount_pct"]


@query("deal_search", f"WITH {BASE_SQL} SELECT {', '.join(SHOWN)} FROM {SEARCH_SQL}")
def deal_search(spark, d):
    return search.search_deals(*deal_parts(spark, d), SEARCH).select(*SHOWN)


@query(
    "deal_search_sorted",
    f"""WITH {BASE_SQL} SELECT {', '.join(SHOWN)} FROM {JOINED_SQL} WHERE category = 'running' AND best_price <= 30000
      ORDER BY coalesce(max_discount_pct, 0) DESC, best_price, best_price DESC, first_seq""",
)
def deal_search_sorted(spark, d):
    found = search.search_deals(*deal_parts(spark, d), search.DealFilter(category="running", max_price=30000.0))
    return search.sort_deals(found).select(*SHOWN)


@query("deal_sorted", f"WITH {OFFERS_SQL}, {DEALS_SQL} SELECT {DEAL_COLS} FROM deals ORDER BY best_price DESC, first_seq")
def deal_sorted(spark, d):
    return search.sort_deals(deals_view(spark, d), "published").select(*DEAL_COLS.split(", "))


def _shelf_sql(name: str, order: str) -> str:
    return f"SELECT * FROM (SELECT '{name}' AS shelf, {DEAL_COLS} FROM deals ORDER BY {order}, best_price DESC, first_seq LIMIT 4)"


@query(
    "shelves",
    f"WITH {OFFERS_SQL}, {DEALS_SQL} "
    + _shelf_sql("top-discounts", "coalesce(max_discount_pct, 0) DESC, best_price")
    + " UNION ALL " + _shelf_sql("budget-picks", "best_price, coalesce(max_discount_pct, 0) DESC")
    + " UNION ALL " + _shelf_sql("most-offers", "offers_count DESC, coalesce(max_discount_pct, 0) DESC"),
)
def shelves(spark, d):
    return search.shelves(deals_view(spark, d)).select("shelf", *DEAL_COLS.split(", "))


BADGE_SQL = """CASE WHEN h.status IS NULL THEN 'Health unknown' WHEN h.source_mode = 'fixture' THEN 'Fixture fallback'
  WHEN h.status = 'ok' THEN 'Live parser' WHEN h.status = 'disabled' THEN 'Parser disabled' ELSE 'Parser issue' END"""
TONE_SQL = """CASE WHEN h.status IS NULL THEN 'neutral' WHEN h.source_mode = 'fixture' THEN 'warn' WHEN h.status = 'ok' THEN 'good'
  WHEN h.status = 'disabled' THEN 'warn' ELSE 'bad' END"""
BADGE_TITLE_SQL = """CASE WHEN h.status IS NULL THEN 'No parser health status is currently available.'
  WHEN h.source_mode = 'fixture' THEN coalesce(h.warning, 'Fixture data was used for this retailer.')
  WHEN h.status = 'ok' THEN 'Retailer parser is healthy and running live.'
  WHEN h.status = 'disabled' THEN coalesce(h.warning, 'Retailer parser is currently disabled.')
  ELSE coalesce(h.warning, 'Retailer parser reported a failure.') END"""
CARD = ["shoe_id", "brand", "category", "retailer_name", "best_price", "offers_count", "price_label", "discount_label", "badge_label", "badge_tone"]
CARDS_SQL = f"""cards AS (SELECT shoe_id, brand, category, coalesce(r.name, o.retailer_id) AS retailer_name, best_price, deals.offers_count AS offers_count,
    '$' || printf('%.2f', best_price) || ' CAD' AS price_label,
    CASE WHEN max_discount_pct > 0 THEN 'Up to ' || CAST(floor(max_discount_pct + 0.5e0) AS INTEGER) || '% off' END AS discount_label,
    {BADGE_SQL} AS badge_label, {TONE_SQL} AS badge_tone, max_discount_pct, first_seq
  FROM deals JOIN products p USING (shoe_id) JOIN (SELECT DISTINCT offer_id, retailer_id FROM offers) o ON o.offer_id = best_offer_id
  LEFT JOIN retailers r ON r.retailer_id = o.retailer_id LEFT JOIN health h ON h.retailer_id = o.retailer_id)"""


def cards_view(spark, d):
    deals, offers, shoes = deal_parts(spark, d)
    return search.deal_cards(deals, offers, shoes, retailers_view(spark, d), health_view(spark, d))


@query("deal_cards", f"WITH {BASE_SQL}, {RETAILERS_SQL}, {HEALTH_SQL}, {CARDS_SQL} SELECT {', '.join(CARD)} FROM cards")
def deal_cards(spark, d):
    return cards_view(spark, d).select(*CARD)


def flagship(spark, d):
    """Dedupe, roll up, join for display, best discount first."""
    offers = dedupe.dedupe_offers(
        titled_offers(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("sku", "gtin")})
    )
    deals = rollup.deal_rollup(offers)
    p = products_view(spark, d).select("shoe_id", "brand", "model", "category")
    best = dedupe.first_rows(offers, ["offer_id"], ["seq"])
    cards = search.deal_cards(deals, best, p, retailers_view(spark, d), health_view(spark, d))
    return search.sort_deals(cards).select(*CARD, "max_discount_pct", "best_offer_id")


@query(
    "best_deals",
    f"""WITH {OFFERS_SQL}, {PRODUCTS_SQL}, {RETAILERS_SQL}, {HEALTH_SQL},
      once AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY retailer_id, lower(regexp_replace(url, '[?].*$', '')), model, category,
        gender, size_range, printf('%.2f', price_current) ORDER BY {SEQ_SQL}) AS drn FROM offers o JOIN products USING (shoe_id)) WHERE drn = 1),
      {DEALS_SQL.replace('FROM offers)', 'FROM once)')}, {CARDS_SQL}
      SELECT {', '.join('c.' + x for x in CARD)}, c.max_discount_pct, d.best_offer_id FROM cards c JOIN deals d USING (shoe_id)""",
)
def best_deals(spark, d):
    return flagship(spark, d)


RELATED = ["shoe_id", "offer_id", "l_orderkey", "l_linenumber", "l_suppkey", "in_stock", "price_current", "trust", "trust_pct"]


@query(
    "related_offers",
    f"""WITH {OFFERS_SQL}, {PRODUCTS_SQL} SELECT k.shoe_id, o.offer_id, l_orderkey, l_linenumber, l_suppkey, in_stock, price_current,
        CASE WHEN source_confidence >= 0.9e0 THEN 'High trust' WHEN source_confidence >= 0.75e0 THEN 'Moderate trust' ELSE 'Low trust' END AS trust,
        CAST(floor(source_confidence * 100e0 + 0.5e0) AS BIGINT) AS trust_pct
      FROM offers o JOIN products p USING (shoe_id) JOIN products k ON p.model = k.model AND p.brand IS NOT DISTINCT FROM k.brand AND p.category = k.category
      ORDER BY in_stock DESC, price_current""",
)
def related_offers(spark, d):
    offers = titled_offers(spark, d)
    shoes = products_view(spark, d).select("shoe_id", "brand", "model", "category")
    # Offers are sorted before they are told once for each product: the sort moves every offer once.
    found = search.related_offers(offers, shoes, by="attributes", listed=True)
    cols = [F.col(f"seq.{c}").alias(c) if c.startswith("l_") else F.col(c) for c in RELATED]
    return search.each_product(search.sort_related(found)).select(*cols)


@query(
    "offer_bridge",
    f"""WITH {OFFERS_SQL} SELECT shoe_id, offer_id, l_orderkey, l_linenumber, in_stock, price_current FROM offers
      WHERE shoe_id IN (SELECT 'p' || p_partkey FROM part)""",
)
def offer_bridge(spark, d):
    wanted = table(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("shoe_id")
    )
    found = search.related_offers(offers_view(spark, d), wanted, by="bridge")
    return found.select("shoe_id", "offer_id", "seq.l_orderkey", "seq.l_linenumber", "in_stock", "price_current")


@query(
    "health_badge",
    f"""WITH {OFFERS_SQL}, {HEALTH_SQL} SELECT o.retailer_id, {BADGE_SQL} AS label, {TONE_SQL} AS tone, {BADGE_TITLE_SQL} AS title, count(*) AS offers
      FROM offers o LEFT JOIN health h ON h.retailer_id = o.retailer_id GROUP BY ALL""",
)
def health_badge(spark, d):
    offers = offers_view(spark, d).groupBy("retailer_id").agg(F.count("*").alias("offers"))
    b = labels.badge("status", "source_mode", "warning")
    return offers.join(health_view(spark, d).select("retailer_id", "status", "source_mode", "warning"), "retailer_id", "left").select(
        "retailer_id", b["label"].alias("label"), b["tone"].alias("tone"), b["title"].alias("title"), "offers"
    )

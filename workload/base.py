"""Registry and the views the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.ids import stable_id
from offerloom.functions.money import discount_pct, fixed2, js_round
from offerloom.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can say the same, its oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For queries with much work per row."""
    return spread(table(spark, sf_dir, name))


# --- SQL spelling of shared expressions (DuckDB) -------------------------------
WS = (
    "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_token(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '''\"', ''), '[^a-z0-9-]+', ' ', 'g'))"


def sql_round(x: str, digits: int) -> str:
    scale = f"{10**digits}e0"
    return f"(floor({x} * {scale} + 0.5e0) / {scale})"


def sql_discount(cur: str, org: str) -> str:
    return (
        f"CASE WHEN {org} IS NULL OR {org} <= 0 OR {cur} < 0 THEN NULL WHEN {cur} >= {org} THEN 0e0 "
        f"ELSE ceil((({org} - {cur}) / {org} * 100e0 - 2.220446049250313e-16) * 100e0) / 100e0 END"
    )


def sql_excerpt(x: str, n: int, empty: str) -> str:
    s = sql_squeeze(x)
    return f"CASE WHEN {s} = '' THEN {quoted(empty)} WHEN length({s}) <= {n} THEN {s} ELSE substr({s}, 1, {n - 3}) || '...' END"


def sql_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def ts_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_id(prefix: str, *parts: str) -> str:
    joined = " || ".join(f"{p} || '|'" for p in parts)
    return f"('{prefix}_' || substr(sha1({joined}), 1, 12))"


# --- the offers view: line items as offers ---------------------------------------
SEQ = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

# Expressions that read the same in Spark SQL and DuckDB.
TITLE = "concat(p_name, ' ', lower(p_type), ' ', cast(p_size as string))"
GENDER = "CASE WHEN p_size % 4 = 0 THEN 'men' WHEN p_size % 4 = 1 THEN 'women' WHEN p_size % 4 = 2 THEN 'unisex' END"
CATEGORY = "CASE WHEN p_size % 3 = 0 THEN 'trail' ELSE 'running' END"
SIZE_TEXT = "CASE WHEN p_size % 2 = 0 THEN concat('M', cast(p_size as string)) END"


def offers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as offers of a retailer (supplier) for a product (part)."""
    return _as_offers(spread_table(spark, sf_dir, "lineitem"))


def _as_offers(li: DataFrame, *more: str) -> DataFrame:
    """Offers of line items, with ``more`` of their columns."""
    offers = li.select(
        F.struct(*SEQ).alias("seq"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("retailer_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("shoe_id"),
        F.concat(
            F.lit("https://Shop"), F.col("l_suppkey").cast("string"), F.lit(".example.com/P/"),
            F.col("l_partkey").cast("string"), F.lit("?ref="), F.col("l_linenumber").cast("string"),
        ).alias("url"),
        F.col("l_extendedprice").alias("price_original"),
        js_round(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")), 2).alias("price_current"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
        F.col("l_shipdate").alias("scraped_at"),
        F.col("l_returnflag").alias("flag"),
        js_round(F.lit(0.45) + F.col("l_linenumber") * F.lit(0.07), 2).alias("source_confidence"),
        *more,
    )
    return offers.withColumn("discount_pct", discount_pct("price_current", "price_original")).withColumn(
        "offer_id",
        stable_id("ofr", F.col("retailer_id"), F.col("url"), F.col("shoe_id"), fixed2("price_current")),
    )


def products_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products."""
    return _as_products(table(spark, sf_dir, "part"))


def _as_products(part: DataFrame, *more: str) -> DataFrame:
    return part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("shoe_id"),
        F.col("p_brand").alias("brand"),
        F.replace(F.expr(TITLE), F.lit(" "), F.lit("-")).alias("model"),
        F.expr(TITLE).alias("title_raw"),
        F.expr(CATEGORY).alias("category"),
        F.expr(GENDER).alias("gender"),
        F.expr(SIZE_TEXT).alias("size_range"),
        *more,
    )


def titled_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with the attributes of their product."""
    p = _as_products(table(spark, sf_dir, "part"), "p_partkey").withColumnRenamed("model", "model_normalized").drop("shoe_id")
    li = spread_table(spark, sf_dir, "lineitem")
    # The line items meet the parts as they are; what makes offers of them is worked out behind the join.
    joined = li.join(p, li["l_partkey"] == p["p_partkey"])
    return _as_offers(joined, *[c for c in p.columns if c != "p_partkey"])


def retailers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as retailers."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = F.col("s_suppkey").cast("string")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.concat(F.lit("s"), key).alias("retailer_id"),
        F.col("s_name").alias("name"),
        F.when(F.col("n_regionkey") == 1, F.lit("CA")).otherwise(F.col("n_name")).alias("country"),
        F.lit("CAD").alias("currency"),
        F.concat(F.lit("https://shop"), key, F.lit(".example.com")).alias("homepage_url"),
        F.concat(F.lit("https://shop"), key, F.lit(".example.com/favicon.ico")).alias("logo_url"),
        F.when(F.col("s_acctbal") > 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("last_crawled_at"),
    )


# Health of a source: the last day of its events decides.
def health_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as source health: one row per user, a share of errors makes it fail."""
    e = table(spark, sf_dir, "events")
    is_error = F.col("event_type") == "error"
    return (
        e.groupBy("user_id")
        .agg(
            F.count("*").alias("discovered_count"),
            F.count_if(is_error).alias("errors"),
            F.count_if(F.col("event_type") == "purchase").alias("offers_count"),
            F.count_if(F.col("event_type") == "view").alias("pages_crawled"),
            F.max_by("event_id", F.when(is_error, F.col("event_id"))).alias("last_error"),
        )
        .select(
            F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("retailer_id"),
            F.when(F.col("errors") * 4 > F.col("discovered_count"), F.lit("failed"))
            .when(F.col("user_id") % 11 == 0, F.lit("disabled"))
            .otherwise(F.lit("ok"))
            .alias("status"),
            F.when(F.col("errors") * 4 > F.col("discovered_count"), F.lit("fixture"))
            .when(F.col("user_id") % 11 == 0, F.lit(None).cast("string"))
            .otherwise(F.lit("live"))
            .alias("source_mode"),
            F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("page fetch  failed "), F.col("last_error").cast("string")))
            .when(F.col("user_id") % 7 == 0, F.lit("Fixture data loaded"))
            .alias("warning"),
            "offers_count",
            "discovered_count",
            "pages_crawled",
            F.lit(None).cast("string").alias("execution_path"),
        )
    )


OFFERS_SQL = f"""offers AS (
  SELECT *, {sql_discount('price_current', 'price_original')} AS discount_pct,
    {sql_id('ofr', 'retailer_id', 'url', 'shoe_id', "printf('%.2f', price_current)")} AS offer_id
  FROM (SELECT 's' || l_suppkey AS retailer_id, 'p' || l_partkey AS shoe_id,
      'https://Shop' || l_suppkey || '.example.com/P/' || l_partkey || '?ref=' || l_linenumber AS url,
      l_extendedprice AS price_original,
      {sql_round('(l_extendedprice * (1e0 - l_discount))', 2)} AS price_current,
      l_returnflag <> 'R' AS in_stock, l_shipdate AS scraped_at, l_returnflag AS flag,
      {sql_round('(0.45e0 + l_linenumber * 0.07e0)', 2)} AS source_confidence, {', '.join(SEQ)}
    FROM lineitem))"""
PRODUCTS_SQL = f"""products AS (
  SELECT 'p' || p_partkey AS shoe_id, p_brand AS brand, replace({TITLE}, ' ', '-') AS model, {TITLE} AS title_raw,
    {CATEGORY} AS category, {GENDER} AS gender, {SIZE_TEXT} AS size_range FROM part)"""
RETAILERS_SQL = """retailers AS (
  SELECT 's' || s_suppkey AS retailer_id, s_name AS name,
    CASE WHEN n_regionkey = 1 THEN 'CA' ELSE n_name END AS country, 'CAD' AS currency,
    'https://shop' || s_suppkey || '.example.com' AS homepage_url,
    'https://shop' || s_suppkey || '.example.com/favicon.ico' AS logo_url,
    CASE WHEN s_acctbal > 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS last_crawled_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
HEALTH_SQL = """health AS (
  SELECT 's' || user_id AS retailer_id,
    CASE WHEN errors * 4 > discovered_count THEN 'failed' WHEN user_id % 11 = 0 THEN 'disabled' ELSE 'ok' END AS status,
    CASE WHEN errors * 4 > discovered_count THEN 'fixture' WHEN user_id % 11 = 0 THEN NULL ELSE 'live' END AS source_mode,
    CASE WHEN user_id % 3 = 0 THEN 'page fetch  failed ' || last_error
         WHEN user_id % 7 = 0 THEN 'Fixture data loaded' END AS warning,
    offers_count, discovered_count, pages_crawled, CAST(NULL AS VARCHAR) AS execution_path
  FROM (SELECT user_id, count(*) AS discovered_count, count(*) FILTER (event_type = 'error') AS errors,
      count(*) FILTER (event_type = 'purchase') AS offers_count, count(*) FILTER (event_type = 'view') AS pages_crawled,
      max(event_id) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id))"""
SEQ_SQL = ", ".join(SEQ)
DEALS_SQL = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY shoe_id ORDER BY price_current, {SEQ_SQL}) AS rn,
    row_number() OVER (ORDER BY {SEQ_SQL}) AS nth FROM offers),
deals AS (
  SELECT shoe_id, max(CASE WHEN rn = 1 THEN offer_id END) AS best_offer_id, min(price_current) AS best_price,
    count(*) AS offers_count,
    CASE WHEN max(discount_pct) > 0 THEN {sql_round('max(discount_pct)', 2)} END AS max_discount_pct,
    max(scraped_at) AS updated_at, min(nth) AS first_seq
  FROM ranked GROUP BY shoe_id)"""

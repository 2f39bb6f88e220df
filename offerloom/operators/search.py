"""Faceted search, rankings, drill-down and display joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.labels import badge, mode_label, status_label, status_rank
from offerloom.functions.money import card_price_text, discount_text, trust_label, trust_pct
from offerloom.functions.names import norm_brand
from offerloom.functions.text import excerpt, model_display, norm_token, size_display
from offerloom.operators.grid import grid_join


@dataclass(frozen=True)
class DealFilter:
    """Search state; "all" and None mean no restriction."""

    query: str = ""
    brand: str = "all"
    category: str = "all"
    gender: str = "all"
    retailer_id: str = "all"
    min_price: float | None = None
    max_price: float | None = None


def deals_with_best_offer(deals: DataFrame, offers: DataFrame, shoes: DataFrame) -> DataFrame:
    """Deals whose best offer and product exist, with the columns search needs."""
    best = offers.select(
        F.col("offer_id").alias("best_offer_id"), "retailer_id", "url", "title_raw", "gender", "size_range"
    )
    products = shoes.select("shoe_id", "brand", "model", "category")
    return deals.join(products, "shoe_id").join(best, "best_offer_id")


def search_condition(f: DealFilter) -> Column:
    """One conjunction: the equality and range parts reach the scans."""
    cond = F.lit(True)
    for column, value in (
        ("brand", f.brand), ("category", f.category), ("gender", f.gender), ("retailer_id", f.retailer_id)
    ):
        if value != "all":
            cond = cond & (F.col(column) == value)
    if f.min_price is not None:
        cond = cond & (F.col("best_price") >= f.min_price)
    if f.max_price is not None:
        cond = cond & (F.col("best_price") <= f.max_price)
    if f.query.strip():
        haystack = norm_token(
            F.concat_ws(" ", "brand", "model", "title_raw", F.coalesce("size_range", F.lit("")))
        )
        cond = cond & F.contains(haystack, norm_token(F.lit(f.query)))
    return cond


def search_deals(deals: DataFrame, offers: DataFrame, shoes: DataFrame, f: DealFilter) -> DataFrame:
    return deals_with_best_offer(deals, offers, shoes).filter(search_condition(f))


def ranking(mode: str) -> list[Column]:
    """Order of a search result; ties keep the published order (price desc, first seen)."""
    discount = F.coalesce("max_discount_pct", F.lit(0.0))
    published = [F.desc("best_price"), F.asc("first_seq")]
    orders = {
        "max-discount": [discount.desc(), F.asc("best_price")],
        "lowest-price": [F.asc("best_price"), discount.desc()],
        "most-offers": [F.desc("offers_count"), discount.desc()],
        "published": [],
    }
    return [*orders[mode], *published]


def sort_deals(deals: DataFrame, mode: str = "max-discount") -> DataFrame:
    return deals.orderBy(*ranking(mode))


def sort_products(products: DataFrame) -> DataFrame:
    return products.orderBy("model", "first_seq")


def shelves(deals: DataFrame, n: int = rules.SHELF_SIZE) -> DataFrame:
    """The three top-n shelves; each is a top-n scan, not a full sort."""
    out = None
    for shelf, mode in (("top-discounts", "max-discount"), ("budget-picks", "lowest-price"), ("most-offers", "most-offers")):
        top = deals.orderBy(*ranking(mode)).limit(n).withColumn("shelf", F.lit(shelf))
        out = top if out is None else out.unionByName(top)
    return out


def deal_cards(
    deals: DataFrame, offers: DataFrame, shoes: DataFrame, retailers: DataFrame, health: DataFrame
) -> DataFrame:
    """Display rows.

    The inner joins run on product and offer ids; retailer and health are left
    joins and Spark broadcasts them when its size estimate allows.
    """
    h = health.select(
        "retailer_id", F.col("status").alias("_status"), F.col("source_mode").alias("_mode"), F.col("warning").alias("_warning")
    )
    r = retailers.select("retailer_id", F.col("name").alias("_name"))
    return (
        deals_with_best_offer(deals, offers, shoes)
        .join(r, "retailer_id", "left")
        .join(h, "retailer_id", "left")
        .withColumn("retailer_name", F.coalesce("_name", "retailer_id"))
        .withColumn("model_display", model_display("model"))
        .withColumn("size_display", size_display("size_range"))
        .withColumn("price_label", card_price_text("best_price"))
        .withColumn("discount_label", discount_text("max_discount_pct"))
        .withColumn("_badge", badge("_status", "_mode", "_warning"))
        .withColumn("badge_label", F.col("_badge.label"))
        .withColumn("badge_tone", F.col("_badge.tone"))
        .drop("_status", "_mode", "_warning", "_name", "_badge")
    )


#: Products in one list of ``related_offers``, at most.
LISTED = 1_000


def related_offers(offers: DataFrame, products: DataFrame, by: str = "bridge", listed: bool = False) -> DataFrame:
    """Offers of each product with their trust band.

    ``bridge`` uses the assignment made by clustering; ``attributes`` compares
    model, normalised brand (null-safe) and category.  ``listed``: an offer is one row for up to ``LISTED`` of its
    products, which are the column ``products``; ``each_product`` makes one row of each, best after sorting.
    """
    if by == "bridge":
        joined = offers.join(products.select("shoe_id"), "shoe_id")
        if listed:
            joined = joined.withColumn("products", F.array(F.struct("shoe_id"))).drop("shoe_id")
    else:
        o = offers.drop("shoe_id").filter("model_normalized IS NOT NULL AND category IS NOT NULL")
        p = products.select("shoe_id", F.col("model").alias("_model"), norm_brand("brand").alias("_pbrand"), F.col("category").alias("_cat"))
        p, key = p.filter("_model IS NOT NULL AND _cat IS NOT NULL"), ["_model", "_pbrand", "_cat"]
        if listed:
            nth = F.row_number().over(Window.partitionBy(*key).orderBy("shoe_id"))
            lists = p.withColumn("_list", F.floor((nth - 1) / LISTED)).groupBy(*key, "_list")
            p = lists.agg(F.collect_list(F.struct("shoe_id")).alias("products"))
        # One model can have a large share of the offers, so its rows are dealt over a grid.
        joined = grid_join(
            o, p, [F.col("model_normalized"), norm_brand("brand"), F.col("category")], [F.col(c) for c in key],
            left_spot=["offer_id"], right_spot=["_list"] if listed else ["shoe_id"],
        ).drop(*key, "_list")
    return joined.withColumn("trust", trust_label("source_confidence")).withColumn(
        "trust_pct", trust_pct("source_confidence")
    )


def each_product(listed: DataFrame) -> DataFrame:
    """One row for each product of every offer, in the order of the offers."""
    return listed.withColumn("_product", F.explode("products")).withColumn("shoe_id", F.col("_product.shoe_id")).drop("products", "_product")


def sort_related(offers: DataFrame, order: Column | str = "seq") -> DataFrame:
    return offers.orderBy(F.desc("in_stock"), F.asc("price_current"), order)


def reliability(retailers: DataFrame, health: DataFrame) -> DataFrame:
    """Retailers with status, mode and warning excerpt, worst first."""
    h = health.select("retailer_id", "status", "source_mode", "warning", F.col("offers_count").alias("_n"))
    return (
        retailers.join(h, "retailer_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("unknown")))
        .withColumn("source_mode", F.coalesce("source_mode", F.lit("unknown")))
        .withColumn("offers_count", F.coalesce("_n", F.lit(0)))
        .withColumn("warning_excerpt", excerpt(F.coalesce("warning", F.lit(""))))
        .withColumn("status_label", status_label("status"))
        .withColumn("mode_label", mode_label("source_mode"))
        .withColumn("status_rank", status_rank("status"))
        .drop("_n")
    )


def sort_reliability(rows: DataFrame) -> DataFrame:
    return rows.orderBy("status_rank", F.collate("name", "UNICODE"))


def reliability_kpis(rows: DataFrame) -> DataFrame:
    """One row of counters over reliability rows."""
    ok = F.col("status") == "ok"
    return rows.agg(
        F.count_if(ok & (F.col("source_mode") == "live")).alias("live_healthy"),
        F.count_if(~ok | F.col("warning").isNotNull()).alias("attention"),
        F.count_if(F.col("source_mode") == "fixture").alias("fixture"),
        F.count_if(F.col("last_crawled_at").isNotNull()).alias("crawled"),
    )

"""Driver contract and page jobs from end to end."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from offerloom.operators.extract import STATE, extract_offers
from offerloom.plans.ingest import clean_offers


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns[0] == "shoe_id"
    top = rows.limit(5).collect()
    assert len(top) == 5
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_pages_to_offers(spark):
    html = (
        '<html><script>window.S = {"p":[{"name":"Ghost 16 Shoes","price":"149.99","url":"/p/1"}]}</script>'
        '<script type="application/ld+json">{"@type":"Product","name":"Ghost 16 Shoes","url":"/p/1","offers":{"price":149.99}}</script></html>'
    )
    pages = spark.createDataFrame([("s1", 0, "https://a.com/list", html)], "source string, page_index int, base_url string, html string")
    offers, discovered = extract_offers(pages)
    first = offers.collect()
    assert [(r["url"], r["price_current"], r["extractor_rank"]) for r in first] == [("https://a.com/p/1", 149.99, 0)]
    assert discovered.first()["discovered_count"] == 2
    preferred, _ = extract_offers(pages, state_first=F.col("source") == "s1")
    assert preferred.first()["extractor_rank"] == -1
    assert STATE == 2
    raw = offers.select(
        F.col("source").alias("retailer_id"), F.struct("page_index", "extractor_rank", "pos").alias("seq"), "url", "title_raw", "brand",
        "model_raw", "gender", "category", "colorway", "size_range", "price_current", "price_original", "in_stock", "sku", "gtin",
        F.lit(False).alias("used_fixture"), F.lit("2024-03-01 12:00:00").cast("timestamp").alias("scraped_at"),
    )
    clean = clean_offers(raw).first()
    assert (clean["model_normalized"], clean["category"], clean["source_confidence"]) == ("ghost-16-shoes", "running", 0.55)

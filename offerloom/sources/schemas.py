"""Schemas of the published tables."""

IDENTIFIERS = "struct<sku:string,gtin:string>"

RETAILERS = (
    "retailer_id string, name string, country string, currency string, homepage_url string, "
    "logo_url string, shipping_notes string, last_crawled_at timestamp"
)
RAW_OFFERS = (
    "source string, url string, title_raw string, brand string, model_raw string, gender string, "
    "category string, colorway string, size_range string, price_current double, price_original double, "
    f"in_stock boolean, identifiers {IDENTIFIERS}, "
    "seq struct<source_rank:int,page_index:int,extractor_rank:int,pos:int>, used_fixture boolean, scraped_at timestamp"
)
OFFERS = (
    "offer_id string, retailer_id string, url string, title_raw string, brand string, model_normalized string, "
    "gender string, category string, colorway string, size_range string, price_current double, "
    "price_original double, discount_pct double, in_stock boolean, scraped_at timestamp, source_confidence double"
)
SHOES = (
    f"shoe_id string, brand string, model string, category string, identifiers {IDENTIFIERS}, "
    "match_rules_version string, alias_count bigint"
)
ALIASES = "shoe_id string, model_normalized string"
DEALS = (
    "shoe_id string, best_offer_id string, best_price double, offers_count bigint, max_discount_pct double, "
    "updated_at timestamp"
)
SOURCE_HEALTH = (
    "retailer_id string, status string, offers_count bigint, warning_rows bigint, warns_fixture boolean, duration_ms bigint, "
    "discovered_count bigint, parsed_count bigint, pages_crawled bigint, source_mode string, execution_path string"
)
BENCHMARK = "retailer_id string, expected_models array<string>, expected_count bigint"
STATE = "scope string, retailer_id string, failures bigint"
DISABLED = "retailer_id string"

METADATA = (
    "generated_at timestamp, stale_after_hours double, stale boolean, newest_scrape timestamp, retailers_count bigint, "
    "offers_count bigint, shoes_count bigint, deals_count bigint, aggregate_recall double, fixture_usage_rate double, "
    "fixture_usage_threshold double"
)
WARNINGS = "retailer_id string, pos int, text string"

#: Page files as they arrive: a row a fetch; ``error`` is null where it worked, ``html`` where it did not.
FETCHED = (
    "drop_date date, source string, page_index int, base_url string, html string, url string, error string, duration_ms bigint"
)

PUBLISHED = {
    "retailers": RETAILERS,
    "offers": OFFERS,
    "shoes": SHOES,
    "aliases": ALIASES,
    "deals": DEALS,
    "source_health": SOURCE_HEALTH,
    "warnings": WARNINGS,
    "metadata": METADATA,
}

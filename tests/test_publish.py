"""From fetched pages to published tables that open again, and extraction from pages that are broken."""

import datetime as dt

from pyspark.sql import functions as F

from offerloom.functions.names import decide_category
from offerloom.operators.extract import ScriptHints, extract_offers, extract_state, extract_tracking
from offerloom.plans.check import validate_snapshot
from offerloom.plans.publish import RAW, publish_run
from offerloom.sources import schemas
from offerloom.sources.tables import load_dataset, write_snapshot

DAY = dt.datetime(2024, 3, 1, 12)
PAGES = "source string, page_index int, base_url string, html string"


def product(name, price, url):
    return (
        f'<script type="application/ld+json">{{"@type":"Product","name":"{name}","brand":"{name.split()[0]}","url":"{url}",'
        f'"offers":{{"price":{price}}}}}</script>'
    )


def test_pages_to_dataset(spark, tmp_path):
    pages = spark.createDataFrame(
        [
            ("s1", 0, "https://s1.example.com/list", product("Acme Rapid 5 Running Shoes", 99.5, "/p/1") + product("Dune Mirage 12 Trail Shoes", 120, "/p/2")),
            ("s1", 1, "https://s1.example.com/list?page=2", None),
            ("s2", 0, "https://s2.example.com/list", product("Acme Rapid 5 Running Shoes", 95, "/p/7")),
            ("s4", 0, "https://s4.example.com/list", product("Off Shoe 1 Running Shoes", 1, "/p/7")),
        ],
        PAGES,
    )
    log = spark.createDataFrame(
        [("s1", 0, "u", None, 5), ("s1", 1, "u", "HTTP 500", 7), ("s2", 0, "u", None, 3), ("s3", 0, "u", "HTTP 404", 9), ("s4", 0, "u", None, 1)],
        "source string, page_index int, url string, error string, duration_ms long",
    )
    row = ("s3", "https://s3.example.com/p/1", "Gale Zephyr City 4 Running Shoes", "Gale", None, None, "running", None, None, 80.0, None, True, None, None, 0, 0, 0)
    kinds = dict.fromkeys(RAW, "string") | {"price_current": "double", "price_original": "double", "in_stock": "boolean"}
    kinds |= dict.fromkeys(["page_index", "extractor_rank", "pos"], "int")
    fixture = spark.createDataFrame([row], "source string, " + ", ".join(f"{c} {kinds[c]}" for c in RAW))
    retailers = spark.createDataFrame(
        [(f"s{i}", f"Shop {i}", "CA", "CAD", f"https://s{i}.example.com", f"https://s{i}.example.com/i", None, None) for i in range(1, 6)],
        schemas.RETAILERS,
    )
    disabled = spark.createDataFrame([("s4",)], schemas.DISABLED)
    thrown = spark.createDataFrame([("s5", None, 2)], "retailer_id string, error string, duration_ms long")
    run = publish_run(pages, log, fixture, retailers, disabled, thrown, F.lit(DAY))
    root = str(tmp_path / "data")
    write_snapshot(run.tables(), root, "2024-03-01")
    data = load_dataset(spark, root, "2024-03-01", check="enforce")
    assert data.offers.count() == 4
    assert (data.shoes.count(), data.deals.count(), data.aliases.count()) == (3, 3, 3)
    told = {r["retailer_id"]: r for r in data.source_health.collect()}
    assert {k: r["status"] for k, r in told.items()} == {"s1": "ok", "s2": "ok", "s3": "failed", "s4": "disabled", "s5": "failed"}
    assert (told["s1"]["offers_count"], told["s1"]["warning_rows"], told["s1"]["pages_crawled"]) == (2, 1, 1)
    assert (told["s3"]["warns_fixture"], told["s3"]["execution_path"], told["s3"]["warning_rows"]) == (True, "fixture", 2)
    said = [(r["retailer_id"], r["text"]) for r in data.warnings.orderBy("retailer_id", "pos").collect()]
    assert [s for s, _ in said] == ["s1", "s3", "s3", "s5"]
    assert [t for _, t in said[:2]] == ["s1: HTTP 500", "s3: HTTP 404"] and said[3][1] == "s5: parser failed."
    assert said[2][1].startswith("s3: No offers extracted from live pages, loaded fixture data. Blocker hint: url-drift")
    row = data.metadata.first()
    assert (row["offers_count"], row["shoes_count"], row["retailers_count"], row["stale"]) == (4, 3, 5, False)
    crawled = {r["retailer_id"] for r in data.retailers.where("last_crawled_at is not null").collect()}
    assert crawled == {"s1", "s2"}
    assert validate_snapshot(data).count() == 0


def test_broken_pages_do_not_stop_a_run(spark):
    surrogate = '<script>window.s = {"items":[{"title":"Acme Rapid 5 Running Shoes \\ud83d","price":50,"url":"/p/1"}]};</script>'
    listed = '<script>{"items":[{"name":["Acme Rapid 5 Running Shoes"],"title":"Acme Rapid 5 Running Shoes","price":50}]}</script>'
    pages = spark.createDataFrame(
        [("a", 0, "https://a.com/x", None), ("b", 0, "https://b.com/x", surrogate), ("c", 0, "https://c.com/x", listed), ("d", 0, "https://d.com/x", "")], PAGES
    )
    offers, discovered = extract_offers(pages)
    assert [(r["source"], r["price_current"]) for r in offers.collect()] == [("b", 50.0)]
    assert discovered.count() == 1
    title = "<title>\nAcme Rapid 5 Running Shoes | Shop\n</title>pr%3D99.00"
    detail = spark.createDataFrame([("e", 0, "https://e.com/pdp/1", title)], PAGES)
    assert extract_tracking(detail).first()["title_raw"] == "Acme Rapid 5 Running Shoes | Shop"


def test_hinted_scripts_come_first(spark):
    one = '<script>{"a":[{"name":"Acme Rapid 5 Running Shoes","price":50,"url":"/p/1"}]}</script>'
    other = '<script id="__STATE">{"b":[{"name":"Dune Mirage 12 Running Shoes","price":60,"url":"/p/2"}]}</script>'
    pages = spark.createDataFrame([("a", 0, "https://a.com/x", one + other)], PAGES)

    def first(hints):
        return extract_state(pages, hints).orderBy("pos").first()["title_raw"][:4]

    assert first(None) == "Acme"
    assert first(ScriptHints(script_ids=("__state",))) == "Dune"
    assert first(ScriptHints(root_keys=("B",))) == "Dune"
    assert first(ScriptHints(global_keys=("nowhere",))) == "Acme"


class Listed:
    """An extractor of a caller: one offer a line ``offer|title|price``."""

    rank = 9

    def offers(self, pages):
        lines = pages.select("source", "page_index", "base_url", F.posexplode(F.regexp_extract_all("html", F.lit(r"offer\|[^|<]+\|[0-9.]+"), F.lit(0))).alias("pos", "line"))
        part = F.split("line", r"\|")
        return lines.select("source", "page_index", "base_url", "pos", part[1].alias("title_raw"), part[1].alias("model_raw"), part[2].alias("price_current"), F.col("base_url").alias("url"))


def test_extractors_and_rules_can_be_added(spark):
    """Neither needs a change of the library: an extractor is an object, rules are a table."""
    html = product("Acme Rapid 5 Running Shoes", 50, "/p/1") + "<p>offer|Dune Mirage 12 Running Shoes|60</p><p>offer|Crest Ridge Shoes|70</p>"
    pages = spark.createDataFrame([("a", 0, "https://a.com/x", html), ("b", 0, "https://b.com/x", None)], PAGES)
    offers, discovered = extract_offers(pages, others=[Listed()])
    assert [(r["title_raw"][:4], r["price_current"]) for r in offers.orderBy("extractor_rank", "pos").collect()] == [("Acme", 50.0), ("Dune", 60.0), ("Cres", 70.0)]
    assert discovered.first()["discovered_count"] == 3
    table = spark.createDataFrame([(2, "Shoes", "running"), (1, "RIDGE", "trail")], "pos int, token string, category string")
    decided = offers.select(decide_category("title_raw", F.lit("road"), table).alias("c"), "title_raw")
    assert {r["title_raw"][:4]: r["c"] for r in decided.collect()} == {"Acme": "running", "Dune": "running", "Cres": "trail"}
    assert {r["c"] for r in offers.select(decide_category("title_raw", F.lit("road"), table.where("false")).alias("c")).collect()} == {"road"}

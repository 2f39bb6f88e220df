"""Raw offers to catalogue, search, audit and validation on a small hand-made set."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from offerloom.operators import health, match, search
from offerloom.operators.audit import CoverageBreach, fixture_rate
from offerloom.operators.rollup import canonical_products, product_aliases, with_aliases
from offerloom.operators.validate import CONTRACTS
from offerloom.plans.audit import run_audit
from offerloom.plans.check import validate_snapshot
from offerloom.plans.ingest import build_catalogue, clean_offers
from offerloom.sources import schemas
from offerloom.sources.tables import load_benchmarks, load_dataset, load_or_empty, write_snapshot, write_tickets

RAW = (
    "seq int, retailer_id string, url string, title_raw string, brand string, model_raw string, gender string, category string, "
    "colorway string, size_range string, price_current double, price_original double, in_stock boolean, sku string, gtin string, "
    "used_fixture boolean, scraped_at timestamp"
)
DAY = dt.datetime(2024, 3, 1, 12)

# (shop, brand, model, sku, price): three rows share a sku, three pairs share one, eight stand alone.
ROWS = [
    ("s1", "Acme", "Rapid 5", "ac-rp5 01", 118.5), ("s2", "ACME", "RAPID 5", "AC-RP5-01", 112.25),
    ("s3", "Acme", "Rapid-5", "ACRP501", 109.0), ("s4", "Borealis", "Drift X 900 v2", "bo-900", 140.0),
    ("s5", "Borealis", "Drift X 900v2", "BO900", 131.4), ("s6", "Cobalt", "Anchor 7", "cob-7", 99.9),
    ("s7", "cobalt", "Anchor 7", "COB7", 104.2), ("s8", "Dune", "Mirage 12", "dun12", 158.0),
    ("s9", "dune", "Mirage 12 W", "DUN-12", 151.75), ("s10", "Ember", "Ridgefox 3", "e1", 163.3),
    ("s11", "Fjord", "Skerry 8", "f1", 121.1), ("s12", "Gale", "Zephyr City 4", "g1", 143.0),
    ("s13", "Ember", "Kiln 6", "e2", 167.6), ("s14", "Fjord", "Cove 21", "f2", 155.5),
    ("s15", "Helix", "Strand Tempo 2", "x1", 172.0), ("s16", "Ion", "Cloudbank 9", "x2", 188.8),
    ("s17", "Juniper Works", "Echo 15", "x3", 106.6),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (i, shop, f"https://{shop}.example.com/products/{i}", f"{brand} {model} Running Shoes", brand, model, None,
         "running", None, None, price, 230.0, True, sku, None, False, DAY)
        for i, (shop, brand, model, sku, price) in enumerate(ROWS)
    ]
    junk = (99, "s1", "https://s1.example.com/x", "Add to wish list", None, None, None, None, None, None, 5.0, None, True, None, None, False, DAY)
    return spark.createDataFrame([*rows, junk, (100, *rows[0][1:])], RAW)


@pytest.fixture(scope="module")
def catalogue(raw):
    c = build_catalogue(clean_offers(raw, [("ridgefox", "trail")]))
    return type(c)(*(df.cache() for df in (c.offers, c.shoes, c.aliases, c.deals)))


def test_seventeen_offers_twelve_products(catalogue):
    assert catalogue.offers.count() == 17
    assert catalogue.shoes.count() == 12
    assert catalogue.deals.count() == 12
    best = {r["shoe_id"]: r for r in catalogue.deals.collect()}
    rapid = with_aliases(catalogue.shoes, catalogue.aliases).filter("brand = 'Acme'").first()
    assert (best[rapid["shoe_id"]]["best_price"], best[rapid["shoe_id"]]["offers_count"]) == (109.0, 3)
    assert (rapid["aliases"], rapid["alias_count"]) == (["rapid-5"], 1)
    assert catalogue.shoes.filter("category = 'trail'").select("model").first()["model"] == "ridgefox-3"


def test_search(catalogue):
    def count(**f):
        found = search.search_deals(catalogue.deals, catalogue.published_offers(), catalogue.shoes, search.DealFilter(**f))
        return found.count()

    assert count() == 12
    assert count(brand="Dune") == 1
    assert count(brand="Dune", query="Mirage 12") == 1
    assert count(brand="Dune", query="anchor") == 0
    assert count(brand="Dune", query="mirage-12") == 1
    assert count(category="trail") == 1
    assert count(min_price=150.0, max_price=170.0) == 4


def test_snapshot_round_trip_and_validation(spark, catalogue, tmp_path):
    retailers = spark.createDataFrame(
        [(f"s{i}", f"Shop {i}", "CA", "CAD", f"https://s{i}.example.com", f"https://s{i}.example.com/i", None, DAY) for i in range(1, 17)],
        schemas.RETAILERS,
    )
    told = spark.createDataFrame([("s1", "ok", 1, 0, False, 5, 1, 1, 1, "live", "http")], schemas.SOURCE_HEALTH)
    tables = {
        "retailers": retailers, "offers": catalogue.published_offers(), "shoes": catalogue.shoes.drop("first_seq"), "aliases": catalogue.aliases.drop("first_seen"),
        "deals": catalogue.deals.drop("first_seq"), "source_health": told,
        "warnings": spark.createDataFrame([("s1", 0, "s1: slow")], schemas.WARNINGS),
        "metadata": spark.createDataFrame([(DAY, 36.0, False, DAY, 16, 17, 12, 11, 1.0, 0.0, 0.1)], schemas.METADATA),
    }
    root = str(tmp_path / "data")
    write_snapshot(tables, root, "2024-03-01")
    write_snapshot(tables, root, "2024-03-02")
    data = load_dataset(spark, root, "2024-03-01", check="off")
    report = spark.createDataFrame([(1.0, 0.25, 0.1)], "aggregate_recall double, fixture_usage_rate double, fixture_usage_threshold double")
    found = {(r["kind"], r["detail"]) for r in validate_snapshot(data, report).collect()}
    # Shop 17 has no retailer row, one published count is off and one figure differs from the report's.
    assert found == {("foreign-key", "offer->retailer s17"), ("count", "deals"), ("report", "fixture_usage_rate")}
    assert {r["kind"] for r in validate_snapshot(data).collect()} == {"foreign-key", "count"}
    assert load_dataset(spark, root, "2024-03-02").offers.count() == 17


def test_sorted_search(catalogue):
    found = search.sort_deals(
        search.search_deals(catalogue.deals, catalogue.published_offers(), catalogue.shoes, search.DealFilter()), "lowest-price"
    ).collect()
    keys = [(r["best_price"], -(r["max_discount_pct"] or 0), r["first_seq"]) for r in found]
    assert keys == sorted(keys)


def test_aliases_stay_whole(spark):
    rows = [(i, "p", None, f"m-{i % 7}", "running", None, None) for i in range(50)]
    offers = spark.createDataFrame(
        rows, "seq int, shoe_id string, brand string, model_normalized string, category string, sku string, gtin string"
    )
    product = with_aliases(canonical_products(offers), product_aliases(offers)).first()
    assert (product["aliases"], product["alias_count"]) == ([f"m-{i}" for i in range(7)], 7)


def test_a_product_with_very_many_spellings_keeps_its_contract(spark):
    offers = spark.range(10_500).select(
        F.col("id").alias("seq"), F.lit("p").alias("shoe_id"), F.lit("b").alias("brand"), F.concat(F.lit("m-"), "id").alias("model_normalized"),
        F.lit("running").alias("category"), F.lit(None).cast("string").alias("sku"), F.lit(None).cast("string").alias("gtin"),
    )
    product = CONTRACTS["shoes"].enforce(canonical_products(offers)).first()
    assert (product["model"], product["alias_count"]) == ("m-0", 10_500)
    assert product_aliases(offers).count() == 10_500


def test_many_warnings_still_count(spark):
    pages = spark.createDataFrame(
        [("s1", 3, 5, False, True, "http", 0), ("s2", 0, 5, False, False, "http", 0), ("s2", 2, 1, False, True, "browser", 1)],
        "retailer_id string, discovered_count long, duration_ms long, used_fixture boolean, ok boolean, execution_path string, path_rank int",
    )
    said = spark.range(1001).select(F.lit("s1").alias("retailer_id"), F.col("id").alias("pos"), F.lit("Loaded FIXTURE rows").alias("text"))
    rows = spark.createDataFrame([("s1",), ("s1",), ("s2",)], "retailer_id string")
    found = health.source_health(pages, said, rows, rows.limit(1))
    got = {r["retailer_id"]: r for r in found.collect()}
    assert (got["s1"]["warning_rows"], got["s1"]["warns_fixture"], got["s1"]["parsed_count"], got["s1"]["offers_count"]) == (1001, True, 2, 1)
    assert (got["s2"]["execution_path"], got["s2"]["warning_rows"], got["s2"]["offers_count"]) == ("browser", 0, 0)
    assert health.health_summary(found).first()["headline"] == "1/2 healthy"
    assert fixture_rate(found).first()["fixture_hits"] == 1
    text = health.global_warnings(found.join(health.joined_warnings(said), "retailer_id", "left")).collect()
    assert [(r["retailer_id"], r["text"].count("|")) for r in text] == [("s1", 1000)]
    thrown = spark.createDataFrame([("s3", None, 7), ("s4", "no fixture", 7)], "retailer_id string, error string, duration_ms long")
    lost = health.thrown_health(thrown)
    assert [r["warning"] for r in lost.orderBy("retailer_id").collect()] == ["Unknown parser failure.", "no fixture"]
    named = health.global_warnings(lost, thrown).orderBy("retailer_id").collect()
    assert [r["text"] for r in named] == ["s3: parser failed.", "s4: parser failed."]


def test_contract_modes(spark):
    rows = spark.createDataFrame([("retailer", "a", 1), ("aggregate", None, 2), ("retailer", "", -1)], schemas.STATE)
    contract = CONTRACTS["coverage_state"]
    good, bad = contract.quarantine(rows)
    assert good.count() == 2
    assert bad.first()["violations"] == ["failures:range", "retailer_id:only-for-retailer"]
    with pytest.raises(Exception, match="coverage_state"):
        contract.enforce(rows).collect()


def test_match_cases(spark):
    cand = "cand_id int, brand string, model string, category string, sku string, gtin string"
    cat = "ord int, shoe_id string, brand string, model string, category string, sku string, gtin string"
    candidates = spark.createDataFrame(
        [
            (1, "Acme", "something else", "running", "acme-rp5-w-77", None),
            (2, None, "Drift Light 900 v2", "running", None, None),
            (3, "Acme", "Rapid Glide", "running", None, None),
            (4, "Acme", "rapid tempo 5", "trail", None, None),
        ],
        cand,
    )
    catalog = spark.createDataFrame(
        [
            (1, "a", "Acme", "rapid-tempo-5", "running", "ACMERP5W77", None),
            (2, "b", "Borealis", "drift-light-900-v2", "running", None, None),
            (3, "c", "Acme", "rapid-glide-8", "running", None, None),
            (4, "d", "Acme", "rapid-glide-9", "running", None, None),
        ],
        cat,
    )
    got = {r["cand_id"]: (r["shoe_id"], r["reason"], r["confidence"]) for r in match.resolve_matches(candidates, catalog).collect()}
    assert got == {1: ("a", "exact-id", 1.0), 2: ("b", "model-fallback", 1.0), 3: (None, "none", 0.0), 4: (None, "none", 0.0)}


def test_audit_breach_on_fixture_use(spark, tmp_path):
    bench = spark.createDataFrame([("s1", [], 1)], schemas.BENCHMARK)
    offers = spark.createDataFrame([("s1", "m-1")], "retailer_id string, model_normalized string")
    told = spark.createDataFrame([("s1", "failed", 1, 0, False, 5, 1, 1, 1, "fixture", "fixture")], schemas.SOURCE_HEALTH)
    state = load_or_empty(spark, str(tmp_path / "none"), schemas.STATE)
    off = spark.createDataFrame([], schemas.DISABLED)
    r = run_audit(bench, offers, told, state, off, F.lit("2024-03-02 14:39:54.280").cast("timestamp"))
    assert [(b["scope"], b["recall"]) for b in r.breaches.collect()] == [("fixture", 1.0)]
    assert r.retailers.first()["pass"] is True
    assert CONTRACTS["coverage_report"].enforce(r.report()).first()["per_retailer_recall"] == {"s1": 1.0}
    assert sorted(map(tuple, r.state.collect())) == [("aggregate", None, 0), ("retailer", "s1", 0)]


def test_streaks_of_two_runs(spark):
    bench = spark.createDataFrame([("s1", ["m-1", "m-2"], None), ("s2", ["m-1"], None)], schemas.BENCHMARK)
    offers = spark.createDataFrame([("s2", "m-1")], "retailer_id string, model_normalized string")
    told = spark.createDataFrame([], schemas.SOURCE_HEALTH)
    state, off = spark.createDataFrame([("retailer", "s9", 4)], schemas.STATE), spark.createDataFrame([], schemas.DISABLED)
    for n in (1, 2):
        r = run_audit(bench, offers, told, state, off, F.lit("2024-03-02").cast("timestamp"))
        streaks = {(s["scope"], s["retailer_id"]): s["failures"] for s in r.state.collect()}
        assert streaks == {("retailer", "s1"): n, ("retailer", "s2"): 0, ("retailer", "s9"): 4, ("aggregate", None): n}
        assert {b["scope"]: b["consecutive_failures"] for b in r.breaches.collect()} == {"retailer": n, "aggregate": n}
        state = spark.createDataFrame(CONTRACTS["coverage_state"].enforce(r.state).collect(), schemas.STATE)
    assert [d["retailer_id"] for d in r.disabled.collect()] == ["s1"]


def test_fixture_breach_ticket(spark, tmp_path):
    bench = spark.createDataFrame([("s1", [], 1)], schemas.BENCHMARK)
    offers = spark.createDataFrame([("s1", "m-1")], "retailer_id string, model_normalized string")
    told = spark.createDataFrame([("s1", "failed", 1, 0, False, 5, 1, 1, 1, "fixture", "fixture")], schemas.SOURCE_HEALTH)
    off, state = spark.createDataFrame([], schemas.DISABLED), spark.createDataFrame([], schemas.STATE)
    r = run_audit(bench, offers, told, state, off, F.lit("2024-03-02 14:39:54.280").cast("timestamp"))
    ticket = r.tickets.first()
    assert ticket["ticket_name"] == "2024-03-02T14-39-54-280Z-fixture-fixture-usage.md"
    assert "- Fixture usage rate: 1.0000" in ticket["body"]
    for _ in range(2):  # writing again replaces
        write_tickets(r.tickets, str(tmp_path / "tickets"))
    assert spark.read.text(str(tmp_path / "tickets")).where("value like '# Coverage breach%'").count() == 1
    with pytest.raises(CoverageBreach, match="1 fixture"):
        r.raise_on_breach()


def test_benchmark_folder(spark, tmp_path):
    folder = tmp_path / "bench"
    folder.mkdir()
    (folder / "a.json").write_text('{"retailer_id": "s1", "expected_count": 2}')
    (folder / "b.json").write_text('{"retailer_id": "s2", "expected_models": ["x"]}')
    assert {r["retailer_id"]: r["expected_models"] for r in load_benchmarks(spark, str(folder)).collect()} == {"s1": [], "s2": ["x"]}
    (folder / "c.json").write_text('{"retailer_id": "s1"}')
    with pytest.raises(ValueError, match="duplicate"):
        load_benchmarks(spark, str(folder))

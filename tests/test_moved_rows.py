"""What joins and windows move between tasks."""

from pyspark.sql import functions as F

from offerloom.operators import dedupe, search

OFFERS = "seq long, retailer_id string, url string, model_normalized string, category string, gender string, size_range string, sku string, gtin string, price_current double"


def test_dedupe_moves_one_short_key(spark):
    """Keys that are null, empty, or run together differently stay apart; rows are dealt by one short key."""
    same = ("r", "https://a.example/x", "m", "trail", None, None, None, None, 1.0)
    rows = [
        (2, *same), (1, *same),
        (3, None, *same[1:]), (4, "", *same[1:]), (5, "-", *same[1:]),
        (6, *same[:2], "m1:t", "rail", *same[4:]), (7, *same[:2], "m", "1:trail", *same[4:]), (8, *same[:3], None, *same[4:]),
        (9, *same[:4], "", *same[5:]), (10, *same[:8], None), (11, *same[:8], None),
    ]
    first = dedupe.dedupe_offers(spark.createDataFrame(rows, OFFERS))
    # An absent gender and an empty one are the same.
    assert sorted(r["seq"] for r in first.collect()) == [1, 3, 4, 5, 6, 7, 8, 10]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key#" in plan and "_key" not in first.columns


def test_related_offers_are_sorted_before_they_are_told_per_product(spark, monkeypatch):
    monkeypatch.setattr(search, "LISTED", 2)
    offers = spark.createDataFrame(
        [(i, f"o{i % 4}", "x", "m" if i % 3 else None, "B" if i % 2 else None, "trail", float(i % 5), i % 2 == 0, 0.9) for i in range(12)],
        "seq long, offer_id string, shoe_id string, model_normalized string, brand string, category string, price_current double, in_stock boolean, source_confidence double",
    )
    shoes = spark.createDataFrame(
        [*((f"p{i}", "B" if i % 2 else None, "m", "trail") for i in range(5)), ("p1", "B", "m", "trail"), (None, "B", "m", "trail"), ("q", "B", None, "trail")],
        "shoe_id string, brand string, model string, category string",
    )
    listed = search.related_offers(offers, shoes, by="attributes", listed=True)
    found = search.each_product(search.sort_related(listed))
    plain = search.related_offers(offers, shoes, by="attributes")
    assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    # Every offer with a model has 3 or 4 products, two of which are one row to the sort.
    assert listed.count() == 8 * 2 and plain.count() == 4 * 3 + 4 * 4
    got = [(not r["in_stock"], r["price_current"], r["seq"]) for r in found.collect()]
    assert got == sorted(got)
    own = search.related_offers(offers, shoes.withColumn("shoe_id", F.lit("x")).limit(1), listed=True)
    assert search.each_product(own).select("shoe_id").distinct().collect() == [("x",)]

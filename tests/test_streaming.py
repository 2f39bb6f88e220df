"""Incremental runs give what the batch gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from offerloom.operators.audit import _place, _time_bounds, streak_history
from offerloom.plans.ingest import build_catalogue, clean_offers
from offerloom.plans.check import validate_snapshot
from offerloom.plans.publish import RAW as RAW_COLUMNS
from offerloom.plans.publish import Sources, publish_run
from offerloom.sources import schemas
from offerloom.sources.tables import load_dataset, write_snapshot
from offerloom.streaming.daily import ingest_drops, ingest_pages
from offerloom.streaming.streaks import stream_streaks
from test_pipeline import DAY, RAW, ROWS
from test_publish import product


def test_streaks_equal_history(spark, tmp_path):
    rows = [
        (f"s{s}", dt.datetime(2024, 1, d), (s * d) % 3 == 0) for s in range(1, 5) for d in range(1, 9)
    ]
    schema = "retailer_id string, run_at timestamp, pass boolean"
    src = str(tmp_path / "in")
    first = [r for r in rows if r[1].day <= 4]
    rest = [r for r in rows if r[1].day > 4]
    for part in (first, rest):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        query = (
            stream_streaks(spark.readStream.schema(schema).parquet(src))
            .writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "cp"))
            .option("path", str(tmp_path / "out"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("retailer_id", "run_at", "pass", "consecutive_failures", "auto_disabled")
    want = streak_history(spark.createDataFrame(rows, schema)).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_streaks_go_on_from_the_batch_table(spark, tmp_path):
    """The batch audits the first days and writes its state; the stream starts from it and is stopped once."""
    rows = [(f"s{s}", dt.datetime(2024, 1, d), (s * d) % 4 == 0) for s in range(1, 6) for d in range(1, 13)]
    schema = "retailer_id string, run_at timestamp, pass boolean"
    history = streak_history(spark.createDataFrame(rows, schema))
    batch = history.where("run_at = timestamp '2024-01-04'")
    state = batch.select(F.lit("retailer").alias("scope"), "retailer_id", F.col("consecutive_failures").alias("failures"))
    state = state.unionByName(spark.createDataFrame([("retailer", "quiet", 3), ("aggregate", None, 9)], "scope string, retailer_id string, failures long"))
    state.write.parquet(str(tmp_path / "state"))
    src = str(tmp_path / "in")
    for low, high in ((5, 8), (9, 12)):
        part = [r for r in rows if low <= r[1].day <= high] + [("new", dt.datetime(2024, 1, low), False)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        streaks = stream_streaks(spark.readStream.schema(schema).parquet(src), spark.read.parquet(str(tmp_path / "state")))
        query = (
            streaks.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
            .option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = history.where("run_at > timestamp '2024-01-04'").select(*got.columns)
    assert sorted(got.where("retailer_id <> 'new'").collect()) == sorted(want.collect())
    assert [r["consecutive_failures"] for r in got.where("retailer_id = 'new'").orderBy("run_at").collect()] == [1, 2]


@pytest.mark.parametrize("segment", [1, 7, 40, 10_000])
def test_segments_of_a_history(spark, segment):
    """One source with most runs, one that always fails, null sources and results, equal times for different sources."""
    dice = random.Random(segment)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", start + dt.timedelta(minutes=i), dice.random() < 0.1) for i in range(300)]
    rows += [("bad", start + dt.timedelta(minutes=7 * i), False) for i in range(40)]
    rows += [(None, start + dt.timedelta(minutes=11 * i), None if i % 5 else True) for i in range(25)]
    rows += [("once", start, False), ("late", start + dt.timedelta(days=9), False)]
    want, streak = set(), {}
    for key, at, ok in sorted(rows, key=lambda r: r[1]):
        streak[key] = 0 if ok else streak.get(key, 0) + 1
        want.add((key, at, streak[key], streak[key] >= 2))
    schema = "retailer_id string, run_at timestamp, pass boolean"
    df = streak_history(spark.createDataFrame(rows, schema).repartition(3), segment_rows=segment)
    got = [(r["retailer_id"], r["run_at"], r["consecutive_failures"], r["auto_disabled"]) for r in df.collect()]
    assert len(got) == len(rows) and set(got) == want
    assert streak_history(spark.createDataFrame([], schema), segment_rows=segment).count() == 0


def test_hot_source_is_many_tasks(spark):
    """A million runs of one source: no group of the plan holds more than a few blocks of them."""
    runs = spark.range(1_000_000).selectExpr("'hot' AS retailer_id", "timestamp_seconds(id) AS run_at", "id % 1000 = 0 AS pass")
    bounds = _time_bounds(runs, "run_at", 20_000)
    assert len(bounds) == 50
    place = _place(F.unix_micros("run_at"), bounds)
    sizes = [r["count"] for r in runs.groupBy(place.alias("p")).count().collect()]
    assert len(sizes) == 51 and max(sizes) < 25_000
    last = streak_history(runs, segment_rows=20_000).agg(F.max("consecutive_failures"), F.count("*"), F.sum("consecutive_failures")).first()
    assert tuple(last) == (999, 1_000_000, 1000 * sum(range(1000)))


def page(source, index, *items, error=None):
    html = None if error else "".join(product(name, price, f"/p/{k}") for name, price, k in items)
    return (source, index, f"https://{source}.example.com/list?page={index}", html, f"https://{source}.example.com/list?page={index}", error, 5)


def test_page_drops_equal_one_run(spark, tmp_path):
    """Two drops of one day; the second has new sources, a source with more pages and a page that is fetched again."""
    first = [
        page("s1", 0, ("Acme Rapid 5 Running Shoes", 99.5, 1), ("Dune Mirage 12 Trail Shoes", 120, 2)),
        page("s2", 0, ("Acme Rapid 5 Running Shoes", 95, 7), ("Gale Zephyr City 4 Running Shoes", 70, 8)),
        page("s3", 0, error="HTTP 404"),
    ]
    second = [
        page("s0", 0, ("Acme Rapid 5 Pro Running Shoes", 101, 3), ("Dune Mirage 12 Trail Shoes", 118, 4)),
        page("s2", 1, ("Acme Rapid 6 Running Shoes", 105, 9)),
        page("s1", 0, ("Dune Mirage 12 Trail Shoes", 119, 2), ("Crest Ridge 3 Trail Shoes", 88, 5)),
        page("s4", 0, ("Off Shoe 1 Running Shoes", 1, 1)),
    ]
    row = ("s3", "https://s3.example.com/p/1", "Gale Zephyr City 4 Running Shoes", "Gale", None, None, "running", None, None, 80.0, None, True, None, None, 0, 0, 0)
    kinds = dict.fromkeys(RAW_COLUMNS, "string") | {"price_current": "double", "price_original": "double", "in_stock": "boolean"}
    kinds |= dict.fromkeys(["page_index", "extractor_rank", "pos"], "int")
    retailers = [(f"s{i}", f"Shop {i}", "CA", "CAD", f"https://s{i}.example.com", f"https://s{i}.example.com/i", None, None) for i in range(6)]
    sources = Sources(
        spark.createDataFrame([row], "source string, " + ", ".join(f"{c} {kinds[c]}" for c in RAW_COLUMNS)),
        spark.createDataFrame(retailers, schemas.RETAILERS),
        spark.createDataFrame([("s4",)], schemas.DISABLED),
        spark.createDataFrame([("s5", None, 2)], "retailer_id string, error string, duration_ms long"),
    )
    day, src, root = dt.date(2024, 3, 1), str(tmp_path / "drops"), str(tmp_path / "data")
    now = dt.datetime(2024, 3, 1, 12)
    for part in (first, second):
        spark.createDataFrame([(day, *r) for r in part], schemas.FETCHED).coalesce(1).write.mode("append").parquet(src)
        ingest_pages(spark, src, root, str(tmp_path / "cp"), sources, lambda _: F.lit(now)).awaitTermination()
    last = {(r[0], r[1]): r for r in first + second}
    columns = "source string, page_index int, base_url string, html string, url string, error string, duration_ms long"
    pages = spark.createDataFrame(list(last.values()), columns)
    log = pages.select("source", "page_index", "url", "error", "duration_ms")
    whole = publish_run(pages, log, sources.fixture, sources.retailers, sources.disabled, sources.thrown, F.lit(now))
    write_snapshot(whole.tables(), str(tmp_path / "whole"), "2024-03-01")
    got, want = load_dataset(spark, root, "2024-03-01", check="enforce"), load_dataset(spark, str(tmp_path / "whole"), "2024-03-01")
    for name in schemas.PUBLISHED:
        a, b = getattr(got, name).collect(), getattr(want, name).collect()
        assert sorted(map(str, a)) == sorted(map(str, b)), name
        assert a, name
    assert got.offers.count() == 8
    assert validate_snapshot(got).count() == 0
    # Sources that no drop touched again were worked through once.
    kept = spark.read.parquet(f"{root}/_pages/{day}/live").groupBy("batch_id").agg(F.collect_set("source").alias("s")).orderBy("batch_id")
    assert [sorted(r["s"]) for r in kept.collect()] == [["s1", "s2"], ["s0", "s1", "s2"]]


def test_daily_drops_equal_batch(spark, tmp_path):
    rows = [
        (i, shop, f"https://{shop}.example.com/products/{i}", f"{brand} {model} Running Shoes", brand, model, None,
         "running", None, None, price, 230.0, True, sku, None, False, DAY)
        for i, (shop, brand, model, sku, price) in enumerate(ROWS)
    ]
    src, root = str(tmp_path / "drops"), str(tmp_path / "data")
    schema = RAW + ", drop_date date"
    day = dt.date(2024, 3, 1)
    for part in (rows[:9], rows[9:]):
        spark.createDataFrame([(*r, day) for r in part], schema).coalesce(1).write.mode("append").parquet(src)
        ingest_drops(spark, src, schema, root, str(tmp_path / "cp")).awaitTermination()
    batch = build_catalogue(clean_offers(spark.createDataFrame(rows, RAW)))
    cols = ["shoe_id", "best_offer_id", "best_price", "offers_count", "max_discount_pct"]
    got = spark.read.parquet(f"{root}/deals").filter(F.col("snapshot_date") == F.lit(day)).select(*cols)
    assert sorted(got.collect()) == sorted(batch.deals.select(*cols).collect())

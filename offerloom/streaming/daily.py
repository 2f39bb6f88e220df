"""Daily drops: raw offers, or fetched pages that are worked through as they come."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerloom.operators.extract import ScriptHints, extract_offers
from offerloom.plans.ingest import TokenRules, build_catalogue, clean_offers
from offerloom.plans.publish import Sources, publish_extracted
from offerloom.session import drop_folder
from offerloom.sources import schemas
from offerloom.sources.tables import write_snapshot


def ingest_drops(
    spark: SparkSession,
    drops: str,
    schema: str,
    root: str,
    checkpoint: str,
    token_rules: TokenRules | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Read new raw-offer files, rebuild the catalogue of each day they belong to.

    ``availableNow`` drains what has arrived and stops.  A batch rewrites the
    raw partitions of its batch id (so a replay changes nothing) and rebuilds
    every touched day from all raw rows of that day: a full rebuild, equal to
    the batch run on the same rows.  ``schema`` must hold ``drop_date``.
    """
    raw = f"{root}/raw_offers"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("drop_date", "batch_id").parquet(raw)
        # Days are calendar days of one drop: a handful.
        days = [r["drop_date"] for r in batch.select("drop_date").distinct().collect()]
        for day in days:
            rows = spark.read.parquet(raw).filter(F.col("drop_date") == F.lit(day)).drop("batch_id", "drop_date")
            c = build_catalogue(clean_offers(rows, token_rules))
            write_snapshot(
                {"offers": c.published_offers(), "offer_shoe": c.offer_shoe(), "shoes": c.shoes.drop("first_seq"),
                 "aliases": c.aliases.drop("first_seen"), "deals": c.deals.drop("first_seq")},
                root,
                str(day),
            )

    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .load(drops)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class PageStore:
    """What is kept of one day's pages below ``folder``: pages, what was found in them, and the last clustering.

    Every batch writes its own folders, so a batch that is run again replaces what it wrote.  Of a source the rows of
    the last batch that touched it stand.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, name: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch_id={batch_id}")

    def read(self, name: str, batch_id: int) -> DataFrame:
        """Rows of all batches up to one."""
        return self.spark.read.parquet(f"{self.folder}/{name}").filter(F.col("batch_id") <= batch_id)

    def standing(self, name: str, batch_id: int) -> DataFrame:
        """Rows of every source from the last batch that touched it."""
        last = self.read("touched", batch_id).groupBy("source").agg(F.max("batch_id").alias("batch_id"))
        return self.read(name, batch_id).join(last, ["source", "batch_id"], "left_semi").drop("batch_id")

    def settled(self, batch_id: int) -> int | None:
        """The last batch before this one that left a clustering."""
        try:
            done = self.read("settled", batch_id - 1).agg(F.max("batch_id")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return done

    def clustering(self, batch_id: int) -> str:
        return f"{self.folder}/clustering/batch_id={batch_id}"


def ingest_day(
    store: PageStore, fetched: DataFrame, batch_id: int, sources: Sources, now: Column, root: str, day: str,
    token_rules: TokenRules | None = None, patches: DataFrame | None = None, hints: ScriptHints | None = None,
) -> None:
    """Take one batch of a day's pages and publish the day again.

    Only sources of the batch are worked through again (all their pages of the day), and the clustering goes on from
    the one before: offers of the other sources are decided again only where they see what changed.
    """
    spark = store.spark
    store.write("pages", fetched, batch_id)
    store.write("touched", fetched.select("source").distinct(), batch_id)
    touched = store.read("touched", batch_id).filter(F.col("batch_id") == batch_id).drop("batch_id")
    everything = store.read("pages", batch_id)
    # A page that is fetched again replaces the older one.
    newest = F.max_by(F.struct("base_url", "html", "url", "error", "duration_ms"), "batch_id")
    pages = everything.join(touched, "source", "left_semi").groupBy("source", "page_index").agg(newest.alias("p")).select("source", "page_index", "p.*")
    live, discovered = extract_offers(sources.active(pages), hints=hints)
    store.write("live", live, batch_id)
    store.write("discovered", discovered, batch_id)
    log = everything.groupBy("source", "page_index").agg(F.max_by(F.struct("url", "error", "duration_ms"), "batch_id").alias("p")).select("source", "page_index", "p.*")
    before = store.settled(batch_id)
    keep = store.clustering(batch_id)
    run = publish_extracted(
        store.standing("live", batch_id), store.standing("discovered", batch_id), log, sources, now, token_rules, patches,
        None if before is None else store.clustering(before), keep,
    )
    write_snapshot(run.tables(), root, day)
    store.write("settled", spark.createDataFrame([(day,)], "day string"), batch_id)
    if before is not None:
        drop_folder(spark, store.clustering(before))


def ingest_pages(
    spark: SparkSession,
    drops: str,
    root: str,
    checkpoint: str,
    sources: Sources,
    now: Callable[[date], Column],
    token_rules: TokenRules | None = None,
    patches: DataFrame | None = None,
    hints: ScriptHints | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Read new page files (``schemas.FETCHED``) and publish every day they belong to.

    ``availableNow`` drains what has arrived and stops.  ``now`` gives the time a day's run counts as.  The published
    tables are those of ``publish_run`` over all pages of the day.  ``root`` opens with ``load_dataset``; what is kept
    between runs lies beside it under ``root/_pages``.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # Days are calendar days of one drop: a handful.
        for day in sorted(r["drop_date"] for r in batch.select("drop_date").distinct().collect()):
            store = PageStore(batch.sparkSession, f"{root}/_pages/{day}")
            rows = batch.filter(F.col("drop_date") == F.lit(day)).drop("drop_date")
            ingest_day(store, rows, batch_id, sources, now(day), root, str(day), token_rules, patches, hints)

    return (
        spark.readStream.schema(schemas.FETCHED)
        .format(fmt)
        .load(drops)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

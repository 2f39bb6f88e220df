"""Fetched pages to the published tables: extract, fall back, clean, cluster, roll up, and tell how every source did."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.operators import crawl, health
from offerloom.operators.extract import ScriptHints, extract_offers
from offerloom.operators.rollup import run_metadata
from offerloom.plans.ingest import TokenRules, build_catalogue, clean_offers, publishable
from offerloom.session import cut_lineage
from offerloom.sources import schemas
from offerloom.sources.tables import with_fallback

#: Columns of raw offers beside the source.
RAW = [
    "url", "title_raw", "brand", "model_raw", "gender", "category", "colorway", "size_range", "price_current",
    "price_original", "in_stock", "sku", "gtin", "page_index", "extractor_rank", "pos",
]


@dataclass(frozen=True)
class Published:
    """The tables of one run, under the names ``load_dataset`` reads."""

    retailers: DataFrame
    offers: DataFrame
    shoes: DataFrame
    aliases: DataFrame
    deals: DataFrame
    source_health: DataFrame
    warnings: DataFrame
    metadata: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a published table in order; one that is absent is null."""
    wanted = [c.strip().split(" ", 1) for c in schema.replace(f"identifiers {schemas.IDENTIFIERS}", "identifiers @").split(",")]
    columns = []
    for name, kind in wanted:
        kind = schemas.IDENTIFIERS if kind == "@" else kind
        columns.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*columns)


@dataclass(frozen=True)
class Sources:
    """What a run knows about its sources beside their pages.

    ``fixture``: source and the raw-offer columns, used where a source yields
    nothing.  ``thrown``: retailer_id, error, duration_ms.  ``disabled``:
    retailer_id.
    """

    fixture: DataFrame
    retailers: DataFrame
    disabled: DataFrame
    thrown: DataFrame

    def active(self, df: DataFrame) -> DataFrame:
        """Rows of sources that are neither disabled nor failed."""
        off = self.disabled.unionByName(self.thrown.select("retailer_id")).select(F.col("retailer_id").alias("source")).distinct()
        return df.join(off, "source", "left_anti")


def publish_run(
    pages: DataFrame,
    fetch_log: DataFrame,
    fixture: DataFrame,
    retailers: DataFrame,
    disabled: DataFrame,
    thrown: DataFrame,
    now: Column,
    token_rules: TokenRules | None = None,
    patches: DataFrame | None = None,
    hints: ScriptHints | None = None,
) -> Published:
    """One run from pages to tables.

    ``pages``: source, page_index, base_url, html.  ``fetch_log``: source,
    page_index, url, error (null = fetched), duration_ms.  The others as in
    ``Sources``.
    """
    sources = Sources(fixture, retailers, disabled, thrown)
    live, discovered = extract_offers(sources.active(pages), hints=hints)
    return publish_extracted(live, discovered, fetch_log, sources, now, token_rules, patches)


def publish_extracted(
    live: DataFrame,
    discovered: DataFrame,
    fetch_log: DataFrame,
    sources: Sources,
    now: Column,
    token_rules: TokenRules | None = None,
    patches: DataFrame | None = None,
    known: str | None = None,
    keep: str | None = None,
) -> Published:
    """The tables of a run whose pages have been worked through.

    ``live``: extracted offers; ``discovered``: source, page_index,
    discovered_count; ``known``, ``keep``: see ``build_catalogue``.
    """
    retailers, disabled, thrown, active = sources.retailers, sources.disabled, sources.thrown, sources.active
    live, log = active(live), active(fetch_log)
    found = cut_lineage(with_fallback(live.select("source", *RAW), active(sources.fixture).select("source", *RAW)))
    raw = found.select(
        F.col("source").alias("retailer_id"), F.struct("source", "page_index", "extractor_rank", "pos").alias("seq"), *RAW[:13],
        "used_fixture", now.alias("scraped_at"),
    )
    catalogue = build_catalogue(clean_offers(raw, token_rules, patches), known, keep)

    used = found.groupBy("source").agg(F.bool_or("used_fixture").alias("used_fixture"))
    crawled = log.join(discovered, ["source", "page_index"], "left").join(used, "source", "left").select(
        F.col("source").alias("retailer_id"), F.coalesce("discovered_count", F.lit(0)).alias("discovered_count"), "duration_ms",
        F.coalesce("used_fixture", F.lit(False)).alias("used_fixture"), F.col("error").isNull().alias("ok"),
        F.when(F.coalesce("used_fixture", F.lit(False)), F.lit("fixture")).otherwise(F.lit("http")).alias("execution_path"),
        F.lit(0).alias("path_rank"),
    )
    parsed = live.groupBy("source").agg(F.count("*").alias("parsed_count"))
    blocked = crawl.classify_blockers(log, parsed)
    fallback = used.where("used_fixture").join(blocked, "source").select(
        "source", F.lit(2**31 - 1).alias("pos"),
        crawl.fallback_warning(F.lit(None).cast("string"), F.lit("fixture"), "classification", F.lit(0)).alias("text"),
    )
    errors = log.where("error is not null").select("source", F.col("page_index").alias("pos"), F.col("error").alias("text"))
    said = errors.unionByName(fallback).select(F.col("source").alias("retailer_id"), "pos", "text")
    told = cut_lineage(
        health.source_health(crawled, said, raw, publishable(raw))
        .unionByName(health.disabled_health(disabled), allowMissingColumns=True)
        .unionByName(health.thrown_health(thrown), allowMissingColumns=True)
    )
    rows = {
        "retailers": health.retailer_dim(retailers, told, now),
        "offers": catalogue.published_offers(),
        "shoes": catalogue.shoes,
        "aliases": catalogue.aliases,
        "deals": catalogue.deals,
        "source_health": told,
        "warnings": health.warning_rows(said, thrown),
    }
    counted = {name: rows[name] for name in ("retailers", "offers", "shoes", "deals")}
    rows["metadata"] = run_metadata(counted, rows["offers"], now)
    return Published(**{name: _shaped(df, schemas.PUBLISHED[name]) for name, df in rows.items()})

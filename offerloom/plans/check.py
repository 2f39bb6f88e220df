"""Validation of a published snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators.rollup import table_counts
from offerloom.operators.validate import CONTRACTS, count_reconcile, duplicate_keys, fk_check, report_reconcile
from offerloom.sources.tables import Dataset


def validate_snapshot(data: Dataset, report: DataFrame | None = None) -> DataFrame:
    """Every finding as (kind, detail, row_count); empty when the snapshot is sound.

    ``report``: aggregate_recall, fixture_usage_rate and fixture_usage_threshold
    of the coverage report, where there is one.
    """
    tables = {
        "retailers": data.retailers, "offers": data.offers, "shoes": data.shoes, "aliases": data.aliases,
        "deals": data.deals, "source_health": data.source_health, "warnings": data.warnings, "metadata": data.metadata,
    }
    out = None
    for name, df in tables.items():
        broken = (
            CONTRACTS[name].report(df)
            .select(F.explode("violations").alias("rule"))
            .groupBy("rule")
            .agg(F.count("*").alias("row_count"))
            .select(F.lit("contract").alias("kind"), F.concat_ws(" ", F.lit(name), "rule").alias("detail"), "row_count")
        )
        out = broken if out is None else out.unionByName(broken)
    fks = fk_check(data.retailers, data.offers, data.shoes, data.deals).select(
        F.lit("foreign-key").alias("kind"), F.concat_ws(" ", "check_name", "missing_key").alias("detail"),
        F.col("child_rows").alias("row_count"),
    )
    names = ("offers", "shoes", "deals")
    counted = table_counts({n: tables[n] for n in names})
    published = data.metadata.select(*[F.col(f"{n}_count").alias(n) for n in names]).unpivot([], list(names), "table_name", "row_count")
    counts = count_reconcile(published, counted).select(
        F.lit("count").alias("kind"), F.col("table_name").alias("detail"), F.col("actual_count").alias("row_count")
    )
    ids = duplicate_keys(data.offers, "offer_id", "offers").select(
        F.lit("duplicate-id").alias("kind"), F.col("key").alias("detail"), "row_count"
    )
    out = out.unionByName(fks).unionByName(counts).unionByName(ids)
    if report is None:
        return out
    figures = report_reconcile(data.metadata, report).select(
        F.lit("report").alias("kind"), F.col("figure").alias("detail"), F.lit(1).cast("long").alias("row_count")
    )
    return out.unionByName(figures)

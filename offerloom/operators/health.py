"""Source health: per-source crawl rollup and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import present, squeeze

# --- fixed value: text of a disabled source ---
DISABLED_TEXT = "Parser disabled via config."
# --- fixed values: texts of a source that threw ---
UNKNOWN_FAILURE = "Unknown parser failure."
THROWN_TEXT = "parser failed."


def has_warning(health: DataFrame) -> Column:
    """Whether a source said something: by its number of messages, or by its text where only that is given."""
    if "warning_rows" in health.columns:
        return F.coalesce("warning_rows", F.lit(0)) > 0
    return present(squeeze(F.coalesce("warning", F.lit("")))).isNotNull()


def says_fixture(health: DataFrame) -> Column:
    """Whether a message of a source names fixture data."""
    if "warns_fixture" in health.columns:
        return F.coalesce("warns_fixture", F.lit(False))
    return _names_fixture("warning")


def _names_fixture(text: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("fixture"))


def health_summary(health: DataFrame) -> DataFrame:
    """One row: counts by class (failed > disabled > degraded > healthy), level and texts."""
    fixture = F.coalesce(F.col("source_mode") == "fixture", F.lit(False))
    failed, disabled = F.col("status") == "failed", F.col("status") == "disabled"
    active = ~failed & ~disabled
    warned = has_warning(health)
    odd = warned | fixture
    counts = health.agg(
        F.count("*").alias("total_retailers"),
        F.count_if(active & ~odd).alias("healthy_retailers"),
        F.count_if(active & odd).alias("degraded_retailers"),
        F.count_if(failed).alias("failed_retailers"),
        F.count_if(disabled).alias("disabled_retailers"),
        F.count_if(warned).alias("warning_retailers"),
        F.count_if(fixture).alias("fixture_retailers"),
        F.count_if(~fixture).alias("live_or_unspecified"),
        F.coalesce(F.sum("offers_count"), F.lit(0)).alias("total_offers"),
    )

    def n(column: str, text: str) -> Column:
        return F.concat(F.col(column).cast("string"), F.lit(text))

    def some(column: str, text: str) -> Column:
        return F.when(F.col(column) > 0, n(column, text))

    level = (
        F.when(F.col("total_retailers") == 0, F.lit("unknown"))
        .when(F.col("failed_retailers") > 0, F.lit("critical"))
        .when((F.col("degraded_retailers") > 0) | (F.col("disabled_retailers") > 0), F.lit("degraded"))
        .otherwise(F.lit("healthy"))
    )
    of_all = F.concat(F.lit("/"), F.col("total_retailers").cast("string"))
    headline = (
        F.when(F.col("level") == "unknown", F.lit("Health unavailable"))
        .when(F.col("level") == "critical", F.concat(F.col("failed_retailers").cast("string"), of_all, F.lit(" failed")))
        .when(F.col("level") == "degraded", F.concat(F.col("healthy_retailers").cast("string"), of_all, F.lit(" healthy")))
        .otherwise(F.concat(F.col("healthy_retailers").cast("string"), of_all, F.lit(" stable")))
    )
    # concat_ws drops the segments that are null.
    detail = F.when(F.col("level") == "unknown", F.lit("No parser telemetry found in metadata.")).otherwise(
        F.concat_ws(
            " | ",
            n("healthy_retailers", " healthy"),
            n("degraded_retailers", " degraded"),
            n("failed_retailers", " failed"),
            some("disabled_retailers", " disabled"),
            some("fixture_retailers", " fixture-backed"),
            some("warning_retailers", " with warnings"),
        )
    )
    return counts.withColumn("level", level).withColumn("headline", headline).withColumn("detail", detail)


def mode_counts(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count_if(F.col("source_mode") == "live").alias("live"),
        F.count_if(F.col("source_mode") == "fixture").alias("fixture"),
    )


def disabled_health(disabled: DataFrame) -> DataFrame:
    """Health rows of sources that were skipped."""
    zero = F.lit(0).cast("long")
    return disabled.select(
        "retailer_id",
        F.lit("disabled").alias("status"),
        zero.alias("offers_count"),
        F.lit(DISABLED_TEXT).alias("warning"),
        F.lit(1).cast("long").alias("warning_rows"),
        F.lit(False).alias("warns_fixture"),
        zero.alias("duration_ms"),
        zero.alias("discovered_count"),
        zero.alias("parsed_count"),
        zero.alias("pages_crawled"),
        F.lit(None).cast("string").alias("source_mode"),
        F.lit(None).cast("string").alias("execution_path"),
    )


def skip_disabled(rows: DataFrame, disabled: DataFrame) -> DataFrame:
    return rows.join(disabled.select("retailer_id"), "retailer_id", "left_anti")


def thrown_health(failures: DataFrame) -> DataFrame:
    """Health rows of sources whose parser threw (retailer_id, error, duration_ms): failed, nothing else known."""
    return failures.select(
        "retailer_id",
        F.lit("failed").alias("status"),
        F.lit(0).cast("long").alias("offers_count"),
        F.coalesce("error", F.lit(UNKNOWN_FAILURE)).alias("warning"),
        F.lit(1).cast("long").alias("warning_rows"),
        _names_fixture("error").alias("warns_fixture"),
        "duration_ms",
        *[F.lit(None).cast("long").alias(c) for c in ("discovered_count", "parsed_count", "pages_crawled")],
        *[F.lit(None).cast("string").alias(c) for c in ("source_mode", "execution_path")],
    )


def joined_warnings(warnings: DataFrame) -> DataFrame:
    """(retailer_id, warning): messages of a source joined by a bar, in order.

    For showing the sources of one run.  Health itself is worked out from the
    rows, so nothing depends on this text.
    """
    text = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return warnings.groupBy("retailer_id").agg(F.array_join(text, " | ").alias("warning"))


def source_health(pages: DataFrame, warnings: DataFrame, parsed: DataFrame, offers: DataFrame) -> DataFrame:
    """One row per crawled source.

    ``pages``: retailer_id, discovered_count, duration_ms, used_fixture, ok,
    execution_path and path_rank (the order in which paths are tried).
    ``warnings``: retailer_id, pos, text.  ``parsed``: rows of a source after
    raw dedupe.  ``offers``: those left after the filters.  The path is the
    first one that found something.
    """
    crawl = pages.groupBy("retailer_id").agg(
        F.sum("discovered_count").alias("discovered_count"),
        F.sum("duration_ms").alias("duration_ms"),
        F.count_if(F.col("ok")).alias("pages_crawled"),
        F.bool_or("used_fixture").alias("_fixture"),
        F.min_by("execution_path", F.when(F.col("discovered_count") > 0, F.col("path_rank"))).alias("_won"),
        F.min_by("execution_path", "path_rank").alias("_tried"),
    )

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("retailer_id").agg(F.count("*").alias(name))

    said = warnings.groupBy("retailer_id").agg(
        F.count("*").alias("warning_rows"), F.bool_or(_names_fixture("text")).alias("warns_fixture")
    )
    return (
        crawl.join(count(parsed, "parsed_count"), "retailer_id", "left")
        .join(count(offers, "offers_count"), "retailer_id", "left")
        .join(said, "retailer_id", "left")
        .select(
            "retailer_id",
            F.when(F.col("_fixture"), F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
            F.coalesce("offers_count", F.lit(0)).alias("offers_count"),
            F.coalesce("warning_rows", F.lit(0)).alias("warning_rows"),
            F.coalesce("warns_fixture", F.lit(False)).alias("warns_fixture"),
            "duration_ms",
            "discovered_count",
            F.coalesce("parsed_count", F.lit(0)).alias("parsed_count"),
            "pages_crawled",
            F.when(F.col("_fixture"), F.lit("fixture")).otherwise(F.lit("live")).alias("source_mode"),
            F.coalesce("_won", "_tried").alias("execution_path"),
        )
    )


def global_warnings(health: DataFrame, thrown: DataFrame | None = None) -> DataFrame:
    """(retailer_id, text): every source warning with its source as prefix.

    ``thrown``: sources whose parser threw; of those only that is said.
    """
    said = health.filter(present("warning").isNotNull() & (F.col("status") != "disabled"))
    rows = said.select("retailer_id", F.concat_ws(": ", "retailer_id", "warning").alias("text"))
    if thrown is None:
        return rows
    failed = thrown.select("retailer_id").distinct()
    return rows.join(failed, "retailer_id", "left_anti").unionByName(
        failed.select("retailer_id", F.concat_ws(": ", "retailer_id", F.lit(THROWN_TEXT)).alias("text"))
    )


def warning_rows(said: DataFrame, thrown: DataFrame) -> DataFrame:
    """(retailer_id, pos, text): every message as a row of its own, with its source as prefix.

    ``said``: retailer_id, pos, text.  Of sources whose parser threw only that is said.
    """
    failed = thrown.select("retailer_id").distinct()
    told = said.filter(present("text").isNotNull()).join(failed, "retailer_id", "left_anti")
    rows = told.select("retailer_id", "pos", "text").unionByName(failed.select("retailer_id", F.lit(0).alias("pos"), F.lit(THROWN_TEXT).alias("text")))
    return rows.withColumn("text", F.concat_ws(": ", "retailer_id", "text"))


def retailer_dim(retailers: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Retailers with the time of their last good crawl."""
    h = health.select("retailer_id", F.col("status").alias("_status"))
    return (
        retailers.join(h, "retailer_id", "left")
        .withColumn("last_crawled_at", F.when(F.col("_status") == "ok", now).otherwise(F.col("last_crawled_at")))
        .drop("_status")
    )

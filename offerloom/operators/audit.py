"""Recall audit against expected lists, with failure streaks and breach reports."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.money import js_round
from offerloom.functions.text import as_col, file_slug
from offerloom.operators.health import says_fixture


#: Runs of all sources in one block of a history, about; and the blocks, at most.
SEGMENT_ROWS, MAX_BLOCKS = 1_000_000, 256


def model_token(c: Column | str) -> Column:
    return F.lower(F.trim(as_col(c)))


def recall_per_source(benchmarks: DataFrame, offers: DataFrame, threshold: float = rules.RETAILER_RECALL) -> DataFrame:
    """Recall of each benchmarked source.

    ``benchmarks``: retailer_id, expected_models array, expected_count.  The
    hits come from a join of (source, model) rows that are distinct before they
    meet; the model sets themselves are never gathered.
    """
    seen = offers.select("retailer_id", model_token("model_normalized").alias("model")).distinct()
    wanted = benchmarks.select("retailer_id", F.explode("expected_models").alias("_m")).select(
        "retailer_id", model_token("_m").alias("model")
    ).distinct()
    available = seen.groupBy("retailer_id").agg(F.count("*").alias("_available"))
    listed = wanted.groupBy("retailer_id").agg(F.count("*").alias("_listed"))
    hits = wanted.join(seen, ["retailer_id", "model"], "left_semi").groupBy("retailer_id").agg(
        F.count("*").alias("_hits")
    )
    counts = (
        benchmarks.select("retailer_id", "expected_count")
        .join(available, "retailer_id", "left")
        .join(listed, "retailer_id", "left")
        .join(hits, "retailer_id", "left")
        .fillna(0, ["_available", "_listed", "_hits"])
    )
    return score_recall(counts, threshold)


def score_recall(counts: DataFrame, threshold: float = rules.RETAILER_RECALL) -> DataFrame:
    """Recall figures from counts (_available, _listed, _hits, expected_count)."""
    expected = F.coalesce(F.col("expected_count").cast("long"), F.col("_listed"))
    by_count = F.least("_available", "expected")
    matched = F.when(F.col("_listed") > 0, F.greatest(F.col("_hits"), by_count)).otherwise(by_count)

    def rate(part: Column) -> Column:
        return F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(
            js_round(part.cast("double") / F.nullif(F.col("expected"), F.lit(0)), 4)
        )

    return (
        counts.withColumn("expected", expected)
        .withColumn("matched", matched)
        .withColumn("recall", rate(F.col("matched")))
        .withColumn("model_recall", rate(F.col("_hits")))
        .withColumn("threshold", F.lit(threshold))
        .withColumn("pass", F.col("recall") >= threshold)
        .select("retailer_id", "expected", "matched", "recall", "model_recall", "threshold", "pass")
    )


def next_streaks(results: DataFrame, state: DataFrame, disable_after: int = rules.DISABLE_AFTER) -> DataFrame:
    """Adds consecutive_failures and auto_disabled; ``state``: scope, retailer_id, failures."""
    prior = state.filter("scope = 'retailer'").select("retailer_id", F.col("failures").alias("_prior"))
    streak = F.when(F.col("pass"), F.lit(0)).otherwise(F.coalesce("_prior", F.lit(0)) + 1).cast("long")
    return (
        results.join(prior, "retailer_id", "left")
        .withColumn("consecutive_failures", streak)
        .withColumn("auto_disabled", ~F.col("pass") & (F.col("consecutive_failures") >= disable_after))
        .drop("_prior")
    )


def aggregate_streak(state: DataFrame) -> Column:
    """Failures in a row of the aggregate check before this run."""
    return state.filter("scope = 'aggregate'").agg(F.coalesce(F.max("failures"), F.lit(0)).cast("long").alias("n")).scalar()


def next_state(audited: DataFrame, state: DataFrame, total: DataFrame) -> DataFrame:
    """New streak of every source and of the aggregate; a source without a benchmark keeps its old streak."""
    new = audited.select("retailer_id", F.col("consecutive_failures").alias("failures"))
    old = state.filter("scope = 'retailer'").select("retailer_id", F.col("failures").cast("long").alias("failures"))
    sources = new.unionByName(old.join(new, "retailer_id", "left_anti"))
    failures = F.when(F.col("pass"), F.lit(0)).otherwise(aggregate_streak(state) + 1).cast("long")
    return sources.select(F.lit("retailer").alias("scope"), "retailer_id", "failures").unionByName(
        total.select(F.lit("aggregate").alias("scope"), F.lit(None).cast("string").alias("retailer_id"), failures.alias("failures"))
    )


def _time_bounds(runs: DataFrame, time: str, rows: int) -> list:
    """Times that cut all runs into blocks of about ``rows``; none where one block holds them."""
    blocks = runs.count() // rows
    if blocks < 1:
        return []
    blocks = min(blocks, MAX_BLOCKS - 1)
    shares = [(i + 1) / (blocks + 1) for i in range(blocks)]
    cuts = runs.agg(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), shares, 10_000).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def _segments(runs: DataFrame, key: str, time: str, ok: str) -> DataFrame:
    """Streak of every run as its own segment sees it, and whether the segment has no pass up to the run."""
    w = Window.partitionBy(key, "_segment").orderBy(time)
    island = F.sum(F.coalesce(F.col(ok), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    by_island = Window.partitionBy(key, "_segment", "_island").orderBy(time)
    since = F.row_number().over(by_island) - F.when(F.col("_island") > 0, F.lit(1)).otherwise(F.lit(0))
    return runs.withColumn("_island", island).withColumn("_own", since.cast("long")).withColumn("_leads", F.col("_island") == 0)


def _carried(segments: DataFrame, key: str, time: str) -> DataFrame:
    """Failures in a row with which every segment of a source begins.

    A segment is told by its length, its failures at the end and whether it has a pass; two neighbours combine to the
    same three figures, so a source costs one row a segment here.
    """
    told = segments.groupBy(key, "_segment").agg(
        F.max_by("_own", F.struct(time, "_own")).alias("_tail"), F.max(~F.col("_leads")).alias("_any_pass")
    )
    order = Window.partitionBy(key).orderBy("_segment")
    groups = told.withColumn("_group", F.sum(F.col("_any_pass").cast("int")).over(order))
    tail = F.sum("_tail").over(Window.partitionBy(key, "_group").orderBy("_segment"))
    ended = groups.withColumn("_after", tail)
    carry = F.coalesce(F.lag("_after").over(order), F.lit(0))
    return ended.select(F.col(key).alias("_key"), F.col("_segment").alias("_of"), carry.alias("_carry"))


def streak_history(
    runs: DataFrame, key: str = "retailer_id", time: str = "run_at", ok: str = "pass", disable_after: int = rules.DISABLE_AFTER,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Streak after every run of a history.  A run without a result counts as failed.

    Runs are cut at the same times for all sources, about ``segment_rows`` runs a block, so that the runs of one source
    are as many tasks as there are blocks.  Streaks are counted per source and block; what a block begins with follows
    from the summaries of the blocks before it.
    """
    bounds = _time_bounds(runs, time, segment_rows)
    place = _place(F.unix_micros(F.col(time).cast("timestamp")), bounds)
    segments = _segments(runs.withColumn("_segment", place), key, time, ok)
    if not bounds:
        out = segments.withColumn("_carry", F.lit(0))
    else:
        carried = _carried(segments, key, time)
        out = segments.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_segment") == F.col("_of")), "left")
    passed = F.coalesce(F.col(ok), F.lit(False))
    streak = F.when(passed, F.lit(0)).otherwise(F.col("_own") + F.when(F.col("_leads"), F.col("_carry")).otherwise(F.lit(0)))
    return (
        out.withColumn("consecutive_failures", streak.cast("long"))
        .withColumn("auto_disabled", ~passed & (F.col("consecutive_failures") >= disable_after))
        .select(*runs.columns, "consecutive_failures", "auto_disabled")
    )


def _place(at: Column, bounds: list) -> Column:
    """How many of the bounds lie at or before a time, by halving."""
    if not bounds:
        return F.lit(0)
    middle = len(bounds) // 2
    return F.when(at < F.lit(bounds[middle]), _place(at, bounds[:middle])).otherwise(F.lit(middle + 1) + _place(at, bounds[middle + 1 :]))


def newly_disabled(audited: DataFrame, disabled: DataFrame) -> DataFrame:
    return audited.filter("auto_disabled").select("retailer_id").join(disabled, "retailer_id", "left_anti")


def next_disabled(audited: DataFrame, disabled: DataFrame) -> DataFrame:
    return disabled.select("retailer_id").union(newly_disabled(audited, disabled)).distinct()


def aggregate_recall(results: DataFrame, threshold: float = rules.AGGREGATE_RECALL) -> DataFrame:
    """One row over all sources; 1 when nothing is expected."""
    return (
        results.agg(
            F.coalesce(F.sum("expected"), F.lit(0)).alias("total_expected"),
            F.coalesce(F.sum("matched"), F.lit(0)).alias("total_matched"),
        )
        .withColumn(
            "aggregate_recall",
            F.when(F.col("total_expected") == 0, F.lit(1.0)).otherwise(
                js_round(
                    F.col("total_matched").cast("double") / F.nullif(F.col("total_expected"), F.lit(0)), 4
                )
            ),
        )
        .withColumn("threshold", F.lit(threshold))
        .withColumn("pass", F.col("aggregate_recall") >= threshold)
    )


def uses_fixture(health: DataFrame) -> Column:
    """Whether a health row stands on fixture data."""
    said = says_fixture(health)
    path = F.coalesce(F.col("execution_path") == "fixture", F.lit(False))
    mode = F.coalesce(F.col("source_mode") == "fixture", F.lit(False))
    return path | mode | said


def fixture_rate(health: DataFrame, threshold: float = rules.FIXTURE_USAGE) -> DataFrame:
    """One row: share of active sources on fixture data; 0 without active sources."""
    return (
        health.filter("status <> 'disabled'")
        .agg(F.count("*").alias("active"), F.count_if(uses_fixture(health)).alias("fixture_hits"))
        .withColumn(
            "fixture_usage_rate",
            F.when(F.col("active") == 0, F.lit(0.0)).otherwise(
                js_round(F.col("fixture_hits").cast("double") / F.nullif(F.col("active"), F.lit(0)), 4)
            ),
        )
        .withColumn("threshold", F.lit(threshold))
        .withColumn("pass", F.col("fixture_usage_rate") <= threshold)
    )


def breaches(audited: DataFrame, fixture: DataFrame, total: DataFrame, aggregate_streak: Column) -> DataFrame:
    """Breach rows in report order: sources, fixture, aggregate."""
    none_long, none_bool, none_text = (F.lit(None).cast(t) for t in ("long", "boolean", "string"))
    source = audited.filter(~F.col("pass")).select(
        F.lit(0).alias("scope_rank"), F.lit("retailer").alias("scope"), "retailer_id", "recall",
        "threshold", "consecutive_failures", "auto_disabled",
    )
    fixed = fixture.filter(~F.col("pass")).select(
        F.lit(1).alias("scope_rank"), F.lit("fixture").alias("scope"), none_text.alias("retailer_id"),
        F.col("fixture_usage_rate").alias("recall"), "threshold",
        none_long.alias("consecutive_failures"), none_bool.alias("auto_disabled"),
    )
    whole = total.filter(~F.col("pass")).select(
        F.lit(2).alias("scope_rank"), F.lit("aggregate").alias("scope"), none_text.alias("retailer_id"),
        F.col("aggregate_recall").alias("recall"), "threshold",
        aggregate_streak.cast("long").alias("consecutive_failures"), none_bool.alias("auto_disabled"),
    )
    return source.unionByName(fixed).unionByName(whole)


def breach_text() -> Column:
    """Text of one breach in the failure message."""
    rate, limit = F.format_string("%.4f", "recall"), F.format_string("%.2f", "threshold")
    return (
        F.when(F.col("scope") == "aggregate", F.concat(F.lit("aggregate "), rate, F.lit(" < "), limit))
        .when(F.col("scope") == "fixture", F.concat(F.lit("fixture usage "), rate, F.lit(" > "), limit))
        .otherwise(
            F.concat(
                F.col("retailer_id"), F.lit(" "), rate, F.lit(" < "), limit, F.lit(" (streak="),
                F.col("consecutive_failures").cast("string"), F.lit(")"),
            )
        )
    )


def tickets(breach_rows: DataFrame, generated_at: Column, aggregate: Column, fixture_usage: Column) -> DataFrame:
    """(ticket_name, body): one report per breach."""
    stamp = F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    scope, source = F.col("scope"), F.coalesce("retailer_id", F.lit("retailer"))
    is_source = scope == "retailer"
    slug = file_slug(
        F.when(is_source, source).when(scope == "fixture", F.lit("fixture-usage")).otherwise(F.lit("all-retailers"))
    )
    # --- fixed values: ticket lines ---
    title = (
        F.when(is_source, F.concat(F.lit("Coverage breach: "), source))
        .when(scope == "fixture", F.lit("Coverage breach: fixture usage"))
        .otherwise(F.lit("Coverage breach: aggregate recall"))
    )
    label = F.when(scope == "fixture", F.lit("Fixture usage rate")).otherwise(F.lit("Recall"))

    def only(cond: Column, line: Column) -> Column:
        return F.when(cond, line)

    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), title),
        F.lit(""),
        F.concat(F.lit("- Generated at: "), stamp),
        F.concat(F.lit("- Scope: "), scope),
        F.concat(F.lit("- "), label, F.lit(": "), F.format_string("%.4f", "recall")),
        F.concat(F.lit("- Threshold: "), F.format_string("%.2f", "threshold")),
        F.concat(F.lit("- Fixture usage rate: "), F.format_string("%.4f", fixture_usage)),
        only(
            F.col("consecutive_failures").isNotNull(),
            F.concat(F.lit("- Consecutive failures: "), F.col("consecutive_failures").cast("string")),
        ),
        F.concat(F.lit("- Aggregate recall: "), F.format_string("%.4f", aggregate)),
        only(is_source, F.concat(F.lit("- Retailer: "), source)),
        only(
            is_source,
            F.concat(
                F.lit("- Parser auto-disabled: "),
                F.when(F.coalesce("auto_disabled", F.lit(False)), F.lit("yes")).otherwise(F.lit("no")),
            ),
        ),
        F.lit(""),
        F.lit("## Follow-up"),
        F.lit(""),
        F.lit("1. Review parser output against benchmark expectations."),
        F.lit("2. Patch parser selectors or mappings."),
        F.lit("3. Re-run the coverage audit and confirm thresholds pass."),
        F.lit(""),
    )
    name = F.concat(F.regexp_replace(stamp, "[:.]", "-"), F.lit("-"), scope, F.lit("-"), slug, F.lit(".md"))
    return breach_rows.select(name.alias("ticket_name"), body.alias("body"))


class CoverageBreach(RuntimeError):
    """Raised by ``AuditResult.raise_on_breach``."""


@dataclass(frozen=True)
class AuditResult:
    """Tables of one audit; write them first, then ``raise_on_breach``."""

    retailers: DataFrame
    total: DataFrame
    fixture: DataFrame
    breaches: DataFrame
    state: DataFrame
    disabled: DataFrame
    tickets: DataFrame
    generated_at: Column

    def report(self) -> DataFrame:
        """One nested row for export: thresholds, a recall map, source rows and breaches.

        The audit tables are the report; this is their form as one document.
        """
        row = F.struct(
            "retailer_id", "expected", "matched", "recall", "threshold", "pass", "consecutive_failures", "auto_disabled"
        )
        per_source = self.retailers.agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("retailer_id", "recall")))).alias("per_retailer_recall"),
            F.array_sort(F.collect_list(row)).alias("retailers"),
        )
        listed = self.breaches.agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "scope_rank", "scope", "retailer_id", "recall", "threshold", "consecutive_failures", "auto_disabled"
                    )
                )
            ).alias("breaches")
        )
        return per_source.select(
            self.generated_at.alias("generated_at"),
            F.struct(
                F.lit(rules.RETAILER_RECALL).alias("per_retailer_recall"),
                F.lit(rules.AGGREGATE_RECALL).alias("aggregate_recall"),
                F.lit(rules.FIXTURE_USAGE).alias("fixture_usage_rate"),
            ).alias("thresholds"),
            "per_retailer_recall",
            self.total.select("aggregate_recall").scalar().alias("aggregate_recall"),
            self.fixture.select("fixture_usage_rate").scalar().alias("fixture_usage_rate"),
            "retailers",
            listed.scalar().alias("breaches"),
        )

    def raise_on_breach(self) -> None:
        """Fail when there is a breach.  The message counts them by scope and names each (one a source at most)."""
        found = self.breaches.select("scope_rank", "scope", breach_text().alias("text")).orderBy("scope_rank", "retailer_id").collect()
        if found:
            counts = Counter(r["scope"] for r in found)
            told = ", ".join(f"{n} {scope}" for scope, n in counts.items())
            raise CoverageBreach(f"threshold breach: {told}: " + "; ".join(r["text"] for r in found))

"""Row contracts, foreign keys and reconciled counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules


@dataclass(frozen=True)
class Rule:
    """A named condition that marks a bad row."""

    name: str
    bad: Callable[[], Column]


def required(c: str) -> Rule:
    return Rule(f"{c}:required", lambda: F.col(c).isNull())


def non_empty(c: str) -> Rule:
    return Rule(f"{c}:non-empty", lambda: F.col(c).isNull() | (F.length(c) == 0))


def one_of(c: str, values: list[str], optional: bool = False) -> Rule:
    def bad() -> Column:
        outside = ~F.col(c).isin(*values)
        return F.coalesce(outside, F.lit(False)) if optional else F.coalesce(outside, F.lit(True))

    return Rule(f"{c}:one-of", bad)


def equals(c: str, value: str) -> Rule:
    return Rule(f"{c}:equals", lambda: ~F.col(c).eqNullSafe(F.lit(value)))


def is_url(c: str) -> Rule:
    return Rule(f"{c}:url", lambda: F.try_parse_url(F.col(c), F.lit("PROTOCOL")).isNull())


def at_least(c: str, low: float, optional: bool = False) -> Rule:
    return between(c, low, None, optional)


def between(c: str, low: float, high: float | None, optional: bool = False) -> Rule:
    def bad() -> Column:
        out = F.col(c) < low
        if high is not None:
            out = out | (F.col(c) > high)
        return F.coalesce(out, F.lit(not optional))

    return Rule(f"{c}:range", bad)


def only_for(c: str, kind: str, value: str) -> Rule:
    """Given for rows of one kind, absent for all others."""
    return Rule(f"{c}:only-for-{value}", lambda: (F.col(kind) == value) != (F.length(F.coalesce(c, F.lit(""))) > 0))


def positive(c: str, optional: bool = False) -> Rule:
    return Rule(f"{c}:positive", lambda: F.coalesce(F.col(c) <= 0, F.lit(not optional)))


@dataclass(frozen=True)
class Contract:
    """All rules of one table, checked in a single pass."""

    table: str
    rules: tuple[Rule, ...]

    def report(self, df: DataFrame) -> DataFrame:
        """Adds ``violations``: names of the broken rules, in rule order."""
        checks = [F.when(r.bad(), F.lit(r.name)) for r in self.rules]
        return df.withColumn("violations", F.array_compact(F.array(*checks)))

    def quarantine(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(good rows, bad rows with their violations)."""
        checked = self.report(df)
        return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)

    def enforce(self, df: DataFrame) -> DataFrame:
        """The same rows; the job fails at the first bad one."""
        message = F.concat(F.lit(f"{self.table}: "), F.array_join("violations", ", "))
        checked = self.report(df).filter(
            F.when(F.size("violations") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        )
        return checked.drop("violations")


CONTRACTS = {
    c.table: c
    for c in (
        Contract("retailers", (
            non_empty("retailer_id"), non_empty("name"), equals("country", rules.COUNTRY),
            equals("currency", rules.CURRENCY), is_url("homepage_url"), is_url("logo_url"),
        )),
        Contract("offers", (
            non_empty("offer_id"), non_empty("retailer_id"), is_url("url"), non_empty("title_raw"),
            non_empty("model_normalized"), one_of("gender", rules.GENDERS, optional=True),
            one_of("category", rules.CATEGORIES), at_least("price_current", 0),
            at_least("price_original", 0, optional=True), between("discount_pct", 0, 100, optional=True),
            required("in_stock"), required("scraped_at"), between("source_confidence", 0, 1),
        )),
        Contract("shoes", (
            non_empty("shoe_id"), non_empty("brand"), non_empty("model"),
            one_of("category", rules.CATEGORIES), positive("alias_count"), non_empty("match_rules_version"),
        )),
        Contract("aliases", (non_empty("shoe_id"), non_empty("model_normalized"))),
        Contract("deals", (
            non_empty("shoe_id"), non_empty("best_offer_id"), at_least("best_price", 0),
            positive("offers_count"), between("max_discount_pct", 0, 100, optional=True), required("updated_at"),
        )),
        Contract("source_health", (
            non_empty("retailer_id"), one_of("status", rules.HEALTH_STATUSES), at_least("offers_count", 0),
            at_least("duration_ms", 0), at_least("warning_rows", 0), required("warns_fixture"), at_least("discovered_count", 0, optional=True),
            at_least("parsed_count", 0, optional=True), at_least("pages_crawled", 0, optional=True),
            one_of("source_mode", rules.SOURCE_MODES, optional=True),
            one_of("execution_path", rules.EXECUTION_PATHS, optional=True),
        )),
        Contract("coverage_benchmark", (non_empty("retailer_id"), positive("expected_count", optional=True))),
        Contract("coverage_result", (
            non_empty("retailer_id"), at_least("expected", 0), at_least("matched", 0), between("recall", 0, 1),
            between("threshold", 0, 1), required("pass"), at_least("consecutive_failures", 0), required("auto_disabled"),
        )),
        Contract("coverage_breach", (
            one_of("scope", rules.BREACH_SCOPES), between("recall", 0, 1), between("threshold", 0, 1),
            at_least("consecutive_failures", 0, optional=True),
        )),
        Contract("coverage_state", (
            one_of("scope", ["retailer", "aggregate"]), at_least("failures", 0), only_for("retailer_id", "scope", "retailer"),
        )),
        Contract("coverage_report", (
            required("generated_at"), between("aggregate_recall", 0, 1), between("fixture_usage_rate", 0, 1),
            between("thresholds.per_retailer_recall", 0, 1), between("thresholds.aggregate_recall", 0, 1),
            between("thresholds.fixture_usage_rate", 0, 1), required("retailers"), required("breaches"),
        )),
        Contract("warnings", (non_empty("retailer_id"), non_empty("text"))),
        Contract("metadata", (
            required("generated_at"), positive("stale_after_hours"), required("stale"), at_least("retailers_count", 0),
            at_least("offers_count", 0), at_least("shoes_count", 0), at_least("deals_count", 0),
            between("aggregate_recall", 0, 1, optional=True), between("fixture_usage_rate", 0, 1, optional=True),
            between("fixture_usage_threshold", 0, 1, optional=True),
        )),
    )
}


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(check_name, missing_key, child_rows): keys without a parent, with their row counts.

    Keys are counted before they meet the parent, so the join handles one row
    per key however many rows share it.
    """
    keys = child.groupBy(F.col(child_key).cast("string").alias("missing_key")).agg(F.count("*").alias("child_rows"))
    known = parent.select(F.col(parent_key).cast("string").alias("missing_key"))
    return keys.join(known, "missing_key", "left_anti").select(F.lit(name).alias("check_name"), "missing_key", "child_rows")


def fk_check(retailers: DataFrame, offers: DataFrame, shoes: DataFrame, deals: DataFrame) -> DataFrame:
    return (
        orphans(offers, "retailer_id", retailers, "retailer_id", "offer->retailer")
        .unionByName(orphans(deals, "shoe_id", shoes, "shoe_id", "deal->shoe"))
        .unionByName(orphans(deals, "best_offer_id", offers, "offer_id", "deal->offer"))
    )


def duplicate_keys(df: DataFrame, key: str, table: str) -> DataFrame:
    """Ids used by more than one row."""
    return (
        df.groupBy(F.col(key).cast("string").alias("key"))
        .agg(F.count("*").alias("row_count"))
        .filter("row_count > 1")
        .select(F.lit(table).alias("table_name"), "key", "row_count")
    )


def count_reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables whose published count differs; both: table_name, row_count."""
    a = actual.select("table_name", F.col("row_count").alias("actual_count"))
    return (
        expected.withColumnRenamed("row_count", "expected_count")
        .join(a, "table_name", "full")
        .filter(~F.col("expected_count").eqNullSafe(F.col("actual_count")))
    )


def report_reconcile(metadata: DataFrame, report: DataFrame) -> DataFrame:
    """Figures that differ between metadata and report (one row each, same columns).

    An absent side gives no findings; a threshold that is absent on the
    metadata side is a finding of its own.
    """
    figures = ["aggregate_recall", "fixture_usage_rate", "fixture_usage_threshold"]

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot([], figures, "figure", name)

    return (
        rows(metadata, "in_metadata")
        .join(rows(report, "in_report"), "figure")
        .filter(~F.col("in_metadata").eqNullSafe(F.col("in_report")))
    )

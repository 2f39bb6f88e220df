"""Recall audit, streaks and breaches: suppliers' parts before and after a date."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import audit, rollup
from offerloom.plans.audit import run_audit
from offerloom.sources import schemas
from offerloom.sources.tables import duplicate_benchmarks
from workload.base import HEALTH_SQL, health_view, query, sql_round, sql_ts, table, ts_text

CUT = "1998-01-01 00:00:00"
GENERATED = "2024-02-01 10:20:30"


def benchmarks(spark, d):
    """Expected models per source: parts it shipped early; some lists carry a count instead."""
    li = table(spark, d, "lineitem")
    early = li.filter(F.col("l_shipdate") < F.lit(CUT).cast("timestamp"))
    lists = early.groupBy("l_suppkey").agg(F.collect_set(F.concat(F.lit(" P"), (F.col("l_partkey") % 40).cast("string"))).alias("m"))
    key = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    none = F.array().cast("array<string>")
    return lists.select(
        key.alias("retailer_id"),
        F.when(F.col("l_suppkey") % 6 == 0, none).otherwise(F.col("m")).alias("expected_models"),
        F.when(F.col("l_suppkey") % 6 < 2, (30 + F.col("l_suppkey") % 20).cast("long")).alias("expected_count"),
    )


def observed(spark, d):
    li = table(spark, d, "lineitem")
    late = (F.col("l_shipdate") >= F.lit(CUT).cast("timestamp")) & (F.col("l_partkey") % 40 < 30 + F.col("l_suppkey") % 11)
    return li.filter(late & (F.col("l_suppkey") % 9 > 0)).select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("retailer_id"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string"), F.lit(" ")).alias("model_normalized"),
    )


def prior_state(spark, d):
    sources = table(spark, d, "supplier").filter("s_acctbal > 0").select(
        F.lit("retailer").alias("scope"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("retailer_id"),
        (F.col("s_suppkey") % 3).alias("failures"),
    )
    return sources.unionByName(spark.createDataFrame([("aggregate", None, 1)], schemas.STATE))


def disabled(spark, d):
    return table(spark, d, "supplier").filter("s_acctbal < 1000").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("retailer_id")
    )


RECALL_SQL = f"""lists AS (SELECT l_suppkey AS k, l_partkey % 40 AS m FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}' GROUP BY ALL),
  bench AS (SELECT k, 's' || k AS retailer_id, CASE WHEN k % 6 < 2 THEN 30 + k % 20 END AS expected_count FROM lists GROUP BY k),
  wanted AS (SELECT k, m FROM lists WHERE k % 6 <> 0),
  seen AS (SELECT l_suppkey AS k, l_partkey % 40 AS m FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}'
    AND l_partkey % 40 < 30 + l_suppkey % 11 AND l_suppkey % 9 > 0 GROUP BY ALL),
  counted AS (SELECT retailer_id, expected_count, (SELECT count(*) FROM seen s WHERE s.k = b.k) AS available,
    (SELECT count(*) FROM wanted w WHERE w.k = b.k) AS listed, (SELECT count(*) FROM wanted w JOIN seen s USING (k, m) WHERE w.k = b.k) AS hits FROM bench b),
  sized AS (SELECT *, coalesce(expected_count, listed) AS expected FROM counted),
  scored AS (SELECT *, CASE WHEN listed > 0 THEN greatest(hits, least(available, expected)) ELSE least(available, expected) END AS matched FROM sized),
  results AS (SELECT retailer_id, expected, matched, CASE WHEN expected = 0 THEN 1e0 ELSE {sql_round('(matched::DOUBLE / expected)', 4)} END AS recall,
    CASE WHEN expected = 0 THEN 1e0 ELSE {sql_round('(hits::DOUBLE / expected)', 4)} END AS model_recall, 0.9e0 AS threshold FROM scored),
  prior AS (SELECT 's' || s_suppkey AS retailer_id, s_suppkey % 3 AS failures FROM supplier WHERE s_acctbal > 0),
  off AS (SELECT 's' || s_suppkey AS retailer_id FROM supplier WHERE s_acctbal < 1000),
  audited AS (SELECT r.*, recall >= 0.9e0 AS pass, CASE WHEN recall >= 0.9e0 THEN 0 ELSE coalesce(failures, 0) + 1 END AS consecutive_failures
    FROM results r LEFT JOIN prior USING (retailer_id)),
  total AS (SELECT coalesce(sum(expected), 0) AS total_expected, coalesce(sum(matched), 0) AS total_matched,
    CASE WHEN coalesce(sum(expected), 0) = 0 THEN 1e0 ELSE {sql_round('(sum(matched)::DOUBLE / sum(expected))', 4)} END AS aggregate_recall FROM audited)"""
FIXTURE_SQL = f"""rate AS (SELECT count(*) AS active, count(*) FILTER (source_mode = 'fixture' OR contains(lower(coalesce(warning, '')), 'fixture')) AS fixture_hits FROM health
    WHERE status <> 'disabled'),
  fix AS (SELECT *, CASE WHEN active = 0 THEN 0e0 ELSE {sql_round('(fixture_hits::DOUBLE / active)', 4)} END AS fixture_usage_rate FROM rate)"""
BREACH_SQL = """breaches AS (SELECT 0 AS scope_rank, 'retailer' AS scope, retailer_id, recall, threshold, consecutive_failures, consecutive_failures >= 2 AS auto_disabled
    FROM audited WHERE NOT pass
  UNION ALL SELECT 1, 'fixture', NULL, fixture_usage_rate, 0.1e0, NULL, NULL FROM fix WHERE fixture_usage_rate > 0.1e0
  UNION ALL SELECT 2, 'aggregate', NULL, aggregate_recall, 0.93e0, 2, NULL FROM total WHERE aggregate_recall < 0.93e0)"""


def result(spark, d):
    return run_audit(
        benchmarks(spark, d), observed(spark, d), health_view(spark, d), prior_state(spark, d), disabled(spark, d),
        F.lit(GENERATED).cast("timestamp"),
    )


@query(
    "bench_dupes",
    "SELECT 's' || l_suppkey || '-' || l_partkey AS retailer_id, count(*) AS lists FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def bench_dupes(spark, d):
    # A list per line: a supplier's lists for one part are duplicates.
    source = F.concat(F.lit("s"), F.concat_ws("-", "l_suppkey", "l_partkey"))
    return duplicate_benchmarks(table(spark, d, "lineitem").select(source.alias("retailer_id")))


@query(
    "audit_recall",
    f"WITH {RECALL_SQL} SELECT retailer_id, expected, matched, recall, model_recall, threshold, pass, consecutive_failures, NOT pass AND consecutive_failures >= 2 AS auto_disabled FROM audited ORDER BY 1",
)
def audit_recall(spark, d):
    return result(spark, d).retailers.orderBy("retailer_id")


@query("audit_total", f"WITH {RECALL_SQL} SELECT *, 0.93e0 AS threshold, aggregate_recall >= 0.93e0 AS pass FROM total")
def audit_total(spark, d):
    return result(spark, d).total


@query("fixture_rate", f"WITH {HEALTH_SQL}, {FIXTURE_SQL} SELECT *, 0.1e0 AS threshold, fixture_usage_rate <= 0.1e0 AS pass FROM fix")
def fixture_rate(spark, d):
    return audit.fixture_rate(health_view(spark, d))


@query(
    "audit_breaches",
    f"""WITH {RECALL_SQL}, {HEALTH_SQL}, {FIXTURE_SQL}, {BREACH_SQL} SELECT *, CASE scope WHEN 'aggregate' THEN 'aggregate ' || printf('%.4f', recall) || ' < ' || printf('%.2f', threshold)
      WHEN 'fixture' THEN 'fixture usage ' || printf('%.4f', recall) || ' > ' || printf('%.2f', threshold)
      ELSE retailer_id || ' ' || printf('%.4f', recall) || ' < ' || printf('%.2f', threshold) || ' (streak=' || consecutive_failures || ')' END AS text FROM breaches
      ORDER BY scope_rank, retailer_id""",
)
def audit_breaches(spark, d):
    return result(spark, d).breaches.withColumn("text", audit.breach_text()).orderBy("scope_rank", "retailer_id")


@query(
    "audit_tickets",
    f"""WITH {RECALL_SQL}, {HEALTH_SQL}, {FIXTURE_SQL}, {BREACH_SQL}
      SELECT '2024-02-01T10-20-30-000Z-' || scope || '-' || CASE scope WHEN 'retailer' THEN retailer_id WHEN 'fixture' THEN 'fixture-usage' ELSE 'all-retailers' END || '.md' AS ticket_name,
        concat_ws(chr(10), '# Coverage breach: ' || CASE scope WHEN 'retailer' THEN retailer_id WHEN 'fixture' THEN 'fixture usage' ELSE 'aggregate recall' END, '',
          '- Generated at: 2024-02-01T10:20:30.000Z', '- Scope: ' || scope, '- ' || CASE scope WHEN 'fixture' THEN 'Fixture usage rate' ELSE 'Recall' END || ': ' || printf('%.4f', recall),
          '- Threshold: ' || printf('%.2f', threshold), '- Fixture usage rate: ' || printf('%.4f', fixture_usage_rate), '- Consecutive failures: ' || consecutive_failures,
          '- Aggregate recall: ' || printf('%.4f', aggregate_recall), CASE scope WHEN 'retailer' THEN '- Retailer: ' || retailer_id END,
          CASE scope WHEN 'retailer' THEN '- Parser auto-disabled: ' || CASE WHEN auto_disabled THEN 'yes' ELSE 'no' END END, '', '## Follow-up', '',
          '1. Review parser output against benchmark expectations.', '2. Patch parser selectors or mappings.', '3. Re-run the coverage audit and confirm thresholds pass.', '') AS body
      FROM breaches, fix, total""",
)
def audit_tickets(spark, d):
    return result(spark, d).tickets


@query(
    "audit_report",
    f"""WITH {RECALL_SQL}, {HEALTH_SQL}, {FIXTURE_SQL}, {BREACH_SQL}
      SELECT '{GENERATED}' AS generated_at, aggregate_recall, fixture_usage_rate, (SELECT count(*) FROM audited) AS sources, (SELECT count(*) FROM breaches) AS breach_rows,
        (SELECT string_agg(retailer_id || '=' || printf('%.4f', recall), ' ' ORDER BY retailer_id) FROM audited) AS recalls FROM total, fix""",
)
def audit_report(spark, d):
    row = result(spark, d).report()
    recalls = F.transform(
        F.array_sort(F.map_entries("per_retailer_recall")), lambda e: F.concat_ws("=", e["key"], F.format_string("%.4f", e["value"]))
    )
    return row.select(
        ts_text("generated_at").alias("generated_at"), "aggregate_recall", "fixture_usage_rate",
        F.size("retailers").alias("sources"), F.size("breaches").alias("breach_rows"), F.array_join(recalls, " ").alias("recalls"),
    )


@query(
    "metadata_row",
    f"""WITH {RECALL_SQL}, {HEALTH_SQL}, {FIXTURE_SQL} SELECT (SELECT count(*) FROM lineitem) AS offers_count, {sql_ts('(SELECT max(l_shipdate) FROM lineitem)')} AS newest_scrape,
        aggregate_recall, fixture_usage_rate, 0.1e0 AS fixture_usage_threshold FROM total, fix""",
)
def metadata_row(spark, d):
    offers, r = table(spark, d, "lineitem").withColumnRenamed("l_shipdate", "scraped_at"), result(spark, d)
    row = rollup.run_metadata({"offers": offers}, offers, F.lit(GENERATED).cast("timestamp"))
    return rollup.merge_coverage(row, r.total, r.fixture).select(
        "offers_count", ts_text("newest_scrape").alias("newest_scrape"), "aggregate_recall", "fixture_usage_rate", "fixture_usage_threshold"
    )


@query(
    "audit_state",
    f"""WITH {RECALL_SQL} SELECT 'retailer' AS scope, retailer_id, consecutive_failures AS failures FROM audited
      UNION ALL SELECT 'retailer', retailer_id, failures FROM prior WHERE retailer_id NOT IN (SELECT retailer_id FROM audited)
      UNION ALL SELECT 'aggregate', NULL, CASE WHEN aggregate_recall >= 0.93e0 THEN 0 ELSE 2 END FROM total""",
)
def audit_state(spark, d):
    return result(spark, d).state


@query(
    "newly_disabled",
    f"""WITH {RECALL_SQL}, n AS (SELECT retailer_id FROM audited WHERE NOT pass AND consecutive_failures >= 2 AND retailer_id NOT IN (SELECT retailer_id FROM off))
      SELECT 'new' AS list, retailer_id FROM n UNION ALL SELECT 'all', retailer_id FROM (SELECT * FROM off UNION SELECT * FROM n)""",
)
def newly_disabled(spark, d):
    r = result(spark, d)
    new = audit.newly_disabled(r.retailers, disabled(spark, d))
    return new.select(F.lit("new").alias("list"), "retailer_id").union(r.disabled.select(F.lit("all"), "retailer_id"))


RUNS_SQL = """runs AS (SELECT user_id, date_trunc('day', ts) AS run_at, count(*) FILTER (event_type = 'error') = 0 AS pass FROM events GROUP BY 1, 2)"""


def runs(spark, d):
    return (
        table(spark, d, "events")
        .groupBy(F.col("user_id").alias("retailer_id"), F.date_trunc("day", "ts").alias("run_at"))
        .agg((F.count_if(F.col("event_type") == "error") == 0).alias("pass"))
    )


@query(
    "fail_streak",
    f"""WITH {RUNS_SQL}, i AS (SELECT *, sum(pass::INT) OVER (PARTITION BY user_id ORDER BY run_at) AS island FROM runs),
      s AS (SELECT user_id AS retailer_id, run_at, pass, count(*) FILTER (NOT pass) OVER (PARTITION BY user_id, island ORDER BY run_at) AS n FROM i)
      SELECT retailer_id, {sql_ts('run_at')} AS run_at, pass, CASE WHEN pass THEN 0 ELSE n END AS consecutive_failures, NOT pass AND n >= 2 AS auto_disabled FROM s""",
)
def fail_streak(spark, d):
    return audit.streak_history(runs(spark, d)).withColumn("run_at", ts_text("run_at"))

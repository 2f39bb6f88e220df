"""Source health, fetch diagnosis and fallbacks over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom import rules
from offerloom.operators import crawl, dedupe, health, search
from offerloom.sources.tables import with_fallback
from workload.base import HEALTH_SQL, RETAILERS_SQL, health_view, query, retailers_view, sql_excerpt, sql_ts, table, ts_text

# Page fetches: a source is a user on a day, its events are the pages in time order.
ERROR_TEXT = (
    "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'HTTP 404 for page' WHEN event_id % 5 = 1 THEN 'http 403 Forbidden' "
    "WHEN event_id % 5 = 2 THEN 'Timed out' WHEN event_id % 5 = 3 THEN 'Request BLOCKED' ELSE 'HTTP 500' END END"
)
PAGE_INDEX_SQL = "event_id - min(event_id) OVER (PARTITION BY user_id)"
LOG_SQL = f"""log AS (SELECT user_id AS source, event_id, {PAGE_INDEX_SQL} AS page_index, 'u' || event_id AS url, {ERROR_TEXT} AS error,
    CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 3 END AS n, value FROM events)"""


def fetch_log(spark, d):
    e = table(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    index = F.col("event_id") - F.col("first_id")
    return e.join(first, "user_id").select(
        F.col("user_id").alias("source"), "event_id", index.alias("page_index"),
        F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.expr(ERROR_TEXT).alias("error"),
        F.when(F.col("event_type") == "view", F.lit(0)).otherwise(F.col("event_id") % 3).alias("n"), "value",
    )


STATUS_SQL = "try_cast(regexp_extract(error, '(?i)HTTP\\s+(\\d{3})', 1) AS INT)"
BOT_SQL = f"({STATUS_SQL} IN (401, 403, 429) OR contains(lower(error), 'captcha') OR contains(lower(error), 'forbidden') OR contains(lower(error), 'access denied') OR contains(lower(error), 'blocked'))"
DRIFT = ", ".join(str(s) for s in rules.URL_DRIFT_STATUS)


@query(
    "blocker_class",
    f"""WITH {LOG_SQL}, f AS (SELECT *, {STATUS_SQL} AS status, coalesce({BOT_SQL}, false) AS bot FROM log),
      a AS (SELECT source, max(CASE WHEN page_index = 0 AND status IN ({DRIFT}) THEN url END) AS drift_url, max(CASE WHEN page_index = 0 THEN status END) AS base_status, arg_min(url, page_index) FILTER (bot) AS bot_url,
        arg_min(url, page_index) FILTER (error IS NOT NULL) AS fail_url, count(*) FILTER (error IS NULL AND page_index = 0) > 0 AS first_ok,
        count(*) FILTER (error IS NOT NULL) AS failures, count(*) FILTER (error IS NULL) AS pages_crawled FROM f GROUP BY source)
      SELECT source, pages_crawled, CASE WHEN drift_url IS NOT NULL THEN 'Base deals URL returned ' || base_status || '.' WHEN bot_url IS NOT NULL THEN 'Request blocked, timed out, or fetch aborted.'
        WHEN first_ok AND failures > 0 THEN 'Later pages failed after base page succeeded.' WHEN pages_crawled > 0 AND source % 2 = 0 THEN 'Pages fetched successfully but no offers were extracted.' END AS details,
        CASE WHEN drift_url IS NOT NULL THEN 'url-drift' WHEN bot_url IS NOT NULL THEN 'anti-bot' WHEN first_ok AND failures > 0 THEN 'pagination'
        WHEN pages_crawled > 0 AND source % 2 = 0 THEN 'selector-drift' ELSE 'unknown' END AS classification,
        CASE WHEN drift_url IS NOT NULL THEN drift_url WHEN bot_url IS NOT NULL THEN bot_url WHEN first_ok AND failures > 0 THEN fail_url END AS url FROM a""",
)
def blocker_class(spark, d):
    log = fetch_log(spark, d)
    parsed = log.select("source").distinct().withColumn("parsed_count", F.col("source") % 2)
    return crawl.classify_blockers(log, parsed)


@query(
    "error_class",
    f"""WITH {LOG_SQL} SELECT event_id, CASE WHEN {STATUS_SQL} IN ({DRIFT}) THEN 'url-drift' WHEN {BOT_SQL} THEN 'anti-bot' ELSE 'unknown' END AS classification
      FROM log WHERE error IS NOT NULL""",
)
def error_class(spark, d):
    return fetch_log(spark, d).filter("error is not null").select("event_id", crawl.classify_error("error").alias("classification"))


@query(
    "first_nonempty",
    """WITH p AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'linked' WHEN 'view' THEN 'sitemap' WHEN 'purchase' THEN 'browser' WHEN 'signup' THEN 'fixture' ELSE CASE WHEN user_id % 3 = 0 THEN 'listing' ELSE 'retry' END END AS path_name,
        CASE user_id % 4 WHEN 0 THEN 'anti-bot' WHEN 1 THEN 'selector-drift' WHEN 2 THEN 'pagination' ELSE 'unknown' END AS kind FROM events),
      r AS (SELECT *, CASE WHEN path_name = 'listing' THEN 0 WHEN path_name = 'browser' AND kind IN ('anti-bot', 'unknown') THEN 1 WHEN path_name = 'linked' AND kind IN ('selector-drift', 'unknown') THEN 2
        WHEN path_name = 'sitemap' AND kind <> 'pagination' THEN 3 WHEN path_name = 'browser' AND kind <> 'pagination' THEN 4 WHEN path_name = 'fixture' THEN 5 END AS prio FROM p),
      k AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY prio) AS dr FROM r WHERE prio IS NOT NULL)
      SELECT event_id, user_id, path_name FROM k WHERE dr = 1""",
)
def first_nonempty(spark, d):
    names = {"click": "linked", "view": "sitemap", "purchase": "browser", "signup": "fixture"}
    # A retry is a path of its own, which is not among those that are tried.
    path = F.when(F.col("user_id") % 3 == 0, F.lit("listing")).otherwise(F.lit("retry"))
    for event, name in names.items():
        path = F.when(F.col("event_type") == event, F.lit(name)).otherwise(path)
    kind = F.get(F.array(*[F.lit(k) for k in ("anti-bot", "selector-drift", "pagination", "unknown")]), (F.col("user_id") % 4).cast("int"))
    rows = table(spark, d, "events").select("event_id", "user_id", path.alias("path_name"), kind.alias("kind"))
    tried = rows.withColumn("prio", crawl.fallback_priority("path_name", "kind")).filter("prio is not null")
    return dedupe.first_nonempty(tried, "user_id", "prio").select("event_id", "user_id", "path_name")


@query(
    "fallback_warning",
    f"""WITH {LOG_SQL} SELECT event_id, CASE event_id % 5 WHEN 0 THEN coalesce('Live extraction failed (' || error || '), loaded fixture data.', 'No offers extracted from live pages, loaded fixture data.') || ' Blocker hint: unknown.'
        WHEN 1 THEN concat_ws(' | ', error, 'Recovered via browser fallback (' || n || ' pages).') WHEN 2 THEN concat_ws(' | ', error, 'Recovered via linked product fallback (' || n || ' pages).')
        WHEN 3 THEN concat_ws(' | ', error, 'Recovered via sitemap fallback (' || n || ' pages).') ELSE error END AS warning FROM log""",
)
def fallback_warning(spark, d):
    paths = F.array(*[F.lit(p) for p in ("fixture", "browser", "linked", "sitemap", "listing")])
    path = F.get(paths, (F.col("event_id") % 5).cast("int"))
    return fetch_log(spark, d).select(
        "event_id", crawl.fallback_warning("error", path, F.lit("unknown"), "n").alias("warning")
    )


CLASS_SQL = f"CASE WHEN {STATUS_SQL} IN ({DRIFT}) THEN 'url-drift' WHEN {BOT_SQL} THEN 'anti-bot' ELSE 'unknown' END"


@query(
    "error_details",
    f"""WITH {LOG_SQL} SELECT event_id, CASE {CLASS_SQL} WHEN 'url-drift' THEN 'Base deals URL returned ' || {STATUS_SQL} || '.'
        WHEN 'anti-bot' THEN 'Request blocked, timed out, or fetch aborted.' ELSE 'Unexpected parser failure.' END AS details FROM log""",
)
def error_details(spark, d):
    return fetch_log(spark, d).select("event_id", crawl.error_details("error").alias("details"))


@query(
    "source_warning",
    f"""WITH {LOG_SQL} SELECT event_id, CASE WHEN source % 7 = 0 THEN 'Scraping disabled by retailer guardrail, loaded fixture data.'
        WHEN event_id % 3 = 0 THEN 'Fetch failed, loaded fixture data (' || coalesce(error, 'unknown') || '). Blocker hint: ' || {CLASS_SQL} || '.'
        WHEN event_id % 3 = 1 THEN coalesce('Live extraction failed (' || error || '), loaded fixture data.', 'No offers extracted from live pages, loaded fixture data.') || ' Blocker hint: unknown.'
        ELSE concat_ws(' | ', error, 'Recovered via sitemap fallback (' || n || ' pages).') END AS warning FROM log""",
)
def source_warning(spark, d):
    failure = F.when(F.col("event_id") % 3 == 0, F.coalesce("error", F.lit("")))
    path = F.when(F.col("event_id") % 3 == 1, F.lit("fixture")).otherwise(F.lit("sitemap"))
    said = crawl.source_warning(F.col("source") % 7 != 0, failure, "error", path, F.lit("unknown"), "n")
    return fetch_log(spark, d).select("event_id", said.alias("warning"))


@query(
    "fallback_switches",
    """WITH p AS (SELECT event_id, user_id % 4 AS k, user_id % 3 <> 0 AS browser, user_id % 7 <> 0 AS allowed,
        CASE event_type WHEN 'click' THEN 'linked' WHEN 'view' THEN 'sitemap' WHEN 'purchase' THEN 'browser' WHEN 'signup' THEN 'fixture' ELSE 'listing' END AS name FROM events)
      SELECT event_id, CASE WHEN NOT allowed AND name <> 'fixture' THEN NULL WHEN name = 'listing' THEN 0 WHEN name = 'browser' AND NOT browser THEN NULL
        WHEN name = 'browser' AND k IN (0, 3) THEN 1 WHEN name = 'linked' AND k IN (1, 3) THEN 2 WHEN name = 'sitemap' AND k <> 2 THEN 3
        WHEN name = 'browser' AND k <> 2 THEN 4 WHEN name = 'fixture' THEN 5 END AS prio FROM p""",
)
def fallback_switches(spark, d):
    """Order of recovery paths where a source may not be opened in a browser, or not be scraped."""
    names = {"click": "linked", "view": "sitemap", "purchase": "browser", "signup": "fixture"}
    path = F.lit("listing")
    for event, name in names.items():
        path = F.when(F.col("event_type") == event, F.lit(name)).otherwise(path)
    kind = F.get(F.array(*[F.lit(k) for k in ("anti-bot", "selector-drift", "pagination", "unknown")]), (F.col("user_id") % 4).cast("int"))
    prio = crawl.fallback_priority(path, kind, F.col("user_id") % 3 != 0, F.col("user_id") % 7 != 0)
    return table(spark, d, "events").select("event_id", prio.alias("prio"))


@query(
    "page_cutoff",
    f"""WITH {LOG_SQL}, w AS (SELECT *, count(*) FILTER (error IS NULL) OVER (PARTITION BY source ORDER BY page_index) AS ok_so_far FROM log),
      s AS (SELECT source, min(page_index) AS stop FROM w WHERE (error IS NULL AND n = 0 AND ok_so_far > 1) OR (error IS NOT NULL AND ok_so_far > 0) GROUP BY source)
      SELECT source, page_index, url FROM log LEFT JOIN s USING (source) WHERE stop IS NULL OR page_index <= stop""",
)
def page_cutoff(spark, d):
    rows = fetch_log(spark, d).withColumn("ok", F.col("error").isNull())
    return crawl.read_until_cutoff(rows).select("source", "page_index", "url")


@query(
    "src_fallback",
    """WITH f AS (SELECT l_suppkey AS source, count(*) AS n FROM lineitem GROUP BY 1), live AS (SELECT 2 * user_id AS source, value AS v FROM events)
      SELECT source, v, false AS used_fixture FROM live UNION ALL SELECT source, n::DOUBLE, true FROM f WHERE source NOT IN (SELECT source FROM live)""",
)
def src_fallback(spark, d):
    live = table(spark, d, "events").select((2 * F.col("user_id")).alias("source"), F.col("value").alias("v"))
    fixture = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").cast("double").alias("v"))
    return with_fallback(live, fixture)


HEALTH_OUT = ["retailer_id", "status", "offers_count", "warning", "discovered_count", "pages_crawled", "source_mode"]


def off(spark, d):
    return table(spark, d, "supplier").filter("s_nationkey < 4").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("retailer_id"))


@query(
    "disabled_sources",
    f"""WITH {HEALTH_SQL}, off AS (SELECT 's' || s_suppkey AS retailer_id FROM supplier WHERE s_nationkey < 4)
      SELECT {', '.join(HEALTH_OUT)} FROM health WHERE retailer_id NOT IN (SELECT retailer_id FROM off)
      UNION ALL SELECT retailer_id, 'disabled', 0, 'Parser disabled via config.', 0, 0, NULL FROM off""",
)
def disabled_sources(spark, d):
    skip = off(spark, d)
    live = health.skip_disabled(health_view(spark, d), skip).select(*HEALTH_OUT)
    return live.unionByName(health.disabled_health(skip).select(*HEALTH_OUT))


RUN_SQL = f"""run AS (SELECT 's' || source || 'd' || cast(event_id // 2000 AS VARCHAR) AS retailer_id, * FROM log)"""


@query(
    "source_health",
    f"""WITH {LOG_SQL}, {RUN_SQL}, w AS (SELECT retailer_id, count(*) AS warning_rows, string_agg(error, ' | ' ORDER BY page_index, error) AS warning FROM run WHERE error IS NOT NULL GROUP BY 1),
      o AS (SELECT retailer_id, count(*) FILTER (n = 2) AS k, count(*) AS p FROM run WHERE n > 0 AND error IS NULL GROUP BY 1),
      c AS (SELECT retailer_id, sum(n) AS discovered_count, sum(CAST(floor(value) AS BIGINT)) AS duration_ms, count(*) FILTER (error IS NULL) AS pages_crawled, bool_or(n = 1 AND error IS NOT NULL) AS fx,
        CASE WHEN bool_or(n = 2 AND event_id % 2 = 0) THEN 'http' WHEN bool_or(n = 1) THEN 'browser' WHEN bool_or(n = 2) THEN 'sitemap'
          WHEN bool_or(event_id % 2 = 0) THEN 'http' ELSE 'sitemap' END AS path FROM run GROUP BY 1)
      SELECT c.retailer_id, CASE WHEN fx THEN 'failed' ELSE 'ok' END AS status, coalesce(k, 0) AS offers_count, warning, coalesce(warning_rows, 0) AS warning_rows, false AS warns_fixture, duration_ms, discovered_count,
        coalesce(p, 0) AS parsed_count, pages_crawled, CASE WHEN fx THEN 'fixture' ELSE 'live' END AS source_mode, path AS execution_path FROM c LEFT JOIN w USING (retailer_id) LEFT JOIN o USING (retailer_id)""",
)
def source_health(spark, d):
    batch = F.floor(F.col("event_id") / 2000).cast("string")
    run = fetch_log(spark, d).withColumn("retailer_id", F.concat(F.lit("s"), F.col("source").cast("string"), F.lit("d"), batch))
    failed = F.col("error").isNotNull()
    # Pages with one row are the browser's; the others belong to the listing or the sitemap.
    path = F.when(F.col("n") == 1, F.lit(1)).when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.lit(2))
    pages = run.select(
        "retailer_id", F.col("n").alias("discovered_count"), F.floor("value").alias("duration_ms"), (~failed).alias("ok"),
        ((F.col("n") == 1) & failed).alias("used_fixture"), F.get(F.array(F.lit("http"), F.lit("browser"), F.lit("sitemap")), path).alias("execution_path"),
        path.alias("path_rank"),
    )
    warnings = run.filter(failed).select("retailer_id", F.col("page_index").alias("pos"), F.col("error").alias("text"))
    found = run.filter(~failed & (F.col("n") > 0))
    rows = health.source_health(pages, warnings, found, found.filter("n = 2"))
    return rows.join(health.joined_warnings(warnings), "retailer_id", "left")


@query(
    "warnings",
    f"WITH {HEALTH_SQL} SELECT retailer_id, retailer_id || ': ' || warning AS text FROM health WHERE coalesce(warning, '') <> '' AND status <> 'disabled' ORDER BY retailer_id",
)
def warnings(spark, d):
    return health.global_warnings(health_view(spark, d)).orderBy("retailer_id")


SUMMARY_SQL = """h AS (SELECT *, coalesce(source_mode = 'fixture', false) AS fx, trim(coalesce(warning, '')) <> '' AS warned FROM health),
  c AS (SELECT count(*) AS total_retailers, count(*) FILTER (status = 'ok' AND NOT (fx OR warned)) AS healthy_retailers, count(*) FILTER (status = 'ok' AND (fx OR warned)) AS degraded_retailers,
    count(*) FILTER (status = 'failed') AS failed_retailers, count(*) FILTER (status = 'disabled') AS disabled_retailers, count(*) FILTER (warned) AS warning_retailers,
    count(*) FILTER (fx) AS fixture_retailers, count(*) FILTER (NOT fx) AS live_or_unspecified, sum(offers_count) AS total_offers FROM h)"""


@query(
    "health_summary",
    f"""WITH {HEALTH_SQL}, {SUMMARY_SQL} SELECT *, CASE WHEN failed_retailers > 0 THEN 'critical' WHEN degraded_retailers + disabled_retailers > 0 THEN 'degraded' ELSE 'healthy' END AS level,
        CASE WHEN failed_retailers > 0 THEN failed_retailers || '/' || total_retailers || ' failed' WHEN degraded_retailers + disabled_retailers > 0 THEN healthy_retailers || '/' || total_retailers || ' healthy'
          ELSE healthy_retailers || '/' || total_retailers || ' stable' END AS headline,
        concat_ws(' | ', healthy_retailers || ' healthy', degraded_retailers || ' degraded', failed_retailers || ' failed', CASE WHEN disabled_retailers > 0 THEN disabled_retailers || ' disabled' END,
          CASE WHEN fixture_retailers > 0 THEN fixture_retailers || ' fixture-backed' END, CASE WHEN warning_retailers > 0 THEN warning_retailers || ' with warnings' END) AS detail FROM c""",
)
def health_summary(spark, d):
    return health.health_summary(health_view(spark, d))


@query("mode_counts", f"WITH {HEALTH_SQL} SELECT count(*) FILTER (source_mode = 'live') AS live, count(*) FILTER (source_mode = 'fixture') AS fixture FROM health")
def mode_counts(spark, d):
    return health.mode_counts(health_view(spark, d))


@query(
    "retailer_dim",
    f"""WITH {RETAILERS_SQL}, {HEALTH_SQL} SELECT r.retailer_id, name, country, currency, homepage_url, logo_url,
      {sql_ts("CASE WHEN status = 'ok' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE last_crawled_at END")} AS last_crawled_at FROM retailers r LEFT JOIN health h ON h.retailer_id = r.retailer_id""",
)
def retailer_dim(spark, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return health.retailer_dim(retailers_view(spark, d), health_view(spark, d), now).withColumn("last_crawled_at", ts_text("last_crawled_at"))


REL_SQL = f"""rel AS (SELECT r.retailer_id, name, coalesce(status, 'unknown') AS status, coalesce(source_mode, 'unknown') AS source_mode, warning, coalesce(offers_count, 0) AS offers_count,
    {sql_excerpt("coalesce(warning, '')", 130, 'None')} AS warning_excerpt, last_crawled_at FROM retailers r LEFT JOIN health h ON h.retailer_id = r.retailer_id)"""


@query(
    "reliability",
    f"""WITH {RETAILERS_SQL}, {HEALTH_SQL}, {REL_SQL} SELECT retailer_id, name, status, source_mode, offers_count, warning_excerpt,
        CASE status WHEN 'failed' THEN 0 WHEN 'disabled' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END AS status_rank,
        CASE status WHEN 'failed' THEN 'Failed' WHEN 'disabled' THEN 'Disabled' WHEN 'unknown' THEN 'Unknown' ELSE 'Healthy' END AS status_label,
        CASE source_mode WHEN 'live' THEN 'Live' WHEN 'fixture' THEN 'Fixture' ELSE 'Unknown' END AS mode_label FROM rel ORDER BY status_rank, name""",
)
def reliability(spark, d):
    rows = search.reliability(retailers_view(spark, d), health_view(spark, d))
    return search.sort_reliability(rows).select(
        "retailer_id", "name", "status", "source_mode", "offers_count", "warning_excerpt", "status_rank", "status_label", "mode_label"
    )


@query(
    "reliability_kpis",
    f"""WITH {RETAILERS_SQL}, {HEALTH_SQL}, {REL_SQL} SELECT count(*) FILTER (status = 'ok' AND source_mode = 'live') AS live_healthy,
      count(*) FILTER (status <> 'ok' OR warning IS NOT NULL) AS attention, count(*) FILTER (source_mode = 'fixture') AS fixture, count(*) FILTER (last_crawled_at IS NOT NULL) AS crawled FROM rel""",
)
def reliability_kpis(spark, d):
    return search.reliability_kpis(search.reliability(retailers_view(spark, d), health_view(spark, d)))

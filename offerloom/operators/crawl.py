"""Analytics over fetched pages: links, failures, cut-offs, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.text import as_col, present
from offerloom.functions.urls import host, is_offer_url, is_sitemap, path, resolve_url, same_site
from offerloom.operators.dedupe import first_rows


def _clean_link(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("&amp;"), F.lit("&")))


def page_links(pages: DataFrame, text: str = "html") -> DataFrame:
    """(…, pos, link): anchor targets in page order."""
    found = F.regexp_extract_all(as_col(text), F.lit("(?i)" + rules.HREF_ATTR), F.lit(2))
    keep = [c for c in pages.columns if c != text]
    return (
        pages.select(*keep, F.posexplode(F.transform(found, _clean_link)).alias("pos", "link"))
        .filter(F.col("link") != "")
    )


def sitemap_links(docs: DataFrame, text: str = "html") -> DataFrame:
    """(…, pos, link): <loc> entries of a sitemap."""
    found = F.regexp_extract_all(as_col(text), F.lit("(?i)" + rules.SITEMAP_LOC), F.lit(1))
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.transform(found, _clean_link)).alias("pos", "link")).filter(
        F.col("link") != ""
    )


def robots_sitemaps(docs: DataFrame, text: str = "html") -> DataFrame:
    """(…, pos, link): Sitemap lines of a robots file."""
    lines = F.transform(
        F.split(as_col(text), "\r?\n"), lambda s: F.regexp_extract(s, "(?i)" + rules.ROBOTS_SITEMAP, 1)
    )
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(lines).alias("pos", "link")).filter(F.col("link") != "")


def detail_candidates(
    links: DataFrame, site: str, page: Column | str = "page_id", pos: Column | str = "pos", cap: int | None = None
) -> DataFrame:
    """Detail links of a site, distinct: page by page, on a page detail paths before keyword paths.

    ``links``: site host column ``site``, base_url, link.  ``cap``: how many of
    each site a fetch budget allows; None keeps all.
    """
    order = [page, "prio", pos]
    absolute = links.withColumn("url", resolve_url("link", "base_url"))
    on_path = path("url")
    prio = F.when(on_path.rlike("(?i)" + rules.DETAIL_PATH), F.lit(0)).when(
        on_path.rlike("(?i)" + rules.KEYWORD_PATH), F.lit(1)
    )
    ranked = absolute.filter(same_site("url", F.col(site))).withColumn("prio", prio).filter("prio is not null")
    distinct = first_rows(ranked, [site, "url"], order)
    return distinct if cap is None else first_rows(distinct, [site], order, cap)


def sitemap_candidates(links: DataFrame, site: str, order: list[Column | str], cap: int | None = None) -> DataFrame:
    """Offer pages a sitemap names on its own site, distinct; ``cap`` as in ``detail_candidates``."""
    offers = links.filter(is_offer_url("link", F.col(site)))
    distinct = first_rows(offers, [site, "link"], order)
    return distinct if cap is None else first_rows(distinct, [site], order, cap)


def http_status(c: Column | str) -> Column:
    return F.regexp_extract(as_col(c), r"(?i)HTTP\s+(\d{3})", 1).try_cast("int")


def anti_bot_signal(error: Column | str, status: Column) -> Column:
    said = F.lower(as_col(error))
    words = [F.contains(said, F.lit(w)) for w in rules.ANTI_BOT_WORDS]
    hit = words[0]
    for w in words[1:]:
        hit = hit | w
    return F.coalesce(status.isin(*rules.ANTI_BOT_STATUS), F.lit(False)) | F.coalesce(hit, F.lit(False))


def classify_blockers(fetch_log: DataFrame, parsed: DataFrame) -> DataFrame:
    """Why a source yielded nothing: (source, classification, details, url, pages_crawled).

    ``fetch_log``: source, page_index, url, error (null = fetched).
    ``parsed``: source, parsed_count.  One pass with partial aggregates.
    """
    failed = F.col("error").isNotNull()
    status = http_status("error")
    log = fetch_log.withColumn("_failed", failed).withColumn("_status", status).withColumn(
        "_bot", failed & anti_bot_signal("error", status)
    )
    at = F.col("page_index")
    agg = log.groupBy("source").agg(
        F.min_by(F.struct("_status", "url"), F.when(failed & (at == 0), at)).alias("_base"),
        F.min_by("url", F.when(F.col("_bot"), at)).alias("_bot_url"),
        F.bool_or("_bot").alias("_any_bot"),
        F.bool_or(~failed & (at == 0)).alias("_first_ok"),
        F.count_if(failed).alias("_failures"),
        F.count_if(failed & (at == 0)).alias("_base_failures"),
        F.count_if(~failed).alias("pages_crawled"),
        F.min_by("url", F.when(failed, at)).alias("_fail_url"),
    )
    drift = F.coalesce(F.col("_base._status").isin(*rules.URL_DRIFT_STATUS), F.lit(False))
    later = F.col("_first_ok") & (F.col("_failures") > 0) & (F.col("_base_failures") == 0)
    empty = (F.col("pages_crawled") > 0) & (F.coalesce("parsed_count", F.lit(0)) == 0)
    kind = (
        F.when(drift, F.lit("url-drift"))
        .when(F.col("_any_bot"), F.lit("anti-bot"))
        .when(later, F.lit("pagination"))
        .when(empty, F.lit("selector-drift"))
        .otherwise(F.lit("unknown"))
    )
    return (
        agg.join(parsed.select("source", "parsed_count"), "source", "left")
        .withColumn("classification", kind)
        .withColumn(
            "url",
            F.when(drift, F.col("_base.url"))
            .when(F.col("classification") == "anti-bot", F.col("_bot_url"))
            .when(F.col("classification") == "pagination", F.col("_fail_url")),
        )
        .withColumn("details", blocker_details("classification", F.col("_base._status")))
        .select("source", "classification", "details", "url", "pages_crawled")
    )


def blocker_details(classification: Column | str, status: Column) -> Column:
    kind = as_col(classification)
    out = F.lit(None).cast("string")
    for name, text in rules.BLOCKER_DETAILS.items():
        shown = F.replace(F.lit(text), F.lit("{status}"), F.coalesce(status.cast("string"), F.lit("")))
        out = F.when(kind == name, shown).otherwise(out)
    return out


def classify_error(error: Column | str) -> Column:
    """Class of a failure outside the page loop."""
    status = http_status(error)
    return (
        F.when(F.coalesce(status.isin(*rules.URL_DRIFT_STATUS), F.lit(False)), F.lit("url-drift"))
        .when(anti_bot_signal(error, status), F.lit("anti-bot"))
        .otherwise(F.lit("unknown"))
    )


def error_details(error: Column | str) -> Column:
    """What is said about a failure outside the page loop."""
    said = blocker_details(classify_error(error), http_status(error))
    return F.coalesce(said, F.lit(rules.UNEXPECTED_DETAILS))


def failure_warning(error: Column | str) -> Column:
    """Warning text of a source whose run failed outside the page loop and that shows fixture rows."""
    before, after = rules.FETCH_FAILED_TEXT.split("{message}")
    message = F.concat(F.lit(before), F.coalesce(present(error), F.lit(rules.UNKNOWN_MESSAGE)), F.lit(after))
    return F.concat(message, F.lit(" Blocker hint: "), classify_error(error), F.lit("."))


def source_warning(
    allowed: Column | str, failure: Column | str, warning: Column | str, path_name: Column | str, classification: Column | str,
    pages: Column | str,
) -> Column:
    """Warning text of a source whatever came of it: not to be scraped, failed as a whole (``failure``), or crawled."""
    return (
        F.when(~as_col(allowed), F.lit(rules.GUARDRAIL_TEXT))
        .when(as_col(failure).isNotNull(), failure_warning(failure))
        .otherwise(fallback_warning(warning, path_name, classification, pages))
    )


def fallback_warning(warning: Column | str, path_name: Column | str, classification: Column | str, pages: Column | str) -> Column:
    """Warning text of a source after its recovery path; null without anything to say."""
    said, name = present(warning), as_col(path_name)
    hint = F.concat(F.lit(" Blocker hint: "), as_col(classification), F.lit("."))
    failed = F.concat(F.lit("Live extraction failed ("), said, F.lit("), loaded fixture data."))
    empty = F.lit("No offers extracted from live pages, loaded fixture data.")
    out = F.when(name == "fixture", F.concat(F.coalesce(failed, empty), hint))
    for path, shown in rules.RECOVERY_NAMES.items():
        recovered = F.concat(
            F.lit(f"Recovered via {shown} fallback ("), as_col(pages).cast("string"), F.lit(" pages).")
        )
        out = out.when(name == path, F.concat_ws(" | ", said, recovered))
    return out.otherwise(said)


def fallback_priority(
    path_name: Column | str, classification: Column | str, browser: Column | None = None, allowed: Column | None = None
) -> Column:
    """Order in which recovery paths count; null = the path is not tried.

    Listing pages first.  The browser path comes early for anti-bot and unknown
    blockers and late otherwise; fixture rows are the last resort.  ``browser``:
    whether the source may be opened in a browser (as if true when absent).
    ``allowed``: whether it may be scraped at all; if not, only fixture rows count.
    """
    name, kind = as_col(path_name), as_col(classification)
    early = kind.isin("anti-bot", "unknown")
    retry = kind.isin("anti-bot", "selector-drift", "url-drift", "unknown")
    opened = (name == "browser") & (F.lit(True) if browser is None else F.coalesce(browser, F.lit(False)))
    order = (
        F.when(name == "listing", F.lit(0))
        .when(opened & early, F.lit(1))
        .when((name == "linked") & kind.isin("selector-drift", "unknown"), F.lit(2))
        .when((name == "sitemap") & retry, F.lit(3))
        .when(opened & retry, F.lit(4))
        .when(name == "fixture", F.lit(5))
    )
    return order if allowed is None else F.when(F.coalesce(allowed, F.lit(False)) | (name == "fixture"), order)


def read_until_cutoff(pages: DataFrame, key: str = "source", index: str = "page_index") -> DataFrame:
    """Pages a listing walk reads before it stops.

    ``pages``: ok (fetched), n (rows extracted).  The walk ends with the first
    empty page once two pages were fetched, or the first failure after a fetch.
    Only two numbers per source decide this, so the running counts are reduced
    to them (two smallest fetched indexes, then the first stop after them) and
    joined back; no window runs over a source's pages.
    """
    ok = F.col("ok")
    two = first_rows(pages.filter(ok).select(key, index), [key], [index], 2).groupBy(key).agg(
        F.min(index).alias("_first"), F.max(index).alias("_second")
    )
    stop = (
        pages.select(key, index, "ok", "n")
        .join(two, key)
        .filter(
            (ok & (F.col("n") == 0) & (F.col(index) >= F.col("_second")) & (F.col("_second") > F.col("_first")))
            | (~ok & (F.col(index) > F.col("_first")))
        )
        .groupBy(key)
        .agg(F.min(index).alias("_stop"))
    )
    return (
        pages.join(stop, key, "left")
        .filter(F.col("_stop").isNull() | (F.col(index) <= F.col("_stop")))
        .drop("_stop")
    )


def link_classes(links: DataFrame, site: Column, url: str = "url") -> DataFrame:
    return (
        links.withColumn("is_sitemap", is_sitemap(url))
        .withColumn("same_site", same_site(url, site))
        .withColumn("is_offer", is_offer_url(url, site))
        .withColumn("link_host", host(url))
    )

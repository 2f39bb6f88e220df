"""Links, listing urls and page extraction over pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import urls
from offerloom.operators import crawl, extract
from offerloom.sources.listing import page_urls
from workload.base import query, spread_table, table

LINK = "'^[a-z]+://([^/?#]*)([^?#]*)([?][^#]*)?'"

CANON_SQL = f"""lower(regexp_extract(url, '^([a-z]+:)', 1)) || '//' || lower(regexp_extract(url, {LINK}, 1))
  || coalesce(nullif(regexp_replace(lower(regexp_extract(url, {LINK}, 2)), '/+$', ''), ''), '/')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""


@query(
    "canonical_url",
    f"""SELECT page_id, {CANON_SQL} AS canonical, lower(rtrim(trim('  Not a URL/' || page_id || '//  '), '/')) AS odd FROM (
      SELECT *, list_sort(list_filter(string_split(regexp_replace(regexp_extract(url, {LINK}, 3), '^[?]', ''), '&'),
        lambda p: p <> '' AND NOT regexp_matches(regexp_extract(p, '^[^=]*'), '(?i){rules.TRACKING_PARAMS}'))) AS kept FROM (
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_replace(url, '[?#].*$', '') || '?z=1&a=' || page_id || '&utm_x=1#f' END AS url FROM pages))""",
)
def canonical_url(spark, d):
    changed = F.concat(
        F.regexp_replace("url", "[?#].*$", ""), F.lit("?z=1&a="), F.col("page_id").cast("string"), F.lit("&utm_x=1#f")
    )
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(changed)
    odd = F.concat(F.lit("  Not a URL/"), F.col("page_id").cast("string"), F.lit("//  "))
    return table(spark, d, "pages").select(
        "page_id", urls.canonical_url(url).alias("canonical"), urls.canonical_url(odd).alias("odd")
    )


LINKS_SQL = f"""links AS (SELECT page_id, url, i - 1 AS pos, trim(replace(href, '&amp;', '&')) AS link FROM (
    SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS i FROM (
      SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\b[^>]*href="(.*?)"', 1) AS hrefs FROM pages)) WHERE trim(href) <> '')"""


def links_view(spark, d):
    return crawl.page_links(table(spark, d, "pages"))


@query("links", f"WITH {LINKS_SQL} SELECT page_id, pos, link FROM links")
def links(spark, d):
    return links_view(spark, d).select("page_id", "pos", "link")


SITEMAP = "concat('<urlset><url><loc> ', url, '&amp;k=1 </loc></url><URL><LOC>https://a.example.com/p/', cast(page_id as string), '</LOC></URL><loc></loc></urlset>')"


@query(
    "sitemap_links",
    """SELECT page_id, 'sitemap' AS kind, 0 AS pos, url || '&k=1' AS link FROM pages
      UNION ALL SELECT page_id, 'sitemap', 1, 'https://a.example.com/p/' || page_id FROM pages
      UNION ALL SELECT page_id, 'robots', 1, regexp_replace(url, '[?#].*$', '') || '/sitemap.xml' FROM pages
      UNION ALL SELECT page_id, 'robots', 4, '/s' || page_id || '.xml' FROM pages""",
)
def sitemap_links(spark, d):
    p = table(spark, d, "pages")
    s = crawl.sitemap_links(p.select("page_id", F.expr(SITEMAP).alias("html")))
    robots = F.concat(
        F.lit("User-agent: *\n  sitemap:  "), F.regexp_replace("url", "[?#].*$", ""),
        F.lit("/sitemap.xml  \r\nDisallow: /x\nSitemap: two words\nSITEMAP: /s"), F.col("page_id").cast("string"), F.lit(".xml"),
    )
    r = crawl.robots_sitemaps(p.select("page_id", robots.alias("html")))
    kind = lambda df, k: df.select("page_id", F.lit(k).alias("kind"), "pos", "link")
    return kind(s, "sitemap").union(kind(r, "robots"))


ABS_LINK = (
    "CASE WHEN pos % 6 = 0 THEN link WHEN pos % 6 = 1 THEN concat('a/../b', link, '?q=1') WHEN pos % 6 = 2 THEN concat('//CDN.example.com', link) "
    "WHEN pos % 6 = 3 THEN concat('?p=', cast(pos as string)) WHEN pos % 6 = 4 THEN concat('HTTPS://Other.example.com', link, '#x') ELSE '../up' END"
)
ORIGIN_SQL = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
PATH_SQL = f"regexp_extract(url, {LINK}, 2)"
FOLDER_SQL = f"regexp_extract({PATH_SQL}, '^(.*/)', 1)"


def sql_spelled(url: str) -> str:
    """Characters beyond ASCII as the bytes a browser sends."""
    return f"array_to_string(list_transform(string_split({url}, ''), lambda c: CASE WHEN unicode(c) > 126 THEN url_encode(c) ELSE c END), '')"


@query(
    "abs_url",
    f"""WITH {LINKS_SQL}, r AS (SELECT page_id, pos, CASE WHEN pos % 6 = 0 THEN {ORIGIN_SQL} || link
        WHEN pos % 6 = 1 THEN {ORIGIN_SQL} || {FOLDER_SQL} || 'b' || link || '?q=1'
        WHEN pos % 6 = 2 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example.com' || link
        WHEN pos % 6 = 3 THEN {ORIGIN_SQL} || {PATH_SQL} || '?p=' || pos WHEN pos % 6 = 4 THEN 'https://other.example.com' || link || '#x'
        ELSE {ORIGIN_SQL} || regexp_replace({FOLDER_SQL}, '[^/]*/$', '') || 'up' END AS url FROM links)
      SELECT page_id, pos, {sql_spelled('url')} AS resolved FROM r""",
)
def abs_url(spark, d):
    return links_view(spark, d).select("page_id", "pos", urls.resolve_url(F.expr(ABS_LINK), "url").alias("resolved"))


CLASS_URL = (
    "CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN concat(regexp_replace(url, '[?#].*$', ''), '/Trail-Shoes') "
    "WHEN page_id % 4 = 2 THEN concat(regexp_replace(url, '[?#].*$', ''), '/dp/sitemap.XML?x') ELSE concat('https://www.', cast(page_id as string), '.example.com/p/1') END"
)


@query(
    "link_class",
    f"""SELECT page_id, regexp_matches(u, '(?i){rules.SITEMAP_URL}') AS is_sitemap, regexp_replace(h, '^www[.]', '') = site AS same_site,
        regexp_replace(h, '^www[.]', '') = site AND regexp_matches(regexp_extract(u, {LINK}, 2), '(?i){rules.OFFER_PATH}') AS is_offer, h AS link_host
      FROM (SELECT page_id, u, lower(regexp_extract(u, {LINK}, 1)) AS h, regexp_replace(lower(regexp_extract(url, {LINK}, 1)), '^www[.]', '') AS site
        FROM (SELECT page_id, url, {CLASS_URL} AS u FROM pages))""",
)
def link_class(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.expr(CLASS_URL).alias("link"))
    return crawl.link_classes(rows, urls.host("url"), "link").select("page_id", "is_sitemap", "same_site", "is_offer", "link_host")


TOP_LINK = "CASE WHEN pos % 3 = 0 THEN concat('/pdp', link) WHEN pos % 3 = 1 THEN concat('/trail', link) ELSE link END"


@query(
    "link_topn",
    f"""WITH {LINKS_SQL}, c AS (SELECT page_id, pos, regexp_extract(url, {LINK}, 1) AS site, {sql_spelled(f'({ORIGIN_SQL} || {TOP_LINK})')} AS url, CASE pos % 3 WHEN 0 THEN 0 ELSE 1 END AS prio
        FROM links WHERE pos % 3 < 2 OR regexp_matches(link, '(?i){rules.KEYWORD_PATH}')),
      u AS (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY page_id, prio, pos) AS rn FROM c)
      SELECT site, url, prio, page_id, pos FROM u WHERE rn = 1""",
)
def link_topn(spark, d):
    rows = links_view(spark, d).select("page_id", "pos", urls.host("url").alias("site"), F.col("url").alias("base_url"), F.expr(TOP_LINK).alias("link"))
    return crawl.detail_candidates(rows, "site").select("site", "url", "prio", "page_id", "pos")


MAP_LINK = "concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), CASE WHEN pos % 3 = 0 THEN '/Product' WHEN pos % 3 = 1 THEN '/p' ELSE '/other' END, link)"


@query(
    "sitemap_topn",
    f"""WITH {LINKS_SQL}, c AS (SELECT page_id, pos, regexp_extract(url, {LINK}, 1) AS site, {MAP_LINK} AS link FROM links),
      o AS (SELECT * FROM c WHERE regexp_matches(regexp_extract(link, {LINK}, 2), '(?i){rules.OFFER_PATH}')),
      u AS (SELECT *, row_number() OVER (PARTITION BY site, link ORDER BY page_id, pos) AS rn FROM o)
      SELECT site, link, page_id, pos FROM u WHERE rn = 1""",
)
def sitemap_topn(spark, d):
    rows = links_view(spark, d).select("page_id", "pos", urls.host("url").alias("site"), F.expr(MAP_LINK).alias("link"))
    return crawl.sitemap_candidates(rows, "site", ["page_id", "pos"]).select("site", "link", "page_id", "pos")


@query(
    "page_urls",
    """WITH s AS (SELECT page_id, page_id % 3 AS k, 2 + page_id % 2 AS lo, 1 + page_id % 5 AS hi, regexp_replace(url, '[?#].*$', '') AS b FROM pages)
      SELECT page_id, 0 AS page_index, CASE WHEN k = 1 THEN b || '?page=1&x=2' ELSE b END AS url FROM s
      UNION ALL SELECT page_id, n - lo + 1, CASE WHEN k = 1 THEN b || '?page=' || n || '&x=2' ELSE regexp_extract(b, '^([a-z]+://[^/]*)', 1) || '/deals/page/' || n END
      FROM (SELECT *, unnest(generate_series(lo, hi)) AS n FROM s WHERE k > 0)""",
)
def page_urls_query(spark, d):
    kind = F.col("page_id") % 3
    base = F.regexp_replace("url", "[?#].*$", "")
    sources = table(spark, d, "pages").select(
        "page_id",
        F.when(kind == 1, F.concat(base, F.lit("?page=1&x=2"))).otherwise(base).alias("base_url"),
        F.when(kind == 0, "none").when(kind == 1, "query").otherwise("path").alias("strategy"),
        F.lit("page").alias("page_param"),
        F.lit("/deals/page/{page}").alias("path_template"),
        (2 + F.col("page_id") % 2).cast("int").alias("start_page"),
        (1 + F.col("page_id") % 5).cast("int").alias("max_pages"),
    )
    return page_urls(sources, "page_id")


# --- extraction: html made from part rows, compared with those rows ------------------
PRICE = "cast(cast(p_retailprice as decimal(12,2)) as string)"
ITEM = "concat(p_name, ' Running Shoes ', cast(p_size as string))"
NOISE = "<script>var t = 1;</script><script type='application/ld+json'>{broken</script>"


def part_pages(spark, d, html, url="concat('https://shop.example.com/pdp/', cast(p_partkey as string))"):
    return spread_table(spark, d, "part").select(
        F.col("p_partkey").alias("source"), F.lit(0).alias("page_index"), F.expr(url).alias("base_url"),
        F.concat(F.lit("<html>" + NOISE), F.expr(html), F.lit("</html>")).alias("html"),
    )


def whole_pages(spark, d):
    return spread_table(spark, d, "pages").select(
        (-1 - F.col("page_id")).alias("source"), F.lit(0).alias("page_index"), F.col("url").alias("base_url"), "html"
    )


OUT = ["source", "pos", "url", "title_raw", "brand", "price_current", "price_original", "in_stock", "sku", "gtin"]

JSONLD_HTML = (
    "concat('<script type=\"application/ld+json\">{\"@graph\":[{\"x\":{\"y\":[[{\"@type\":\"PRODUCT\",\"name\":\"', {ITEM}, '\",\"url\":\"/p/', cast(p_partkey as string), "
    "'\",\"brand\":', CASE WHEN p_size % 2 = 0 THEN concat('\"', p_brand, '\"') ELSE concat('{{\"name\":\"', p_brand, '\"}}') END, "
    "',\"sku\":', CASE WHEN p_size % 3 = 0 THEN cast(p_partkey as string) ELSE concat('\"S', cast(p_partkey as string), '\"') END, ',\"gtin\":\"1\",\"gtin13\":\"13', cast(p_size as string), "
    "'\",\"offers\":', CASE WHEN p_size % 4 = 0 THEN concat('[{{\"price\":\"', {PRICE}, '\",\"availability\":\"http://x/OutOfStock\"}},{{\"price\":1}}]') "
    "WHEN p_size % 4 = 1 THEN concat('{{\"price\":', {PRICE}, ',\"highPrice\":\"5000\",\"availability\":\"InStock\"}}') WHEN p_size % 4 = 2 THEN concat('{{\"price\":', {PRICE}, '}}') ELSE '{{\"price\":0}}' END, "
    "'}}]]}}}},{{\"@type\":\"Product\",\"name\":\"Gift guide shoes\",\"offers\":{{\"price\":5}}}}]}}</script>')"
).replace("{ITEM}", ITEM).replace("{PRICE}", PRICE).replace("{{", "{").replace("}}", "}")


@query(
    "extract_jsonld",
    f"""SELECT p_partkey AS source, 0 AS pos, 'https://shop.example.com/p/' || p_partkey AS url, {ITEM} AS title_raw, p_brand AS brand,
        {PRICE}::DOUBLE AS price_current, CASE WHEN p_size % 4 = 1 THEN 5000e0 END AS price_original, p_size % 4 <> 0 AS in_stock,
        CASE WHEN p_size % 3 > 0 THEN 'S' || p_partkey END AS sku, '13' || p_size AS gtin FROM part WHERE p_size % 4 < 3""",
)
def extract_jsonld(spark, d):
    rows = part_pages(spark, d, JSONLD_HTML).unionByName(whole_pages(spark, d))
    return extract.extract_jsonld(rows).select(*OUT)


STATE_HTML = (
    "concat('<script id=x>window.__STATE__ = {\"a\":{\"items\":[{\"productName\":\"', {ITEM}, '\",\"link\":\"?i=', cast(p_partkey as string), '\",\"brand\":{\"name\":\"', p_brand, '\"},\"product_id\":', cast(p_partkey as string), ',', "
    "CASE WHEN p_size % 4 = 0 THEN concat('\"price\":\"$', {PRICE}, '\",\"listPrice\":9999') WHEN p_size % 4 = 1 THEN concat('\"prices\":{\"sale\":', {PRICE}, ',\"list\":1}') "
    "WHEN p_size % 4 = 2 THEN concat('\"pricing_information\":{\"currentPrice\":', {PRICE}, ',\"standardPrice\":\"9,000.50\"},\"availability\":\"Sold out\"') ELSE concat('\"price\":{\"amount\":', {PRICE}, '}') END, "
    "'},{\"name\":\"Plain tee\",\"price\":3}]}};</script>')"
).replace("{ITEM}", ITEM).replace("{PRICE}", PRICE)


@query(
    "extract_state",
    f"""SELECT p_partkey AS source, 0 AS pos, 'https://shop.example.com/pdp/' || p_partkey || '?i=' || p_partkey AS url, {ITEM} AS title_raw, p_brand AS brand,
        {PRICE}::DOUBLE AS price_current, CASE WHEN p_size % 4 = 0 THEN 9999e0 WHEN p_size % 4 = 2 THEN 9000.5e0 END AS price_original,
        p_size % 4 <> 2 AS in_stock, CAST(p_partkey AS VARCHAR) AS sku, CAST(NULL AS VARCHAR) AS gtin FROM part WHERE p_size % 4 < 3""",
)
def extract_state(spark, d):
    rows = part_pages(spark, d, STATE_HTML).unionByName(whole_pages(spark, d))
    return extract.extract_state(rows).select(*OUT)


CARD_HTML = (
    "concat(repeat('. ', 300), '<div data-x=\"sku: K', cast(1000 + p_partkey as string), '\"><a class=c href=\"/p/', replace(p_name, ' ', '-'), '-shoes-', cast(p_partkey as string), '.html\"', "
    "CASE WHEN p_size % 3 = 0 THEN concat(' aria-label=\"', {ITEM}, '\"') ELSE '' END, '>', CASE WHEN p_size % 3 = 1 THEN concat('<b>', {ITEM}, '</b>') ELSE '' END, '</a> <i>$', {PRICE}, '</i> was CAD 8,000.00 ', "
    "CASE WHEN p_size % 5 = 0 THEN 'Sold-out' ELSE '' END, '</div>', repeat('. ', 600), '<a href=\"/x\">short</a>')"
).replace("{ITEM}", ITEM).replace("{PRICE}", PRICE)


@query(
    "extract_cards",
    f"""SELECT p_partkey AS source, 0 AS pos, 'https://shop.example.com/p/' || replace(p_name, ' ', '-') || '-shoes-' || p_partkey || '.html' AS url,
        CASE WHEN p_size % 3 = 2 THEN p_name || ' shoes ' || p_partkey ELSE {ITEM} END AS title_raw, CAST(NULL AS VARCHAR) AS brand,
        {PRICE}::DOUBLE AS price_current, 8000e0 AS price_original, p_size % 5 <> 0 AS in_stock, 'K' || (1000 + p_partkey) AS sku, CAST(NULL AS VARCHAR) AS gtin FROM part""",
)
def extract_cards(spark, d):
    rows = part_pages(spark, d, CARD_HTML).unionByName(whole_pages(spark, d))
    return extract.extract_cards(rows).select(*OUT)


TRACK_HTML = (
    "concat('<title>', {ITEM}, ' &amp; more | Shop</title><img src=\"t?pr%3D', {PRICE}, '&pr%3D99999\">', CASE WHEN p_size % 2 = 0 THEN 'out of stock' ELSE '' END)"
).replace("{ITEM}", ITEM).replace("{PRICE}", PRICE)
TRACK_URL = "concat('https://shop.example.com/', CASE WHEN p_size % 3 = 0 THEN 'list' ELSE 'PDP' END, '/', cast(p_partkey as string))"


@query(
    "extract_tracking",
    f"""SELECT p_partkey AS source, 0 AS pos, {TRACK_URL} AS url, {ITEM} || ' & more' AS title_raw, CAST(NULL AS VARCHAR) AS brand, {PRICE}::DOUBLE AS price_current,
        CAST(NULL AS DOUBLE) AS price_original, p_size % 2 <> 0 AS in_stock, CAST(NULL AS VARCHAR) AS sku, CAST(NULL AS VARCHAR) AS gtin FROM part WHERE p_size % 3 > 0""",
)
def extract_tracking(spark, d):
    rows = part_pages(spark, d, TRACK_HTML, TRACK_URL).unionByName(whole_pages(spark, d))
    return extract.extract_tracking(rows).select(*OUT)


ALL_HTML = (
    "concat('<title>', {ITEM}, '</title>', '<script type=\"application/ld+json\">{\"@type\":\"Product\",\"name\":\"', {ITEM}, '\",\"price\":\"', {PRICE}, '\",\"offers\":{\"price\":', {PRICE}, '}}</script>', repeat('. ', 700), "
    "'<p>t?pr%3D', CASE WHEN p_size % 2 = 0 THEN {PRICE} ELSE '77.00' END, '</p>')"
).replace("{ITEM}", ITEM).replace("{PRICE}", PRICE)


@query(
    "extract_all",
    f"""SELECT p_partkey AS source, 'https://shop.example.com/pdp/' || p_partkey AS url, {ITEM} AS title_raw, price_current, extractor_rank, 3 AS discovered_count FROM (
        SELECT *, {PRICE}::DOUBLE AS price_current, 0 AS extractor_rank FROM part UNION ALL SELECT *, 77e0, 3 FROM part WHERE p_size % 2 = 1)""",
)
def extract_all(spark, d):
    # Structured data is found as product and as offer-like object; the tracking price repeats or differs.
    rows = part_pages(spark, d, ALL_HTML).unionByName(whole_pages(spark, d))
    offers, discovered = extract.extract_offers(rows)
    return offers.join(discovered, ["source", "page_index"]).select(
        "source", "url", "title_raw", "price_current", "extractor_rank", "discovered_count"
    )

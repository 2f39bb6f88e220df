"""Fixed values.

Word lists, alias tables, patterns and thresholds that decide results.  They
are plain data: every function that uses one takes it as a parameter with the
value below as its default.
"""

from __future__ import annotations

# --- fixed values: brand aliases, in matching order -------------------------
BRAND_ALIASES = {
    "asics": "ASICS",
    "new balance": "New Balance",
    "nb": "New Balance",
    "brooks": "Brooks",
    "adidas": "adidas",
    "nike": "Nike",
    "hoka": "HOKA",
    "saucony": "Saucony",
}

# --- fixed values: model aliases --------------------------------------------
MODEL_ALIASES = {
    "gel kayano 30": "gel-kayano-30",
    "gel-kayano 30": "gel-kayano-30",
    "gelkayano 30": "gel-kayano-30",
    "pegasus 41": "pegasus-41",
    "fresh foam 1080 v13": "fresh-foam-1080-v13",
}

# --- fixed values: tokens that carry no product signal ----------------------
LOW_SIGNAL_TOKENS = [
    "men", "mens", "women", "womens", "unisex", "kids", "youth", "junior",
    "running", "trail", "shoe", "shoes",
]

# --- fixed values: gender words, in priority order --------------------------
GENDER_WORDS = [
    ("women", ["women", "womens", "women's"]),
    ("men", ["men", "mens", "men's"]),
    ("kids", ["kids", "youth", "junior"]),
    ("unisex", ["unisex"]),
]

# --- fixed values: words dropped before a title is matched ------------------
MATCH_NOISE_WORDS = ["men", "women", "womens", "mens", "trail", "running"]

# --- fixed values: vocabularies ---------------------------------------------
GENDERS = ["men", "women", "unisex", "kids"]
CATEGORIES = ["running", "trail"]
HEALTH_STATUSES = ["ok", "disabled", "failed"]
SOURCE_MODES = ["live", "fixture"]
EXECUTION_PATHS = ["browser", "http", "fixture"]
BREACH_SCOPES = ["retailer", "aggregate", "fixture"]
COUNTRY = "CA"
CURRENCY = "CAD"
UNKNOWN_BRAND = "Unknown"
MATCH_RULES_VERSION = "v1-hybrid-exact-fallback"

# --- fixed values: named html entities --------------------------------------
NAMED_ENTITIES = {"amp": "&", "quot": '"', "apos": "'", "nbsp": " "}

# --- fixed values: item classifier patterns (case-insensitive) --------------
REJECT_TEXT = [
    r"\badd to wish ?list\b",
    r"\bproduct not added to wishlist\b",
    r"\bstars?\s*&\s*up\b",
    r"\bchance to win\b",
    r"\bgift guide\b",
    r"\bgifts?\s+for\s+under\b",
    r"\bdeals?\s+under\b",
    r"\bdoor\s+crashers?\b",
    r"\bnew arrivals?\b",
    r"\bbest sellers?\b",
    r"\bcss-",
    r"var\(--",
    r"\{[^}]+\}",
]
REJECT_URL = [
    r"\bwishlist\b",
    r"\bcontest\b",
    r"\bcart\b",
    r"href\s*=?\s*['\"]?#['\"]?",
    r"^#$",
]
ACCESSORY_TERMS = [
    r"\bt-?shirt\b",
    r"\btee\b",
    r"\bhoodie\b",
    r"\bjacket\b",
    r"\bshorts?\b",
    r"\bpants?\b",
    r"\bleggings?\b",
    r"\btights?\b",
    r"\bsocks?\b",
    r"\bbras?\b",
    r"\bhats?\b",
    r"\bcaps?\b",
    r"\bgloves?\b",
    r"\bbackpacks?\b",
    r"\bbags?\b",
    r"\bbottles?\b",
    r"\bbelts?\b",
    r"\bwatches?\b",
    r"\bsunglasses?\b",
]
FOOTWEAR_TERMS = r"\b(shoe|shoes|sneaker|sneakers|spike|spikes|cleat|cleats|footwear)\b"
RUNNING_CONTEXT = r"\b(running|trail|road)\b"
MODEL_FAMILIES = (
    r"\b(guide|endorphin|cloudrunner|cloudmonster|kayano|pegasus|clifton|speedgoat|novablast"
    r"|ghost|ride|vomero|adizero|adios|alphafly|vaporfly|boston|glycerin|bondi|mach|peregrine"
    r"|sense\s+ride|fresh\s+foam|gel[-\s]?nimbus)\b"
)
VERSIONED_MODEL = r"\b[a-z][a-z0-9-]*(?:\s+[a-z0-9-]+){0,3}\s+\d{1,2}(?:\.\d+)?\b"
PRODUCT_URL = [r"/(p|pd|product|products)/", r"sku=|pid=|product[_-]?id"]

# --- fixed values: size patterns, first match wins ---------------------------
# (pattern, output format over the numbered groups, which are put in upper case)
SIZE_PATTERNS = [
    (r"\b([mw])\s*(\d{1,2}(?:\.\d+)?)\s*[/-]\s*([mw])\s*(\d{1,2}(?:\.\d+)?)\b", "{1}{2}/{3}{4}"),
    (r"\b(m)\s*(\d{1,2}(?:\.\d+)?)\s+(w)\s*(\d{1,2}(?:\.\d+)?)\b", "{1}{2}/{3}{4}"),
    (r"\b(w)\s*(\d{1,2}(?:\.\d+)?)\s+(m)\s*(\d{1,2}(?:\.\d+)?)\b", "{3}{4}/{1}{2}"),
    (r"\b([mw])\s*(\d{1,2}(?:\.\d+)?)\b", "{1}{2}"),
    (r"\b(us|eu)\s*(\d{1,2}(?:\.\d+)?)\b", "{1} {2}"),
    (r"\bsize\s*:?\s*(\d{1,2}(?:\.\d+)?)\b", "Size {1}"),
]

# --- fixed values: url rules --------------------------------------------------
TRACKING_PARAMS = r"^(utm_|fbclid$|gclid$|ref$|referrer$|mc_eid$|mc_cid$)"
SITEMAP_URL = r"sitemap|\.xml(\?|$)"
OFFER_PATH = r"running|trail|shoe|footwear|product|products|/pd/|/p/|/dp/"
DETAIL_PATH = r"/pdp/|/product/|/pd/|/p/"
KEYWORD_PATH = r"running|trail|shoe|footwear"
SLUG_NOISE = r"\b(?:pdp|product|products|pd|p)\b"

# --- fixed values: price patterns ---------------------------------------------
MARKED_PRICE = r"(?:CAD|CA\$|C\$|\$)\s*([0-9][0-9\s,]*(?:\s*[.,]\s*[0-9]{2})?)"
PRICE_WORD = r"\b(?:price|sale|now|from|was|save)\b"
BARE_PRICE = r"\b([1-9][0-9]{1,3}(?:[.,][0-9]{2}))\b"
BARE_PRICE_RANGE = (20.0, 2500.0)

# --- fixed values: page patterns ------------------------------------------------
SCRIPT_TAG = r"<script[^>]*>([\s\S]*?)</script>"
JSONLD_TAG = r"<script[^>]*application/ld\+json[^>]*>[\s\S]*?</script>"
ANCHOR_TAG = r"<a\b[^>]*href=([\"'])(.*?)\1[^>]*>([\s\S]*?)</a>"
HREF_ATTR = r"<a\b[^>]*href=([\"'])(.*?)\1"
SITEMAP_LOC = r"<loc>\s*([^<]+?)\s*</loc>"
ROBOTS_SITEMAP = r"^\s*Sitemap:\s*(\S+)\s*$"
PAGE_TITLE = r"<title[^>]*>([\s\S]*?)</title>"
TRACKED_PRICE = r"\bpr%3D([0-9]+(?:\.[0-9]{2})?)"
SOLD_OUT = r"out[-\s]?of[-\s]?stock|sold[-\s]?out"
CARD_SKU = r"(?:sku|product(?:[_\s-]?id)?)[\"':\s-]*([a-z0-9-]{4,})"
CARD_GTIN = r"(?:gtin|ean|upc)[\"':\s-]*([0-9]{8,14})"
CARD_WINDOW_BEFORE = 400
CARD_WINDOW_AFTER = 700
MIN_TITLE = 8
STATE_TITLE_KEYS = ["name", "title", "productName", "product_name"]
STATE_PRICE_PATHS = [
    "price", "currentPrice", "salePrice", "offerPrice", "pricing_information.currentPrice",
    "prices.final", "prices.sale", "prices.current",
]
STATE_NESTED_PRICE_PATHS = ["price.amount", "price.value", "prices.current.amount"]
STATE_LIST_PRICE_PATHS = [
    "originalPrice", "compareAtPrice", "listPrice", "pricing_information.standardPrice",
    "prices.list", "prices.original", "compareAtPrice.amount", "prices.original.amount",
    "priceRange.max",
]

# --- fixed values: fetch diagnosis ------------------------------------------------
URL_DRIFT_STATUS = [404, 410, 451, 500, 502, 503]
ANTI_BOT_STATUS = [401, 403, 429]
ANTI_BOT_WORDS = ["captcha", "forbidden", "access denied", "blocked"]
BLOCKER_DETAILS = {
    "url-drift": "Base deals URL returned {status}.",
    "anti-bot": "Request blocked, timed out, or fetch aborted.",
    "pagination": "Later pages failed after base page succeeded.",
    "selector-drift": "Pages fetched successfully but no offers were extracted.",
}
UNEXPECTED_DETAILS = "Unexpected parser failure."
GUARDRAIL_TEXT = "Scraping disabled by retailer guardrail, loaded fixture data."
FETCH_FAILED_TEXT = "Fetch failed, loaded fixture data ({message})."
UNKNOWN_MESSAGE = "unknown"
RECOVERY_NAMES = {"browser": "browser", "linked": "linked product", "sitemap": "sitemap"}

# --- fixed values: thresholds -------------------------------------------------------
BRANDED_THRESHOLD = 0.6
BRANDED_MARGIN = 0.04
BRANDLESS_THRESHOLD = 0.72
BRANDLESS_MARGIN = 0.08
RETAILER_RECALL = 0.9
AGGREGATE_RECALL = 0.93
FIXTURE_USAGE = 0.1
DISABLE_AFTER = 2
STALE_AFTER_HOURS = 36
SHELF_SIZE = 4
WARNING_EXCERPT = 130
RESPONSE_EXCERPT = 180
HIGH_TRUST = 0.9
MODERATE_TRUST = 0.75

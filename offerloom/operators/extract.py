"""Raw offers out of page html.

Each extractor maps ``pages`` (source, page_index, base_url, html; further
columns are dropped) to raw-offer rows with (extractor_rank, pos).  Two small
Arrow helpers do what expressions cannot: walk json of unknown depth, and find
where an anchor stands in the page.  Everything else is built-in expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom import rules
from offerloom.functions.money import parse_number, price_list
from offerloom.functions.names import infer_category, infer_gender
from offerloom.functions.text import let, made_once, offer_text, present, strip_tags
from offerloom.functions.urls import resolve_url, slug_title
from offerloom.operators.classify import is_item
from offerloom.operators.dedupe import dedupe_raw
from offerloom.session import cut_lineage

JSONLD, CARDS, STATE, TRACKING = 0, 1, 2, 3
KEYS = ["source", "page_index", "base_url"]


def _node_finder(titles: list[str] | None, prices: list[str] | None):
    """Arrow function: json texts to the objects in them that may be offers.

    Without keys it looks for ld+json products.  Nested functions travel to the
    workers by value, so the cluster needs no copy of this package.
    """

    def wanted(node: dict) -> bool:
        if titles is None:
            kind = node.get("@type")
            return isinstance(kind, str) and kind.lower() == "product"
        return any(node.get(k) is not None for k in titles) and any(node.get(k) is not None for k in prices)

    def no_constant(name: str) -> None:
        raise ValueError(name)

    def objects(body: str) -> list[str]:
        """Wanted objects of one json value in document order."""
        try:
            stack = [json.loads(body, parse_constant=no_constant)]
        except (ValueError, RecursionError):
            return []
        out = []
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                if wanted(node):
                    # Escaped: an escaped lone surrogate has no UTF-8 form.
                    out.append(json.dumps(node))
                stack.extend(reversed(node.values()))
            elif isinstance(node, list):
                stack.extend(reversed(node))
        return out

    def find(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda texts: [n for t in texts for n in objects(t)])

    return F.pandas_udf(find, T.ArrayType(T.StringType()))


#: Text of pages or anchors that a worker holds as Python objects, about.
PIECE = 4 << 20


def _anchor_finder():
    """Arrow function: pages to their anchors with the text around each, one row an anchor.

    An anchor without a digit around it has no price, so its text stays in the worker.  A worker goes through pages one
    by one and hands anchors on as they fill a piece, however many pages or anchors a batch brings.
    """
    pattern, before, after, piece = rules.ANCHOR_TAG, rules.CARD_WINDOW_BEFORE, rules.CARD_WINDOW_AFTER, PIECE

    def find(batches):
        import pyarrow as pa

        tag, digit = re.compile(pattern, re.IGNORECASE | re.ASCII), re.compile(r"\d")
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

        for batch in batches:
            keys, html = batch.select(batch.schema.names[:-1]), batch.column(batch.num_columns - 1)

            def told(rows):
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                taken = [c.take(columns[0]) for c in keys.columns]
                return pa.RecordBatch.from_arrays([*taken, *columns[1:]], [*keys.schema.names, *ANCHOR])

            rows, held = [], 0
            for at in range(len(html)):
                text = html[at].as_py() or ""
                for pos, m in enumerate(tag.finditer(text)):
                    around = text[max(0, m.start() - before) : m.end() + after]
                    if digit.search(around):
                        rows.append((at, pos, m.group(0), m.group(2), m.group(3), around))
                        held += len(around) + 2 * len(m.group(0))
                        if held > piece:
                            yield told(rows)
                            rows, held = [], 0
            if rows:
                yield told(rows)

    return find


ANCHOR = ["pos", "anchor", "href", "inner", "around"]


def _anchors(pages: DataFrame) -> DataFrame:
    """Anchors of pages, one row each."""
    read = pages.select(*KEYS, "html")
    fields = [*read.schema.fields[:-1], T.StructField("pos", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ANCHOR[1:]]]
    return read.mapInArrow(_anchor_finder(), T.StructType(fields))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def _string(v: Column, path: str) -> Column:
    """The value when it is a json string."""
    return F.when(_kind(v, path) == "STRING", _text(v, path))


def _scalar(v: Column, path: str) -> Column:
    """The value when it is a json string or number, as text."""
    return F.when(_kind(v, path).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)"), _text(v, path))


def _looked_up(v: Column, paths: list[str]) -> Column:
    """What stands at each of the paths: whether anything does, a string or number as text, and the number in it.

    The reading is one expression over an array, so the plan does not grow by it with every path.
    """

    def read(e: Column) -> Column:
        plain = e["kind"].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return F.struct(
            F.coalesce(e["kind"] != "VOID", F.lit(False)).alias("has"),
            F.when((e["kind"] == "STRING") | plain, e["text"]).alias("text"),
            F.when(e["kind"] == "STRING", parse_number(e["text"])).when(plain, e["text"].try_cast("double")).alias("number"),
        )

    return F.transform(F.array(*[F.struct(_kind(v, p).alias("kind"), _text(v, p).alias("text")) for p in paths]), read)


def _first(found: Column, wanted: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(found, wanted), F.lit(0))


def _strict_number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


class Extractor(Protocol):
    """A further way to find offers in pages.

    ``offers`` maps pages (source, page_index, base_url, html) to rows with these keys, ``pos`` and any of the raw-offer
    columns; ``rank`` says where it stands among the others (the built-in ones are 0 to 3, lower wins).
    """

    rank: int

    def offers(self, pages: DataFrame) -> DataFrame: ...


RAW_OFFER = {
    "url": "string", "title_raw": "string", "brand": "string", "model_raw": "string", "gender": "string", "category": "string",
    "colorway": "string", "size_range": "string", "price_current": "double", "price_original": "double", "in_stock": "boolean",
    "sku": "string", "gtin": "string",
}


def _by_others(pages: DataFrame, extractors: Sequence[Extractor]) -> list[DataFrame]:
    """Rows of further extractors, in the shape of the built-in ones; a column they lack is null."""
    out = []
    for extractor in extractors:
        found = extractor.offers(pages.select(*KEYS, "html"))
        shaped = [(F.col(c) if c in found.columns else F.lit(None)).cast(kind).alias(c) for c, kind in RAW_OFFER.items()]
        out.append(found.select(*KEYS, F.lit(extractor.rank).alias("extractor_rank"), F.col("pos").cast("int").alias("pos"), *shaped))
    return out


@dataclass(frozen=True)
class ScriptHints:
    """What marks the scripts that hold a site's state: ids, global names, root keys.  They are read first."""

    script_ids: tuple[str, ...] = ()
    global_keys: tuple[str, ...] = ()
    root_keys: tuple[str, ...] = ()

    def needles(self) -> list[str]:
        roots = [k.lower() for k in self.root_keys]
        return [k.lower() for k in (*self.script_ids, *self.global_keys)] + [n for k in roots for n in (f'"{k}"', f"{k}:")]


def _sold_out(c: Column) -> Column:
    return c.rlike("(?i)" + rules.SOLD_OUT)


def _finish(df: DataFrame, rank: int) -> DataFrame:
    """Common columns; keeps rows the classifier accepts."""
    kind = made_once(df, category=infer_category("title_raw"), gender=infer_gender("title_raw"))
    kept = made_once(kind, lambda r: r["item"], item=is_item("title_raw", "model_raw", "url", "category"))
    return kept.select(
        *KEYS, F.lit(rank).alias("extractor_rank"), "pos", "url", "title_raw", "brand", "model_raw", "gender",
        "category", F.lit(None).cast("string").alias("colorway"), F.lit(None).cast("string").alias("size_range"),
        "price_current", "price_original", "in_stock", "sku", "gtin",
    )


def _found(bodies: str, finder) -> Column:
    """Json objects in the json texts of a page.

    ``bodies`` is a column that was made before (``made_once``): lambdas in the argument of a Python function can keep
    the optimizer from taking the function out of the projection.
    """
    return finder(F.coalesce(bodies, F.array().cast("array<string>")))


def _worked(pages: DataFrame, **columns: Column) -> DataFrame:
    """Pages with what is looked for in their html; ``work_through`` may have found it already."""
    have = [c for c in columns if c in pages.columns]
    return pages.select(*KEYS, *have, *[c.alias(n) for n, c in columns.items() if n not in have])


def _nodes(pages: DataFrame, name: str, bodies: Column, finder) -> DataFrame:
    """One row per json object found, parsed: (keys, pos, v).  ``work_through`` may have found them already."""
    if name not in pages.columns:
        pages = made_once(pages, _bodies=bodies).select(*KEYS, _found("_bodies", finder).alias(name))
    return pages.select(*KEYS, F.posexplode(F.transform(name, F.try_parse_json)).alias("pos", "v"))


def _model_text(v: Column) -> Column:
    return F.coalesce(present(offer_text(_text(v, "model"))), F.col("title_raw"))


def _product_bodies() -> Column:
    tags = F.regexp_extract_all("html", F.lit("(?i)" + rules.JSONLD_TAG), F.lit(0))
    return F.transform(
        tags, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "(?i)^<script[^>]*>", ""), "(?i)</script>$", ""))
    )


def _product_finder():
    return _node_finder(None, None)


def _state_finder():
    return _node_finder(rules.STATE_TITLE_KEYS, [p.split(".")[0] for p in rules.STATE_PRICE_PATHS])


def _tracked() -> Column:
    """Page title, prices in tracking links and stock of a detail page."""
    prices = F.transform(
        F.regexp_extract_all("html", F.lit(r"(?i)(?<!\w)" + rules.TRACKED_PRICE[2:]), F.lit(1)), parse_number
    )
    detail = F.struct(
        F.regexp_extract("html", "(?i)" + rules.PAGE_TITLE, 1).alias("title"),
        F.array_min(F.filter(prices, lambda p: p > 0)).alias("price"),
        (~_sold_out(F.col("html"))).alias("in_stock"),
    )
    return F.when(F.col("base_url").rlike("(?i)/pdp/"), detail)


def work_through(pages: DataFrame, hints: ScriptHints | None = None) -> DataFrame:
    """What the extractors look for in the html; the html goes along for the anchors, which are rows of their own."""
    read = made_once(pages, _ld=_product_bodies(), _scripts=_script_bodies(hints))
    return read.select(
        *KEYS, _found("_ld", _product_finder()).alias("products"), _found("_scripts", _state_finder()).alias("states"),
        "html", _tracked().alias("tracked"),
    )


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """Products in ld+json scripts."""
    v = F.col("v")

    def offer(field: str) -> Column:
        """Field of the offer, or of the first one of a list."""
        listed = _kind(v, "offers").startswith("ARRAY")
        return F.when(listed, _text(v, f"offers[0].{field}")).otherwise(_text(v, f"offers.{field}"))

    priced = made_once(
        _nodes(pages, "products", _product_bodies(), _product_finder()),
        lambda r: (r["title_raw"] != "") & (r["price_current"] > 0),
        title_raw=offer_text(F.coalesce(_text(v, "name"), F.lit(""))),
        price_current=_strict_number(offer("price")),
        high=_strict_number(offer("highPrice")),
        stock=F.coalesce(offer("availability"), F.lit("")),
    )
    found = made_once(
        priced,
        price_original=F.when(F.col("high") > F.col("price_current"), F.col("high")),
        in_stock=(F.col("stock") == "") | F.col("stock").rlike("(?i)instock"),
        brand=F.coalesce(_string(v, "brand"), _string(v, "brand.name")),
        model_raw=_model_text(v),
        url=resolve_url(F.coalesce(_text(v, "url"), F.col("base_url")), "base_url"),
        sku=_string(v, "sku"),
        gtin=F.coalesce(_string(v, "gtin13"), _string(v, "gtin")),
    )
    return _finish(found, JSONLD)


def script_payload(body: Column) -> Column:
    """Json text of a script: the body, or the right side of ``window.name = …``; else null."""
    body = F.trim(body)
    assigned = r"^window\.[a-zA-Z0-9_$]+\s*=\s*([\s\S]+?);?$"
    payload = F.when(body.rlike(assigned), F.trim(F.regexp_extract(body, assigned, 1))).otherwise(body)
    return F.when(payload.rlike(r"^[{\[]"), payload)


def _script_bodies(hints: ScriptHints | None) -> Column:
    """Json texts of a page's scripts; hinted scripts first, else in page order."""
    tags = F.regexp_extract_all("html", F.lit("(?i)" + rules.SCRIPT_TAG), F.lit(0))
    bodies = F.regexp_extract_all("html", F.lit("(?i)" + rules.SCRIPT_TAG), F.lit(1))
    needles = hints.needles() if hints else []
    if needles:
        def hinted(tag: Column) -> Column:
            said = F.lower(tag)
            return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(said, n))

        first = F.transform(tags, hinted)
        marked = F.arrays_zip(bodies.alias("body"), first.alias("first"))
        part = lambda first: F.transform(F.filter(marked, lambda m: m["first"] == first), lambda m: m["body"])
        bodies = F.concat(part(True), part(False))
    return F.array_compact(F.transform(bodies, script_payload))


def extract_state(pages: DataFrame, hints: ScriptHints | None = None) -> DataFrame:
    """Offer-like objects in any json script."""
    v = F.col("v")
    prices = rules.STATE_PRICE_PATHS + rules.STATE_NESTED_PRICE_PATHS
    nodes = made_once(
        _nodes(pages, "states", _script_bodies(hints), _state_finder()),
        titles=_looked_up(v, rules.STATE_TITLE_KEYS), prices=_looked_up(v, prices), lists=_looked_up(v, rules.STATE_LIST_PRICE_PATHS),
    )
    number = lambda found: _first(F.col(found), lambda e: e["number"].isNotNull())["number"]
    own = F.slice("prices", 1, len(rules.STATE_PRICE_PATHS))
    titled = made_once(
        nodes,
        lambda r: (r["title_raw"] != "") & (r["named"] != 0) & (r["price_current"] > 0),
        # The first title key that is present counts, and only as text or a number.
        title_raw=offer_text(F.coalesce(_first(F.col("titles"), lambda e: e["has"])["text"], F.lit(""))),
        # The first price key that is present decides whether the object counts.
        named=_first(own, lambda e: e["has"])["number"],
        price_current=number("prices"),
        listed=number("lists"),
    )
    items = made_once(titled, lambda r: r["item"], item=is_item("title_raw"))
    found = made_once(
        items,
        in_stock=~_sold_out(F.coalesce(_text(v, "availability"), F.lit(""))),
        brand=present(F.coalesce(_string(v, "brand"), _text(v, "brand.name"))),
        model_raw=_model_text(v),
        url=resolve_url(F.coalesce(_text(v, "url"), _text(v, "link"), F.col("base_url")), "base_url"),
        sku=F.coalesce(_string(v, "sku"), _scalar(v, "product_id")),
        gtin=F.coalesce(_string(v, "gtin"), _string(v, "gtin13")),
    )
    original = F.when(F.col("listed") > F.col("price_current"), F.col("listed"))
    return _finish(found.withColumn("price_original", original), STATE)


def extract_cards(pages: DataFrame, legacy_prices: bool = False) -> DataFrame:
    """Product cards: every anchor with a price near it."""
    aria, title = r"(?i)aria-label=([\"'])(.*?)\1", r"(?i)title=([\"'])(.*?)\1"
    shown = (
        F.when(F.col("anchor").rlike(aria), F.regexp_extract("anchor", aria, 2))
        .when(F.col("anchor").rlike(title), F.regexp_extract("anchor", title, 2))
        .otherwise(F.col("inner"))
    )

    def found(pattern: str) -> Column:
        return present(F.regexp_extract("around", "(?i)" + pattern, 1))

    cards = _anchors(pages)
    titled = made_once(
        made_once(cards, url=resolve_url("href", "base_url")),
        lambda r: F.length(r["title_raw"]) >= rules.MIN_TITLE,
        title_raw=offer_text(F.coalesce(present(strip_tags(shown)), slug_title("url"), F.lit(""))),
    )

    def priced(text: Column) -> Column:
        near = price_list(text, legacy_prices)
        prices = let(near, lambda p: F.when(F.size(p) > 0, p).otherwise(price_list("title_raw", legacy_prices)))
        return F.struct(F.array_sort(F.array_distinct(prices)).alias("prices"), (~_sold_out(text)).alias("in_stock"))

    found = made_once(
        titled,
        lambda r: F.size(r["near"]["prices"]) > 0,
        near=let(strip_tags(F.concat_ws(" ", "anchor", "around")), priced),
        sku=found(rules.CARD_SKU),
        gtin=found(rules.CARD_GTIN),
    )
    none = F.lit(None).cast("string")
    return _finish(
        found.withColumn("price_current", F.get("near.prices", F.lit(0)))
        .withColumn("price_original", F.get("near.prices", F.lit(1)))
        .withColumn("in_stock", F.col("near.in_stock"))
        .withColumn("model_raw", F.col("title_raw"))
        .withColumn("brand", none),
        CARDS,
    )


def extract_tracking(pages: DataFrame) -> DataFrame:
    """Detail pages: page title with the lowest price in tracking links."""
    shown = F.regexp_replace("tracked.title", r"\|[^\n\r\x{2028}\x{2029}]*\z", "")
    found = made_once(
        _worked(pages, tracked=_tracked()).filter(F.col("tracked").isNotNull()),
        lambda r: (F.length(r["title_raw"]) >= rules.MIN_TITLE) & r["price_current"].isNotNull(),
        title_raw=offer_text(strip_tags(shown)),
        price_current=F.col("tracked.price"),
    )
    none = F.lit(None).cast("string")
    return _finish(
        found.withColumn("pos", F.lit(0))
        .withColumn("url", F.col("base_url"))
        .withColumn("model_raw", F.col("title_raw"))
        .withColumn("price_original", F.lit(None).cast("double"))
        .withColumn("in_stock", F.col("tracked.in_stock"))
        .withColumn("brand", none)
        .withColumn("sku", none)
        .withColumn("gtin", none),
        TRACKING,
    )


def extract_all(
    pages: DataFrame, state_first: Column | None = None, hints: ScriptHints | None = None, others: Sequence[Extractor] = ()
) -> DataFrame:
    """All extractors with precedence, before dedupe.  ``others``: extractors of the caller.

    ``state_first``: condition over ``source`` under which embedded state
    outranks the others.  ``hints``: which scripts embedded state comes from first.
    The html is worked through once, and once more for its anchors; the extractors read what was found.
    """
    added = _by_others(pages, others)
    pages = cut_lineage(work_through(pages, hints))
    found = extract_jsonld(pages).unionByName(extract_cards(pages)).unionByName(extract_state(pages, hints)).unionByName(
        extract_tracking(pages)
    )
    for rows in added:
        found = found.unionByName(rows)
    if state_first is not None:
        found = found.withColumn(
            "extractor_rank",
            F.when(state_first & (F.col("extractor_rank") == STATE), F.lit(-1)).otherwise(F.col("extractor_rank")),
        )
    return found


def extract_offers(
    pages: DataFrame, state_first: Column | None = None, hints: ScriptHints | None = None, others: Sequence[Extractor] = ()
) -> tuple[DataFrame, DataFrame]:
    """(offers of each page without repeats, discovered_count per page).

    Both outputs read the extracted rows, so the pages are worked through once.
    """
    found = cut_lineage(extract_all(pages, state_first, hints, others))
    discovered = found.groupBy("source", "page_index").agg(F.count("*").alias("discovered_count"))
    return dedupe_raw(found, ["extractor_rank", "pos"], within=["source", "page_index"]), discovered

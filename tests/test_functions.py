"""Unit cases for the column functions."""

import decimal

import pytest
from pyspark.sql import functions as F

from offerloom.functions import ids, labels, money, names, text, urls
from offerloom.operators.classify import is_item, item_reason


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_discount(spark):
    def pct(cur, org):
        return one(spark, money.discount_pct(F.lit(cur), F.lit(org).cast("double")))

    assert pct(100.0, None) is None
    assert pct(100.0, 0.0) is None
    assert pct(110.0, 100.0) == 0.0
    assert pct(60.0, 80.0) == 25.0
    assert pct(2.0, 3.0) == 33.34  # rounded up, not to nearest
    assert pct(99.95, 120.0) == 16.71


def test_js_round(spark):
    assert one(spark, money.js_round(F.lit(1.005), 2)) == 1.0
    assert one(spark, money.js_round(F.lit(0.125), 2)) == 0.13


@pytest.mark.parametrize(
    "value",
    [1.005, 0.125, 0.375, 2.675, 1.255, 8.345, 0.0, 99.999, 129.99, 1234567.885, -1.5, 1e15, 0.004999999999999999, 123456789012.345, 0.285, 1.115],
)
def test_fixed2_is_exact(spark, value):
    exact = decimal.Decimal(abs(value)).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_UP)
    assert one(spark, money.fixed2(F.lit(value))) == f"{'-' if value < 0 else ''}{exact}"


def test_price_text(spark):
    assert one(spark, money.price_text(F.lit(0.125))) == "$0.13"
    assert one(spark, money.price_text(F.lit(1234.5))) == "$1,234.50"


@pytest.mark.parametrize(
    "raw,want", [("rapid tempo 5", "rapid-tempo-5"), ("RAPID-TEMPO 5", "rapid-tempo-5"), ("Sky  Drift_4", "sky-drift-4")]
)
def test_model(spark, raw, want):
    assert one(spark, names.norm_model(F.lit(raw))) == want


def test_tokens(spark):
    assert one(spark, text.split_tokens(F.lit("Acme Rapid-Tempo 5 Women's Trail Shoe"))) == ["acme", "rapid", "tempo", "5"]
    assert one(spark, text.split_tokens(F.lit("Mirage-12 Trail Shoes"), drop_low_signal=False)) == ["mirage", "12", "trail", "shoes"]


def test_identifiers(spark):
    assert one(spark, ids.norm_sku(F.lit(" acme-rp5 w_77 "))) == "ACMERP5W77"
    assert one(spark, ids.norm_gtin(F.lit("40-0638 1333931"))) == "04006381333931"
    assert one(spark, ids.norm_gtin(F.lit("9876543210987654"))) == "9876543210987654"
    assert one(spark, ids.norm_identifiers(F.lit("--"), F.lit("x"))) is None


def test_html_text(spark):
    assert one(spark, text.html_decode(F.lit("Runner&#x2019;s &#60;7&#62;"))) == "Runner\u2019s <7>"
    assert one(spark, text.offer_text(F.lit(" Fox&#39;s&nbsp;&nbsp;&amp; Owl&#x27;s\t"))) == "Fox's & Owl's"
    assert one(spark, text.html_decode(F.lit("&#xD800;&#1114112;&#x10FFFF;"))) == "�&#1114112;\U0010ffff"
    assert one(spark, text.squeeze(F.lit(" a \tb ﻿"))) == "a b"


@pytest.mark.parametrize(
    "raw,cleaned,size",
    [
        ("rapid fox tempo 3 m9 w10", "rapid fox tempo 3", "M9/W10"),
        ("Drift Light 2 Size 8.5", "Drift Light 2", "Size 8.5"),
        ("Glide w6 m5", "Glide", "M5/W6"),
        ("Cove 21", "Cove 21", None),
        ("US 7 - Glide m10 m11", "US 7 - Glide m11", "M10"),
    ],
)
def test_size(spark, raw, cleaned, size):
    got = one(spark, text.size_parts(F.lit(raw)))
    assert (got["cleaned"], got["size_range"]) == (cleaned, size)


@pytest.mark.parametrize(
    "title,category,keep",
    [
        ("3.5 stars & up", None, False),
        ("Wishlist", None, False),
        ("Rapid Fox Running Shoes", None, True),
        ("Trail Shoe Rapid 5", None, True),
        ("Merino Tee with Pocket", "running", False),
        ("Storm Jacket", "trail", False),
        ("Odd Item 12", "trail", True),
        ("Odd Item 12", None, False),
    ],
)
def test_classifier(spark, title, category, keep):
    assert one(spark, is_item(F.lit(title), None, None, F.lit(category).cast("string"))) is keep


def test_classifier_reason(spark):
    assert one(spark, item_reason(F.lit("Some Thing 4"), None, F.lit("https://a.com/p/1"))) == "keep-version"
    assert one(spark, item_reason(F.lit("Ghost 16"), None, F.lit("#"))) == "reject-url"


def test_gender_uses_ascii_boundaries(spark):
    assert one(spark, names.infer_gender(F.lit("émen"))) == "men"
    assert one(spark, names.infer_gender(F.lit("women men"))) == "women"
    assert one(spark, names.infer_gender(F.lit("omen"))) is None


def test_prices(spark):
    def prices(t, **kw):
        return one(spark, money.price_list(F.lit(t), **kw))

    assert prices("<b>Now</b> $1,299.00 was CAD 1 499,99") == [1299.0, 1499.99]
    assert prices("$1,299.00", legacy=True) == [1.29]
    assert prices("sale 129.99 or 9.99") == [129.99]
    assert prices("129.99 alone") == []
    assert one(spark, money.parse_number(F.lit("CA$&nbsp;12,50"))) == 12.5
    assert one(spark, money.parse_number(F.lit("1.2.3"))) is None


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTPS://Shop.Example.com:443/Run/Shoe/?utm_source=a&B=2&a=%20x%20#top", "https://shop.example.com/run/shoe?a=x&b=2"),
        ("http://a.com", "http://a.com/"),
        ("http://a.com:8080/?ref=1", "http://a.com:8080/"),
        (" Not A Url// ", "not a url"),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, urls.canonical_url(F.lit(raw))) == want


@pytest.mark.parametrize(
    "link,want",
    [
        ("/p/1", "https://a.com/p/1"),
        ("x/../y", "https://a.com/shop/y"),
        ("//cdn.b.com/z", "https://cdn.b.com/z"),
        ("?p=2", "https://a.com/shop/list?p=2"),
        ("#f", "https://a.com/shop/list?q=1#f"),
        ("http://C.com", "http://c.com/"),
        ("../../..", "https://a.com/"),
        ("mailto:x@y", "mailto:x@y"),
        ("/a b/\u00e9?q=\"x y\"#\u00e9 `", "https://a.com/a%20b/%C3%A9?q=%22x%20y%22#%C3%A9%20%60"),
        ("/done%20it?a=%zz'", "https://a.com/done%20it?a=%zz%27"),
    ],
)
def test_resolve(spark, link, want):
    assert one(spark, urls.resolve_url(F.lit(link), F.lit("https://a.com/shop/list?q=1"))) == want


def test_query_param(spark):
    def put(u):
        return one(spark, urls.set_query_param(F.lit(u), F.lit("page"), F.lit("3")))

    assert put("https://a.com/x?page=1&y=2") == "https://a.com/x?page=3&y=2"
    assert put("https://a.com") == "https://a.com/?page=3"


def test_display(spark):
    assert one(spark, text.model_display(F.lit("rapid-tempo_5 GTX v2"))) == "Rapid Tempo 5 GTX V2"
    assert one(spark, text.size_display(F.lit("M_8"))) == "M 8"
    assert one(spark, text.excerpt(F.lit("x" * 200)))[-4:] == "x..."
    assert one(spark, labels.time_label(F.lit("soon"))) == "Invalid timestamp"
    assert one(spark, money.trust_label(F.lit(0.8))) == "Moderate trust"


def test_confidence(spark):
    none = F.lit(None).cast("string")
    full = money.source_confidence(F.lit("b"), F.lit("m"), F.lit("s"), none, F.lit(1.0), F.lit(2.0), F.lit(False))
    assert one(spark, full) == 0.95
    bare = money.source_confidence(none, F.lit(""), none, none, F.lit(1.0), F.lit(None).cast("double"), F.lit(True))
    assert one(spark, bare) == 0.35
    assert one(spark, money.blend_confidence(F.lit(0.5), F.lit(1.0))) == 0.75


def test_anchors_leave_the_worker_in_pieces(monkeypatch):
    """A page with very many anchors is many small batches; none is lost, and the keys stay with them."""
    import pyarrow as pa

    from offerloom.operators import extract

    monkeypatch.setattr(extract, "PIECE", 10_000)
    pages = ["".join(f'<a href="/p/{i}">shoe {i}</a> $1{i}.00 ' for i in range(300)), None, "<a href='/q'>no price</a>", '<a href="/last">x</a> 5']
    batch = pa.RecordBatch.from_pydict({"source": list("abcd"), "page_index": [0, 1, 2, 3], "base_url": list("wxyz"), "html": pages})
    told = list(extract._anchor_finder()([batch]))
    assert len(told) > 10 and max(t.nbytes for t in told) < 50_000
    rows = [(r["source"], r["pos"], r["href"]) for t in told for r in t.to_pylist()]
    assert rows == [("a", i, f"/p/{i}") for i in range(300)] + [("d", 0, "/last")]

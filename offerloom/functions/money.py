"""Prices, discounts, confidence scores and their rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.text import any_match, as_col, ascii_regex, let, present, strip_tags

# --- fixed value: spacing of doubles at 1 -------------------------------------
EPSILON = 2.0**-52


def js_round(c: Column | str, digits: int) -> Column:
    """floor(x * 10^n + .5) / 10^n on doubles (half up, binary)."""
    scale = F.lit(float(10**digits))
    return F.floor(as_col(c) * scale + F.lit(0.5)).cast("double") / scale


def fixed2(c: Column | str) -> Column:
    """Two decimals of the exact binary value, halves up (1.005 is below the half: 1.00; 0.125 is one: 0.13).

    ``x * 100`` is rounded, so its error is worked out by splitting x into a
    high and a low part whose products are exact.
    """
    def parts(value: Column) -> Column:
        x = F.abs(value)
        return F.struct(value.alias("value"), x.alias("x"), (x * F.lit(134217729.0)).alias("wide"), (x * F.lit(100.0)).alias("scaled"))

    def with_error(p: Column) -> Column:
        high = p["wide"] - (p["wide"] - p["x"])
        return let(
            high,
            lambda h: F.struct(
                p["value"].alias("value"), p["x"].alias("x"), p["scaled"].alias("scaled"), F.floor(p["scaled"]).alias("whole"),
                ((h * F.lit(100.0) - p["scaled"]) + (p["x"] - h) * F.lit(100.0)).alias("error"),
            ),
        )

    def cents(p: Column) -> Column:
        up = ((p["scaled"] - p["whole"].cast("double")) - F.lit(0.5)) + p["error"] >= 0
        return p["whole"] + F.when(up, F.lit(1)).otherwise(F.lit(0))

    def shown(p: Column) -> Column:
        text = let(cents(p), lambda n: F.format_string("%d.%02d", F.floor(n / F.lit(100)), n % F.lit(100)))
        signed = F.concat(F.when(p["value"] < 0, F.lit("-")).otherwise(F.lit("")), text)
        return F.when(p["x"] < F.lit(1e13), signed).otherwise(F.format_string("%.2f", p["value"]))

    return let(parts(as_col(c).cast("double")), lambda p: let(with_error(p), shown))


def discount_pct(current: Column | str, original: Column | str) -> Column:
    """Percentage off, rounded up at two decimals; null without a usable original."""
    cur, org = as_col(current), as_col(original)
    pct = (org - cur) / org * F.lit(100.0)
    up = F.ceil((pct - F.lit(EPSILON)) * F.lit(100.0)).cast("double") / F.lit(100.0)
    usable = org.isNotNull() & (org > 0) & (cur >= 0)
    return F.when(usable & (cur >= org), F.lit(0.0)).when(usable, up)


def parse_number(c: Column | str) -> Column:
    """Number in messy text; a two-digit tail after a comma is a decimal part."""
    c = F.regexp_replace(as_col(c), "(?i)&nbsp;", " ")
    c = F.regexp_replace(c, "[^0-9.,-]+", "")
    c = F.regexp_replace(c, r"(\d),(\d{2})$", "$1.$2")
    return present(F.replace(c, F.lit(","), F.lit(""))).try_cast("double")


def price_list(c: Column | str, legacy: bool = False) -> Column:
    """Prices named in a snippet, in order.

    Marked amounts first; bare amounts only when there is none and a price word
    occurs.  ``legacy`` keeps the old reading of "1,299.00" as 1.29.
    """
    text = strip_tags(c)
    if not legacy:
        text = F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?!\d))", "")
    text = F.regexp_replace(text, r"(\d)\s*[.,]\s*(\d{2})", "$1.$2")
    low, high = rules.BARE_PRICE_RANGE

    def amounts(t: Column, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), parse_number)

    def read(t: Column) -> Column:
        marked = F.filter(amounts(t, "(?i)" + rules.MARKED_PRICE), lambda p: p > 0)
        bare = F.filter(amounts(t, ascii_regex(rules.BARE_PRICE)), lambda p: (p > low) & (p < high))
        none = F.array().cast("array<double>")
        worded = F.when(any_match(t, [rules.PRICE_WORD]), bare).otherwise(none)
        return let(marked, lambda m: F.when(F.size(m) > 0, m).otherwise(worded))

    return let(text, read)


def source_confidence(
    brand: Column | str,
    model: Column | str,
    sku: Column | str,
    gtin: Column | str,
    current: Column | str,
    original: Column | str,
    used_fixture: Column | str,
) -> Column:
    """Confidence in [0, 1] from what the source gave."""

    # --- fixed values: base score and weights ---
    def plus(cond: Column, weight: float) -> Column:
        return F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))

    has_id = present(sku).isNotNull() | present(gtin).isNotNull()
    score = (
        F.lit(0.45)
        + plus(present(brand).isNotNull(), 0.1)
        + plus(present(model).isNotNull(), 0.1)
        + plus(has_id, 0.2)
        + plus(as_col(original) > as_col(current), 0.1)
        - plus(as_col(used_fixture), 0.1)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), js_round(score, 2)))


def blend_confidence(own: Column | str, match: Column | str) -> Column:
    """Confidence after a match: never lower, else the rounded mean."""
    own, match = as_col(own), as_col(match)
    return F.greatest(own, js_round((own + match) / F.lit(2.0), 2))


def trust_label(c: Column | str) -> Column:
    c = as_col(c)
    return (
        F.when(c >= rules.HIGH_TRUST, F.lit("High trust"))
        .when(c >= rules.MODERATE_TRUST, F.lit("Moderate trust"))
        .otherwise(F.lit("Low trust"))
    )


def trust_pct(c: Column | str) -> Column:
    return F.floor(as_col(c) * F.lit(100.0) + F.lit(0.5))


def price_text(c: Column | str) -> Column:
    """Shown price: the shortest decimal form, halves away from zero."""
    return F.concat(F.lit("$"), F.format_number(F.round(as_col(c).cast("decimal(30,10)"), 2), 2))


def card_price_text(c: Column | str) -> Column:
    return F.concat(F.lit("$"), fixed2(c), F.lit(f" {rules.CURRENCY}"))


def discount_text(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c > 0, F.concat(F.lit("Up to "), F.format_string("%.0f", c), F.lit("% off")))

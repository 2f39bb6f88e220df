"""Rule-based item classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.text import any_match, as_col, let, offer_text


def _or_empty(c: Column | str | None) -> Column:
    return F.lit("") if c is None else F.coalesce(as_col(c), F.lit(""))


def item_reason(
    title: Column | str,
    model: Column | str | None = None,
    url: Column | str | None = None,
    category: Column | str | None = None,
) -> Column:
    """Why an item is kept or rejected; the kept reasons start with "keep"."""
    both = F.lower(offer_text(_or_empty(title)))
    if model is not None:
        both = F.concat_ws(" ", both, F.lower(offer_text(_or_empty(model))))
    link = F.lower(offer_text(_or_empty(url)))
    kind = offer_text(_or_empty(category))

    def reason(text: Column, link: Column) -> Column:
        context = any_match(text, [rules.RUNNING_CONTEXT]) | any_match(kind, [rules.RUNNING_CONTEXT])
        supported = context | any_match(link, rules.PRODUCT_URL)
        return (
            F.when(text == "", F.lit("empty"))
            .when(any_match(text, rules.REJECT_TEXT), F.lit("reject-text"))
            .when((link != "") & any_match(link, rules.REJECT_URL), F.lit("reject-url"))
            .when(any_match(text, [rules.FOOTWEAR_TERMS]), F.lit("keep-footwear"))
            .when(any_match(text, rules.ACCESSORY_TERMS), F.lit("accessory"))
            .when(any_match(text, [rules.MODEL_FAMILIES]), F.lit("keep-family"))
            .when(supported & any_match(text, [rules.VERSIONED_MODEL]), F.lit("keep-version"))
            .otherwise(F.lit("no-signal"))
        )

    return let(offer_text(both), lambda t: let(link, lambda u: reason(t, u)))


def is_item(
    title: Column | str,
    model: Column | str | None = None,
    url: Column | str | None = None,
    category: Column | str | None = None,
) -> Column:
    return item_reason(title, model, url, category).startswith("keep")


def classify_items(df: DataFrame, title="title_raw", model="model_raw", url="url", category="category") -> DataFrame:
    """Adds ``reason`` and ``keep``."""
    return df.withColumn("reason", item_reason(title, model, url, category)).withColumn(
        "keep", F.col("reason").startswith("keep")
    )

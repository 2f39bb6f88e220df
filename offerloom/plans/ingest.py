"""Raw offers to published tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.ids import norm_gtin, norm_sku, stable_id
from offerloom.functions.money import discount_pct, fixed2, source_confidence
from offerloom.functions.names import TokenRules, decide_category, extract_brand, infer_gender, norm_brand, norm_model
from offerloom.functions.text import made_once, offer_text, present, size_parts
from offerloom.operators.classify import is_item
from offerloom.operators.cluster import cluster_offers, with_blended_confidence
from offerloom.operators.dedupe import dedupe_offers
from offerloom.operators.overrides import apply_patches
from offerloom.operators.rollup import canonical_products, deal_rollup, product_aliases
from offerloom.session import cut_lineage

def valid_offers(raw: DataFrame) -> DataFrame:
    """Offers with a price and a link; cheap, so it runs before the classifier."""
    return raw.filter((F.col("price_current") > 0) & present("url").isNotNull())


def working_offers(raw: DataFrame, token_rules: TokenRules | None = None) -> DataFrame:
    """Normalised offers with ids, discount and confidence; one projection, no shuffle.

    ``raw``: retailer_id, url, title_raw, brand, model_raw, gender, category,
    colorway, size_range, price_current, price_original, in_stock, sku, gtin,
    used_fixture, scraped_at; further columns (such as seq) pass through.
    """
    title = offer_text("title_raw")
    model_text = F.coalesce(offer_text(present("model_raw")), F.col("_title"))
    base = (
        raw.withColumn("_title", title)
        .withColumn("_model_text", model_text)
        .withColumn(
            "source_confidence",
            source_confidence("brand", "model_raw", "sku", "gtin", "price_current", "price_original", "used_fixture"),
        )
        .withColumn("_size", size_parts("_model_text"))
        .withColumn("model_normalized", norm_model("_size.cleaned"))
        .withColumn("brand", norm_brand(F.coalesce("brand", extract_brand("_title"))))
        .withColumn("category", decide_category("_title", "category", [] if token_rules is None else token_rules))
        .withColumn("gender", F.coalesce("gender", infer_gender("_title")))
        .withColumn("size_range", F.coalesce("size_range", "_size.size_range"))
        .withColumn("sku", norm_sku("sku"))
        .withColumn("gtin", norm_gtin("gtin"))
        .withColumn("discount_pct", discount_pct("price_current", "price_original"))
        .withColumn("title_raw", F.col("_title"))
    )
    offer_id = stable_id(
        "ofr", F.col("retailer_id"), F.col("url"), F.col("model_normalized"), fixed2("price_current"),
        F.coalesce("sku", F.lit("")), F.coalesce("gtin", F.lit("")),
    )
    # Made once: later joins and windows on the id would work it out again.
    return made_once(base, offer_id=offer_id).drop("_title", "_model_text", "_size", "model_raw", "used_fixture")


def publishable(raw: DataFrame) -> DataFrame:
    """Valid rows the item classifier accepts."""
    return valid_offers(raw).filter(is_item("title_raw", "model_raw", "url", "category"))


def clean_offers(
    raw: DataFrame, token_rules: TokenRules | None = None, patches: DataFrame | None = None,
    order: tuple[Column | str, ...] = ("seq",),
) -> DataFrame:
    """Valid, classified, normalised, distinct and patched offers."""
    offers = dedupe_offers(working_offers(publishable(raw), token_rules), order)
    return offers if patches is None else apply_patches(offers, patches)


@dataclass(frozen=True)
class Catalogue:
    """Offers with their product, products and their spellings, and deals."""

    offers: DataFrame
    shoes: DataFrame
    aliases: DataFrame
    deals: DataFrame

    def published_offers(self) -> DataFrame:
        return self.offers.drop("sku", "gtin", "seq", "shoe_id", "match_confidence", "match_reason")

    def offer_shoe(self) -> DataFrame:
        return self.offers.select(
            "offer_id", "shoe_id", F.col("match_reason").alias("reason"), F.col("match_confidence").alias("confidence")
        )


def build_catalogue(offers: DataFrame, known: str | None = None, keep: str | None = None) -> Catalogue:
    """Cluster clean offers (column ``seq`` gives the order) and roll them up.

    The clean offers are read by every later step and the clustered ones by
    three outputs, so each is computed once and written.  ``known``, ``keep``:
    folders of an earlier clustering to go on from, and for the next one.
    """
    keyed = cut_lineage(offers.withColumn("ord", F.col("seq")).withColumn("model", F.col("model_normalized")))
    clustered = cut_lineage(with_blended_confidence(cluster_offers(keyed, known=known, keep=keep)).drop("ord", "model"))
    return Catalogue(clustered, canonical_products(clustered), product_aliases(clustered), deal_rollup(clustered))

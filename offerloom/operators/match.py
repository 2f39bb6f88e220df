"""Match candidates against a product catalogue (stateless)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.ids import norm_gtin, norm_sku
from offerloom.functions.names import norm_brand, norm_model
from offerloom.operators.dedupe import first_rows
from offerloom.operators.similarity import similar_sets, token_set

# A score this far below the threshold can change no decision.
BRANDED_BOUND = 0.56
BRANDLESS_BOUND = 0.64


def _ids(df: DataFrame, *keep: str) -> DataFrame:
    """One row per present identifier: (keep, kind, value)."""
    return df.select(
        *keep,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("sku").alias("kind"), norm_sku("sku").alias("value")),
                    F.struct(F.lit("gtin").alias("kind"), norm_gtin("gtin").alias("value")),
                ),
                lambda x: x["value"].isNotNull(),
            )
        ).alias("_id"),
    ).select(*keep, "_id.kind", "_id.value")


def match_exact(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """(cand_id, shoe_id, ord): first catalogue row that shares the sku or the gtin.

    The catalogue is reduced to one row per identifier first, so the join is
    many-to-one and absent identifiers never meet.
    """
    holders = (
        _ids(catalog, "ord", "shoe_id")
        .groupBy("kind", "value")
        .agg(F.min(F.struct("ord", "shoe_id")).alias("first"))
    )
    return (
        _ids(candidates, "cand_id")
        .join(holders, ["kind", "value"])
        .groupBy("cand_id")
        .agg(F.min("first").alias("first"))
        .select("cand_id", "first.shoe_id", "first.ord")
    )


def _name(block: Column, tokens: Column) -> Column:
    """Key of a name: a block and a token set."""
    return F.md5(F.concat_ws("\u0001", block, F.array_sort(tokens)))


def _own_block() -> Column:
    return F.concat(F.lit("="), F.col("brand_n"), F.lit("\u0001"), F.col("category"))


def _any_block() -> Column:
    return F.concat(F.lit("*\u0001"), F.col("category"))


def candidate_names(candidates: DataFrame) -> DataFrame:
    """Adds brand_n, tokens, block and cand_name.

    A branded candidate looks among products of its category and brand, a
    brandless one among all products of its category: that is its block.
    """
    return (
        candidates.withColumn("brand_n", norm_brand("brand"))
        .withColumn("tokens", token_set(norm_model("model")))
        .withColumn("block", F.coalesce(_own_block(), _any_block()))
        .withColumn("cand_name", _name(F.col("block"), F.col("tokens")))
    )


def product_names(catalog: DataFrame) -> DataFrame:
    """Adds brand_n, tokens and the two names a product can be found under."""
    return (
        catalog.withColumn("brand_n", norm_brand("brand"))
        .withColumn("tokens", token_set("model"))
        .withColumn(
            "names",
            F.array(
                F.struct(_own_block().alias("block"), _name(_own_block(), F.col("tokens")).alias("shoe_name")),
                F.struct(_any_block().alias("block"), _name(_any_block(), F.col("tokens")).alias("shoe_name")),
            ),
        )
    )


def name_pairs(cand: DataFrame, shoes: DataFrame) -> DataFrame:
    """(cand_name, shoe_name, score) of distinct names that can decide a match.

    Products of all brands that share a token set are one name to a brandless
    candidate, so the pairs do not multiply with the number of brands.
    """
    left = cand.select(
        F.col("cand_name").alias("set_id"), "block", "tokens", F.lit(True).alias("l"), F.lit(False).alias("r")
    )
    right = shoes.select("tokens", F.explode("names").alias("n")).select(
        F.col("n.shoe_name").alias("set_id"), "n.block", "tokens", F.lit(False).alias("l"), F.lit(True).alias("r")
    )
    # One key means one block and one token set, so any row of it will do.
    sets = left.unionByName(right).groupBy("set_id").agg(
        F.any_value("block").alias("block"), F.any_value("tokens").alias("tokens"),
        F.bool_or("l").alias("is_left"), F.bool_or("r").alias("is_right"),
    )
    bound = F.when(F.col("block").startswith("="), F.lit(BRANDED_BOUND)).otherwise(F.lit(BRANDLESS_BOUND))
    return similar_sets(sets.withColumn("bound", bound)).select(
        F.col("left_id").alias("cand_name"), F.col("right_id").alias("shoe_name"), "score"
    )


def match_fuzzy(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Similar names: (block, cand_tokens, shoe_tokens, score, candidates, shoes).

    One row per pair of distinct names that can decide a match, with the number
    of candidates and products behind each; rows that share a name are counted,
    not paired.
    """
    cand, shoes = candidate_names(candidates), product_names(catalog)

    def listed(df: DataFrame, key: str, tokens: str, n: str) -> DataFrame:
        return df.groupBy(key).agg(
            F.any_value("block").alias("block"),
            F.any_value(F.array_join(F.array_sort("tokens"), " ")).alias(tokens),
            F.count("*").alias(n),
        )

    found_under = shoes.select("tokens", F.explode("names").alias("n")).select("tokens", "n.block", "n.shoe_name")
    return (
        name_pairs(cand, shoes)
        .join(listed(cand, "cand_name", "cand_tokens", "candidates"), "cand_name")
        .join(listed(found_under, "shoe_name", "shoe_tokens", "shoes").drop("block"), "shoe_name")
        .select(F.translate("block", "\u0001", "/").alias("block"), "cand_tokens", "shoe_tokens", "score", "candidates", "shoes")
    )


def top_two(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """(cand_id, brand_n, shoe_id, win, runner_up): best two scores per candidate.

    Works on distinct names: two catalogue rows per name and two rows per
    candidate name are all a decision can see, so rows are cut to two before
    they are combined.
    """
    cand, shoes = candidate_names(candidates), product_names(catalog)
    listed = shoes.select("shoe_id", "ord", F.explode("names.shoe_name").alias("shoe_name"))
    two_shoes = first_rows(listed, ["shoe_name"], ["ord"], 2)
    scored = name_pairs(cand, shoes).join(two_shoes, "shoe_name")
    best = first_rows(scored, ["cand_name"], [F.desc("score"), "ord"], 2)
    win = best.groupBy("cand_name").agg(
        F.max(F.struct("score", (-F.col("ord")).alias("neg"), "shoe_id")).alias("w"),
        F.when(F.count("*") > 1, F.min("score")).otherwise(F.lit(0.0)).alias("runner_up"),
    )
    return (
        cand.select("cand_id", "brand_n", "cand_name")
        .join(win, "cand_name")
        .select("cand_id", "brand_n", "w.shoe_id", F.col("w.score").alias("win"), "runner_up")
    )


def accepts(branded: Column, win: Column, runner_up: Column) -> Column:
    """Unique-winner rule; the difference is taken on rounded doubles."""
    threshold = F.when(branded, F.lit(rules.BRANDED_THRESHOLD)).otherwise(F.lit(rules.BRANDLESS_THRESHOLD))
    margin = F.when(branded, F.lit(rules.BRANDED_MARGIN)).otherwise(F.lit(rules.BRANDLESS_MARGIN))
    return (win >= threshold) & (win - runner_up >= margin)


def resolve_matches(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """(cand_id, shoe_id, confidence, reason) for every candidate.

    ``candidates``: cand_id, brand, model, category, sku, gtin.  ``catalog``:
    ord (number, catalogue order), shoe_id, brand, model, category, sku, gtin.
    """
    exact = match_exact(candidates, catalog).select("cand_id", F.col("shoe_id").alias("_exact"))
    fuzzy = (
        top_two(candidates, catalog)
        .filter(accepts(F.col("brand_n").isNotNull(), F.col("win"), F.col("runner_up")))
        .select("cand_id", F.col("shoe_id").alias("_fuzzy"), "win")
    )
    return (
        candidates.select("cand_id")
        .join(exact, "cand_id", "left")
        .join(fuzzy, "cand_id", "left")
        .select(
            "cand_id",
            F.coalesce("_exact", "_fuzzy").alias("shoe_id"),
            F.when(F.col("_exact").isNotNull(), F.lit(1.0))
            .otherwise(F.coalesce("win", F.lit(0.0)))
            .alias("confidence"),
            F.when(F.col("_exact").isNotNull(), F.lit("exact-id"))
            .when(F.col("_fuzzy").isNotNull(), F.lit("model-fallback"))
            .otherwise(F.lit("none"))
            .alias("reason"),
        )
    )

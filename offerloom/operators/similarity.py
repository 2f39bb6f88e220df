"""Token-set similarity join.

Exact set-similarity join with prefix and size filters (published as AllPairs /
PPJoin): two sets can only reach the bound if they share one of their rarest
tokens, so only rows that share such a token meet, and a pair is checked once,
at its first shared prefix token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.money import js_round
from offerloom.functions.text import split_tokens

# --- fixed value: half a step of the two-decimal score ---
ROUNDING_SLACK = 0.005
#: Sets of a block that share a token and meet in one task, about; a token of more sets is dealt over a grid of tasks.
SETS_PER_TASK = 10_000


def token_set(c: Column | str) -> Column:
    """Distinct signal tokens."""
    return F.array_distinct(split_tokens(c))


def jaccard(a: Column, b: Column) -> Column:
    """Rounded Jaccard score of two distinct token arrays; 0 when one is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(js_round(shared / union, 2))


def _prefix(ranked: Column, bound: Column) -> Column:
    """The rarest tokens, one of which any partner that reaches the bound shares."""
    n = F.size(ranked)
    keep = n - F.ceil(n * bound - F.lit(1e-9)).cast("int") + 1
    return F.slice(ranked, 1, F.greatest(F.least(keep, n), F.lit(1)))


def similar_sets(sets: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id, score) of one block with score >= bound.

    ``sets``: one row per distinct set - set_id, block, tokens (distinct),
    bound (the same within a block), is_left, is_right.  The tokens of one set
    are bounded by the text they came from.
    """
    sets = sets.filter(F.size("tokens") > 0)
    tokens = sets.select("set_id", "block", F.explode("tokens").alias("token"))
    # Only pairs of one block meet, so a token is as rare as it is there.
    freq = tokens.groupBy("block", "token").agg(F.count("*").alias("df"))
    ranked = (
        tokens.join(freq, ["block", "token"])
        .groupBy("set_id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    )
    raw_bound = F.col("bound") - F.lit(ROUNDING_SLACK)
    side = F.ceil(F.sqrt(F.col("first.df") / F.lit(SETS_PER_TASK))).cast("int")
    keyed = (
        sets.drop("tokens")
        .join(ranked, "set_id")
        .withColumn("prefix", _prefix(F.col("ranked"), raw_bound))
        .withColumn("first", F.explode("prefix"))
        .withColumns({
            "token": F.col("first.token"), "ranked": F.col("ranked.token"), "prefix": F.col("prefix.token"),
            "own": F.pmod(F.xxhash64("set_id"), side).cast("int"), "all": F.explode(F.sequence(F.lit(0), side - 1)),
        })
    )
    # A set takes one row (left) or column (right) of its token's grid; every pair meets in one cell.
    left = keyed.filter("is_left").select(
        F.col("set_id").alias("left_id"), "block", "token", "bound", F.col("own").alias("row"), F.col("all").alias("column"),
        F.col("ranked").alias("left_tokens"), F.col("prefix").alias("left_prefix"),
    )
    right = keyed.filter("is_right").select(
        F.col("set_id").alias("right_id"), "block", "token", F.col("all").alias("row"), F.col("own").alias("column"),
        F.col("ranked").alias("right_tokens"), F.col("prefix").alias("right_prefix"),
    )
    n_left, n_right = F.size("left_tokens"), F.size("right_tokens")
    sized = (n_left >= n_right * raw_bound - F.lit(1e-9)) & (n_right >= n_left * raw_bound - F.lit(1e-9))
    first_shared = F.get(F.array_intersect("left_prefix", "right_prefix"), F.lit(0)) == F.col("token")
    return (
        left.join(right, ["block", "token", "row", "column"])
        .filter(sized & first_shared)
        .select("left_id", "right_id", "bound", jaccard(F.col("left_tokens"), F.col("right_tokens")).alias("score"))
        .filter(F.col("score") >= F.col("bound"))
        .drop("bound")
    )

"""First-wins operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions.money import fixed2
from offerloom.functions.text import as_col, let
from offerloom.functions.urls import canonical_url


def first_rows(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key by ``order``.

    The rank filter is pushed below the shuffle (each map task forwards at most
    ``n`` rows per key), so a key with a large share of the rows stays cheap.
    """
    w = Window.partitionBy(*[as_col(k) for k in keys]).orderBy(*[as_col(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _absent(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _digest(keys: Sequence[Column]) -> Column:
    """One short key that is equal where all keys are, null or not; rows are moved and sorted with it alone."""
    marks = [let(k, lambda x: F.coalesce(F.concat(F.length(x), F.lit(":"), x), F.lit("-"))) for k in keys]
    return F.unhex(F.md5(F.concat(*marks)))


def dedupe_offers(offers: DataFrame, order: Sequence[Column | str] = ("seq",)) -> DataFrame:
    """Working offers, first of each (source, page, item, size, ids, price)."""
    keys = [
        F.col("retailer_id"),
        canonical_url("url"),
        F.col("model_normalized"),
        F.col("category"),
        _absent("gender"),
        _absent("size_range"),
        _absent("sku"),
        _absent("gtin"),
        fixed2("price_current"),
    ]
    return first_rows(offers.withColumn("_key", _digest(keys)), ["_key"], order).drop("_key")


def dedupe_raw(offers: DataFrame, order: Sequence[Column | str], within: Sequence[str] = ()) -> DataFrame:
    """Raw offers, first of each (url, title, price)."""
    return first_rows(offers, [*within, "url", "title_raw", fixed2("price_current")], order)


def first_nonempty(df: DataFrame, key: str, priority: Column | str) -> DataFrame:
    """Rows of the best-ranked path that produced any row for the key.

    Two small aggregates and a join instead of a rank over the rows: the best
    rank per key is combined before the shuffle.
    """
    ranked = df.withColumn("_prio", as_col(priority))
    best = ranked.groupBy(key).agg(F.min("_prio").alias("_best"))
    return ranked.join(best, key).filter(F.col("_prio") == F.col("_best")).drop("_prio", "_best")

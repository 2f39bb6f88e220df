"""Listing page urls of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.urls import is_absolute, resolve_url, set_query_param
from offerloom.operators.dedupe import first_rows


def page_urls(sources: DataFrame, key: str = "source") -> DataFrame:
    """(key, page_index, url): the first page, then the numbered ones, distinct in order.

    ``sources``: base_url, strategy ("none", "query", "path"), page_param,
    path_template, start_page, max_pages.
    """
    numbered = (F.col("strategy") != "none") & (F.col("max_pages") >= F.col("start_page")) & is_absolute(F.col("base_url"))
    pages = F.when(numbered, F.sequence("start_page", "max_pages")).otherwise(F.array().cast("array<int>"))
    number = F.col("n").cast("string")

    def numbered_url() -> Column:
        by_path = F.regexp_replace("path_template", r"\{page\}", number)
        return F.when(
            F.col("strategy") == "query", set_query_param(F.col("base_url"), F.col("page_param"), number)
        ).otherwise(resolve_url(by_path, "base_url"))

    rest = sources.withColumn("n", F.explode(pages)).select(key, "n", numbered_url().alias("url"))
    first = sources.select(key, F.lit(-1).alias("n"), F.col("base_url").alias("url"))
    distinct = first_rows(first.unionByName(rest), [key, "url"], ["n"])
    earliest = F.coalesce(F.col("n"), F.lit(-1))
    return distinct.join(sources.select(key, "start_page"), key).select(
        key,
        F.when(earliest < 0, F.lit(0)).otherwise(earliest - F.col("start_page") + 1).alias("page_index"),
        "url",
    )

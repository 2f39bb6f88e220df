"""Connected components of a table of links, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.session import cut_lineage


#: Rows of a small table that one task writes, about.
ROWS_PER_TASK = 50_000


def _written(df: DataFrame, rows: int) -> DataFrame:
    """A table of about so many rows at most, in as few files as they need."""
    return cut_lineage(df.coalesce(max(1, -(-rows // ROWS_PER_TASK))))


def _roots(links: DataFrame, n: int) -> DataFrame:
    """(id, root) for every id that has a smaller neighbour: its smallest neighbour, followed to the end; ``n`` links."""
    parents = links.groupBy(F.greatest("a", "b").alias("id")).agg(F.min(F.least("a", "b")).alias("root"))
    parents = _written(parents, n)
    while True:
        up = parents.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        jumped = parents.join(up, "root", "left").select(
            "id", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")
        )
        jumped = _written(jumped, n)
        parents = jumped.select("id", "root")
        if jumped.where("moved").isEmpty():
            return parents


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, comp) of all ids whose component has a smaller id, after adding links (a, b).

    An id without a row is its own component.  Each round hooks every component to its smallest neighbour and
    follows the hooks to their ends, so that the number of components that still have links at least halves.
    """
    while True:
        left = links.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left")
        both = left.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
        open_links = both.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        open_links = _written(open_links.where("a <> b").distinct(), links.count())
        n = open_links.count()
        if not n:
            return labels
        roots = _roots(open_links, n)
        moved = labels.join(roots.select(F.col("id").alias("comp"), "root"), "comp", "left")
        moved = moved.select("id", F.coalesce("root", "comp").alias("comp"))
        new = roots.join(labels.select("id"), "id", "left_anti").select("id", F.col("root").alias("comp"))
        labels = _written(moved.unionByName(new), labels.count() + 2 * n)
        links = open_links

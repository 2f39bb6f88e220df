"""Curated corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators.dedupe import first_rows


def apply_patches(
    offers: DataFrame, patches: DataFrame, key: str = "offer_id", fields: list[str] | None = None
) -> DataFrame:
    """Overwrite the fields a patch names.

    ``patches``: (key, pos, set map<string,string>); the last patch of a key
    wins as a whole.  A field present with a null value clears the column; a
    field that is absent leaves it.
    """
    last = first_rows(patches.select(key, "pos", "set"), [key], [F.col("pos").desc()]).select(
        F.col(key).alias("_patch_key"), F.col("set").alias("_set")
    )
    joined = offers.join(last, F.col(key) == F.col("_patch_key"), "left")
    types = dict(offers.dtypes)
    names = [f for f in (offers.columns if fields is None else fields) if f in types and f != key]
    patched = {
        f: F.when(
            F.coalesce(F.map_contains_key("_set", F.lit(f)), F.lit(False)),
            F.try_element_at("_set", F.lit(f)).cast(types[f]),
        ).otherwise(F.col(f))
        for f in names
        if not types[f].startswith(("array", "map", "struct"))
    }
    return joined.withColumns(patched).drop("_patch_key", "_set")

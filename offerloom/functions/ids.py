"""Identifier normalisation and stable row ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.text import as_col, present


def norm_sku(c: Column | str) -> Column:
    return present(F.upper(F.regexp_replace(F.lower(as_col(c)), "[^a-z0-9]", "")))


def norm_gtin(c: Column | str) -> Column:
    """Digits, padded to 14; longer values keep every digit."""
    digits = present(F.regexp_replace(as_col(c), "[^0-9]", ""))
    return F.when(F.length(digits) < 14, F.lpad(digits, 14, "0")).otherwise(digits)


def norm_identifiers(sku: Column | str, gtin: Column | str) -> Column:
    s, g = norm_sku(sku), norm_gtin(gtin)
    return F.when(s.isNotNull() | g.isNotNull(), F.struct(s.alias("sku"), g.alias("gtin")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix plus 12 hex digits over the parts, each closed by a bar."""
    bars = [x for p in parts for x in (p, F.lit("|"))]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat(*bars)), 1, 12))

"""The ordered clustering by its definition: every offer is ranked against all products founded before it."""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

FILLER = frozenset("men mens women womens unisex kids youth junior running trail shoe shoes".split())


class Product(NamedTuple):
    key: tuple
    words: frozenset
    brand: str
    category: str


def words_of(model):
    return frozenset(model.replace("-", " ").split()) - FILLER


def alike(a, b):
    """Share of common words in hundredths, halves up."""
    share = Fraction(len(a & b), len(a | b)) if a and b else Fraction(0)
    return int(share * 100 + Fraction(1, 2)) / 100


def by_name(offer, founded):
    """The product whose name is alike enough and clearly ahead of all others."""
    own = words_of(offer["model"])
    rivals = [p for p in founded if p.category == offer["category"] and offer["brand"] in (None, "", p.brand)]
    ranking = sorted(((-alike(own, p.words), place) for place, p in enumerate(rivals)))
    needed, lead = (0.6, 0.04) if offer["brand"] else (0.72, 0.08)
    scores = [-s for s, _ in ranking[:2]] + [0.0, 0.0]
    if scores[0] > 0 and scores[0] >= needed and scores[0] - scores[1] >= lead:
        return rivals[ranking[0][1]].key, scores[0]
    return None


def sequential(offers):
    """offers: dicts in order; returns [(product key, reason, confidence)]."""
    founded, identifiers, out = [], {}, []

    def learn(key, offer):
        """A product keeps the first identifier of each kind it sees."""
        for kind in ("sku", "gtin"):
            if offer[kind]:
                identifiers.setdefault((key, kind), offer[kind])

    for offer in offers:
        keys = list(dict.fromkeys(p.key for p in founded))
        exact = [k for k in keys if any(offer[kind] and identifiers.get((k, kind)) == offer[kind] for kind in ("sku", "gtin"))]
        named = None if exact else by_name(offer, founded)
        if exact:
            found = (exact[0], "exact-id", 1.0)
        elif named:
            found = (named[0], "model-fallback", named[1])
        else:
            key = (offer["brand"] or "unknown", offer["model"], offer["category"], offer["sku"] or "", offer["gtin"] or "")
            founded.append(Product(key, words_of(offer["model"]), offer["brand"] or "Unknown", offer["category"]))
            found = (key, "none", 0.0)
        learn(found[0], offer)
        out.append(found)
    return out

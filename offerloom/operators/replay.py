"""A first guess of the events of ordered clustering: offers of a bounded group taken one by one.

The guess only saves rounds.  Whatever it says, the rounds of ``cluster_offers`` go on until the events reproduce
themselves.  So a group may be dealt freely (about ``GROUP`` classes, by category, then by brand), a class brings its
first ``OFFERS`` offers at most, a name its ``LOOKS`` most similar names, and links that leave a group are not seen.
Every link that leaves a group may cost rounds, so a group is as large as a task can hold: names, products and
identifiers are numbers, and strings and links stay in Arrow columns.  A class that looks among names is asked again only
when some name got a founding since.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.operators.dedupe import first_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP, OFFERS, LOOKS = 500_000, 50, 100
BRANDED = (rules.BRANDED_THRESHOLD, rules.BRANDED_MARGIN)
BRANDLESS = (rules.BRANDLESS_THRESHOLD, rules.BRANDLESS_MARGIN)
EVENTS = "class_id string, founds boolean, shoe_id string, shoe_names array<string>, ord {ord}, sku string, gtin string"


class Catalogue:
    """Products founded so far, by name and by identifier; products, names and identifiers are numbers."""

    def __init__(self, shoes: int, names: int, ids: int):
        #: The first two foundings of each name, as (turn, product).
        self.founders: list[tuple] = [()] * names
        #: How often a name got a founding: without a new one, names decide as before.
        self.stamp = 0
        self.founded = [-1] * shoes
        self.known = [[False] * shoes, [False] * shoes]
        self.holders: list[tuple | None] = [None] * ids

    def found(self, shoe: int, names: tuple[int, ...], turn: int, ids: tuple[int, int]) -> None:
        for name in names:
            if len(self.founders[name]) < 2:
                self.founders[name] += ((turn, shoe),)
                self.stamp += 1
        if self.founded[shoe] < 0:
            self.founded[shoe] = turn
            self.learn(shoe, ids)

    def learn(self, shoe: int, ids: tuple[int, int]) -> bool:
        """A product takes the identifiers of the kinds it lacks."""
        new = False
        for known, value in zip(self.known, ids, strict=True):
            if value >= 0 and not known[shoe]:
                known[shoe] = new = True
                held = (self.founded[shoe], shoe)
                self.holders[value] = min(held, self.holders[value] or held)
        return new

    def holder(self, ids: tuple[int, int]) -> int | None:
        """The earliest product that has one of the identifiers."""
        held = [self.holders[i] for i in ids if i >= 0 and self.holders[i]]
        return min(held)[1] if held else None

    def best(self, names: list[int], scores: list[float], branded: bool) -> int | None:
        """The product with the most similar name, if it is clearly ahead.  Names come by falling score."""
        top: list[tuple] = []
        for name, score in zip(names, scores, strict=True):
            if len(top) > 1 and score < -top[1][0]:
                break
            if self.founders[name]:
                top = sorted([*top, *((-score, *f) for f in self.founders[name])])[:2]
        if not top:
            return None
        win, runner_up = -top[0][0], -top[1][0] if len(top) > 1 else 0.0
        needed, lead = BRANDED if branded else BRANDLESS
        return top[0][2] if win >= needed and win - runner_up >= lead else None


def _place(ord_):
    """An ord that compares as Spark compares it: a struct field by field, null first."""
    return tuple((v is not None, _place(v)) for v in ord_.values()) if isinstance(ord_, dict) else ord_


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All entries of a column of lists, and where those of each row begin (a last one behind the last row)."""
    whole = column.combine_chunks()
    sizes = np.nan_to_num(whole.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return whole.flatten(), np.r_[0, np.cumsum(sizes)]


def _turns(ords: pa.Array) -> np.ndarray:
    """Places of the ords in their order."""
    if pa.types.is_integer(ords.type) or pa.types.is_floating(ords.type):
        return np.argsort(ords.to_numpy(zero_copy_only=False), kind="stable")
    keys = [_place(o) for o in ords.to_pylist()]
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Numbers from 0 of the different values, -1 for null; and how many there are."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def _replay(group: pa.Table) -> pa.Table:
    flat, at = _lists(group.column("looks"))
    looked, scores = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("shoe_key", "score"))
    own, own_at = _lists(group.column("shoe_keys"))
    names, number = np.unique(np.r_[own.to_numpy(zero_copy_only=False), looked].astype(np.int64), return_inverse=True)
    own, looked = number[: own_at[-1]].tolist(), number[own_at[-1] :]
    skus, kinds = _numbered(group.column("sku"))
    gtins, more = _numbered(group.column("gtin"))
    ids = list(zip(skus.tolist(), np.where(gtins < 0, -1, gtins + kinds).tolist(), strict=True))
    shoes, different = _numbered(group.column("shoe_id"))
    last = dict(zip(shoes.tolist(), range(len(shoes)), strict=True))
    ords, ords_at = _lists(group.column("ords"))
    order = _turns(ords)
    owners = np.repeat(np.arange(len(shoes)), np.diff(ords_at))[order].tolist()
    shoes, branded = shoes.tolist(), group.column("branded").to_pylist()
    shop, out = Catalogue(different, len(names), kinds + more), []
    starts, founds = own_at.tolist(), [0] * len(shoes)
    named: list[tuple | None] = [None] * len(shoes)
    for turn, i in enumerate(owners):
        shoe = shop.holder(ids[i])
        if shoe is None:
            if named[i] is None or named[i][0] != shop.stamp:
                a, b = at[i], at[i + 1]
                named[i] = (shop.stamp, shop.best(looked[a:b].tolist(), scores[a:b].tolist(), branded[i]))
            shoe = named[i][1]
        if shoe is None:
            shop.found(shoes[i], own[starts[i] : starts[i + 1]], turn, ids[i])
            # No third founding by a class is among the first two of its name.
            if founds[i] < 2:
                out.append((i, True, shoes[i], turn))
                founds[i] += 1
        elif shop.learn(shoe, ids[i]):
            out.append((i, False, shoe, turn))
    who, new, shoe, turn = (np.array([r[k] for r in out], np.int64) for k in range(4))
    rows = group.take(pa.array(who))
    spelled = group.column("shoe_id").take(pa.array([last[s] for s in shoe.tolist()], pa.int64()))
    told = rows.column("shoe_names")
    told = pc.if_else(pa.array(new.astype(bool)), told, pa.scalar(None, told.type))
    columns = [rows.column("class_id"), pa.array(new.astype(bool)), spelled, told, ords.take(pa.array(order[turn])), rows.column("sku"), rows.column("gtin")]
    return pa.table(columns, [f.split()[0] for f in EVENTS.split(", ")])


def replayed(classes: DataFrame, edges: DataFrame, offers: DataFrame) -> DataFrame:
    """Events that the groups come to, one row each, as classes cause them."""
    size = classes.groupBy("category").agg(F.count("*").alias("_size"))
    total = F.broadcast(classes.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / GROUP)).alias("_groups")))  # one row
    few = first_rows(offers.select("class_id", "ord"), ["class_id"], ["ord"], OFFERS)
    ords = few.groupBy("class_id").agg(F.collect_list("ord").alias("ords"))
    near = first_rows(edges, ["cand_name"], [F.desc("score"), "shoe_name"], LOOKS)
    look = F.struct("score", F.xxhash64("shoe_name").alias("shoe_key"))
    looks = near.groupBy("cand_name").agg(F.sort_array(F.collect_list(look), asc=False).alias("looks"))
    # A branded class looks among products of its brand only.
    part = F.pmod(F.xxhash64(F.coalesce("brand_n", "class_id")), F.ceil(F.col("_size") / GROUP))
    rows = (
        classes.join(size, "category")
        .crossJoin(total)
        .withColumn("_group", F.pmod(F.xxhash64("category", part), F.col("_groups")))
        .join(ords, "class_id")
        .join(looks, "cand_name", "left")
        .select(
            "_group", "class_id", "ords", "shoe_id", "shoe_names", "sku", "gtin", F.col("brand_n").isNotNull().alias("branded"), "looks",
            F.transform("shoe_names", lambda n: F.xxhash64(n)).alias("shoe_keys"),
        )
    )
    kind = offers.schema["ord"].dataType.simpleString()
    return rows.groupBy("_group").applyInArrow(_replay, EVENTS.format(ord=kind))

"""Ordered greedy clustering of offers into products.

Offers are taken in order.  Each is matched against the products founded so
far (same identifier, else unique best name); without a match it founds a
product.  A match may also give the product an identifier it lacked, which
later offers can then hit.

The order makes this look sequential.  It is computed as a fixpoint instead:

* a decision depends only on *earlier* events (a product founded, an identifier
  gained), and on few of them: the first two products of each name and the
  earliest holder of each identifier;
* from a guessed set of events, all decisions and hence all events follow by
  joins; this step is repeated until the events no longer change.  The guess
  comes from taking the offers of bounded groups one by one (``replay``).

A set of events that reproduces itself is the sequential outcome: the earliest
event depends on nothing, and each next one only on events already shown to
agree.  Every round settles at least one more link of each dependency chain, so
the loop ends.  No group of offers is ever gathered: rounds work on distinct
(brand, model, category, ids) classes and on pairs of distinct names, and a hot
class is one row.

Rounds are semi-naive.  Only classes that can see an event that changed in the
round before (by a name or an identifier) are decided again, and only products
of the names they touch get their events again; everything else stands, as do
all events before the first one that changed.  What a round replaces is written
beside the older rows (``Versions``); superseded rows are dropped now and then.
The frontier falls about by half a round, and small rounds run in a session
that does not plan for large ones.

A product that is founded again (an ambiguous name without identifiers) stays
one product; the second founding only makes its name ambiguous for others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.ids import stable_id
from offerloom.functions.money import blend_confidence
from offerloom.operators.dedupe import first_rows
from offerloom.operators.match import accepts, candidate_names, name_pairs, product_names
from offerloom.operators.replay import replayed
from offerloom.operators.versions import Stored, Versions


def product_id(brand: Column, model: Column, category: Column, sku: Column, gtin: Column) -> Column:
    def or_empty(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return stable_id("shoe", F.coalesce(brand, F.lit("unknown")), model, category, or_empty(sku), or_empty(gtin))


def _class_key() -> Column:
    marks = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("brand", "model", "category", "sku", "gtin")]
    return F.sha2(F.concat_ws("\u0001", *marks), 256)


def offer_classes(offers: DataFrame) -> DataFrame:
    """One row per distinct (brand, model, category, sku, gtin) with first and last ord.

    While clustering, a product goes by its narrower name and its id (``name/shoe_id``), so that events can be
    told by name.
    """
    classes = (
        offers.groupBy("brand", "model", "category", "sku", "gtin")
        .agg(
            F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
            F.concat_ws("/", F.count("*"), F.sum(F.xxhash64("ord").cast("decimal(38,0)"))).alias("ords_print"),
        )
        .withColumn("class_id", _class_key())
        .withColumn(
            "shoe_id", product_id(F.col("brand"), F.col("model"), F.col("category"), F.col("sku"), F.col("gtin"))
        )
    )
    cand = candidate_names(classes).drop("tokens", "block")
    named = cand.withColumn("brand", F.coalesce("brand", F.lit(rules.UNKNOWN_BRAND))).transform(_as_products)
    return named.withColumn("shoe_id", F.concat_ws("/", F.get("shoe_names", F.lit(0)), "shoe_id"))


def _topic() -> Column:
    """The narrower name of the product that an event is about."""
    return F.substring_index("shoe_id", "/", 1)


def _as_products(classes: DataFrame) -> DataFrame:
    """Adds ``shoe_names``: where the product is found that a class would found."""
    named = product_names(classes.withColumnRenamed("brand_n", "_cand_brand"))
    return named.withColumn("shoe_names", F.col("names.shoe_name")).drop("names", "tokens", "brand_n").withColumnRenamed(
        "_cand_brand", "brand_n"
    )


def _all_names(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names under which classes look for products, and under which the products they found are found."""
    # Classes that differ in identifiers only share their names, which are worked out once.
    own = classes.select(F.col("brand_n").alias("brand"), "model", "category").distinct()
    return candidate_names(own), product_names(classes.select("brand", "model", "category").distinct())


def name_edges(classes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(cand_name, shoe_name, score) between the distinct names of the classes.

    With ``known`` classes only pairs with a name that none of them has; names that share no word with a new one
    take no part.
    """
    looks, listed = _all_names(classes)
    if known is None:
        return name_pairs(looks, listed)
    old_looks, old_listed = _all_names(known)
    old = old_looks.select(F.col("cand_name").alias("_name")).unionByName(old_listed.select(F.explode("names.shoe_name").alias("_name")))
    names = looks.select("cand_name", "block", "tokens").unionByName(
        listed.select("tokens", F.explode("names").alias("n")).select(F.col("n.shoe_name").alias("cand_name"), "n.block", "tokens")
    )
    new = Stored(names.join(old, names["cand_name"] == old["_name"], "left_anti").distinct())
    words = new.rows().select("block", F.explode("tokens").alias("_word")).distinct()

    def near(df: DataFrame, block: str) -> DataFrame:
        """Rows with a word and block of a new name."""
        told = df.withColumn("_word", F.explode("tokens")).withColumn("_block", F.col(block))
        return told.join(words, (told["_word"] == words["_word"]) & (told["_block"] == words["block"]), "left_semi").drop("_word", "_block").dropDuplicates()

    blocks = listed.withColumn("_any", F.explode("names.block"))
    pairs = name_pairs(near(looks, "block"), near(blocks, "_any").drop("_any").dropDuplicates())
    fresh = new.rows().select(F.col("cand_name").alias("_new"))
    return (
        pairs.join(fresh.withColumn("_a", F.lit(True)), F.col("cand_name") == F.col("_new"), "left").drop("_new")
        .join(fresh.withColumn("_b", F.lit(True)), F.col("shoe_name") == F.col("_new"), "left").drop("_new")
        .filter(F.col("_a").isNotNull() | F.col("_b").isNotNull()).select("cand_name", "shoe_name", "score").distinct()
    )


def _name_timeline(edges: DataFrame, founded: DataFrame) -> DataFrame:
    """Per candidate name: scores with the first two founding times behind them.

    A score has two decimals, so a name has at most 45 of them.
    """
    listed = founded.select("ord", "shoe_id", F.explode("shoe_names").alias("shoe_name"))
    two = first_rows(listed, ["shoe_name"], ["ord"], 2)
    by_score = first_rows(edges.join(two, "shoe_name"), ["cand_name", "score"], ["ord"], 2)
    pair = by_score.groupBy("cand_name", "score").agg(
        F.min(F.struct("ord", "shoe_id")).alias("a"),
        F.max("ord").alias("_last"),
    )
    entry = F.struct(
        F.col("score"),
        F.col("a.ord").alias("t1"),
        F.when(F.col("_last") > F.col("a.ord"), F.col("_last")).alias("t2"),
        F.col("a.shoe_id").alias("shoe_id"),
    )
    return pair.groupBy("cand_name").agg(F.sort_array(F.collect_list(entry), asc=False).alias("names"))


def _record_lows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Holders that were earlier in the catalogue than all holders before them."""
    before = Window.partitionBy(*keys).orderBy("acq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_low", F.min("pos").over(before))
        .filter(F.col("_low").isNull() | (F.col("pos") < F.col("_low")))
        .drop("_low")
    )


def _id_holders(founded: DataFrame, gained: DataFrame) -> DataFrame:
    """Per (kind, value): the products that were its first holder, over time.

    Only a holder earlier in the catalogue than all previous ones can win, so
    the list is a chain of record lows (about log n long).  Lows are taken per
    salt first, which keeps a hot identifier out of a single task.
    """
    ids = founded.select(
        "ord",
        "shoe_id",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("sku").alias("kind"), F.col("sku").alias("value")),
                    F.struct(F.lit("gtin").alias("kind"), F.col("gtin").alias("value")),
                ),
                lambda x: x["value"].isNotNull(),
            )
        ).alias("id"),
    )
    first = ids.groupBy("id.kind", "id.value").agg(F.min(F.struct("ord", "shoe_id")).alias("f")).select(
        "kind", "value", F.col("f.ord").alias("acq"), F.col("f.ord").alias("pos"), "f.shoe_id"
    )
    by_match = (
        gained.join(first.select("kind", "value", F.col("pos").alias("_first")), ["kind", "value"], "left")
        .filter(F.col("_first").isNull() | (F.col("pos") < F.col("_first")))
        .select("kind", "value", "acq", "pos", "shoe_id")
    )
    lows = _record_lows(
        by_match.withColumn("_salt", F.pmod(F.xxhash64("shoe_id"), F.lit(64))), ["kind", "value", "_salt"]
    ).drop("_salt")
    chain = _record_lows(first.unionByName(lows), ["kind", "value"])
    return chain.groupBy("kind", "value").agg(F.collect_list(F.struct("acq", "pos", "shoe_id")).alias("holders"))


def _timelines(classes: DataFrame, names: DataFrame, holders: DataFrame) -> DataFrame:
    """Adds ``timeline``: the decision of a class after each event it can see."""

    def of_kind(kind: str) -> DataFrame:
        return holders.filter(F.col("kind") == kind).select(
            F.col("value").alias(f"_{kind}"), F.col("holders").alias(f"_{kind}_holders")
        )

    # Classes without the identifier take no part in the join.
    def attach(df: DataFrame, kind: str) -> DataFrame:
        hit = (
            df.filter(F.col(kind).isNotNull())
            .select("class_id", F.col(kind).alias(f"_{kind}"))
            .join(of_kind(kind), f"_{kind}")
            .drop(f"_{kind}")
        )
        return df.join(hit, "class_id", "left")

    df = attach(attach(classes, "sku"), "gtin").join(names, "cand_name", "left")
    types = {f.name: f.dataType for f in df.schema.fields}
    none_held = F.array().cast(types["_sku_holders"])
    none_named = F.array().cast(types["names"])
    df = df.withColumn(
        "_held", F.concat(F.coalesce("_sku_holders", none_held), F.coalesce("_gtin_holders", none_held))
    ).withColumn("names", F.coalesce("names", none_named))

    times = F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform("_held", lambda h: h["acq"]),
                F.transform("names", lambda n: n["t1"]),
                F.filter(F.transform("names", lambda n: n["t2"]), lambda t: t.isNotNull()),
            )
        )
    )
    branded = F.col("brand_n").isNotNull()

    # Three small steps instead of one nested expression: what is visible after
    # an event, the best two of it, the decision.
    def visible(t: Column) -> Column:
        return F.struct(
            t.alias("after"),
            F.array_min(
                F.transform(
                    F.filter("_held", lambda h: h["acq"] <= t),
                    lambda h: F.struct(h["pos"].alias("pos"), h["shoe_id"].alias("shoe_id")),
                )
            ).alias("held"),
            F.slice(F.filter("names", lambda n: n["t1"] <= t), 1, 2).alias("live"),
        )

    def best_two(v: Column) -> Column:
        best = F.get(v["live"], F.lit(0))
        second = F.coalesce(F.get(v["live"], F.lit(1))["score"], F.lit(0.0))
        return F.struct(
            v["after"].alias("after"),
            v["held"]["shoe_id"].alias("held"),
            best["shoe_id"].alias("shoe_id"),
            best["score"].alias("score"),
            F.when(best["t2"] <= v["after"], best["score"]).otherwise(second).alias("runner_up"),
        )

    def decide(v: Column) -> Column:
        held = v["held"].isNotNull()
        named = F.coalesce(accepts(branded, v["score"], v["runner_up"]), F.lit(False))
        return F.struct(
            v["after"].alias("after"),
            F.when(held, F.lit("exact-id")).when(named, F.lit("model-fallback")).otherwise(F.lit("none")).alias("reason"),
            F.when(held, v["held"]).when(named, v["shoe_id"]).alias("shoe_id"),
            F.when(held, F.lit(1.0)).when(named, v["score"]).otherwise(F.lit(0.0)).alias("confidence"),
        )

    timeline = F.transform(F.transform(F.transform(times, visible), best_two), decide)
    return df.withColumn("timeline", timeline).drop("_held", "names", "_sku_holders", "_gtin_holders")


def decision_at(ord_: Column) -> Column:
    """Last timeline entry strictly before an offer; null when there is none."""
    return F.try_element_at(F.filter("timeline", lambda e: e["after"] < ord_), F.lit(-1))


def _events(decided: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Foundings and gained identifiers that follow from the timelines.

    Only the first offer of a class in each stretch of equal decisions can
    cause an event.  The first stretch needs no offers; later ones are looked
    up only where the decision could cause an event at all.
    """
    keep = ["class_id", "shoe_id", "shoe_names", "sku", "gtin", "timeline"]
    has_id = F.col("sku").isNotNull() | F.col("gtin").isNotNull()
    own = F.col("shoe_id")
    # "after" is an event time; an offer at that very time caused it.
    later = F.filter(
        "timeline",
        lambda e: (e["after"] >= F.col("first_ord"))
        & (e["after"] < F.col("last_ord"))
        & ((e["reason"] == "none") | (has_id & (e["shoe_id"] != own))),
    )
    open_classes = decided.filter(F.size(later) > 0).select(*keep)
    probes = offers.select("class_id", "ord").join(open_classes, "class_id").withColumn("d", decision_at(F.col("ord")))
    stretches = (
        probes.filter(F.col("d").isNotNull())
        .groupBy("class_id", F.col("d.after").alias("_after"))
        .agg(
            F.min("ord").alias("ord"),
            *[F.first(c).alias(c) for c in ("shoe_id", "shoe_names", "sku", "gtin", "d")],
        )
        .drop("_after")
    )
    firsts = decided.select(
        "class_id", F.col("first_ord").alias("ord"), "shoe_id", "shoe_names", "sku", "gtin",
        decision_at(F.col("first_ord")).alias("d"),
    )
    rows = firsts.unionByName(stretches)
    none = F.coalesce(F.col("d.reason") == "none", F.lit(True))
    founded = rows.filter(none).select("class_id", "shoe_id", "shoe_names", "ord", "sku", "gtin")
    by_match = rows.filter(~none).select("class_id", F.col("d.shoe_id").alias("shoe_id"), "ord", "sku", "gtin")
    return founded, by_match


def _relevant(founded: DataFrame, by_match: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that can matter: two foundings per name, one gain per product and kind.

    The first name of a product is the narrower one (own brand): two foundings
    of it hold every founding that can be among the first two of the wider one.
    """
    founded = founded.withColumn("_name", F.get("shoe_names", F.lit(0))).dropDuplicates(["_name", "shoe_id", "ord"])
    firsts = first_rows(founded, ["shoe_id"], ["ord"]).withColumn("first", F.lit(True))
    seconds = (
        first_rows(founded, ["_name"], ["ord"], 2)
        .join(firsts.select("shoe_id", "ord"), ["shoe_id", "ord"], "left_anti")
        .withColumn("first", F.lit(False))
    )
    products = firsts.select("shoe_id", F.col("ord").alias("pos"), F.col("sku").alias("_sku"), F.col("gtin").alias("_gtin"))
    gains = (
        by_match.select(
            "shoe_id",
            "ord",
            F.explode(
                F.filter(
                    F.array(
                        F.struct(F.lit("sku").alias("kind"), F.col("sku").alias("value")),
                        F.struct(F.lit("gtin").alias("kind"), F.col("gtin").alias("value")),
                    ),
                    lambda x: x["value"].isNotNull(),
                )
            ).alias("id"),
        )
        .groupBy("shoe_id", "id.kind")
        .agg(F.min(F.struct(F.col("ord"), F.col("id.value"))).alias("e"))
        .join(products, "shoe_id")
        .filter(F.when(F.col("kind") == "sku", F.col("_sku")).otherwise(F.col("_gtin")).isNull())
        .select("kind", "e.value", F.col("e.ord").alias("acq"), "pos", "shoe_id")
    )
    return firsts.unionByName(seconds).drop("_name"), gains


def _pack(founded: DataFrame, gained: DataFrame) -> DataFrame:
    """Both event kinds as one table, so that one checkpoint holds a round."""
    a = founded.select(
        F.lit("founded").alias("event"), "shoe_id", "shoe_names", "ord", "sku", "gtin", "first",
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"),
        F.col("ord").alias("pos"),
    )
    b = gained.select(
        F.lit("gained").alias("event"), "shoe_id", F.lit(None).cast("array<string>").alias("shoe_names"),
        F.col("acq").alias("ord"), F.lit(None).cast("string").alias("sku"),
        F.lit(None).cast("string").alias("gtin"), F.lit(None).cast("boolean").alias("first"),
        "kind", "value", "pos",
    )
    return a.unionByName(b)


def _unpack(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    founded = events.filter("event = 'founded'").select("shoe_id", "shoe_names", "ord", "sku", "gtin", "first")
    gained = events.filter("event = 'gained'").select("kind", "value", F.col("ord").alias("acq"), "pos", "shoe_id")
    return founded, gained


def _raw(founded: DataFrame, by_match: DataFrame) -> DataFrame:
    """Events as classes cause them, one table for both kinds."""
    a = founded.select("class_id", F.lit(True).alias("founds"), "shoe_id", "shoe_names", "ord", "sku", "gtin")
    none = F.lit(None).cast("array<string>")
    b = by_match.select("class_id", F.lit(False).alias("founds"), "shoe_id", none.alias("shoe_names"), "ord", "sku", "gtin")
    return a.unionByName(b)


def _reduced(raw: DataFrame) -> DataFrame:
    """Events that can matter, of all products whose raw events are given."""
    founded = raw.filter("founds").select("shoe_id", "shoe_names", "ord", "sku", "gtin")
    return _pack(*_relevant(founded, raw.filter("not founds").select("shoe_id", "ord", "sku", "gtin")))


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events that are in one of two tables only."""
    sides = before.withColumn("_side", F.lit(-1)).unionByName(after.withColumn("_side", F.lit(1)))
    return sides.groupBy(*after.columns).agg(F.sum("_side").alias("_side")).filter("_side <> 0").drop("_side")


def _who_sees(changed: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes that look at a name or an identifier of a changed event."""
    names = changed.select(F.explode("shoe_names").alias("shoe_name"))
    lookers = edges.join(names, "shoe_name", "left_semi").select("cand_name")
    seen = classes.join(lookers, "cand_name", "left_semi")
    for kind in ("sku", "gtin"):
        values = changed.select(F.coalesce(kind, F.when(F.col("kind") == kind, F.col("value"))).alias(kind)).filter(F.col(kind).isNotNull())
        seen = seen.unionByName(classes.join(values, kind, "left_semi"))
    return seen.dropDuplicates(["class_id"])


#: Changed events, and classes that see them, up to which a round is small: it runs in one partition and without
#: re-planning.  Results are the same.
SMALL_ROUND = 5_000


def _small_session(spark: SparkSession) -> SparkSession:
    small = spark.newSession()
    small.conf.set("spark.sql.shuffle.partitions", "1")
    small.conf.set("spark.sql.adaptive.enabled", "false")
    return small


#: Tables that a run leaves for the next one.
KEPT = ("classes", "edges", "events", "raw", "decided")


def _settle(
    run: SparkSession, small: SparkSession, narrow: Stored, classes: Stored, edges: Stored,
    state: tuple[Versions, Versions, Versions], todo: Stored, gone: DataFrame | None, turn: int, watch: Callable[[int, int], None] | None,
) -> None:
    """Rounds until no event changes.  ``todo``: classes of the first round; ``gone``: classes that are there no more."""
    spark, (events, raw, decided) = run, state
    while True:
        c, current = todo.rows(run), events.current(run)
        e = edges.rows(run) if turn == 0 else edges.rows(run).join(c, "cand_name", "left_semi")
        founded, gained = _unpack(current)
        fresh = Stored(_timelines(c, _name_timeline(e, founded), _id_holders(founded, gained)))
        caused = Stored(_raw(*_events(fresh.rows(run), narrow.rows(run))).withColumn("topic", _topic()))
        keys = fresh.rows(run).select("class_id")
        if gone is not None:
            keys, gone = keys.unionByName(gone.select("class_id")), None
        replaced = Stored(keys)
        old = current if turn == 0 else raw.current(run).join(replaced.rows(run), "class_id", "left_semi")
        touched = Stored(old.select("topic").unionByName(caused.rows(run).select("topic")).distinct())
        before = current.join(touched.rows(run), "topic", "left_semi")
        raw.replace(caused, replaced, turn)
        decided.replace(fresh, fresh, turn, lent=True)
        after = Stored(_reduced(raw.current(run).join(touched.rows(run), "topic", "left_semi")).withColumn("topic", _topic()))
        changed = Stored(_changed(before, after.rows(run)))
        events.replace(after, touched, turn)
        count = changed.rows(run).count()
        if watch:
            watch(fresh.rows(run).count(), count)
        todo.drop()
        if count:
            run, turn = small if count <= SMALL_ROUND else spark, turn + 1
            todo = Stored(_who_sees(changed.rows(run), classes.rows(run), edges.rows(run)))
            # Few events can be seen by very many classes.
            if run is small and todo.rows(run).count() > SMALL_ROUND:
                run = spark
        changed.drop()
        if not count:
            return
        for versions in state:
            versions.tidy(run)


def cluster_offers(
    offers: DataFrame, watch: Callable[[int, int], None] | None = None, known: str | None = None, keep: str | None = None
) -> DataFrame:
    """Assign every offer to a product.

    ``offers``: ord (unique, orderable), brand, model, category, sku, gtin -
    normalised; further columns pass through.  Adds shoe_id, match_confidence,
    match_reason ("none" for a founding offer).  ``watch`` is told, round by
    round, how many classes were decided and how many events changed.

    ``keep``: a folder to leave the settled tables in, another one than ``known``.  ``known``: such a folder
    of a run over other offers of the same catalogue (ords of common offers must
    be the same): then only classes whose offers differ are decided first, and
    after them those that see what changed.  The result is that of a whole run.
    """
    spark = offers.sparkSession
    keyed = offers.withColumn("class_id", _class_key())
    narrow = Stored(keyed.select("class_id", "ord", "brand", "model", "category", "sku", "gtin"))
    if set(offers.columns) <= set(narrow.schema.names):
        # Nothing passes through: what was written is read instead of worked out again.
        keyed = narrow.rows().select(*keyed.columns)
    classes = Stored(offer_classes(narrow.rows()))
    events, raw, decided = state = Versions("topic"), Versions("class_id"), Versions("class_id")
    gone, turn = None, 0
    if known is None:
        edges = Stored(name_edges(classes.rows()))
        replay = Stored(replayed(classes.rows(), edges.rows(), narrow.rows()))
        guess = Stored(_reduced(replay.rows()).withColumn("topic", _topic()))
        replay.drop()
        events.replace(guess, guess, -1, lent=True)
        todo = Stored(classes.rows())
    else:
        old = {name: Stored.at(spark, f"{known}/{name}") for name in KEPT}
        before = old["classes"].rows()
        edges = Stored(old["edges"].rows().unionByName(name_edges(classes.rows(), before)).distinct())
        for versions, name in zip(state, ("events", "raw", "decided")):
            versions.replace(old[name], old[name], -1, lent=True)
            versions.borrowed = True
        todo = Stored(classes.rows().join(before.select("class_id", "ords_print"), ["class_id", "ords_print"], "left_anti"))
        gone, turn = before.join(classes.rows(), "class_id", "left_anti"), 1
    _settle(spark, _small_session(spark), narrow, classes, edges, state, todo, gone, turn, watch)
    standing = decided.current(spark).join(classes.rows(), "class_id", "left_semi")
    if keep is not None:
        tables = (classes.rows(), edges.rows(), events.current(spark), raw.current(spark), standing)
        for name, table in zip(KEPT, tables):
            table.write.mode("overwrite").parquet(f"{keep}/{name}")
    timeline = standing.select("class_id", F.col("shoe_id").alias("_own"), "timeline")
    d = F.col("_d")
    return (
        keyed.join(timeline, "class_id")
        .withColumn("_d", decision_at(F.col("ord")))
        .withColumn("shoe_id", F.substring_index(F.coalesce(d["shoe_id"], F.col("_own")), "/", -1))
        .withColumn("match_confidence", F.coalesce(d["confidence"], F.lit(0.0)))
        .withColumn("match_reason", F.coalesce(d["reason"], F.lit("none")))
        .drop("_d", "_own", "timeline", "class_id")
    )


def with_blended_confidence(clustered: DataFrame, column: str = "source_confidence") -> DataFrame:
    """Source confidence after the match."""
    blended = blend_confidence(column, "match_confidence")
    return clustered.withColumn(
        column, F.when(F.col("match_reason") == "none", F.col(column)).otherwise(blended)
    )

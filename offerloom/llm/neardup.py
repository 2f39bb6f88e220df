"""Near duplicates by a chosen-path set similarity join.

A document is its set of word shingles; documents with equal sets are one class.  A class has a sketch of minwise
tokens.  Every tree deals the classes into nodes by one or two of the tokens that the node's path selects; a pair
that is similar stays together with high probability.  In small nodes all pairs are compared by their sketches;
larger nodes compare all their classes with one of them and branch again by other tokens.  Only pairs that
the sketches let pass are compared on their full sets, and only links confirmed there count.  Trees are independent,
so the chance to miss a pair falls with their number.

Only connections matter, so classes that are known to be connected are not compared with each other again: a node
whose classes are all connected is done, and a large group of copies costs as many comparisons as it has classes.
A first look at a node makes only as many pairs as hold its alike classes together.  What is still unconnected then
may be like very many classes and linked with few; such classes are not paired one by one: each is a query against
the members of a component, and blocks of queries meet blocks of members, where all intersections are counted at once.

Defined cases: a text without words has an empty set and is linked with nothing; a text of fewer words than a
shingle has its word sequence as only element.  A null text has no words.  Rows that repeat an id count as one
document whose links are joined.  A row without id takes no part: its component is null and it is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import id_and_text, ship
from offerloom.llm.components import merge_components
from offerloom.llm.wordhash import mix, pieces, run_hashes, word_hashes
from offerloom.session import cut_lineage

ship(__name__)

SHINGLE = 5
PERCENT = 80
#: Minwise tokens of a sketch; one byte of each is kept for estimates and for branching below the roots.
TOKENS = 64
#: Independent trees; every fourth branches by two tokens.
TREES = 12
#: Nodes of up to this many classes are compared exhaustively, by their sketches.
SMALL_NODE = 1024
#: So is a larger one of up to this many, if it has not more unconnected pairs than so many small nodes.
WIDE_NODE = 65_536
#: Ids whose texts are looked for are sent everywhere up to this many; more are joined.
SENT_IDS = 250_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Queries and members of a component that meet in one task, about.
QUERIES_PER_CELL, MEMBERS_PER_CELL = 256, 1024

SKETCH = "doc_id long, n_shingles long, key1 long, key2 long, sketch binary, nodes array<long>"
PAIR = "a long, b long"


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within a text, and the text each belongs to."""
    words, text = word_hashes([t.translate(LOWER) for t in texts])
    n = max(len(words) - size + 1, 0)
    whole = np.flatnonzero(text[:n] == text[size - 1 : size - 1 + n])
    hashes, owner = run_hashes(words, size, 31)[whole], text[whole]
    counts = np.bincount(text, minlength=len(texts))
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        first = int(np.searchsorted(text, i))
        hashes = np.r_[hashes, run_hashes(words[first : first + counts[i]], int(counts[i]), 37)]
        owner = np.r_[owner, i]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(hashes)]
    return hashes[new], owner[new]


def _factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64))
    return seeds[:TOKENS] | np.uint64(1), seeds[TOKENS:]


def _branches(node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tokens that a node selects: (which nodes, their token); every node one, a quarter of them another one."""
    everyone = np.arange(len(node))
    second = np.flatnonzero(mix(node ^ np.uint64(0x51)) % np.uint64(4) == 0)
    one = (mix(node ^ np.uint64(0x52)) % np.uint64(TOKENS)).astype(np.int64)
    other = (mix(node ^ np.uint64(0x53)) % np.uint64(TOKENS)).astype(np.int64)
    return [(everyone, one), (second, other[second])]


def _sketcher(size: int, trees: int):
    factors, shifts = _factors()
    names = [c.split()[0] for c in SKETCH.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    roots = [t for t in range(trees)] + [trees + t for t in range(0, trees, 4)]

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]
            for a, b in pieces(texts):
                hashes, owner = shingle_sets(texts[a:b], size)
                n = b - a
                counts = np.bincount(owner, minlength=n)
                full = np.flatnonzero(counts)
                first = (np.cumsum(counts) - counts)[full]
                key1, key2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                sketches, nodes = np.zeros((n, TOKENS), np.uint8), np.zeros((n, len(roots)), np.uint64)
                if len(full):
                    key1[full] = np.add.reduceat(mix(hashes), first)
                    key2[full] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5)), first)
                    lows = np.zeros((len(full), TOKENS), np.uint64)
                    for k in range(TOKENS):
                        lows[:, k] = np.minimum.reduceat((hashes * factors[k] + shifts[k]) >> np.uint64(20), first)
                    sketches[full] = lows.astype(np.uint8)
                    for j, root in enumerate(roots):  # the first token of every tree, then the second of some
                        tree = np.uint64((root % trees + 1) * 1_000_003)
                        nodes[full, j] = mix(lows[:, root % TOKENS] * np.uint64(64) + np.uint64(root % TOKENS) ^ mix(np.array([tree])))
                held = [nodes[i].view(np.int64) if counts[i] else [] for i in range(n)]
                columns = [ids[a:b], counts, key1.view(np.int64), key2.view(np.int64), [s.tobytes() for s in sketches], held]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return sketch


def _matrix(column) -> np.ndarray:
    """Sketches of a column as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, TOKENS)


def _least_equal(percent: int) -> int:
    """Equal tokens that a pair with this similarity has but for about one case in ten million."""
    p = percent / 100
    return max(1, math.floor(TOKENS * p - 5.2 * math.sqrt(TOKENS * p * (1 - p))))


def _alike(i: int, others: np.ndarray, sketches: np.ndarray, n: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Of ``others`` those whose sketch and size let them be similar to class ``i``."""
    others = others[100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])]
    return others[(sketches[others] == sketches[i]).sum(1) >= least]


def _forest(ids, comps, sketches, n, least, percent) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that hold each group of alike classes of a node together: the smallest id and all that are like it,
    then the rest, and who is like them.  A class that is like none of the rest is paired with one of those taken out
    before, if it is like any, so that every class that is like another one of the node is in a pair."""
    left, taken = np.arange(len(ids)), np.zeros(len(ids), bool)
    while len(left):
        found = _alike(left[0], left[1:], sketches, n, least, percent)
        if len(found):
            yield np.full(len(found), ids[left[0]]), ids[found]
        elif len(before := _alike(left[0], np.flatnonzero(taken), sketches, n, least, percent)):
            yield np.minimum(ids[before[:1]], ids[left[0]]), np.maximum(ids[before[:1]], ids[left[0]])
        taken[found] = True
        left = np.setdiff1d(left[1:], found, assume_unique=True)


def _queries(ids, comps, sketches, n, least, percent) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(component, id, whether a query): classes outside the node's largest component that are like a class of
    another component, and the classes they are like, filed under the largest component."""
    _, comp, sizes = np.unique(comps, return_inverse=True, return_counts=True)
    largest = comp == sizes.argmax()
    query, member = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    for i in np.flatnonzero(~largest):
        found = _alike(i, np.flatnonzero((comp != comp[i]) & (largest | (np.arange(len(ids)) > i))), sketches, n, least, percent)
        query[i] = len(found) > 0
        member[found] = True
    if query.any():
        both = np.r_[ids[query], ids[member]]
        yield np.full(len(both), comps[largest][0]), both, np.r_[np.ones(query.sum(), bool), np.zeros(member.sum(), bool)]


def _by_node(of_node, names: list[str], least: int, percent: int):
    """Rows that ``of_node`` makes of every node; rows come sorted by node."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            parts = [b for b in (rest, batch) if b is not None and b.num_rows]
            if not parts:
                continue
            table = pa.Table.from_batches(parts).combine_chunks()
            node = table.column("node").to_numpy()
            cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
            if batch is not None:  # the last node may go on in the next batch
                done = int(cuts[-1]) if len(cuts) else 0
                rest = table.slice(done).combine_chunks().to_batches()[0]
                table, cuts = table.slice(0, done), cuts[:-1]
                if not done:
                    continue
            ids, comps, n = (table.column(c).to_numpy() for c in ("id", "comp", "n"))
            sketches = _matrix(table.column("sketch"))
            found = []
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(ids)], strict=True):
                if b - a > 1:
                    found += list(of_node(ids[a:b], comps[a:b], sketches[a:b], n[a:b], least, percent))
            if found:
                columns = np.unique(np.stack([np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _star(least: int):
    """Pairs of a class and its node's chosen class that the sketches let pass."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            alike = (_matrix(batch.column(1)) == _matrix(batch.column(3))).sum(1) >= least
            a, b = batch.column(0).to_numpy()[alike], batch.column(2).to_numpy()[alike]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return pairs


def _children(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the nodes below: one or two for each class, by tokens that the node selects."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy().view(np.uint64)
        sketches = _matrix(batch.column(2))
        for rows, token in _branches(node):
            key = mix(node[rows] * np.uint64(0x9E3779B97F4A7C15) + token.astype(np.uint64) * np.uint64(256) + sketches[rows, token])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), *[batch.column(c).take(pa.array(rows)) for c in (1, 2, 3)]], ["node", "id", "sketch", "n"]
            )


def _set_rows(size: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for a, b in pieces(texts):
                hashes, owner = shingle_sets(texts[a:b], size)
                bounds = np.searchsorted(owner, np.arange(b - a + 1))
                held = [hashes[bounds[i] : bounds[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(held, pa.binary())], ["id", "shingles"])

    return rows


def _confirm(percent: int):
    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                both = len(x) + len(y)
                common = both - len(np.unique(np.concatenate([x, y]))) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                keep.append(100 * common >= percent * (both - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return links


def _cell_links(percent: int):
    """Links between the queries and the members of a cell, by counting all common shingles at once."""

    def links(cell: pa.Table) -> pa.Table:
        ids, query = cell.column("id").to_numpy(), cell.column("query").to_numpy().astype(bool)
        sets = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()]
        mine, others = np.flatnonzero(query), np.flatnonzero(~query)
        sizes = np.array([len(x) for x in sets])
        token = np.concatenate([sets[i] for i in mine]) if len(mine) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(mine)), sizes[mine])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, len(others) if len(mine) else 0, 32):
            part = others[start : start + 32]
            wanted = np.concatenate([sets[i] for i in part])
            low, high = np.searchsorted(token, wanted), np.searchsorted(token, wanted, side="right")
            times = high - low
            at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            pair = np.repeat(np.repeat(np.arange(len(part)), sizes[part]), times) * len(mine) + owner[at]
            common = np.bincount(pair, minlength=len(part) * len(mine)).reshape(len(part), len(mine))
            union = sizes[part][:, None] + sizes[mine][None, :] - common
            m, q = np.nonzero(100 * common >= percent * union)
            a.append(ids[part[m]])
            b.append(ids[mine[q]])
        a, b = np.concatenate(a), np.concatenate(b)
        low, high = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        return pa.table([pa.array(low), pa.array(high)], ["a", "b"])

    return links


class _Sets:
    """Shingle sets of the classes that are compared, read from the texts when first needed."""

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size, self.held = rows, size, None

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, shingles) of all classes asked for so far; ``ids``: column id."""
        ids = ids.select(F.col("id").alias("doc_id")).distinct()
        if self.held is not None:
            ids = ids.join(self.held.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
        ids = cut_lineage(ids)
        wanted = ids.count()
        if wanted:
            texts = self.rows.join(F.broadcast(ids) if wanted <= SENT_IDS else ids, "doc_id", "left_semi")
            new = cut_lineage(texts.mapInArrow(_set_rows(self.size), "id long, shingles binary"))
            self.held = new if self.held is None else self.held.unionByName(new)
        return self.held


def find_groups(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    trees: int = TREES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = id_and_text(docs, doc_id, text)
    sketched = cut_lineage(rows.mapInArrow(_sketcher(size, trees), SKETCH))
    classes = (
        sketched.where("n_shingles > 0 and doc_id is not null")
        .groupBy("key1", "key2")
        .agg(F.min("doc_id").alias("id"), F.any_value("sketch").alias("sketch"), F.any_value("nodes").alias("nodes"), F.any_value("n_shingles").alias("n"))
    )
    classes = cut_lineage(classes)
    labels = _connect(classes, _Sets(rows.dropna(subset=["doc_id"]), size), percent)
    placed = classes.join(labels, "id", "left").select("key1", "key2", F.coalesce("comp", "id").alias("found"))
    joined = sketched.join(placed, ["key1", "key2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("found"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of every group, with all its columns."""
    groups = find_groups(docs, size, percent, trees, doc_id, text)
    dropped = cut_lineage(groups.where("not kept").select(F.col("doc_id").alias("__id")).distinct())
    return docs.join(dropped, docs[doc_id] == dropped["__id"], "left_anti")


def _confirm_pairs(pairs: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Links among pairs (a, b)."""
    held = sets.of(pairs.select("a").union(pairs.select("b")).withColumnRenamed("a", "id"))
    if held is None:
        return pairs
    one = pairs.join(held.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(held.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return cut_lineage(both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), PAIR))


def _confirm_queries(asked: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Links between the queries and the members of a component (comp, id, query).

    A component's queries and members are dealt over a grid of cells, so that a large one is many tasks.
    """
    held = sets.of(asked.select("id"))
    if held is None:
        return asked.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    grid = asked.groupBy("comp").agg(
        F.ceil(F.sum("query") / QUERIES_PER_CELL).cast("int").alias("rows"), F.ceil(F.sum(1 - F.col("query")) / MEMBERS_PER_CELL).cast("int").alias("columns")
    )
    spot = F.xxhash64("id")
    own = F.col("query") == 1
    placed = asked.join(grid, "comp").select(
        "comp", "id", "query",
        F.explode(
            F.when(own, F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.struct(F.pmod(spot, F.col("rows")).cast("int").alias("r"), c.alias("c"))))
            .otherwise(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("r"), F.pmod(spot, F.col("columns")).cast("int").alias("c"))))
        ).alias("cell"),
    )
    rows = placed.join(held, "id").select("comp", "cell.r", "cell.c", "id", "query", "shingles")
    return cut_lineage(rows.groupBy("comp", "r", "c").applyInArrow(_cell_links(percent), PAIR))


def _connect(classes: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Component (id, comp) of every class that is linked with one of smaller id."""
    spark, least = classes.sparkSession, _least_equal(percent)
    labels = spark.createDataFrame([], "id long, comp long")
    tested = spark.createDataFrame([], PAIR)
    members = classes.select(F.explode("nodes").alias("node"), "id", "sketch", "n")
    first = True
    while True:
        # Rows of nodes that have more than one component, with the node's number of classes and of pairs left.
        known = members.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        sizes = known.groupBy("node", "comp").agg(F.count("*").cast("double").alias("k")).groupBy("node").agg(
            F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("squares")
        )
        sizes = sizes.where("size > 1 and size * size > squares")
        sizes = sizes.select("node", "size", ((F.col("size") * F.col("size") - F.col("squares")) / 2).alias("open_pairs"))
        live = cut_lineage(known.join(sizes, "node"))
        small = (F.col("size") <= SMALL_NODE) | ((F.col("size") <= WIDE_NODE) & (F.col("open_pairs") <= SMALL_NODE * F.col("size")))
        little = live.where(small).select("node", "id", "comp", "sketch", "n").repartition("node").sortWithinPartitions("node", "id")
        large = live.where(~small)
        pivots = large.groupBy("node").agg(F.min_by(F.struct("id", "sketch"), F.xxhash64("node", "id")).alias("p"))
        stars = large.join(pivots.select("node", F.col("p.id").alias("pivot"), F.col("p.sketch").alias("pivot_sketch")), "node")
        pairs = stars.where("id <> pivot").select("id", "sketch", "pivot", "pivot_sketch").mapInArrow(_star(least), PAIR)
        if first:
            pairs = pairs.unionByName(little.mapInArrow(_by_node(_forest, ["a", "b"], least, percent), PAIR))
        pairs = cut_lineage(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            labels = merge_components(labels, _confirm_pairs(pairs, sets, percent))
            tested = cut_lineage(tested.unionByName(pairs))
        if first:
            # The same nodes again, now that most of their classes are connected.  Of small nodes only the
            # classes matter that were like another one; ``_forest`` puts each of them in a tested pair.
            like = tested.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            again = live.where(small).join(like, "id", "left_semi").unionByName(live.where(~small), allowMissingColumns=True)
            members, first = again.select("node", "id", "sketch", "n"), False
            continue
        asked = little.mapInArrow(_by_node(_queries, ["comp", "id", "query"], least, percent), "comp long, id long, query long")
        asked = cut_lineage(asked.distinct())
        if not asked.isEmpty():
            labels = merge_components(labels, _confirm_queries(asked, sets, percent))
        below = large.select("node", "id", "sketch", "n").mapInArrow(_children, "node long, id long, sketch binary, n long")
        members = cut_lineage(below)
        if members.isEmpty():
            return labels

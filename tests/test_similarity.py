"""The similarity join against all pairs, with a token that nearly every set has."""

import random

import pytest
from pyspark.sql import functions as F

from offerloom.operators import similarity
from offerloom.operators.grid import dealt, grid_join


@pytest.mark.parametrize("per_task", [3, 10_000])
def test_equals_all_pairs(spark, monkeypatch, per_task):
    monkeypatch.setattr(similarity, "SETS_PER_TASK", per_task)
    dice = random.Random(1)
    rows = []
    for i in range(160):
        words = {w for w in "abcdefghij" if dice.random() < 0.3} | ({"hot"} if dice.random() < 0.9 else set())
        rows.append((f"s{i}", f"b{i % 2}", sorted(words), 0.6, i % 3 != 0, i % 3 != 1))
    sets = spark.createDataFrame(rows, "set_id string, block string, tokens array<string>, bound double, is_left boolean, is_right boolean")
    got = {(r["left_id"], r["right_id"]): r["score"] for r in similarity.similar_sets(sets).collect()}
    want = {}
    for a, block, x, bound, is_left, _ in rows:
        for b, other, y, _, _, is_right in rows:
            if block == other and is_left and is_right and x and y:
                score = int(len(set(x) & set(y)) / len(set(x) | set(y)) * 100 + 0.5) / 100
                if score >= bound:
                    want[a, b] = score
    assert got == want
    assert similarity.similar_sets(sets.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("cell", [7, 100, 100_000])
def test_grid_join(spark, cell):
    """One key has 90 % of the rows of both sides; null keys match, and every pair comes once."""
    left = [(i, "hot" if i % 10 else f"k{i % 30}", None if i % 4 else "x") for i in range(300)]
    right = [(i, "hot" if i % 10 else f"k{i % 50}", None if i % 3 else "x") for i in range(100)]
    a, b = spark.createDataFrame(left, "i int, k string, n string"), spark.createDataFrame(right, "j int, l string, m string")
    keys = [F.col("k"), F.col("n")], [F.col("l"), F.col("m")]
    got = [(r["i"], r["j"]) for r in grid_join(a, b, *keys, cell).collect()]
    assert sorted(got) == sorted((x[0], y[0]) for x in left for y in right if x[1:] == y[1:])
    one, other = dealt(a, b, *keys, cell)
    for side in (one, other):
        sizes = [r["count"] for r in side.groupBy("_g_key", "_g_row", "_g_column").count().collect()]
        assert max(sizes) <= max(3 * cell, 10)

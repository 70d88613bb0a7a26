from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cueline.operators.intervals import _own_levels, overlaps, usual_width


def spans(rng: random.Random, n: int) -> list[tuple]:
    """Points, short and very long spans, spans that end before they begin, nulls; a third of the rows at one place of one key."""
    out = []
    for i in range(n):
        low = 500 if rng.random() < 0.33 else rng.randrange(-1000, 2000)
        length = rng.choice([0, 0, 1, 5, rng.randrange(1, 40), rng.randrange(1, 3000), -3])
        key = "hot" if low == 500 else rng.choice(["a", "b", "hot", None])
        out.append((key, rng.choice([low] * 30 + [None]), low + length, i))
    return out


@pytest.mark.parametrize(("hot", "width"), [(20_000, None), (10, 7), (10, 100_000)])
def test_same_as_all_pairs(spark: SparkSession, hot: int, width: int | None) -> None:
    rng = random.Random(hot)
    left, right = spans(rng, 300), spans(rng, 350)
    a = spark.createDataFrame(left, "k string, low int, high int, i int").repartition(3)
    b = spark.createDataFrame(right, "k string, begin bigint, end bigint, j int").repartition(4)
    last = lambda low, high: max(low, high - 1)
    fits = lambda low, high: low is not None and high >= low
    for keys in (["k"], []):
        want = sorted(
            (x[3], y[3]) for x in left for y in right
            if fits(*x[1:3]) and fits(*y[1:3]) and x[1] <= last(*y[1:3]) and y[1] <= last(*x[1:3]) and (not keys or x[0] == y[0] is not None)
        )
        right_side = b if keys else b.withColumnRenamed("k", "k2")
        found = overlaps(a, right_side, ("low", "high"), ("begin", "end"), keys, width, hot)
        assert sorted(tuple(r) for r in found.select("i", "j").collect()) == want
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_points_and_no_rows(spark: SparkSession) -> None:
    points = spark.createDataFrame([(1, 10), (2, 19), (3, 20), (4, None)], "id int, t int")
    held = spark.createDataFrame([(10, 20, "x"), (20, 20, "y")], "low int, high int, name string")
    assert sorted(tuple(r) for r in overlaps(points, held, ("t", "t"), ("low", "high")).select("id", "name").collect()) == [(1, "x"), (2, "x"), (3, "y")]
    assert overlaps(points, held.limit(0), ("t", "t"), ("low", "high")).collect() == []
    assert usual_width(held.limit(0), "low", "high") == 1


def test_rows_go_only_to_levels_where_the_other_side_is(spark: SparkSession) -> None:
    levels = lambda own, others: spark.range(1).select(_own_levels(F.lit(own), others)).first()[0]
    assert levels(3, [0]) == [3]  # a span goes to no level but its own where the others are points
    assert levels(0, [0, 3, 9]) == [0, 3, 9]
    assert levels(6, [3, 6, 9]) == [6, 9]
    assert levels(3, []) == [3]


def test_sides_are_shuffled_once(spark: SparkSession) -> None:
    a = spark.createDataFrame([("k", i) for i in range(50)], "k string, at bigint").repartition(3)
    b = spark.createDataFrame([("k", i, i + 7) for i in range(50)], "k string, low bigint, high bigint").repartition(3)
    plan = overlaps(a, b, ("at", "at"), ("low", "high"), ["k"], 2)._jdf.queryExecution().executedPlan().toString()
    # Besides the two sides of the join, only counts and the bins that they name are exchanged; no join of the rows with counts is.
    assert plan.count("SortMergeJoin") <= 1

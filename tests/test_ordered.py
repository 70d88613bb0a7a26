from __future__ import annotations

import bisect
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.operators.ordered import as_of, in_order

SCHEMA = "item string, t bigint, id bigint, value bigint, mark boolean, Place string, _part string"


def rows_of(rng: random.Random, n: int, hot: float = 0.34) -> list[tuple]:
    """One item holds a third of the rows; times tie; items and values may be null."""
    out = []
    for i in range(n):
        item = "hot" if rng.random() < hot else rng.choice([None, *"abcdefgh"])
        out.append((item, rng.randrange(n // 4 + 1), i, rng.choice([None, *range(-5, 50)]), rng.choice([True, False, False, None]), "x", "y"))
    return out


def wanted(rows: list[tuple]) -> set[tuple]:
    items: dict[str | None, list[tuple]] = {}
    for r in rows:
        items.setdefault(r[0], []).append(r)
    out = set()
    for own in items.values():
        own.sort(key=lambda r: (r[1], r[2]))
        total, kept = 0, None
        for k, r in enumerate(own):
            kept = r[2] if r[4] else kept
            out.add((r[2], k, total, own[k + 1][1] if k + 1 < len(own) else None, kept))
            total += r[3] or 0
    return out


def found(df: DataFrame) -> set[tuple]:
    placed = in_order(df, "item", ["t", "id"], "nth", {"before": "value"}, {"next_t": "t"}, {"kept": "id"}, "mark")
    assert placed.columns == [*df.columns, "nth", "before", "next_t", "kept"]
    return {tuple(r) for r in placed.select("id", "nth", "before", "next_t", "kept").collect()}


def test_places_sums_next_and_last(spark: SparkSession) -> None:
    for seed, n, parts in ((1, 3000, 7), (2, 40, 13), (3, 1, 1)):
        rows = rows_of(random.Random(seed), n)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == wanted(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_small_batches_and_one_item(spark: SparkSession) -> None:
    """Batches of two rows, all rows of one item: every batch and partition goes on from the one before."""
    rows = rows_of(random.Random(4), 500, hot=1.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == wanted(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_item_is_dealt_to_several_tasks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("item"), "id")
        placed = in_order(df, "item", ["id"], "nth")
        assert placed.filter("item = 'hot' AND nth = id DIV 3").count() == 13_334
        assert "windowspecdefinition(item" not in placed._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark: SparkSession) -> None:
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_as_of(spark: SparkSession) -> None:
    rng = random.Random(6)
    left = [(rng.choice([None, "hot", "hot", "a", "b"]), rng.choice([None, *range(300)]), i, "l") for i in range(700)]
    right = [(rng.choice([None, "hot", "hot", "a", "c"]), rng.choice([None, *range(300)]), i, rng.choice([None, *"xyz"])) for i in range(400)]
    a = spark.createDataFrame(left, "item string, t int, id int, v string").repartition(3)
    b = spark.createDataFrame(right, "item string, t int, no int, w string").repartition(5)
    times: dict[str, list[tuple]] = {}
    for item, t, no, w in right:
        if item is not None and t is not None:
            times.setdefault(item, []).append((t, no, w))
    for own in times.values():
        own.sort(key=lambda r: r[:2])
    for earlier, tolerance in ((False, None), (True, None), (False, 4), (True, 2)):
        want = set()
        for item, t, i, v in left:
            own, hit = times.get(item, []), (None, None, None)
            if t is not None and own:
                k = bisect.bisect_left(own, (t, -1)) if earlier else bisect.bisect_right(own, (t, 1 << 40))
                if k and (tolerance is None or own[k - 1][0] >= t - tolerance):
                    hit = own[k - 1]
            want.add((item, t, i, v, *hit))
        got = as_of(a, b, "item", "t", ["no", "w"], ["no"], None if tolerance is None else F.lit(tolerance), earlier, "since")
        assert got.columns == ["item", "t", "id", "v", "since", "no", "w"]
        assert {tuple(r) for r in got.collect()} == want

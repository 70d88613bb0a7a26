from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cueline.operators.sessions import session_summary, sessions
from cueline.streaming.changes import milliseconds, versions
from cueline.streaming.sessions import arriving_sessions

T0 = datetime(2024, 1, 1)


def drained(spark, schema, source, out, point, build, batches):
    """Runs the stream over each batch of rows in turn, from its checkpoint each time, and returns what came out."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        build(stream).writeStream.format("parquet").option("checkpointLocation", point).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).collect()


def test_versions_of_files(spark, tmp_path):
    """Late, repeated and changed files, and one that comes again after its state was dropped."""
    minute = lambda n: T0 + timedelta(minutes=n)
    batches = [
        [("a", minute(0), "one"), ("a", minute(1), "two"), ("b", minute(1), "x"), ("b", minute(1), "x"), (None, minute(1), "x"), ("n", minute(1), None)],
        [("a", minute(1), "two"), ("a", minute(0), "one"), ("b", minute(5), "x"), ("b", minute(6), "y")],
        [("c", minute(600), "later")],
        [("d", minute(610), "later"), ("a", minute(605), "two"), ("b", minute(2), "behind the watermark")],
        [("d", minute(620), "later")],
    ]
    paths = [str(tmp_path / x) for x in ("in", "out", "point")]
    found = drained(spark, "item_id string, changed timestamp, content string", *paths, lambda df: versions(df, "10 minutes", "2 hours"), batches)
    assert sorted((r["item_id"], r["version"], r["content"]) for r in found) == [
        ("a", 1, "one"), ("a", 1, "two"), ("a", 2, "two"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "later"), ("d", 1, "later"), ("n", 1, ""),
    ]
    assert milliseconds("2 hours") == 7_200_000


def test_a_late_event_joins_two_sessions(spark, tmp_path):
    second = lambda n: T0 + timedelta(seconds=n)
    batches = [[("u", second(0)), ("u", second(50)), ("v", second(10))], [("u", second(25)), ("v", second(45))], [("w", second(1000))], [("u", second(30)), ("w", second(1010))], [("w", second(2000))]]
    paths = [str(tmp_path / x) for x in ("in", "out", "point")]
    found = drained(spark, "user string, at timestamp", *paths, lambda df: arriving_sessions(df, "user", "at", "30 seconds", "100 seconds"), batches)
    got = {(r["user"], r["begins"], r["n"]) for r in found}
    assert got == {("u", second(0), 3), ("v", second(10), 1), ("v", second(45), 1), ("w", second(1000), 2)}
    # The same sessions in batch, of the rows that were not behind the watermark.
    rows = [r for b in batches[:2] for r in b] + [("w", second(1000)), ("w", second(1010))]
    df = spark.createDataFrame(rows, "user string, at timestamp").withColumn("t", F.unix_seconds("at"))
    assert {(r["user"], r["begins"], r["n"]) for r in session_summary(sessions(df, "user", "t", 30), "user", "t").collect()} == {(u, int((t - T0).total_seconds()) + 1704067200, n) for u, t, n in got}

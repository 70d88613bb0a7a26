from __future__ import annotations

from pyspark.sql import SparkSession

from cueline.operators import media


def test_only_absent_outputs_go_on_from_the_join(spark: SparkSession) -> None:
    plan = spark.createDataFrame(
        [("d", "a.mp4", "a_01.mp3", 2), ("d", "a.mp4", "a_02.mp3", 2), ("d", "b.mp4", "b_01.mp3", 2), ("d", "b.mp4", "b_02.mp3", 2), ("e", "b.mp4", "b.mp3", 1), ("d", "c.mp3", "c.mp3", 1), (None, "f.mp4", "f.mp3", 1), ("d", None, "g.mp3", 1)],
        "dir string, source string, output string, n_chunks bigint",
    )
    there = spark.createDataFrame([("d", "a_01.mp3")] * 3 + [("d", "a_02.mp3"), ("d", "b_02.mp3"), ("d", "b.mp3"), (None, "f.mp3"), ("d", "g.mp3")], "dir string, name string")
    found = media.extract_status(plan, there)
    want = {("d", "a.mp4", "skipped", 2), ("d", "b.mp4", "run", 2), ("e", "b.mp4", "run", 1), ("d", "c.mp3", "skipped", 1), (None, "f.mp4", "run", 1), ("d", None, "skipped", 1)}
    assert {tuple(r) for r in found.collect()} == want and found.columns == ["dir", "source", "status", "n_outputs"]
    again = {tuple(r) for r in media.extract_status(plan, there, overwrite=True).collect()}
    assert {r for r in again if r[2] == "skipped"} == {("d", "c.mp3", "skipped", 1)} and len(again) == len(want)
    assert "LeftAnti" in found._jdf.queryExecution().executedPlan().toString()

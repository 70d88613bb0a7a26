from __future__ import annotations

from pyspark.sql import functions as F

from cueline.streaming import arrivals


def test_each_file_is_read_once(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    (src / "a.lrc").write_text("[00:01.00]a|||b\n[00:02.00]c|||d\n")
    arrivals.retime_arrivals(spark, str(src), out, state).awaitTermination()
    (src / "b.lrc").write_text("[00:05.00]e|||f\n")
    (src / "note.txt").write_text("[00:05.00]e|||f\n")
    arrivals.retime_arrivals(spark, str(src), out, state, variant="progressive").awaitTermination()
    lines = sorted((r["item_id"].rsplit("/", 1)[1], r["idx"], r["pass"], r["line"]) for r in spark.read.parquet(out).collect())
    assert [x[:3] for x in lines] == [("a.lrc", 0, 0), ("a.lrc", 1, 0), ("b.lrc", 0, 0), ("b.lrc", 0, 1)]
    assert lines[1][3] == "[00:03.30]c|||d"


def test_lengths_of_real_clips(spark):
    files = spark.createDataFrame([("a.lrc", "[00:01.00]a|||b\n[00:02.00]c|||d\n")], "item_id string, content string")
    found = arrivals.retimed(files, lengths=lambda s: s.withColumns({"target_ms": F.lit(1000), "native_ms": F.lit(500)}))
    assert [r["line"] for r in found.orderBy("idx").collect()] == ["[00:00.00]a|||b", "[00:05.00]c|||d"]

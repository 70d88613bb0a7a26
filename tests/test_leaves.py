from __future__ import annotations

from pyspark.sql import SparkSession

from cueline.operators import control


def test_leaves_are_passed_on_as_they_are_found(spark: SparkSession, monkeypatch) -> None:
    """Rows leave the workers in batches of leaves; no document's leaves come as one value."""
    monkeypatch.setattr(control, "LEAVES", 3)
    texts = [(1, "One. Two, three four! " * 40), (2, None), (3, ""), (4, "x" * 300), (5, "short"), (6, "a, b; " * 30)]
    found = control.split_levels(spark.createDataFrame(texts, "doc bigint, text string"), 10, "doc")
    want = sorted((d, list(path), len(path) - 1, piece, rejected) for d, t in texts if t is not None for path, piece, rejected in control.leaves(t, 10))
    assert sorted((r["doc"], r["path"], r["depth"], r["piece"], r["rejected"]) for r in found.collect()) == want
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()

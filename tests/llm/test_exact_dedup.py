from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cases import CLASHING, documents
from cueline.llm.exact_dedup import exact_dedup, exact_groups


@pytest.mark.parametrize("digest", [None, lambda t: F.length(t).cast("string"), lambda t: F.lit("same")])
def test_groups_match_brute_force(spark, digest):
    df = documents(spark)
    options = {} if digest is None else {"digest": digest}
    groups = defaultdict(list)
    for r in df.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    found = exact_groups(df, **options)
    assert found.columns == [*(c for c in df.columns if c != "kept"), "keep_id", "group_size", "kept", "text_sha256"]
    rows = found.collect()
    assert len(rows) == df.count()
    for r in rows:
        own = groups[r["text"] or ""]
        keep = max((i for i in own if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


@pytest.mark.parametrize("digest", [None, lambda t: F.length(t).cast("string")])
def test_one_row_of_each_text_stays(spark, digest):
    df = documents(spark)
    kept = exact_dedup(df, **({} if digest is None else {"digest": digest}))
    assert kept.columns == df.columns
    rows = kept.collect()
    want = {}
    for r in df.collect():
        t = r["text"] or ""
        want[t] = max(want.get(t, -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert Counter((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in rows) == Counter(want.items())
    assert all(r["node"] == f"node{r['doc_id']}" and r["Row"] == f"Row{r['doc_id']}" for r in rows if r["doc_id"] is not None)


def test_empty(spark):
    df = documents(spark).limit(0)
    assert exact_groups(df).count() == 0 and exact_dedup(df).count() == 0
    assert set(CLASHING) <= set(exact_dedup(df).columns)


def test_rows_of_one_id_and_text_that_differ_elsewhere(spark):
    """Which one stays depends on the rows, not on where they are."""
    rows = [(7, "same", lang, k) for k, lang in enumerate(["en", "de", None, "fr", "en"])] + [(3, "same", "es", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars int")
    found = {tuple(exact_dedup(df.repartition(k, "n_chars")).collect()) for k in (1, 2, 3, 5)}
    assert len(found) == 1 and len(next(iter(found))) == 1 and next(iter(found))[0]["doc_id"] == 7

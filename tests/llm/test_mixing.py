from __future__ import annotations

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cases import documents
from cueline.llm.mixing import mix_sources, mixture, numbered


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes, weights, share, epochs):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, closed = share * sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(closed.values()), [s for s in order if s not in closed]
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > epochs * sizes[s]]
        if not over:
            return closed | {s: level * w[s] for s in open_}
        closed |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize(("weights", "share", "epochs"), [((5, 2, 1), 1.5, 2.0), ((1, 9), 0.5, 3.0), ((1,), 5.0, 2.0)])
def test_targets_and_cuts(spark, weights, share, epochs):
    df = documents(spark)
    rows = mix_sources(df, weights=weights, share=share, epochs=epochs, slice_rows=30).collect()
    assert len(rows) == df.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == size(r["text"]) and 0 <= r["taken"] <= math.ceil(epochs) * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = shares(dict(sizes), weights, share, epochs)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert taken[s] == math.floor(want[s] + 1e-9)
    again = mix_sources(df.repartition(3), weights=weights, share=share, epochs=epochs, slice_rows=30).collect()
    key = lambda r: repr((r["doc_id"], r["text"], r["taken"], r["target"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixture_repeats_documents(spark):
    df = documents(spark)
    takes = mixture(df).collect()
    want = {repr((r["doc_id"], r["text"])): r["taken"] for r in mix_sources(df).dropDuplicates(["doc_id", "text"]).collect()}
    by = defaultdict(list)
    for r in takes:
        by[repr((r["doc_id"], r["text"]))].append(r)
        assert r["text"] is not None and 0 < r["words"] <= size(r["text"])
    for k, own in by.items():
        if len({r["epoch"] for r in own}) == len(own):
            assert sum(r["words"] for r in own) == want[k]
            assert sorted(r["epoch"] for r in own) == list(range(len(own)))


def test_texts_of_the_mix_follow_its_words(spark):
    """On the cut, ``cut_text`` holds the words taken and no more, with their blanks; so a source's texts have its target's words."""
    rows = [(i, "\n  a\tb \v c\r\nd " + " é" * (i % 5) + "\x0b", f"s{i % 2}") for i in range(11)] + [(20, " x " * 60, "s2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("cut_text", F.lit("old"))
    takes = mixture(df, weights=(3, 2, 1), share=0.5).collect()
    cut = [r for r in takes if r["cut_text"] is not None]
    assert len(cut) > 1 and any(r["source"] == "s2" for r in cut)
    words = defaultdict(int)
    for r in takes:
        text = r["text"] if r["cut_text"] is None else r["cut_text"]
        assert size(text) == r["words"] and r["text"].startswith(text) and (r["cut_text"] is not None) == (r["words"] < r["size"])
        words[r["source"]] += size(text)
    assert words == {r["source"]: math.floor(r["target"] + 1e-9) for r in takes}


def test_numbered(spark):
    df = spark.createDataFrame([(f"{(i * 7919) % 1000:04d}",) for i in range(1000)], "s string").repartition(7)
    rows = numbered(df, [F.col("s").asc()], "at").orderBy("s").collect()
    assert [r["at"] for r in rows] == list(range(1000)) and rows[0].asDict().keys() == {"s", "at"}


def test_empty(spark):
    df = documents(spark)
    assert mix_sources(df.limit(0)).count() == 0
    rows = mix_sources(df.filter("text IS NULL")).collect()
    assert rows and all((r["size"], r["target"], r["taken"]) == (0, 0.0, 0) for r in rows)

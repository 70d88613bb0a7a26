from __future__ import annotations

import random
import re

import pytest

from cases import documents, lower, prose
from cueline.llm.decontaminate import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def setting(spark):
    rng = random.Random(9)
    items = [prose(rng, "en", n) for n in (30, 12, 10, 25)]
    df = documents(spark)
    planted = [
        (1001, f"Some words. {items[0].upper()}\n and more words here"),
        (1002, "x, " + ",; ".join(items[1].split()[1:11]) + " y"),
        (1003, " ".join(items[2].split()[:9])),
        (1004, items[3] + " " + items[3]),
        (1005, "é The tiny one, é again: tiny-one!"),
        (1006, f"{prose(rng, 'en', 6000)} {items[1]} {prose(rng, 'en', 6000)} {items[3]}; tiny, one"),
    ]
    cells = ", ".join(f"NULL AS {c}" if c not in ("doc_id", "text") else c for c in df.columns)
    df = df.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string").selectExpr(*cells.split(", ")).selectExpr(*(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in df.schema)))
    bench = [(i, t) for i, t in enumerate(items)] + [(7, "Tiny one"), (8, None), (9, "?!"), (0, items[0]), (None, items[3])]
    return df, spark.createDataFrame(bench, "item_id bigint, text string"), bench


def brute(text, bench):
    words = WORD.findall(lower(text))
    hit, items = set(), set()
    at = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    for item, t in bench:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for i in at.get(w[k], []):
                if words[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    items.add("" if item is None else str(item))
    return len(words), len(hit), sorted(items)


@pytest.mark.parametrize("block_chars", [1 << 20, 120])
def test_matches_brute_force(spark, block_chars):
    df, bench_df, bench = setting(spark)
    rows = contamination(df, bench_df, block_chars=block_chars).collect()
    assert len(rows) == df.count() and any(r["contaminated"] for r in rows)
    for r in rows:
        n, hit, items = brute(r["text"], bench)
        assert (r["n_words"], r["n_hit"], r["items"], r["n_items"], r["contaminated"]) == (n, hit, items, len(items), hit > 0)
        for s in r["spans"]:
            inside = WORD.findall(lower(r["text"][s["start"] : s["end"]]))
            assert inside == WORD.findall(lower(r["text"]))[s["first"] : s["last"] + 1]


def test_clean_documents_stay(spark):
    df, bench_df, bench = setting(spark)
    kept = decontaminate(df, bench_df)
    assert kept.columns == df.columns
    gone = {r["doc_id"] for r in df.collect()} - {r["doc_id"] for r in kept.collect()}
    assert gone == {1001, 1002, 1004, 1005, 1006}


def test_empty(spark):
    df, bench_df, _ = setting(spark)
    assert contamination(df.limit(0), bench_df).count() == 0
    assert not any(r["contaminated"] for r in contamination(df, bench_df.limit(0)).collect())


def test_words_that_only_share_a_hash_are_no_match(monkeypatch):
    """A match is of the words themselves, and of one text."""
    import numpy as np
    import pyarrow as pa

    from cueline.llm import decontaminate as module

    data, offsets = module.utf8_view(pa.array(["a b c", "x b c d", "b", "c d b c"]))
    built = module._automaton([("1", "b c"), ("2", "b c"), ("3", "c d")], 2)
    count, hits = module._matches(data, offsets, built)
    assert count.tolist() == [3, 4, 1, 4]
    assert {d: ([(s["first"], s["last"]) for s in spans], items) for d, (spans, items) in hits.items()} == {0: ([(1, 2)], {"1", "2"}), 1: ([(1, 3)], {"1", "2", "3"}), 3: ([(0, 3)], {"1", "2", "3"})}
    # "q" gets the hash of "b".
    real, q, b = module.word_hashes, module._hashed(["q"])[0], module._hashed(["b"])[0]
    monkeypatch.setattr(module, "word_hashes", lambda *x: np.where(real(*x) == q, b, real(*x)))
    assert module._matches(*module.utf8_view(pa.array(["q c", "b c"])), built)[1].keys() == {1}


def test_long_text(spark):
    rng = random.Random(4)
    item = prose(rng, "en", 40)
    long = prose(rng, "de", 300_000) + " " + item
    df = spark.createDataFrame([(1, long), (2, item)], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in contamination(df, spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()}
    assert found == {1: (len(WORD.findall(lower(long))), len(WORD.findall(lower(item)))), 2: (len(WORD.findall(lower(item))),) * 2}

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from cases import WORDS, documents, lower
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm import phrases
from cueline.llm.phrases import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows: list[tuple[str | None, str | None]], least: int, share: int, best: int) -> set[tuple]:
    """Every phrase counted and every cut scored, one by one."""
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        found = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\n\v\f\r]", lower(text)):
            words = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                found.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out: set[tuple] = set()
    for lang, f in counts.items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        candidates = [w for w, c in f.items() if len(w) > 1 and c >= least]
        scored = []
        for w in candidates:
            inside = any(len(x) > len(w) and w in (x[:2], x[1:]) and 100 * f[x] >= share * f[w] for x in candidates)
            if not inside:
                cuts = [(1_000_000 * f[w] ** 2 // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                scored.append((-score, -f[w], " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def rows_of(df: DataFrame) -> list[tuple[str | None, str | None]]:
    return [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]


@pytest.mark.parametrize("most", [1 << 22, 30, 0])
def test_same_as_plain_counts(spark: SparkSession, most: int) -> None:
    """With both tables, with that of the words only, and with none."""
    docs = documents(spark)
    found = collocations(docs, least=4, best=300, most=most)
    assert found.columns == COLUMNS
    assert {tuple(r) for r in found.collect()} == plain(rows_of(docs), 4, 50, 300)


def test_ties_overlaps_and_hot_phrases(spark: SparkSession) -> None:
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS["de"][:6]) for _ in range(rng.randrange(1, 40))) + rng.choice(".,;\n\t ") for _ in range(300)]
    texts += ["Aa aa AA aa aa"] * 7 + ["x y, x y; x\ty  x y"] * 5 + ["a same line of words"] * 200 + ["b\u0085c b\u0085c"] * 12 + ["..", " ", None, "z" * 200_000 + " tail " * 40]
    rows = [(t, rng.choice(["de", "", None])) for t in texts]
    docs = spark.createDataFrame([(None, *r, "c") for r in rows], "lang2 string, text string, lang string, n string")
    assert {tuple(r) for r in collocations(docs, best=40).collect()} == plain(rows, 10, 50, 40)


def test_products_beyond_64_bits(spark: SparkSession) -> None:
    big = 3_000_000_000_000
    row = spark.range(1).select(phrases._score(F.lit(big), F.lit(big + 1), F.lit(2 * big)).alias("score")).first()
    assert row["score"] == 1_000_000 * big * big // ((big + 1) * 2 * big)


def test_no_rows_and_no_words(spark: SparkSession) -> None:
    schema = "text string, lang string"
    for rows in ([], [(None, None), ("", "en"), (" .\t", "en")]):
        found = collocations(spark.createDataFrame(rows, schema))
        assert found.columns == COLUMNS and not found.collect()

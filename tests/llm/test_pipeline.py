"""The pipeline's stages and queries on tables of the driver's form."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from cases import prose
from cueline.llm import queries
from test_decontaminate import brute as leaks
from test_near_dedup import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    path = str(tmp_path_factory.mktemp("sf"))
    items = [prose(rng, "en", 40), prose(rng, "de", 8)]
    texts = [prose(rng, ("en", "de", "fr")[i % 3], rng.randrange(30, 80)) for i in range(240)]
    texts += [texts[0], texts[0], texts[1], texts[2] + " end", texts[3] + f"\n{items[0]}", texts[4] + f" {items[1]} ", None, "", "!!", "1 2 3"]
    rows = [(i, t, ("en", "de", "fr")[i % 3], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, list(enumerate(items))


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, path))
        assert docs.columns == columns if k < 4 else set(columns) < set(docs.columns)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    lettered = {i: t for i, t, *_ in rows if re.search("[a-z]", t or "")}
    assert kept["language_id"] == lettered
    last = {t: i for i, t in sorted(lettered.items())}
    assert kept["exact_dedup"] == {i: t for t, i in last.items()}
    before = sorted(kept["exact_dedup"].items())
    near = {d: t for (d, t), (_, c) in zip(before, brute_components(before), strict=True) if d == c}
    assert kept["near_dedup"] == near and len(near) < len(before)
    clean = {d: t for d, t in near.items() if not leaks(t, items)[1]}
    assert kept["decontaminate"] == clean and len(clean) < len(near)
    words = {d: len(t.split()) for d, t in clean.items()}
    assert abs(sum(r["words"] for r in docs.collect()) - 1.5 * sum(words.values())) < 4


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() > 0 and {"epoch", "words", "target"} <= set(out.columns)


def test_registered():
    named = __spark_entry__.queries()
    assert "pipeline" in named and sorted(n.split("_")[0] for n in named if re.match(r"op\d+_", n)) == sorted(f"op{k}" for k in range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(columns)
    got = sorted((tuple(value(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(value(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)

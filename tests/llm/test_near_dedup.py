from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from cases import changed, documents, lower, prose
from cueline.llm.graph import components, stars
from cueline.llm.hashing import BLANKS, byte_classes, shingle_hashes, word_bounds, word_hashes
from cueline.llm.near_dedup import MARGIN, near_dedup, near_groups
from cueline.llm.setsketch import M, band_keys, jaccard, merge, registers


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    """Least id reachable of each row's place in ``rows``, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(len(s), least[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def check(spark, df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = sorted(((d, t, *w) for (d, t), w in zip(rows, brute_components(rows), strict=True)), key=repr)
    found = near_groups(df, **options)
    got = sorted(((r["doc_id"], r["text"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr)
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_matches_brute_force(spark):
    check(spark, documents(spark))


@pytest.mark.parametrize("block", [16, 1024])
def test_group_of_near_copies_that_no_star_settles(spark, block):
    """Copies of copies: many that share a bucket with the least one are linked to others only."""
    rng = random.Random(5)
    texts = [prose(rng, "en", 80)]
    for _ in range(150):
        texts.append(changed(rng, rng.choice(texts[-12:]), rng.randrange(1, 4)))
    rng.shuffle(texts)
    check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4), block=block)


def test_one_of_each_group_stays(spark):
    df = documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    kept = near_dedup(df)
    assert kept.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = {d for (d, _), (_, c) in zip(rows, brute_components(rows), strict=True) if d == c}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_empty(spark):
    df = documents(spark)
    assert near_groups(df.limit(0)).count() == 0
    assert near_groups(df.filter("text IS NULL")).count() == df.filter("text IS NULL").count()


def test_shingle_hashes_follow_the_words():
    texts = ["a b c d e f", "A  B\tc\nd e f", "x", "", "a b c d e", "é à ü ö ß", "aa b", "a ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    low, apart = byte_classes(BLANKS)
    starts, ends, first = word_bounds(low[data], offsets, apart)
    hashes, at = shingle_hashes(word_hashes(low[data], starts, ends), first, 5)
    sets = [set(hashes[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        assert len(sets[i] & sets[j]) == len(shingles(a) & shingles(b))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def test_registers_are_mergeable_and_estimate():
    rng = np.random.default_rng(3)
    for n, share in ((3, 1 / 3), (40, 0.5), (500, 0.75), (5000, 0.9)):
        pool = rng.integers(0, 1 << 63, 2 * n, np.uint64)
        common = int(n * 2 * share / (1 + share))
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 2 * n, np.uint64)
            a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
            one = lambda x: registers(x, np.array([0, len(x)]))
            assert (merge(one(a), one(b)) == one(np.union1d(a, b))).all()
            exact = common / (2 * n - common)
            errors.append(jaccard(one(a), one(b), np.array([float(n)]), np.array([float(n)]))[0] - exact)
        assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 2 / np.sqrt(M)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (7, 3)] + [(500, k) for k in range(501, 540)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {200: 100} | {k: 500 for k in range(501, 540)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def least_of_each(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in list(root) if find(x) != x}


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range((60, 150, 250, 400)[seed])] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, k) for k in range(4000, 4300)]
    rng.shuffle(links)
    want = least_of_each(links)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    a, b = np.array(links).T
    assert dict(zip(*(x.tolist() for x in stars(a, b)), strict=True)) == want


@pytest.mark.parametrize(("n_a", "n_b", "common"), [(3, 4, 3), (7, 7, 6), (12, 16, 12), (35, 35, 30)])
def test_bands_recall_sets_at_the_threshold(n_a, n_b, common):
    """Of pairs of similarity 0.75 hardly any shares no band, and no estimate falls so low that a pair would not be verified."""
    rng = np.random.default_rng(n_a)
    k = 20_000
    pool = rng.integers(0, 1 << 63, (k, n_a + n_b - common), np.uint64)
    a, b = pool[:, :n_a], np.concatenate([pool[:, :common], pool[:, n_a:]], axis=1)
    regs_a, regs_b = registers(a.ravel(), np.arange(k + 1) * n_a), registers(b.ravel(), np.arange(k + 1) * n_b)
    assert (~(band_keys(regs_a) == band_keys(regs_b)).any(axis=1)).sum() <= 2
    assert jaccard(regs_a, regs_b, np.full(k, float(n_a)), np.full(k, float(n_b))).min() > 0.75 - MARGIN


def test_rows_of_one_id_and_different_texts(spark):
    """Each row is judged by its own text; a null id is larger than any other."""
    rng = random.Random(11)
    own = [prose(rng, "en", 80) for _ in range(3)]
    near = [t + " and more" for t in own]
    rows = [(1, own[0]), (1, own[1]), (2, near[1]), (None, own[2]), (None, near[0]), (3, near[2]), (None, "alone"), (None, "apart")]
    found = near_groups(spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string")).collect()
    want = {(1, own[0]): 1, (1, own[1]): 1, (2, near[1]): 1, (None, own[2]): 3, (None, near[0]): 1, (3, near[2]): 3, (None, "alone"): None, (None, "apart"): None}
    assert len(found) == 9 and {(r["doc_id"], r["text"]): r["component_id"] for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)

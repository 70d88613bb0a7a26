from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from cases import changed, documents, prose
from pyspark.sql import DataFrame, SparkSession
from test_near_dedup import shingles

from cueline.llm import set_join
from cueline.llm.set_join import jaccard_groups, most_apart, schemes_of, segments_of


def linked(rows: list[tuple[int | None, str | None]], percent: int) -> list[tuple[int, int | None]]:
    """Set size and least reachable id of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        low, high = sorted((len(sets[i]), len(sets[j])))
        if low and 100 * low >= percent * high:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (low + high - both):
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        k = find(i)
        least[k] = doc if least.get(k) is None else min(x for x in (doc, least[k]) if x is not None) if doc is not None else least[k]
    return [(len(s), least[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def check(df: DataFrame, percent: int = 80, **options: int) -> None:
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = sorted(((*r, *w) for r, w in zip(rows, linked(rows, percent), strict=True)), key=repr)
    found = jaccard_groups(df, percent=percent, **options)
    assert found.columns == [*df.columns, "n_shingles", "component_id"]
    assert sorted(((r["doc_id"], r["text"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == want


def drifting(rng: random.Random, n: int, words: int, steps: int) -> list[str]:
    """Copies of copies: similarities to one text spread on both sides of the threshold."""
    texts = [prose(rng, "en", words)]
    for _ in range(n):
        texts.append(changed(rng, rng.choice(texts[-steps:] if rng.random() < 0.5 else texts[:3]), rng.randrange(0, 5)))
    return texts


def test_matches_brute_force(spark: SparkSession) -> None:
    check(documents(spark))


@pytest.mark.parametrize(("costly", "block", "held"), [(0, 4, 50), (2, 512, 1 << 20), (1 << 30, 16, 1 << 20)])
def test_groups_about_the_threshold(spark: SparkSession, costly: int, block: int, held: int) -> None:
    """All tokens cost too much, or some, or none do."""
    rng = random.Random(costly)
    texts = drifting(rng, 130, 90, 8) + drifting(rng, 60, 40, 20) + drifting(rng, 40, 300, 4)
    passage = prose(rng, "de", 40)
    texts += [f"{prose(rng, 'fr', rng.randrange(5, 60))} {passage} {prose(rng, 'fr', 20)}" for _ in range(60)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(4, 12))) for _ in range(120)]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), costly=costly, block=block, held=held)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_small_sets_and_other_similarities(spark: SparkSession, percent: int) -> None:
    """Sets of a few elements, where subsets are empty and bands are narrow."""
    rng = random.Random(percent)
    texts = [" ".join(rng.sample("abcdefghij", 10)[: rng.randrange(4, 10)]) for _ in range(80)]
    for _ in range(160):
        words = rng.choice(texts).split()
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(rng.choice([[*words, rng.choice("abxyz")], [rng.choice("xyz"), *words], words[1:], words[:at] + ["q"] + words[at:], words * 2])))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), percent=percent, costly=1, held=100)


def test_long_texts_and_hot_copies(spark: SparkSession) -> None:
    rng = random.Random(9)
    long = prose(rng, "en", 30_000)
    texts = [long, changed(rng, long, 300), changed(rng, long, 3000), long + " more words at the end"] + [prose(rng, "fr", 30)] * 300 + [None, "", "one"] * 20
    check(spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, token string").repartition(8))


def test_partners_share_a_scheme_and_never_differ_in_all_segments() -> None:
    for percent in (50, 80, 95):
        for a in [*range(1, 300), 1000, 5003, 20_011]:
            for b in {a, a + 1, (a + 100 * a // percent) // 2, 100 * a // percent}:
                most = most_apart(a, b, percent)
                if a <= b and 100 * a >= percent * b and most:
                    of_a, of_b = ({s: (m, h) for s, m, h in schemes_of(x, percent)} for x in (a, b))
                    scheme = set_join._band(a)
                    assert of_a[scheme][1] >= most and of_b[scheme][1] >= most
                    assert of_a[scheme][0] == of_b[scheme][0] == segments_of(scheme, percent) > most


def test_subsets_of_a_set_and_of_one_less() -> None:
    elements = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2))
    segment, starts, sums = set_join._subsets(elements, 40)
    gone = int(starts[3])
    other, _, less = set_join._subsets(np.delete(elements, gone), 40)
    same = dict(zip(other.tolist(), less.tolist(), strict=True))
    assert sum(same.get(s) != x for s, x in zip(segment.tolist(), sums.tolist(), strict=True)) == 1


def test_empty_table(spark: SparkSession) -> None:
    assert not jaccard_groups(spark.createDataFrame([], "doc_id bigint, text string")).collect()


def test_pairs_of_many_common_tokens_are_told_once(spark: SparkSession) -> None:
    """Each meeting is a batch of its own here, so nothing else drops a pair's other meetings."""
    bits = np.full(set_join.BITS // 64, 5, np.uint64).tobytes()
    nodes = spark.createDataFrame([(n, n, 1, 2, bytearray(bits)) for n in range(4)], "node long, root long, n_root long, n_shingles long, bitmap binary")
    own = {0: range(0, 60), 1: range(0, 60), 2: range(55, 90), 3: range(200, 203)}
    rows = spark.createDataFrame([(t * 64 - 3000, n) for n, tokens in own.items() for t in tokens], "token long, node long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = [tuple(r)[:2] for r in set_join._meetings(rows, rows, nodes, 80, 512).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(found) == {(0, 1), (0, 2), (1, 2)}
    # Set 1 only looks where 2 is. The five tokens of 2 that 0 has are not among the least eight of 0: no row can tell, so all five stand.
    assert (found.count((0, 1)), found.count((1, 2)), found.count((0, 2))) == (1, 1, 5)

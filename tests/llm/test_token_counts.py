from __future__ import annotations

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from cases import documents
from cueline.llm import token_counts as module
from cueline.llm.token_counts import BELOW, MARK, Trie, Vocabulary, count_by_source, fit_scores, forward_counts, piece_scores, pretoken_counts, scores_for, token_counts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCORES = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.6, "ab": -4.0, "▁ab": -4.1, "abc": -5.0, "c": -3.0, "ca": -4.5, "é": -6.0}


def best(word, scores):
    """The count of the best segmentation, by trying all of them."""
    least = min(scores.values()) - BELOW

    def ways(rest):
        if not rest:
            yield 0.0, 0
            return
        n = len(rest[0].encode())
        for score, tokens in ways(rest[1:]):
            yield score + least * n, tokens - n
        for end in range(1, len(rest) + 1):
            if rest[:end] in scores:
                for score, tokens in ways(rest[end:]):
                    yield score + scores[rest[:end]], tokens - 1

    score, tokens = max((round(s, 9), t) for s, t in ways(word))
    return -tokens


def test_shared_prefixes_give_the_best_segmentations():
    rng = random.Random(1)
    words = {MARK + "".join(rng.choice("abcéx") for _ in range(rng.randrange(7))) for _ in range(300)}
    found = forward_counts(words, Vocabulary.of(SCORES))
    assert found == {w: best(w, SCORES) for w in words}
    assert forward_counts(["", "a"], Vocabulary.of(SCORES)) == {"": 0, "a": 1}
    assert forward_counts([], Vocabulary.of(SCORES)) == {} and forward_counts(["€"], Vocabulary.of(SCORES)) == {"€": 3}


def test_very_long_words(monkeypatch):
    """Nodes below the depth that is done together, and tries of a bounded size, change nothing."""
    rng = random.Random(2)
    words = [MARK + "".join(rng.choice("abcéx") for _ in range(n)) for n in (500, 501, 3000)] + ["ab" * 400, "ab" * 401]
    vocabulary = Vocabulary.of(SCORES)
    want = {w: plain(w) for w in words}
    assert forward_counts(words, vocabulary) == want
    monkeypatch.setattr(module, "DEEP", 1000)
    monkeypatch.setattr(module, "TRIE_CHARS", 10)
    assert forward_counts(words, vocabulary) == want


def plain(word):
    """Forward scores of one word, piece by piece."""
    least = min(SCORES.values()) - BELOW
    path = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        ways = [(path[-1][0] + least * n, path[-1][1] - n)]
        ways += [(path[i][0] + SCORES[word[i:end]], path[i][1] - 1) for i in range(max(0, end - 3), end) if word[i:end] in SCORES]
        path.append(max(ways))
    return -path[-1][1]


def test_pretokens_are_counted(spark):
    df = documents(spark)
    want = Counter(MARK + w for r in df.collect() for w in re.findall(r"[^ \t\n\v\f\r]+", r["text"] or ""))
    assert {r["word"]: r["n"] for r in pretoken_counts(df).collect()} == want


def test_fitting(spark):
    """Each round uses the counts of the best segmentations; no piece comes or goes, and the texts become likelier."""
    words = Counter({MARK + "ab": 50, MARK + "abc": 20, MARK + "ca": 3, MARK + "éa": 2, MARK: 1})
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(2)

    def likelihood(scores):
        return sum(n * Trie([w], Vocabulary.of(scores)).score[Trie([w], Vocabulary.of(scores)).ends[0]] for w, n in words.items())

    scores = [SCORES, *(fit_scores(df, SCORES, rounds) for rounds in (1, 2, 3))]
    for s in scores[1:]:
        assert s.keys() == SCORES.keys() and abs(sum(math.exp(x) for x in s.values()) - 1) < 1e-9
    likely = [likelihood(s) for s in scores]
    assert likely[0] < likely[1] <= likely[2] + 1e-9 and likely[2] <= likely[3] + 1e-9
    # "▁ab" and "c" (-7.1) beat "▁" and "abc" (-8).
    trie = Trie(list(words), Vocabulary.of(SCORES))
    used = dict(zip(SCORES, trie.used(np.array(list(words.values())), len(SCORES)).tolist(), strict=True))
    assert used == {"▁": 1 + 3 + 2, "▁a": 0, "a": 2, "b": 0, "ab": 0, "▁ab": 70, "abc": 0, "c": 20, "ca": 3, "é": 2}
    assert fit_scores(df.limit(0), SCORES) == SCORES


def test_documents(spark):
    df = documents(spark)
    found = token_counts(df, SCORES)
    assert found.columns == [*df.columns, "n_tokens", "n_pretokens"]
    rows = found.collect()
    assert len(rows) == df.count()
    for r in rows:
        words = re.findall(r"[^ \t\n\v\f\r]+", r["text"] or "")
        counts = forward_counts([MARK + w for w in words], Vocabulary.of(SCORES))
        assert (r["n_tokens"], r["n_pretokens"]) == (sum(counts[MARK + w] for w in words), len(words))
    assert token_counts(df.limit(0), SCORES).count() == 0
    totals = {r["source"]: r["n_tokens"] for r in count_by_source(found).collect()}
    assert sum(totals.values()) == sum(r["n_tokens"] for r in rows) and None in totals


@pytest.mark.skipif(not Path(MODEL).exists(), reason="no public tokenizer here")
def test_public_vocabulary(spark):
    scores, probable = piece_scores(MODEL)
    assert not probable
    assert len(scores) > 30_000 and "▁the" in scores and "<s>" not in scores
    found = forward_counts(["▁the", "▁thermal", "▁the世"], Vocabulary.of(scores))
    assert found["▁the"] == 1 and all(n >= 1 for n in found.values())
    df = documents(spark).filter("length(text) < 1000")
    fitted = scores_for(df, MODEL)
    assert fitted.keys() == scores.keys() and fitted["▁the"] > scores["▁the"] - 5
    before, after = (sum(r["n_tokens"] for r in token_counts(df, s).collect()) for s in (scores, fitted))
    assert after <= before * 1.05

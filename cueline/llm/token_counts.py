"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

A text is cut into pre-tokens (runs without white space, each behind a word mark), and a
pre-token's segmentation is the one of the greatest sum of piece scores. The distinct
pre-tokens of a batch form a trie, whose nodes are their distinct beginnings: the forward score of a beginning is computed once, however many pre-tokens
begin with it, and each pre-token's count is what its last character's node holds. Nodes of one depth are
computed together.

A character that no piece covers is a token per byte of UTF-8, at a score below all
pieces. Of segmentations of equal score the one of fewer tokens counts. Texts are read
whole, in tasks. Beginnings, pieces and pre-tokens are told apart by 64-bit hashes, within a task only.

The pieces are those of a public tokenizer's file, named by the caller; the driver reads it once
and ships pieces and scores. A unigram file has its pieces' probabilities. One of merges has none: there
:func:`fit_scores` takes them from the table itself, by expectation and maximisation over the counts of all its
pre-tokens, of which each round's best segmentations say how often each piece is used. No piece is made or left out.

Defined results: null, empty and blank texts have no tokens. Equal texts get equal
counts. An empty table gives an empty result, and leaves the scores as they are. Input columns named like a result column
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.hashing import BLANKS, byte_classes, mix, run_hash, running, steps, utf8_view, word_bounds, word_hashes
from cueline.llm.tables import settled, small_batches

#: Fixed value: the mark that stands for the white space before a pre-token.
MARK = "▁"
#: How far the score of a byte lies below the least piece.
BELOW = 10.0
#: The shift of ranks in the Zipf-Mandelbrot law, from which fitting starts.
ZIPF_SHIFT = 2.7
#: Rounds of fitting, and what is added to each piece's count.
ROUNDS, SMOOTH = 2, 0.5
#: Pre-tokens that a task remembers, characters of a trie (a longer pre-token is one of its own), and the depth below which nodes are few.
KNOWN, TRIE_CHARS, DEEP = 200_000, 1 << 18, 64

_, _APART = byte_classes(BLANKS)


def piece_scores(path: str) -> tuple[dict[str, float], bool]:
    """The pieces of a sentencepiece model that stand for text with their scores, and whether these are log-probabilities.

    A unigram model's are. One made of merges only has ranks; its pieces get the probabilities
    of the Zipf-Mandelbrot law over their ranks, which sum to 1, to begin with.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)}
    if any(s != round(s) for s in scores.values()):
        return scores, True
    weights = {p: 1 / (rank + ZIPF_SHIFT) for rank, p in enumerate(sorted(scores, key=lambda p: -scores[p]), 1)}
    total = math.log(sum(weights.values()))
    return {p: math.log(w) - total for p, w in weights.items()}, False


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all words, and where each begins (n + 1 entries)."""
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=bounds[1:])
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def _mixed(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(1))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by number: their hashes and scores, the places of a table that lead from a hash to its number (-1: none), their lengths, and a byte's score."""

    hashes: np.ndarray
    scores: np.ndarray
    places: np.ndarray
    lengths: list[int]
    byte_score: float

    @classmethod
    def of(cls, scores: Mapping[str, float]) -> Vocabulary:
        pieces = [p for p in scores if p]
        codes, bounds = _codes(pieces)
        hashes = run_hash(running(_mixed(codes)), bounds[:-1], bounds[1:])
        places = np.full(8 << max(1, len(pieces)).bit_length(), -1, np.int32)
        mask = len(places) - 1
        for number, h in enumerate(hashes.tolist()):
            at = h & mask
            while places[at] >= 0:
                at = (at + 1) & mask
            places[at] = number
        return cls(hashes, np.array([scores[p] for p in pieces]), places, sorted({len(p) for p in pieces}), min(scores.values(), default=0.0) - BELOW)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of pieces of these hashes, or -1."""
        at = (keys & np.uint64(len(self.places) - 1)).astype(np.int64)
        out = self.places[at]
        some = np.flatnonzero(out >= 0)
        some = some[self.hashes[out[some]] != keys[some]]
        while len(some):  # another piece is in the place: the next one may have it
            at[some] = (at[some] + 1) & (len(self.places) - 1)
            out[some] = self.places[at[some]]
            some = some[out[some] >= 0]
            some = some[self.hashes[out[some]] != keys[some]]
        return out


class Trie:
    """Forward scores over the beginnings of some words: per node the best score and its tokens, and the last piece and its length that reach it (-1: bytes)."""

    def __init__(self, words: Sequence[str], vocabulary: Vocabulary) -> None:
        codes, bounds = _codes(words)
        sums = running(_mixed(codes))
        begin = np.repeat(bounds[:-1], np.diff(bounds))
        at = np.arange(len(codes))
        _, first, node = np.unique(run_hash(sums, begin, at + 1), return_index=True, return_inverse=True)
        n = len(first)
        self.depth = at[first] - begin[first] + 1
        # The root is the last entry of all arrays.
        self.parent = np.append(np.where(self.depth > 1, node[first - 1], n), n)
        self.ends = np.where(np.diff(bounds) > 0, node[bounds[1:] - 1], n) if len(codes) else np.full(len(words), n)
        self.score, self.tokens = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        self.piece, self.length = np.full(n + 1, -1), np.ones(n + 1, np.int64)
        size = 1 + (codes[first] > 0x7F).astype(np.int64) + (codes[first] > 0x7FF) + (codes[first] > 0xFFFF)
        matched = {}
        for k in vocabulary.lengths:
            own = np.flatnonzero(self.depth >= k)
            if len(own):
                number = np.full(n, -1, np.int32)
                number[own] = vocabulary.numbers(run_hash(sums, first[own] + 1 - k, first[own] + 1))
                matched[k] = number
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, DEEP + 2))
        for d in range(1, DEEP + 1):
            self._level(order[cuts[d - 1] : cuts[d]], d, size, matched, vocabulary)
        self._deep(order[cuts[DEEP] :], size, matched, vocabulary)

    def _level(self, nodes: np.ndarray, depth: int, size: np.ndarray, matched: dict[int, np.ndarray], vocabulary: Vocabulary) -> None:
        """All nodes of one depth."""
        if not len(nodes):
            return
        above = self.parent[nodes]
        score, tokens = self.score[above] + vocabulary.byte_score * size[nodes], self.tokens[above] + size[nodes]
        piece, length = np.full(len(nodes), -1), np.ones(len(nodes), np.int64)
        for k in range(1, min(depth, max(matched, default=0)) + 1):
            if k in matched and len(has := np.flatnonzero(matched[k][nodes] >= 0)):
                number, base = matched[k][nodes[has]], above[has]
                reached, n = self.score[base] + vocabulary.scores[number], self.tokens[base] + 1
                better = (reached > score[has]) | ((reached == score[has]) & (n < tokens[has]))
                to = has[better]
                score[to], tokens[to], piece[to], length[to] = reached[better], n[better], number[better], k
            above = self.parent[above]
        self.score[nodes], self.tokens[nodes], self.piece[nodes], self.length[nodes] = score, tokens, piece, length

    def _deep(self, nodes: np.ndarray, size: np.ndarray, matched: dict[int, np.ndarray], vocabulary: Vocabulary) -> None:
        """Nodes of very long words, one by one: of each depth there are few."""
        for node in nodes.tolist():
            above = int(self.parent[node])
            best = (self.score[above] + vocabulary.byte_score * size[node], -(self.tokens[above] + size[node]), -1, 1)
            for k in range(1, max(matched, default=0) + 1):
                if k in matched and (number := matched[k][node]) >= 0:
                    reached = (self.score[above] + vocabulary.scores[number], -(self.tokens[above] + 1))
                    if reached > best[:2]:
                        best = (*reached, number, k)
                above = int(self.parent[above])
            self.score[node], self.tokens[node], self.piece[node], self.length[node] = best[0], -best[1], best[2], best[3]

    def used(self, times: np.ndarray, pieces: int) -> np.ndarray:
        """How often each piece is used by the words' best segmentations, if each word comes so many times."""
        found, root = np.zeros(pieces, np.int64), len(self.parent) - 1
        at, times = self.ends.copy(), times.copy()
        while len(at):
            live = at != root
            at, times = at[live], times[live]
            has = self.piece[at] >= 0
            np.add.at(found, self.piece[at[has]], times[has])
            step = self.length[at].copy()
            while (step > 0).any():
                at = np.where(step > 0, self.parent[at], at)
                step -= 1
        return found


def _tries(words: Sequence[str], vocabulary: Vocabulary) -> Iterator[tuple[slice, Trie]]:
    """Tries of bounded size over sorted words, with the words that each has."""
    low, held = 0, 0
    for i, word in enumerate(words):
        held += len(word)
        if held >= TRIE_CHARS or i == len(words) - 1:
            yield slice(low, i + 1), Trie(words[low : i + 1], vocabulary)
            low, held = i + 1, 0


def forward_counts(words: Iterable[str], vocabulary: Vocabulary) -> dict[str, int]:
    """Tokens of each word."""
    own = sorted(set(words))
    return {w: n for part, trie in _tries(own, vocabulary) for w, n in zip(own[part], trie.tokens[trie.ends].tolist(), strict=True)}


def _pretokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts at a time: their range, the first pre-token of each, all pre-tokens' hashes and bytes."""
    data, offsets = utf8_view(texts)
    for low, high in steps(offsets):
        part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = word_bounds(part, at, _APART)
        yield low, high, first, word_hashes(part, starts, ends), part, np.stack([starts, ends])


def _spelled(data: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Pre-tokens behind their marks."""
    raw = data.tobytes()
    return [MARK + raw[a:b].decode() for a, b in bounds.T.tolist()]


def token_counts(df: DataFrame, scores: Mapping[str, float], text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of ``df`` with ``n_tokens`` and ``n_pretokens``."""
    df = df.drop("n_tokens", "n_pretokens")
    kept = [c for c in df.columns if keep_text or c != text_col]
    shipped = df.sparkSession.sparkContext.broadcast(Vocabulary.of(scores))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shipped.value
        known, tokens_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            found = np.zeros((2, batch.num_rows), np.int64)
            for low, high, first, hashes, data, bounds in _pretokens(batch.column(text_col)):
                distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                if len(known) > KNOWN:  # counts of earlier texts are only kept to spare work
                    known, tokens_of = known[:0], tokens_of[:0]
                fresh = at[~np.isin(distinct, known, assume_unique=True)]
                if len(fresh):
                    words = _spelled(data, bounds[:, fresh])
                    counts = forward_counts(words, vocabulary)
                    known = np.concatenate([known, hashes[fresh]])
                    tokens_of = np.concatenate([tokens_of, np.array([counts[w] for w in words])])
                    order = np.argsort(known)
                    known, tokens_of = known[order], tokens_of[order]
                per_word = tokens_of[np.searchsorted(known, distinct)][inverse]
                total = np.concatenate([[0], np.cumsum(per_word)])
                found[:, low:high] = np.diff(total[first]), np.diff(first)
            columns = [*(batch.column(c) for c in kept), *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_tokens", "n_pretokens"])

    fields = [f for f in df.schema.fields if f.name in kept]
    return small_batches(df).mapInArrow(count, T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("n_pretokens", T.LongType())]))


def pretoken_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (behind its mark) and ``n`` of every distinct pre-token of the table."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        known, number, times = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, _, hashes, data, bounds in _pretokens(batch.column(text_col)):
                distinct, at, n = np.unique(hashes, return_index=True, return_counts=True)
                fresh = at[~np.isin(distinct, known, assume_unique=True)]
                known, number = np.concatenate([known, hashes[fresh]]), np.concatenate([number, np.arange(len(fresh)) + len(words)])
                order = np.argsort(known)
                known, number = known[order], number[order]
                words += _spelled(data, bounds[:, fresh])
                times = np.concatenate([times, np.zeros(len(fresh), np.int64)])
                times[number[np.searchsorted(known, distinct)]] += n
            if len(words) > KNOWN:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(times)], names=["word", "n"])
                words, known, number, times = [], known[:0], number[:0], times[:0]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(times)], names=["word", "n"])

    counted = small_batches(df.select(text_col)).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def fit_scores(words: DataFrame, scores: Mapping[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """Log-probabilities of the pieces from counted pre-tokens (:func:`pretoken_counts`), starting from ``scores``.

    A round gathers one count per piece.
    """
    pieces = [p for p in scores if p]
    for _ in range(rounds):
        shipped = words.sparkSession.sparkContext.broadcast(Vocabulary.of(scores))

        def use(batches: Iterable[pa.RecordBatch], shipped: object = shipped) -> Iterator[pa.RecordBatch]:
            found = np.zeros(len(pieces), np.int64)
            for batch in batches:
                order = np.argsort(np.array(batch.column("word").to_pylist(), object))
                own, times = batch.column("word").take(pa.array(order)).to_pylist(), batch.column("n").to_numpy()[order]
                for part, trie in _tries(own, shipped.value):
                    found += trie.used(times[part], len(pieces))
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["piece", "n"])

        used = small_batches(words).mapInArrow(use, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if not used:
            return dict(scores)
        counts = np.full(len(pieces), SMOOTH)
        counts[[r["piece"] for r in used]] += [r["n"] for r in used]
        scores = dict(zip(pieces, (np.log(counts) - np.log(counts.sum())).tolist(), strict=True))
    return dict(scores)


def scores_for(df: DataFrame, path: str, text_col: str = "text") -> dict[str, float]:
    """The scores of a file's pieces: its own, or fitted to the table if it has ranks only."""
    scores, probable = piece_scores(path)
    return scores if probable else fit_scores(settled(pretoken_counts(df, text_col)), scores)


def count_by_source(counted: DataFrame, source_col: str = "source") -> DataFrame:
    """Tokens, pre-tokens and documents of each source."""
    return counted.groupBy(source_col).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_pretokens").alias("n_pretokens"), F.count("*").alias("n_docs"))

"""Phrase collocations by level-wise passes over the texts.

Words are counted per language; a word of at least ``least`` occurrences is *frequent*. The pass for
phrases of k words counts a phrase only where both phrases of k - 1 words in it are frequent, as no other
can be. Phrases are counted in the tasks before they are shuffled. Scores of all cuts come from the
levels' tables by joins.

The frequent phrases of a level are broadcast if they are at most ``MOST`` (8 bytes each in a task). Above that the next pass
counts its phrases without them: the results are the same and more is shuffled, as the least count decides in
any case. No count, phrase or row is left out at any size.

A phrase goes if a longer candidate contains it and occurs at least ``share`` percent as often. The best of
each language are found in steps, over ever fewer groups, so that no task sorts a language.

Defined results: a null text is empty, a null language is ``und``, and an empty one is a language of its own. Words are what blanks and tabs part
within a piece, pieces what ``.,;:!?`` and line ends part; no phrase crosses pieces. A-Z count as a-z. Equal rows
count as often as they are there. Ties of score and count go by the phrase's bytes. An empty table gives an
empty result. Columns but the text and the language are not read. Words are told by 64 bits in the tasks;
frequent ones that shared them would raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.hashing import byte_classes, mix, steps, utf8_view, word_bounds, word_hashes
from cueline.llm.tables import settled, small_batches

#: Occurrences that a phrase needs, percent of a shorter one's at which a longer one takes its place, and phrases that are returned of a language.
LEAST, SHARE, BEST = 10, 50, 2000
#: Frequent phrases of one level that tasks may have as a table.
MOST = 1 << 22
#: Phrases that a task counts at a time before it passes them on.
HELD = 1 << 21
#: Groups of the steps that find a language's best phrases.
_SALTS = (4096, 64)

# What parts words, and what parts pieces.
WORD_BREAKS, PIECE_BREAKS = " \t", ".,;:!?\n\v\f\r"
_LOWER, _APART = byte_classes(WORD_BREAKS + PIECE_BREAKS)
_ENDS = byte_classes(PIECE_BREAKS)[1]
_ODD = np.uint64(0x9E3779B97F4A7C15)
NO_LANGUAGE = "und"

Table = np.ndarray | None


def _words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some rows at a time: their bytes, words' first and past-the-last byte, hash (of language and word), row, and piece."""
    data, offsets = utf8_view(batch.column("text"))
    lang, ends = utf8_view(batch.column("lang"))
    of_lang = mix(word_hashes(lang, ends[:-1], ends[1:]) + _ODD)
    for low, high in steps(offsets):
        part, at = _LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        starts, stops, first = word_bounds(part, at, _APART)
        row = np.repeat(np.arange(low, high), np.diff(first))
        # The breaks before a word, and one for each row before: equal for words of one piece only.
        piece = np.cumsum(_ENDS[part])[starts] + row if len(starts) else np.zeros(0, np.int64)
        yield part, starts, stops, mix(word_hashes(part, starts, stops) ^ of_lang[row]), row, piece


def _tallied(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns, and how often each is there."""
    bits = 63 // len(columns)
    if all(not len(c) or (c.min() >= 0 and c.max() < 1 << bits) for c in columns):
        packed = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            packed = packed << bits | c
        packed, counts = np.unique(packed, return_counts=True)
        return [packed >> bits * k & (1 << bits) - 1 for k in reversed(range(len(columns)))], counts
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    begins = np.flatnonzero(new)
    return [c[begins] for c in columns], np.diff(np.append(begins, len(order)))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``hash`` and ``n`` (partly counted) of all words (``text``, ``lang``); and rows without a word that count all of some rows' words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, starts, stops, hashes, row, _ in _words(batch):
                _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                raw = part.tobytes()
                words: list[str | None] = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
                rows, totals = np.unique(row, return_counts=True)
                taken = batch.column("lang").take(pa.array(np.concatenate([row[first], rows])))
                columns = [taken, pa.array(words + [None] * len(rows), pa.string()), pa.array(np.concatenate([hashes[first], np.zeros(len(rows), np.uint64)]).view(np.int64)), pa.array(np.concatenate([counts, totals]))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "hash", "n"])

    return small_batches(docs).mapInArrow(count, "lang string, word string, hash long, n long")


def _found(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Each value's place in a sorted table, or -1."""
    if not len(table):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)


def gram_counts(docs: DataFrame, k: int, words: Table, pairs: Table, held: int = HELD) -> DataFrame:
    """``w1`` to ``w<k>`` and ``n`` (partly counted) of the phrases of k words.

    ``words`` are the sorted hashes of frequent words, and a word is then its place there; without them it is its
    hash. ``pairs`` are the frequent phrases of two words, each the first's place times 2**32 and the second's.
    """
    names = [f"w{i + 1}" for i in range(k)]
    shipped = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def grams(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        table, twos = shipped.value
        for _, _, _, hashes, _, piece in _words(batch):
            if len(hashes) < k:
                continue
            word = hashes.view(np.int64) if table is None else _found(table, hashes)
            last = len(word) - k + 1
            some = piece[:last] == piece[k - 1 :]
            if table is not None:
                for i in range(k):
                    some &= word[i : last + i] >= 0
            if twos is not None and k > 2:
                frequent = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0) & (piece[:-1] == piece[1:]))
                two = np.zeros(len(word) - 1, bool)
                two[frequent] = _found(twos, word[frequent] << 32 | word[frequent + 1]) >= 0
                for i in range(k - 1):
                    some &= two[i : last + i]
            at = np.flatnonzero(some)
            yield [word[at + i] for i in range(k)]

    def tallied(held_rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns, counts = _tallied([np.concatenate([x[i] for x in held_rows]) for i in range(k)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, counts)], names=[*names, "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = []
        for batch in batches:
            for found in grams(batch):
                rows.append(found)
                if sum(len(x[0]) for x in rows) >= held:
                    yield tallied(rows)
                    rows = []
        if rows:
            yield tallied(rows)

    return small_batches(docs).mapInArrow(count, ", ".join(f"{c} long" for c in (*names, "n")))


def _placed(words: DataFrame, table: Table) -> DataFrame:
    """``words`` with ``w``, as phrases name them."""
    if table is None:
        return words.withColumn("w", F.col("hash"))
    shipped = words.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _found(shipped.value, batch.column("hash").to_numpy().view(np.uint64))
            yield batch.append_column("w", pa.array(at))

    return words.mapInArrow(place, "lang string, word string, hash long, n long, w long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """Whole millionths of a * a / (left * right), in decimals of 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", million * (whole(a) * whole(a)), whole(left) * whole(right))


def _best(scored: DataFrame, best: int) -> DataFrame:
    """The first ``best`` phrases of each language, with their ``rank`` from 1."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in _SALTS:
        group = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= best)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= best)


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, best: int = BEST, most: int = MOST
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and ``r`` (those of the parts at its weakest cut), ``n`` (the language's words) and ``score``."""
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"))
    counted = word_counts(docs).groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("word").isNull())
    counted = settled(counted)
    totals = counted.filter("word IS NULL").select("lang", F.col("n").alias("n_lang"))
    words = counted.filter("word IS NOT NULL")

    frequent = words.count()
    table = None
    if frequent <= most:
        table = np.sort(words.select("hash").toArrow().column("hash").to_numpy().view(np.uint64))
        if (table[1:] == table[:-1]).any():
            raise ValueError("two frequent words have one hash")
    level: Callable[[int, Table], DataFrame] = lambda k, pairs: settled(gram_counts(docs, k, table, pairs).groupBy(*(f"w{i + 1}" for i in range(k))).agg(F.sum("n").alias("a")).filter(F.col("a") >= least))
    twos = level(2, None)
    pairs = None
    if table is not None and twos.count() <= most:
        pairs = np.sort(twos.select((F.shiftleft("w1", 32) + F.col("w2")).alias("pair")).toArrow().column("pair").to_numpy())
    threes = level(3, pairs)

    # Words' counts, and those of the phrases of two words, meet the phrases by joins of their own.
    words = settled(_placed(words, table))
    word = lambda i: words.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("n").alias(f"n{i}"), *([F.col("lang")] if i == 1 else []))
    part = lambda i: twos.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{i + 1}"), F.col("a").alias(f"n{i}{i + 1}"))
    longer = threes.select("w1", "w2", "a").unionByName(threes.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    kept = twos.join(longer, ["w1", "w2"], "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {int(share)} * a"))
    two = kept.join(word(1), "w1").join(word(2), "w2")
    two = two.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"))
    three = threes.join(part(1), ["w1", "w2"]).join(part(2), ["w2", "w3"]).join(word(1), "w1").join(word(2).drop("n2"), "w2").join(word(3), "w3")
    first, second = _score(F.col("a"), F.col("n1"), F.col("n23")), _score(F.col("a"), F.col("n12"), F.col("n3"))
    cut = F.when(first <= second, F.struct(F.col("n1").alias("l"), F.col("n23").alias("r"))).otherwise(F.struct(F.col("n12").alias("l"), F.col("n3").alias("r")))
    three = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r")
    scored = two.unionByName(three).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    out = _best(scored, best).join(totals, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("n_lang").alias("n"), "score")

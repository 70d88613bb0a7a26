"""Benchmark decontamination with one Aho-Corasick automaton.

The items' windows (runs of ten consecutive words, or the whole of a shorter item)
become patterns of an automaton over normalised text: A-Z lower-cased, words told apart from separators. Its letters are
the items' words, by number: a text's words are looked up by a hash, stretches without as many neighbours in a row that some item has side by side as the shortest window needs count as one letter, and
the text is scanned once. The words of a match are compared with the item's own. Where words begin and end
is kept, so that a match maps to words and to offsets in the original.

The automaton is built in the tasks from the items' normalised texts, which the
driver reads and broadcasts in blocks of a bounded size, one after the other. The table is read once, nothing is
shuffled or written in between, and the plan is the same for any benchmark. What a task holds is bounded as well: one block's automaton,
and texts of a bounded size, over which a larger benchmark's blocks pass in turn.

Defined results: null and wordless texts have no words and no hits; a wordless item
has no window; items of one id count once. An empty benchmark leaves every document
clean. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.hashing import NOT_ALNUM, byte_classes, steps, utf8_view, word_bounds, word_hashes
from cueline.llm.tables import ALNUM_WORD, lower_ascii, small_batches

WINDOW = 10
#: Characters of normalised benchmark text that one automaton is built from; an item is not divided.
BLOCK_CHARS = 1 << 19
#: Bytes of texts that a task holds while the blocks of a benchmark of several pass over them.
HELD_BYTES = 1 << 25

_LOWER, _APART = byte_classes(NOT_ALNUM)
_RESULT = ("n_words", "spans", "items")
_SPAN = T.StructType([T.StructField(x, T.LongType()) for x in ("first", "last", "start", "end")])
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]
_ARROW = [
    pa.int64(),
    pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")])),
    pa.list_(pa.string()),
]
#: Bits (a power of two) of the tables that tell stretches of text without a window.
_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_built: dict[bytes, _Patterns] = {}


@dataclass
class _Patterns:
    """An automaton over word numbers (from 1; 0 is any other word), the sorted hashes of the words and their numbers, the words, and of each pattern its length and the items that have it.

    ``pairs`` has a bit for each two words that stand side by side in an item, ``singles`` one for each pattern of one word; ``least`` is the length of the shortest longer one.
    """

    automaton: ahocorasick.Automaton
    hashes: np.ndarray
    numbers: np.ndarray
    words: list[bytes]
    lengths: np.ndarray
    owners: list[tuple[str, ...]]
    pairs: np.ndarray
    singles: np.ndarray
    least: int


def _bit(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - _BITS)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _bit(first * _ODD + second)


def _hashed(words: list[str]) -> np.ndarray:
    data, offsets = utf8_view(pa.array(words, pa.large_string()))
    return word_hashes(data, offsets[:-1], offsets[1:])


def _automaton(items: list[tuple[str, str]], window: int) -> _Patterns:
    """The automaton of some items. The last one built stays with the Python worker for its next batches."""
    key = hashlib.sha256(repr((window, items)).encode()).digest()
    if key not in _built:
        _built.clear()
        known = sorted({w for _, text in items for w in text.split(" ")})
        number = {w: i + 1 for i, w in enumerate(known)}
        hashes = _hashed(known)
        order = np.argsort(hashes)
        if (hashes[order][1:] == hashes[order][:-1]).any():
            raise ValueError("two words of the benchmark have one hash")
        found, places = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
        owners: list[tuple[str, ...]] = []
        lengths: list[int] = []
        pairs, singles = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, bool)
        for item, text in items:
            words = tuple(number[w] for w in text.split(" "))
            for i in range(max(1, len(words) - window + 1)):
                pattern = words[i : i + window]
                place = found.get(pattern, -1)
                if place < 0:
                    found.add_word(pattern, len(owners))
                    owners.append((item,))
                    lengths.append(len(pattern))
                elif item not in owners[place]:
                    # Windows of the same items share one tuple.
                    both = (*owners[place], item)
                    owners[place] = places.setdefault(both, both)
            at = hashes[np.array(words) - 1]
            pairs[_pair(at[:-1], at[1:])] = True
            if len(words) == 1 or window == 1:
                singles[_bit(at)] = True
        if owners:
            found.make_automaton()
        least = min((n for n in lengths if n > 1), default=0)
        _built[key] = _Patterns(found, hashes[order], order + 1, [w.encode() for w in known], np.array(lengths, np.int64), owners, pairs, singles, least)
    return _built[key]


def _near_windows(built: _Patterns, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word may be part of a window."""
    found = built.singles[_bit(hashes)]
    if built.least:
        side = np.zeros(len(hashes) + 1, bool)
        side[1:-1] = built.pairs[_pair(hashes[:-1], hashes[1:])]
        side[first] = False  # two texts
        edges = np.flatnonzero(side[1:] != side[:-1]).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] >= built.least - 1]
        # From the first word of a run of pairs to the last.
        change = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(change, edges[:, 0], 1)
        np.add.at(change, edges[:, 1] + 1, -1)
        found = found | (np.cumsum(change)[:-1] > 0)
    return found


def _letters(built: _Patterns, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of some texts one after the other, and each one's word; a text's end, and a stretch without a window, is a 0."""
    near = np.flatnonzero(_near_windows(built, hashes, first))
    at = np.minimum(np.searchsorted(built.hashes, hashes[near]), len(built.hashes) - 1)
    number = np.zeros(len(hashes), np.int64)
    number[near] = np.where(built.hashes[at] == hashes[near], built.numbers[at], 0)
    apart = np.zeros(len(number) + 1, bool)
    apart[first] = True  # another text's words begin
    kept = (number > 0) | np.append(True, number[:-1] > 0)
    word = np.flatnonzero(kept)
    between = apart[word] & (word > 0)
    place = np.cumsum(between) + np.arange(len(word))
    letters, words = np.zeros(len(word) + int(between.sum()), np.int64), np.full(len(word) + int(between.sum()), -1)
    letters[place], words[place] = number[word], word
    return letters, words


def _matches(data: np.ndarray, offsets: np.ndarray, built: _Patterns) -> tuple[np.ndarray, dict[int, tuple[list[dict], set[str]]]]:
    """Words of each text, and of those with hits the merged spans and the items."""
    low = _LOWER[data]
    starts, ends, first = word_bounds(data, offsets, _APART)
    count = np.diff(first)
    if not built.owners or not len(starts):
        return count, {}
    doc = np.repeat(np.arange(len(count)), count)
    letters, words = _letters(built, word_hashes(low, starts, ends), first)
    ended, pattern = [], []
    for place, number in built.automaton.iter(tuple(letters.tolist())):
        ended.append(place)
        pattern.append(number)
    if not ended:
        return count, {}
    last, pattern = words[np.array(ended)], np.array(pattern)
    begun = last - built.lengths[pattern] + 1
    # Words of another text may only share the hash.
    number = dict(zip(words.tolist(), letters.tolist(), strict=True))
    same = {k: low[starts[k] : ends[k]].tobytes() == built.words[number[k] - 1] for a, b in zip(begun.tolist(), last.tolist(), strict=True) for k in range(a, b + 1)}
    hits: dict[int, tuple[list[list[int]], set[str]]] = {}
    for i in np.argsort(begun, kind="stable"):
        if not all(same[k] for k in range(begun[i], last[i] + 1)):
            continue
        spans, items = hits.setdefault(int(doc[last[i]]), ([], set()))
        if spans and begun[i] <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], int(last[i]))
        else:
            spans.append([int(begun[i]), int(last[i])])
        items.update(built.owners[pattern[i]])

    def chars(doc: int, end: int) -> int:
        return int(np.count_nonzero(data[offsets[doc] : end] & 0xC0 != 0x80))

    return count, {
        d: ([{"first": a - int(first[d]), "last": b - int(first[d]), "start": chars(d, starts[a]), "end": chars(d, ends[b])} for a, b in spans], items)
        for d, (spans, items) in hits.items()
    }


def _merged(old: list[dict], new: list[dict]) -> list[dict]:
    """The union of two lists of spans; those that meet or overlap are one."""
    out: list[dict] = []
    for x in sorted(old + new, key=lambda s: s["first"]):
        if out and x["first"] <= out[-1]["last"] + 1:
            if x["last"] > out[-1]["last"]:
                out[-1] |= {"last": x["last"], "end": x["end"]}
        else:
            out.append(dict(x))
    return out


def _hits(texts: pa.Array, built: _Patterns) -> tuple[np.ndarray, dict[int, tuple[list[dict], set[str]]]]:
    """:func:`_matches` of a batch's texts, some at a time."""
    data, offsets = utf8_view(texts)
    words: list[np.ndarray] = [np.zeros(0, np.int64)]
    found: dict[int, tuple[list[dict], set[str]]] = {}
    for low, high in steps(offsets):
        count, hits = _matches(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], built)
        words.append(count)
        found |= {low + d: own for d, own in hits.items()}
    return np.concatenate(words), found


def _scan(df: DataFrame, text_col: str, blocks: list[Broadcast], window: int, keep_text: bool) -> DataFrame:
    """``df`` with the hits of all blocks."""
    kept = [c for c in df.columns if c not in _RESULT and (keep_text or c != text_col)]

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            some.append(batch)
            if len(blocks) == 1 or sum(x.nbytes for x in some) >= HELD_BYTES:
                yield some
                some = []
        if some:
            yield some

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in held(batches):
            counts = [np.zeros(x.num_rows, np.int64) for x in some]
            spans: list[list[list[dict]]] = [[[] for _ in range(x.num_rows)] for x in some]
            items: list[list[set[str]]] = [[set() for _ in range(x.num_rows)] for x in some]
            for block in blocks:
                built = _automaton(block.value, window)
                for k, batch in enumerate(some):
                    counts[k], hits = _hits(batch.column(text_col), built)
                    for d, (own, own_items) in hits.items():
                        spans[k][d] = _merged(spans[k][d], own)
                        items[k][d] |= own_items
            for k, batch in enumerate(some):
                values = counts[k], spans[k], [sorted(x) for x in items[k]]
                columns = [batch.column(c) for c in kept] + [pa.array(v, t) for v, t in zip(values, _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *_RESULT])

    fields = [f for f in df.schema.fields if f.name in kept]
    return small_batches(df).mapInArrow(scan, T.StructType(fields + _FIELDS))


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep_text: bool = True,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Every row of ``df`` with what it shares with the benchmark.

    Results: ``n_words``; ``n_hit`` (words inside any occurrence of a window); ``items`` (ids as
    strings, sorted) and ``n_items``; ``spans`` (merged: first and last word from 0, start and end
    as character offsets in the original text); ``contaminated``.
    """
    df = df.drop(*_RESULT, "n_hit", "n_items", "contaminated")
    words = F.regexp_extract_all(lower_ascii(F.col(item_text_col)), F.lit(ALNUM_WORD), F.lit(0))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.array_join(words, " ").alias("words")).filter("words <> ''").distinct()
    chars = items.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    blocks = []
    for i in range(n):
        block = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == i)
        blocks.append(df.sparkSession.sparkContext.broadcast(sorted(tuple(x) for x in block.collect())))
    out = _scan(df, text_col, blocks, window, keep_text)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return out.withColumns({"n_hit": hit, "n_items": F.size("items").cast("bigint"), "contaminated": F.size("spans") > 0})


def decontaminate(df: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of ``df`` that share no window with the benchmark, as they came."""
    return contamination(df, benchmark, **options).filter(~F.col("contaminated")).select(*df.columns)

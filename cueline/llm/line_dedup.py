"""Line deduplication across documents by a deletion-neighbourhood join.

Lines are compared by their words. A line goes if an earlier one (by document id, then line
number) is the same, or near: within one edit, a unit put in, left out or changed, that is no more than an
eighth of the line. So units are the words of a line of eight words and more, and the characters (words parted by one blank) of a shorter
one of eight characters and more; if either of two lines is of fewer than eight words, both are compared by characters. In a line of fewer than eight
characters every edit is more than an eighth. The earliest line of a text stays.

1. Every line becomes a 128-bit hash of its words; equal lines keep their earliest place.
2. Two lines within one edit share their first or their last half: at least one of four
   half-line keys. Lines that share none have no partner and need no neighbourhood.
3. The keys that two lines share set bits of a filter of a bounded size, and a second pass over the texts brings the lines whose keys it admits, each once:
   all lines with a partner, and a few without, which do no harm. They emit all variants of one deletion as hashed keys. Lines that differ in one unit share
   a variant and its place; a line that is another's variant has one unit less. In
   each group of equal keys every line is compared with the earliest only, and
   that pair's edit distance is verified on the texts. No group's pairs are formed: all
   lines of a group are within the bound of its earliest.

A very common line counts once, and a key that a third of all lines share is combined in
the tasks before it is shuffled. The plan is the same for any number of lines.

Defined results: a null text has no lines; a blank line has no words, is not counted and
stays. A row is known by its id and its text's hash: rows of equal id and text share their
decisions, rows of equal id and different texts are told apart, and of their lines of one number the one of the
smaller hash is earlier. A null id is earlier than any other. An empty table gives an empty result. Input columns
named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.hashing import BLANKS, byte_classes, mix, run_hash, running, steps, utf8_view, word_bounds, word_hashes
from cueline.llm.tables import BLANK_WORD, apart, apart_from_its_rows, settled, small_batches

#: Units that a line needs for one edit to be near: an edit is at most an eighth of it.
UNITS = 8

_, _APART = byte_classes(BLANKS)
_WORD = re.compile(BLANK_WORD)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of the filter for each key that two lines share, and the most bits in all. Beyond that it admits more lines without a partner.
FILTER_BITS, FILTER_MOST = 16, 1 << 27
#: What is added to the tags of keys of characters, so that they never meet those of words.
_OF_CHARACTERS = 8


def _salted(n: np.ndarray | int, tag: int) -> np.ndarray:
    return mix((np.asarray(n, np.uint64) * np.uint64(16) + np.uint64(tag)) * _ODD)


def _line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word (two rows); word hashes; each line's first word (and the end); its document; its number. Lines without words are left out."""
    starts, ends, first = word_bounds(data, offsets, _APART)
    words = word_hashes(data, starts, ends)
    feeds = np.flatnonzero(data == ord("\n"))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # A word's line: the feeds before it, less those before its document.
    number = np.searchsorted(feeds, starts) - np.searchsorted(feeds, offsets[:-1])[doc]
    begins = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])) if len(words) else np.zeros(0, np.int64)
    return np.stack([starts, ends]), words, np.append(begins, len(words)), doc[begins], number[begins]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all ranges one after the other, and the range that each is of."""
    n = high - low
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[owner], owner


def _characters(data: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of lines (words ``low`` to ``high``), with one blank between two words, as units; and where each line begins (and the end)."""
    word, line = _ranges(low, high)
    at, of = _ranges(bounds[0, word], bounds[1, word])
    lead = data[at] & 0xC0 != 0x80
    at, of = at[lead], of[lead]
    more = np.append(data, np.zeros(4, np.uint8))
    code, on = data[at].astype(np.uint64), np.ones(len(at), bool)
    for k in (1, 2, 3):
        on &= more[at + k] & 0xC0 == 0x80
        code |= np.where(on, more[at + k].astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
    # Before a word there are its line's earlier words' blanks, and those of all lines before.
    blanks = np.arange(len(word)) - line
    ends = np.zeros(len(low) + 1, np.int64)
    np.cumsum(np.bincount(line[of], minlength=len(low)) + (high - low - 1), out=ends[1:])
    units = np.full(ends[-1], ord(" "), np.uint64)
    units[np.arange(len(at)) + blanks[of]] = code
    return mix(units + np.uint64(1)), ends


def _sequences(data: np.ndarray, bounds: np.ndarray, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The lines as units that one edit may be near in: tag, the lines, the units, and each line's first unit and its end. A line of just ``UNITS`` words is there both ways."""
    n = np.diff(at)
    long_ = np.flatnonzero(n >= UNITS)
    yield 0, long_, words, at[long_], at[long_ + 1]
    short = np.flatnonzero((n > 0) & (n <= UNITS))
    units, ends = _characters(data, bounds, at[short], at[short + 1])
    own = np.flatnonzero(np.diff(ends) >= UNITS)
    yield _OF_CHARACTERS, short[own], units, ends[own], ends[own + 1]


def _keys(texts: pa.Array) -> Iterator[tuple]:
    """Of some texts at a time: each line's text and number; its first and past-the-last byte, and those bytes; hash and check; keys of half-lines and the line of each."""
    data, offsets = utf8_view(texts)
    for a, b in steps(offsets):
        part = data[offsets[a] : offsets[b]]
        bounds, words, at, doc, number = _line_words(part, offsets[a : b + 1] - offsets[a])
        n = np.diff(at)
        whole = run_hash(running(words), at[:-1], at[1:])
        check = run_hash(running(mix(words ^ _TWO)), at[:-1], at[1:])
        line, halves = [], []
        for tag, own, units, low, high in _sequences(part, bounds, words, at):
            sums = running(units)
            for less in (0, 1):  # as a line of the shorter length, and as one of a unit more
                m = high - low - less
                half = m // 2
                halves.append(mix(run_hash(sums, low, low + half) ^ _salted(m, tag + 1)))
                halves.append(mix(run_hash(sums, high - half, high) ^ _salted(m, tag + 2)))
                line += [own, own]
        span = np.stack([bounds[0, at[:-1]], bounds[1, at[1:] - 1]])
        yield doc + a, number, span, part, mix(whole ^ _salted(n, 0)).view(np.int64), mix(check).view(np.int64), np.concatenate(halves), np.concatenate(line)


def line_keys(df: DataFrame) -> DataFrame:
    """``id``, ``key``, ``line_no``, ``hash`` and ``check`` (128 bits together) and ``halves`` (keys) of every line with words (``id``, ``key``, ``text``)."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, number, _, _, whole, check, halves, line in _keys(batch.column("text")):
                ends = np.zeros(len(doc) + 1, np.int32)
                np.cumsum(np.bincount(line, minlength=len(doc)), out=ends[1:])
                own = pa.ListArray.from_arrays(pa.array(ends), pa.array(halves[np.argsort(line, kind="stable")].view(np.int64)))
                rows = [batch.column(c).take(pa.array(doc)) for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(number.astype(np.int32)), pa.array(whole), pa.array(check), own], names=["id", "key", "line_no", "hash", "check", "halves"])

    return small_batches(df).mapInArrow(keys, f"id {dict(df.dtypes)['id']}, key long, line_no int, hash long, check long, halves array<long>")


def _filter(shared: DataFrame) -> np.ndarray:
    """A bit for each of two parts of every key (``half``), in words of 64 bits."""
    n = shared.count()
    bits = min(FILTER_MOST, 1 << max(10, (FILTER_BITS * n - 1).bit_length()))
    places = shared.select(F.explode(F.array(*(F.shiftrightunsigned("half", k).bitwiseAND(bits - 1) for k in (0, 32)))).alias("bit"))
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _admitted(halves: np.ndarray, bits: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bits) * 64 - 1)
    found = np.ones(len(halves), bool)
    for k in (0, 32):
        bit = (halves >> np.uint64(k)) & mask
        found &= (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found


def _texts(df: DataFrame, bits: np.ndarray) -> DataFrame:
    """``hash``, ``check``, earliest place (``id``, ``line_no``) and ``line`` of the lines that have a key which the filter admits, each once."""
    shipped = df.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, number, span, part, whole, check, halves, line in _keys(batch.column("text")):
                some = np.unique(line[_admitted(halves, shipped.value)])
                raw = part.tobytes()
                lines = pa.array([raw[a:b].decode() for a, b in span[:, some].T.tolist()], pa.string())
                rows = [batch.column(c).take(pa.array(doc[some])) for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(number[some].astype(np.int32)), pa.array(whole[some]), pa.array(check[some]), lines], names=["id", "key", "line_no", "hash", "check", "line"])

    found = small_batches(df).mapInArrow(cut, f"id {dict(df.dtypes)['id']}, key long, line_no int, hash long, check long, line string")
    # Copies of a line may be parted by other blanks; any of them stands for all.
    first = found.groupBy("hash", "check").agg(F.min(F.struct("id", "line_no", "key")).alias("first"), F.min("line").alias("line"))
    return first.select("hash", "check", "first.id", "first.line_no", "line")


def _variants(texts: DataFrame) -> DataFrame:
    """``key``, ``own`` (the key is the line itself, not a variant) and the line's place and hashes."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_view(batch.column("line"))
            for a, b in steps(offsets, 1 << 16):
                part = data[offsets[a] : offsets[b]]
                starts, ends, first = word_bounds(part, offsets[a : b + 1] - offsets[a], _APART)
                for tag, lines, units, low, high in _sequences(part, np.stack([starts, ends]), word_hashes(part, starts, ends), first):
                    sums = running(units)
                    _, up, _ = sums
                    place, of = _ranges(low, high)
                    line, n = lines[of], (high - low)[of]
                    # The units before the deleted one, then those behind it moved up by one.
                    before, behind = run_hash(sums, low[of], place), run_hash(sums, place + 1, high[of])
                    variant = before + behind * up[place - low[of]]
                    changed = mix(mix(variant ^ _salted(n, tag + 3)) ^ _salted(place - low[of], tag + 4))
                    shorter = mix(variant ^ _salted(n - 1, tag + 5))
                    itself = mix(run_hash(sums, low, high) ^ _salted(high - low, tag + 5))
                    own = np.zeros(2 * len(line) + len(lines), bool)
                    own[2 * len(line) :] = True
                    taken = pa.array(np.concatenate([line, line, lines]) + a)
                    columns = [batch.column(c).take(taken) for c in ("id", "line_no", "hash", "check")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([changed, shorter, itself]).view(np.int64)), pa.array(own), *columns], names=["key", "own", "id", "line_no", "hash", "check"])

    return texts.select("id", "line_no", "hash", "check", "line").mapInArrow(emit, f"key long, own boolean, id {dict(texts.dtypes)['id']}, line_no int, hash long, check long")


def _within_one_edit(a: list[str] | str, b: list[str] | str) -> bool:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def near_lines(a: str, b: str) -> bool:
    """Whether two different lines are near: by words, or by characters if either has too few of them."""
    x, y = _WORD.findall(a), _WORD.findall(b)
    if min(len(x), len(y)) < UNITS:
        x, y = " ".join(x), " ".join(y)
    return min(len(x), len(y)) >= UNITS and _within_one_edit(x, y)


def _near(texts: DataFrame) -> DataFrame:
    """``hash`` and ``check`` of the lines (``id``, ``line_no``, ``hash``, ``check``, ``line``) that have a near earlier line."""
    keys = _variants(texts)
    shared = keys.groupBy("key").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).filter("least < most").select(apart_from_its_rows("key"))
    members = settled(keys.join(shared, "key").withColumn("place", F.struct("id", "line_no", "hash", "check")))
    # A changed unit: all of a group are variants. Else: lines that leave a unit out meet the line that is left.
    groups = members.groupBy("key").agg(F.min(F.when(~F.col("own"), F.col("place"))).alias("variant"), F.min(F.when(F.col("own"), F.col("place"))).alias("whole"))
    joined = members.join(groups.select(apart_from_its_rows("key"), "variant", "whole"), "key")
    partner = F.when(F.col("own"), F.col("variant")).otherwise(F.coalesce("whole", "variant"))
    pairs = joined.withColumn("partner", partner).filter("partner < place").select("hash", "check", F.col("partner.hash").alias("earlier"), F.col("partner.check").alias("earlier_check")).distinct()
    texts = texts.select("hash", "check", "line")
    earlier = texts.select(F.col("hash").alias("earlier"), F.col("check").alias("earlier_check"), F.col("line").alias("earlier_line"))
    sides = pairs.join(texts, ["hash", "check"]).join(earlier, ["earlier", "earlier_check"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array([near_lines(x, y) for x, y in zip(batch.column("line").to_pylist(), batch.column("earlier_line").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("hash", "check")], names=["hash", "check"])

    return sides.select("hash", "check", "line", "earlier_line").mapInArrow(verify, "hash long, check long").distinct()


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def line_decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``key`` (the text's hash), ``line_no`` (from 0, blank lines count), ``repeated`` and ``near`` of every line with words; either sends it away."""
    docs = _keyed(df, id_col, text_col)
    lines = settled(line_keys(docs))
    place = F.struct("id", "line_no", "key")
    firsts = lines.groupBy("hash", "check").agg(F.min(place).alias("first"))

    halves = lines.select("hash", F.explode("halves").alias("half"))
    shared = settled(halves.groupBy("half").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).filter("least < most").select("half"))
    near = settled(_near(settled(_texts(docs, _filter(shared)))))

    marked = firsts.join(near.withColumn("near", F.lit(True)), ["hash", "check"], "left").select(apart_from_its_rows("hash"), "check", "first", F.coalesce("near", F.lit(False)).alias("near"))
    return lines.select("id", "key", "line_no", "hash", "check").join(marked, ["hash", "check"]).select("id", "key", "line_no", (F.col("first") < place).alias("repeated"), "near")


def _counts(df: DataFrame, id_col: str, text_col: str, **options: object) -> DataFrame:
    """``of``, ``of_key`` and the results of :func:`line_counts` of every distinct row."""
    found = line_decisions(df, id_col, text_col, **options).distinct()
    gone = F.col("repeated") | F.col("near")
    counts = found.groupBy("id", "key").agg(
        F.count("*").alias("n_lines"),
        F.count_if("repeated").alias("n_repeated"),
        F.count_if(~F.col("repeated") & F.col("near")).alias("n_near"),
        F.array_sort(F.collect_list(F.when(gone, F.col("line_no")))).alias("dropped"),
    )
    rows = df.select(F.col(id_col).alias("of"), F.xxhash64(text_col).alias("of_key")).distinct()
    out = rows.join(counts, (F.col("of_key") == F.col("key")) & F.col("of").eqNullSafe(F.col("id")), "left")
    none = F.array().cast("array<int>")
    return out.select("of", "of_key", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_lines", "n_repeated", "n_near")), F.coalesce("dropped", none).alias("dropped"))


def line_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """Per id and text: the id, ``n_lines`` (with words), ``n_repeated``, ``n_near`` (of those not repeated) and ``dropped``, the numbers of the lines that go."""
    return _counts(df, id_col, text_col, **options).select(F.col("of").alias(id_col), "n_lines", "n_repeated", "n_near", "dropped")


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``df`` without the lines that go; a null text stays null."""
    n = apart(df, "of", "of_key", "dropped", "row_key", "lines")
    counts = _counts(df, id_col, text_col, **options).select(*(F.col(c).alias(n[c]) for c in ("of", "of_key", "dropped")))
    keyed = df.withColumn(n["row_key"], F.xxhash64(text_col))
    joined = keyed.join(counts, (F.col(n["row_key"]) == F.col(n["of_key"])) & F.col(id_col).eqNullSafe(F.col(n["of"])))
    lines = F.split(text_col, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), n["dropped"])
    cut = F.array_join(F.transform(kept, lambda i: F.get(n["lines"], i)), "\n")
    return joined.withColumn(n["lines"], lines).withColumn(text_col, F.when(F.size(n["dropped"]) > 0, cut).otherwise(F.col(text_col))).select(*df.columns)

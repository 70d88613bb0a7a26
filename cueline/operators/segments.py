"""Subtitle and bilingual text lines as ordered segments.

A segments table has ``item_id``, ``idx`` (from 0), ``start_ms``, ``end_ms``, ``target_text`` and
``native_text``. Places and ends come from range sorts (:mod:`cueline.operators.ordered`), so an item may have any number of cues.
Only the lines of a text that stands in one row are numbered by a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions import text
from cueline.operators.ordered import in_order

#: How long the last cue lasts when the media's length is unknown.
LAST_MS = 5000


def cues(lines: DataFrame, delimiter: str = "|||", strategy: str = "last", line: str = "line") -> DataFrame:
    """``start_ms``, ``target_text`` and ``native_text`` of the lines that are cues and have a native part."""
    kept = [c for c in lines.columns if c != line]
    return lines.select(*kept, F.inline(text.parsed_cue(F.col(line), delimiter, strategy)))


def segments(found: DataFrame, tie: Sequence[str] = ("line_no",), item: str = "item_id", duration: Column | None = None) -> DataFrame:
    """Cues in time order (ties in file order), each ending where the next begins.

    The last one ends at ``duration``, or ``LAST_MS`` after its start if that is unknown.
    """
    length = F.lit(None) if duration is None else duration
    cut = found.select(item, "start_ms", "target_text", "native_text", *(F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)), length.cast("bigint").alias("_length"))
    placed = in_order(cut, item, ["start_ms", *(f"_tie{i}" for i in range(len(tie)))], "idx", leads={"_next": "start_ms"})
    end = F.coalesce("_next", "_length", F.col("start_ms") + LAST_MS).cast("bigint")
    return placed.select(item, "idx", "start_ms", end.alias("end_ms"), "target_text", "native_text")


def text_segments(lines: DataFrame, delimiter: str = "|||", strategy: str = "last", item: str = "item_id", order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Segments of bilingual text: lines with both parts, in order, without times."""
    target, native = text.split_bilingual(F.col("line"), delimiter, strategy)
    both = lines.withColumns({"target_text": target, "native_text": native}).filter("target_text <> '' AND native_text <> ''")
    zero = F.lit(0).cast("bigint")
    place = (F.row_number().over(Window.partitionBy(item).orderBy(*order)) - 1).cast("bigint")
    return both.select(item, place.alias("idx"), zero.alias("start_ms"), zero.alias("end_ms"), "target_text", "native_text")


def described(table: DataFrame) -> DataFrame:
    """With ``start_sec``, ``end_sec``, ``duration_ms`` and a one-line ``label``."""
    short = F.concat(F.lit("Segment("), F.col("idx").cast("string"), F.lit(", "), text.clock(F.col("start_ms")), F.lit(" - "), text.clock(F.col("end_ms")), F.lit(", "), text.preview(F.col("target_text"), 20), F.lit(" / "), text.preview(F.col("native_text"), 20), F.lit(")"))
    return table.withColumns(
        {"start_sec": F.col("start_ms") / F.lit(1000.0), "end_sec": F.col("end_ms") / F.lit(1000.0), "duration_ms": F.col("end_ms") - F.col("start_ms"), "label": short}
    )


def slices(table: DataFrame, track_ms: Column) -> DataFrame:
    """The part of the track that each segment covers, inside the track; never of negative length."""
    low, high = F.greatest(F.lit(0), F.col("start_ms")), F.least(track_ms, F.col("end_ms"))
    return table.withColumns({"from_ms": low.cast("bigint"), "to_ms": high.cast("bigint"), "length_ms": F.greatest(high - low, F.lit(0)).cast("bigint")})


def pcm_slice(pcm: Column, from_ms: Column, to_ms: Column, frame_rate: Column, frame_bytes: Column) -> Column:
    """Bytes of raw sound between two times."""
    at = lambda ms: F.floor(ms * frame_rate / 1000) * frame_bytes
    return F.substr(pcm, (at(from_ms) + 1).cast("int"), F.greatest(at(to_ms) - at(from_ms), F.lit(0)).cast("int"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """User turns that an assistant's follows, as target and native text of an item."""
    ahead = in_order(conversations.select("conv_id", "turn", "role", "text"), "conv_id", ["turn"], leads={"_role": "role", "native_text": "text"})
    pairs = ahead.filter("role = 'user' AND _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("target_text"), "native_text")
    return in_order(pairs, "conv_id", ["turn"], "idx").select("conv_id", "idx", "target_text", "native_text")

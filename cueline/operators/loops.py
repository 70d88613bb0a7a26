"""Repetition loops over segments: parts, offsets in the new track, and re-timed subtitle lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions import text
from cueline.operators.ordered import in_order


@dataclass(frozen=True)
class Timing:
    """Pauses in seconds after the first target, the native and the second target clip."""

    after_first_target: float = 0.8
    after_native: float = 0.5
    after_second_target: float = 1.2

    def pauses(self) -> tuple[Column, Column, Column]:
        return tuple(text.seconds_to_ms(F.lit(s)) for s in (self.after_first_target, self.after_native, self.after_second_target))


#: Passes of a variant: True where the native clip is played, False where it is silent. Others are like ``full``.
PASSES = {"full": (True,), "shadow": (False,), "progressive": (True, False)}


def passes(variant: str) -> tuple[bool, ...]:
    return PASSES.get(variant, PASSES["full"])


def with_clips(segments: DataFrame, clips: DataFrame, item: str = "item_id") -> DataFrame:
    """Segments with ``target_ms`` and ``native_ms`` of ``clips`` (``item``, ``idx``, both lengths); each must have its clips."""
    return segments.join(clips, [item, "idx"])


def unmatched(segments: DataFrame, clips: DataFrame, item: str = "item_id") -> DataFrame:
    """Per item, the numbers of segments without clips and of clips without a segment, where there are any."""
    sides = segments.select(item, "idx", F.lit(1).alias("s")).join(clips.select(item, "idx", F.lit(1).alias("c")), [item, "idx"], "full")
    counts = sides.groupBy(item).agg(F.count_if(F.col("c").isNull()).alias("no_clip"), F.count_if(F.col("s").isNull()).alias("no_segment"))
    return counts.filter("no_clip + no_segment > 0")


def loop_ms(timing: Timing = Timing()) -> Column:
    """Length of one pass: the target twice, the native once, three pauses."""
    first, second, third = timing.pauses()
    return F.col("target_ms") * 2 + F.col("native_ms") + first + second + third


def loop_parts(table: DataFrame, timing: Timing = Timing(), variant: str = "full") -> DataFrame:
    """A row for each part of each pass: ``pass``, ``part``, ``kind`` and ``part_ms``."""
    first, second, third = timing.pauses()
    part = lambda kind, ms: F.struct(F.lit(kind).alias("kind"), ms.cast("bigint").alias("part_ms"))
    rounds = [
        F.struct(
            F.lit(i).alias("pass"),
            F.array(
                part("target", F.col("target_ms")), part("silence", first),
                part("native" if spoken else "silence", F.col("native_ms")), part("silence", second),
                part("target", F.col("target_ms")), part("silence", third),
            ).alias("parts"),
        )
        for i, spoken in enumerate(passes(variant))
    ]
    rows = table.withColumn("_round", F.explode(F.array(*rounds)))
    return rows.select(*table.columns, "_round.pass", F.posexplode("_round.parts").alias("part", "_part")).select(*table.columns, "pass", "part", "_part.*")


def loop_offsets(table: DataFrame, timing: Timing = Timing(), variant: str = "full", item: str = "item_id") -> DataFrame:
    """A row for each pass of each segment: ``pass``, ``loop_ms`` and ``pos_ms``, where it begins in the new track."""
    n = len(passes(variant))
    rows = in_order(table.withColumn("loop_ms", loop_ms(timing).cast("bigint")), item, ["idx"], sums={"_before": "loop_ms"})
    # All passes of a segment are equally long.
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("pos_ms", F.col("_before") * n + F.col("pass") * F.col("loop_ms")).drop("_before")


def track_lengths(offsets: DataFrame, item: str = "item_id") -> DataFrame:
    """Length of each item's new track."""
    return offsets.groupBy(item).agg(F.sum("loop_ms").alias("track_ms"), F.countDistinct("idx").alias("n_segments"))


def retimed_lines(offsets: DataFrame, delimiter: str = "|||") -> DataFrame:
    """``line`` of the new subtitles for each pass: its time, then target and native text."""
    return offsets.withColumn("line", F.concat(text.lrc_stamp(F.col("pos_ms")), F.col("target_text"), F.lit(delimiter), F.col("native_text")))

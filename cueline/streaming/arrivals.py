"""Subtitle files as they arrive: re-timed incrementally with a Structured Streaming file source.

A file arrives whole, as one row, so a micro-batch holds all cues of its files and windows
within a file are complete. The stream's checkpoint remembers which files were read; that takes
the place of looking for results that exist already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cueline.operators import loops, media, segments
from cueline.sources import files

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.lrc", per_batch: int = 1000) -> DataFrame:
    """A stream of ``item_id`` (the path) and ``content``."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch)
    return reader.load(folder).select(F.col("path").alias("item_id"), F.decode("content", "UTF-8").alias("content"))


Lengths = Callable[[DataFrame], DataFrame]


def retimed(batch: DataFrame, timing: loops.Timing = loops.Timing(), variant: str = "full", delimiter: str = "|||", lengths: Lengths = media.stub_lengths) -> DataFrame:
    """Re-timed lines of whole files (``item_id``, ``content``). ``lengths`` adds ``target_ms`` and ``native_ms`` to segments: those of real clips, or the stand-in voice's."""
    cues = segments.cues(files.numbered_lines(batch), delimiter)
    offsets = loops.loop_offsets(lengths(segments.segments(cues)), timing, variant)
    return loops.retimed_lines(offsets, delimiter).select("item_id", "idx", "pass", "line")


def retime_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, variant: str = "full", delimiter: str = "|||", lengths: Lengths = media.stub_lengths) -> StreamingQuery:
    """Reads what has arrived, writes its lines as Parquet under ``out`` and ends.

    A batch that is run again overwrites its own folder, so each file's lines are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        retimed(batch, variant=variant, delimiter=delimiter, lengths=lengths).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

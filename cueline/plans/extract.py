"""Sound from a folder's media files: which chunks of which files, by which commands, and what became of each file."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions import paths
from cueline.functions.workers import reach_package, written
from cueline.operators import media
from cueline.sources import files, sinks


def probe(path: str) -> str:
    """What a probe prints for a media file: its length in seconds; empty if it cannot be run or reports a failure."""
    arguments = ["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "default=noprint_wrappers=1:nokey=1", path]
    try:
        done = subprocess.run(arguments, capture_output=True, text=True, check=False)
        return done.stdout if done.returncode == 0 else ""
    except OSError:
        return ""


def durations(found: DataFrame, ask: Callable[[str], str] = probe) -> DataFrame:
    """A listing with ``duration_s``, as ``ask`` prints it for each file's path, in tasks; 0 where it fails."""
    reach_package(found.sparkSession)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            places = (f"{d}/{n}" for d, n in zip(frame["dir"], frame["name"], strict=True))
            yield frame.assign(printed=[ask(p.removeprefix("file:")) for p in places])

    return found.mapInPandas(run, "dir string, name string, size bigint, printed string").withColumn("duration_s", media.probed_duration(F.col("printed"))).drop("printed")


def extraction_plan(found: DataFrame, split_over: float = media.SPLIT_OVER_S, chunk: float = media.CHUNK_S, bitrate: str = "192k", sample_rate: int = 44100) -> DataFrame:
    """A row for each output of a listing with ``duration_s``: ``dir``, ``source``, chunk columns and ``command``."""
    rows = media.chunk_plan(found.withColumn("stem", paths.stem(F.col("name"))), split_over, chunk).withColumnRenamed("name", "source")
    place = lambda c: F.regexp_replace(F.concat_ws("/", "dir", c), "^file:", "")
    command = sinks.extract_command(place("source"), place("output"), F.lit(bitrate), F.lit(sample_rate), F.col("start_s"), F.col("length_s"))
    return rows.withColumn("command", command)


def extract_folder(
    spark: SparkSession, folder: str, overwrite: bool = False, split_over: float = media.SPLIT_OVER_S, chunk: float = media.CHUNK_S, bitrate: str = "192k", sample_rate: int = 44100,
    ask: Callable[[str], str] = probe, run: Callable[[list[str]], str | None] | None = None,
) -> DataFrame:
    """Runs the commands of a folder's media files; ``dir``, ``source``, ``status`` (``ok``, ``skipped``, ``failed``), ``outputs`` and ``error`` of each file.

    Files whose outputs exist are skipped. Commands run once: their outcomes are written to the shared folder.
    """
    listed = written(files.listing(spark, folder))
    known = files.media_listing(listed)
    plan = extraction_plan(written(durations(known, ask) if split_over > 0 else known.withColumn("duration_s", F.lit(0.0))), split_over, chunk, bitrate, sample_rate)
    status = media.extract_status(plan, listed, overwrite=overwrite)
    todo = plan.join(status.filter("status = 'run'"), ["dir", "source"], "left_semi")
    done = sinks.executed(todo) if run is None else sinks.executed(todo, run)
    skipped = status.filter("status = 'skipped'").select("dir", "source", "status", F.array().cast("array<string>").alias("outputs"), F.lit(None).cast("string").alias("error"))
    return written(done.unionByName(skipped))

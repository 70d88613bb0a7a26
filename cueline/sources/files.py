"""Readers: folder listings and whole text files as tables of numbered lines.

Listings read no content. Files are read whole, so that a
file's lines keep their numbers, and a leading byte-order mark stays in its first line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions import paths, text
from cueline.sources.folders import folder_files


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``dir``, ``name``, ``size`` of the regular files of one folder, of any name, empty ones included. No content is read."""
    return folder_files(spark, folder)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def leaf(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def media_listing(files: DataFrame) -> DataFrame:
    """Audio and video files of a listing, by name."""
    known = [*paths.VIDEO, *paths.AUDIO, *paths.EXTRA_AUDIO]
    return files.filter(paths.extension(F.col("name")).isin(*known)).orderBy("dir", "name")


def text_files(spark: SparkSession, folder: str, pattern: str | None = None, names: Sequence[str] = ()) -> DataFrame:
    """``item_id`` (the path) and ``content`` of a folder's whole files whose names are among ``names``, or match the regular expression ``pattern``."""
    read = folder_files(spark, folder, "content", pattern=pattern or "")
    if names:
        read = read.filter(F.col("name").isin(*names))
    return read.select(F.concat_ws("/", "dir", "name").alias("item_id"), F.decode("content", "UTF-8").alias("content"))


def numbered_lines(files: DataFrame, item: str = "item_id", content: str = "content") -> DataFrame:
    """A row for each line that is not blank: ``item``, ``line_no`` (from 0, blank lines count) and ``line``, trimmed."""
    lines = files.select(item, F.posexplode(text.lines_of(F.col(content))).alias("line_no", "line"))
    return lines.withColumn("line", text.strip_all(F.col("line"))).filter("line <> ''")


def without_comments(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.startswith("line", F.lit("#")))

"""Work lists from folder listings: pairing, skipping what is done, and what a run came to."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions import paths, text
from cueline.functions.workers import written
from cueline.operators.ordered import in_order


def work_items(files: DataFrame, mode: str = "") -> DataFrame:
    """Items of a listing (``dir``, ``name``): sound with its subtitles, then texts that stand alone.

    Results: ``dir``, ``kind_ord``, ``mode``, ``stem``, ``audio``, ``lrc``, ``text``. Subtitles pair by folder and stem, and only
    with a lower-case ``.lrc``. Of several sound files of one stem the one with the last extension
    is taken. A text is left out if its stem was paired; in mode ``text`` nothing is paired.
    An unknown mode is any mode.
    """
    mode = mode if mode in ("audio", "text") else ""
    name = F.col("name")
    files = files.select("dir", "name", paths.extension(name).alias("ext"), paths.stem(name).alias("stem")).filter(~paths.is_result(name))
    none = F.lit(None).cast("string")
    sound = files.filter(F.col("ext").isin(*paths.AUDIO)).groupBy("dir", "stem").agg(F.max_by("name", F.struct("ext", "name")).alias("audio"))
    subtitles = files.filter(F.endswith("name", F.lit(f".{paths.SUBTITLE}"))).select("dir", "stem", F.col("name").alias("lrc"))
    paired = sound.join(subtitles, ["dir", "stem"])
    audio = paired.select("dir", F.lit(0).alias("kind_ord"), F.lit("audio").alias("mode"), "stem", "audio", "lrc", none.alias("text"))
    texts = files.filter(F.col("ext") == paths.TEXT)
    if mode != "text":
        texts = texts.join(paired, ["dir", "stem"], "left_anti")
    text_items = texts.select("dir", F.lit(1).alias("kind_ord"), F.lit("text").alias("mode"), "stem", none.alias("audio"), none.alias("lrc"), name.alias("text"))
    if mode == "audio":
        return audio
    return text_items if mode == "text" else audio.unionByName(text_items)


def unpaired(files: DataFrame) -> DataFrame:
    """Sound files without subtitles."""
    name = F.col("name")
    sound = files.filter(paths.extension(name).isin(*paths.AUDIO) & ~paths.is_result(name)).withColumn("stem", paths.stem(name))
    subtitles = files.filter(F.endswith(name, F.lit(f".{paths.SUBTITLE}"))).select("dir", paths.stem(name).alias("stem"))
    return sound.join(subtitles, ["dir", "stem"], "left_anti").select("dir", "name")


def label() -> Column:
    """The file that an item is called by."""
    return F.coalesce(F.when(F.col("mode") == "audio", F.col("audio")).when(F.col("mode") == "text", F.col("text")), F.lit("unknown"))


def planned(items: DataFrame, files: DataFrame, ext: str = "m4a", overwrite: bool = False) -> DataFrame:
    """Items with ``audio_out``, ``lrc_out`` and ``skipped``: both results are there already, and may stay."""
    audio_out, lrc_out = paths.result_names(label(), ext)
    out = items.withColumns({"audio_out": audio_out, "lrc_out": lrc_out})
    there = files.select("dir", "name").distinct()
    for column in ("audio_out", "lrc_out"):
        out = out.join(there.select("dir", F.col("name").alias(column), F.lit(True).alias(f"_{column}")), ["dir", column], "left")
    done = F.coalesce(F.col("_audio_out") & F.col("_lrc_out"), F.lit(False)) & (not overwrite)
    return out.withColumn("skipped", done).drop("_audio_out", "_lrc_out")


def colliding(items: DataFrame) -> DataFrame:
    """Stems of which more than one item would write the same results."""
    return items.groupBy("dir", "stem").agg(F.count("*").alias("n")).filter("n > 1")


def scan_summary(items: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each group: numbers by mode and a line that says them."""
    counts = items.groupBy(*by).agg(F.count_if(F.col("mode") == "audio").alias("n_audio"), F.count_if(F.col("mode") == "text").alias("n_text"))
    some = lambda n, what: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {what} item"), F.when(F.col(n) == 1, "").otherwise("s")))
    said = F.concat_ws(", ", some("n_audio", "audio"), some("n_text", "text"))
    return counts.withColumn("summary", F.when(said == "", "no items").otherwise(said))


def run_outcomes(runs: DataFrame) -> DataFrame:
    """Counts by ``status`` of a run's items."""
    return runs.groupBy("status").agg(F.count("*").alias("n"), F.sum("elapsed_s").alias("elapsed_s"))


def failures(runs: DataFrame, limit: int = 100) -> DataFrame:
    """Failed items with the last line of their error, shortened."""
    last = F.element_at(F.split(text.strip_all(F.col("error")), "\n"), -1)
    return runs.filter("status = 'failed'").select("item", text.shortened(last, limit).alias("error"))


def checkpoints(rows: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """The rows at which a group's progress enters a new tenth, with ``current`` and ``total``, and its last row."""
    totals = written(rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("total")))
    placed = in_order(rows, group, order, "_place").withColumn("current", F.col("_place") + 1).drop("_place")
    numbered = placed.join(totals, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    tenth = lambda n: F.floor(n * 10 / F.col("total"))
    return numbered.filter((tenth(F.col("current")) > tenth(F.col("current") - 1)) | (F.col("current") == F.col("total")))


def first_rows(rows: DataFrame, group: str, order: tuple[str, ...], shown: Column, n: int = 3) -> DataFrame:
    """The first ``n`` rows of each group, cut to 40 characters, and how many more there are."""
    window = Window.partitionBy(group).orderBy(*order)
    counted = rows.withColumns({"_idx": F.row_number().over(window) - 1, "_n": F.count("*").over(Window.partitionBy(group))})
    return counted.filter(F.col("_idx") < n).select(group, F.col("_idx").alias("idx"), text.preview(shown, 40).alias("shown"), F.greatest(F.col("_n") - n, F.lit(0)).alias("more"))


def log_lines(outcomes: DataFrame, at: datetime) -> DataFrame:
    """A ``line`` of a log file for each item's outcome: time, level and what became of it."""
    failed, skipped = F.col("status") == "failed", F.col("status") == "skipped"
    level = F.rpad(F.when(failed, "ERROR").when(F.col("n_fallback") > 0, "WARNING").otherwise("INFO"), 7, " ")
    silent = F.when(F.col("n_fallback") > 0, F.concat(F.lit(", "), F.col("n_fallback").cast("string"), F.lit(" clips became silence"))).otherwise("")
    said = F.when(failed, F.concat(F.lit("failed: "), F.coalesce("error", F.lit("")))).when(skipped, "skipped, its results exist")
    said = F.coalesce(said, F.concat(F.col("n_segments").cast("string"), F.lit(" segments in "), F.format_string("%.1f", "elapsed_s"), F.lit(" s"), silent))
    return outcomes.select("item", F.lit("").alias("path"), F.concat(F.lit(f"{at:%Y-%m-%d %H:%M:%S} ["), level, F.lit("] "), "item", F.lit(": "), said).alias("line"))

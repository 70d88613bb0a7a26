"""Plans for media work: chunks of long files, volume changes, clip fallbacks and synthesis requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions import paths, text

#: Files over so many seconds are cut into chunks of so many; a last chunk under this part of one joins the one before.
SPLIT_OVER_S, CHUNK_S, SHORT_LAST = 900.0, 600.0, 0.3
#: Below this loudness (dBFS) a clip is taken for silent and not normalised. A missing clip is so many ms of silence.
SILENT_DBFS, MISSING_MS = -60.0, 500


def probed_duration(output: Column) -> Column:
    """Seconds that a probe printed; 0 if it failed."""
    return F.coalesce(text.strip_all(output).try_cast("double"), F.lit(0.0))


def chunk_count(duration: Column, split_over: float = SPLIT_OVER_S, chunk: float = CHUNK_S) -> Column:
    """1 for a file that stays whole; null for a chunk length that is not positive."""
    if chunk <= 0:
        return F.lit(None).cast("bigint")
    full = F.floor(duration / chunk)
    rest = duration % chunk
    joined = (rest > 0) & (rest < F.lit(chunk * SHORT_LAST)) & (full > 0)
    whole = (F.lit(split_over) <= 0) | (duration <= 0) | (duration <= F.lit(split_over))
    return F.when(whole, F.lit(1)).otherwise(F.when(joined, full).otherwise(F.ceil(duration / chunk))).cast("bigint")


def chunk_plan(media: DataFrame, split_over: float = SPLIT_OVER_S, chunk: float = CHUNK_S) -> DataFrame:
    """A row for each chunk of ``media`` (``stem``, ``duration_s``): ``n_chunks``, ``chunk_no``, ``output``, ``start_s`` and ``length_s``.

    A whole file has a null start; the last chunk runs to the end and has a null length.
    """
    rows = media.withColumn("n_chunks", chunk_count(F.col("duration_s"), split_over, chunk)).withColumn("chunk_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_chunks"))))
    many = F.col("n_chunks") > 1
    split = many | ((F.col("duration_s") > split_over) & F.lit(split_over > 0))
    name = F.when(split, paths.numbered_name(F.col("stem"), F.col("chunk_no"), F.col("n_chunks"), "mp3")).otherwise(F.concat("stem", F.lit(".mp3")))
    return rows.withColumns(
        {
            "output": name,
            "start_s": F.when(split, (F.col("chunk_no") - 1) * F.lit(float(chunk))),
            "length_s": F.when(split & (F.col("chunk_no") < F.col("n_chunks")), F.lit(float(chunk))),
        }
    )


def extract_status(plan: DataFrame, existing: DataFrame, source: str = "source", overwrite: bool = False) -> DataFrame:
    """Per ``source`` of a chunk plan: ``skipped`` if every output exists (and may stay), or if a whole file would overwrite itself.

    Where the plan has a ``dir``, outputs are looked for in it, and files of one name in two folders are told apart.
    """
    by = [c for c in ("dir",) if c in plan.columns]
    itself = (F.col("n_chunks") == 1) & (F.col("output") == F.col(source))
    # A source's chunks are counted where they are made; only outputs that are not there go on from the join.
    planned = plan.select(*by, source, itself.alias("_itself"), F.lit(1).cast("bigint").alias("_n"), F.lit(False).alias("_missing"))
    absent = plan.select(*by, "output", source).join(existing.select(*by, F.col("name").alias("output")), [*by, "output"], "left_anti")
    absent = absent.select(*by, source, F.lit(False).alias("_itself"), F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_missing"))
    found = planned.unionByName(absent).groupBy(*by, source).agg(F.bool_or("_missing").alias("_missing"), F.bool_or("_itself").alias("_itself"), F.sum("_n").alias("n_outputs"))
    skipped = (~F.col("_missing") & (not overwrite)) | F.col("_itself")
    return found.select(*by, source, F.when(skipped, "skipped").otherwise("run").alias("status"), "n_outputs")


def applied_gain(dbfs: Column, gain: Column, normalize: Column) -> Column:
    """dB to apply: to the normal loudness if one is set (nothing for a silent clip), else the gain."""
    return F.when(normalize.isNotNull(), F.when(dbfs > SILENT_DBFS, normalize - dbfs).otherwise(F.lit(0.0))).otherwise(F.coalesce(gain, F.lit(0.0)))


def volume_label(gain: Column, normalize: Column) -> Column:
    sign = F.when(gain > 0, F.lit("+")).otherwise(F.lit(""))
    return (
        F.when(normalize.isNotNull(), F.concat(F.lit("normalize to "), normalize.cast("string"), F.lit(" dBFS")))
        .when(gain != 0, F.concat(sign, gain.cast("string"), F.lit(" dB")))
        .otherwise("default")
    )


def usable(size: Column) -> Column:
    """A clip that exists and is not empty."""
    return F.coalesce(size > 0, F.lit(False))


def clip_lengths(wanted: DataFrame, clips: DataFrame, keys: tuple[str, ...] = ("item_id", "idx", "side")) -> DataFrame:
    """``wanted`` with ``clip_ms`` and ``fallback``: the clip's length, or silence where it is missing or empty."""
    found = clips.filter(usable(F.col("size"))).select(*keys, F.col("duration_ms").alias("_ms"))
    return wanted.join(found, list(keys), "left").withColumns({"clip_ms": F.coalesce("_ms", F.lit(MISSING_MS)).cast("bigint"), "fallback": F.col("_ms").isNull()}).drop("_ms")


def fallback_summary(lengths: DataFrame, group: str, idx: str = "idx", shown: int = 8) -> DataFrame:
    """Per group with silent gaps: ``n_fallback``, ``total`` and the first indices with how many more."""
    counts = lengths.groupBy(group).agg(F.count_if("fallback").alias("n_fallback"), F.count("*").alias("total"))
    # The tasks keep the first of each group before they shuffle, so that no task or row gets all of a large group.
    place = F.row_number().over(Window.partitionBy(group).orderBy(idx))
    firsts = lengths.filter(F.col("fallback") & F.col(idx).isNotNull()).select(group, idx).withColumn("_place", place).filter(F.col("_place") <= shown)
    firsts = firsts.groupBy(F.col(group).alias("_of")).agg(F.array_sort(F.collect_list(idx)).alias("_at"))
    counts = counts.join(firsts, F.col(group).eqNullSafe(F.col("_of")), "left")
    first = F.coalesce(F.array_join(F.transform("_at", lambda i: i.cast("string")), ", "), F.lit(""))
    more = F.when(F.col("n_fallback") > shown, F.concat(F.lit(", ... ("), (F.col("n_fallback") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return counts.filter("n_fallback > 0").select(group, "n_fallback", "total", F.concat(first, more).alias("indices"))


def requests(table: DataFrame, side: str, voice: Column, speed: Column, pitch: Column, instructions: Column, engine: Column | None = None) -> DataFrame:
    """What is asked of a speech engine for one side: options that are at their defaults, or that a voice rejects, are null."""
    spoken = F.col("target_text") if side == "target" else F.col("native_text")
    return table.withColumns(
        {
            "side": F.lit(side),
            "spoken": spoken,
            "engine": F.lit(None).cast("string") if engine is None else engine,
            "voice": voice,
            "language": paths.voice_language(voice),
            "speaking_rate": F.when(speed != 1.0, speed),
            "pitch": F.when((pitch != 0.0) & ~F.contains(voice, F.lit("Chirp3")), pitch),
            "instructions": F.nullif(instructions, F.lit("")),
            "clip": paths.clip_name(F.lit(side), F.col("idx")),
        }
    )


def stub_lengths(table: DataFrame) -> DataFrame:
    """Lengths of a stand-in voice, which speaks a character in fixed time: 60 ms (target) and 80 ms (native), and 200 ms more."""
    return table.withColumns({"target_ms": (F.length("target_text") * 60 + 200).cast("bigint"), "native_ms": (F.length("native_text") * 80 + 200).cast("bigint")})

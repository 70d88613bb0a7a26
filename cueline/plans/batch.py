"""Whole runs: from a folder's listing, or one item, to new tracks, re-timed subtitles, and what became of each item.

A run's steps are queries over all its items: lines to segments, slices of the source sound, requests to the speech
engines, repetition loops, tracks. Speech is asked for once: its clips are written to the shared folder before lengths
and tracks are made of them. An item that fails does so alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions import paths, text
from cueline.functions.workers import written, written_and_counted
from cueline.operators import loops, media, scan, segments, settings
from cueline.sources import files, sinks, sound, voices

#: Names of subtitles and texts.
TEXTS = r"\.(lrc|[tT][xX][tT])$"
#: Voices by engine where the caller brings none.
STAND_INS: dict[str, voices.Voice] = dict.fromkeys(("edge", "openai", "google"), sound.stand_in_voice)


def timing_of(run: Mapping) -> loops.Timing:
    return loops.Timing(*(run["timing"][k] for k in ("after_first_target", "after_native", "after_second_target")))


def folder_items(spark: SparkSession, folder: str, mode: str = "", ext: str = "m4a", done: DataFrame | None = None) -> DataFrame:
    """The work list of a folder with its results' names. Results are looked for in the listing ``done``, by default the folder's own."""
    # As the folder is when the run begins: its results will lie there too.
    listed = written(files.listing(spark, folder))
    at = listed.first()
    existing = listed if done is None or at is None else done.select(F.lit(at["dir"]).alias("dir"), "name")
    return scan.planned(scan.work_items(listed, mode), existing, ext).withColumn("item_id", F.concat_ws("/", "dir", scan.label()))


def single_item(spark: SparkSession, run: Mapping) -> DataFrame:
    """The one item of a run that names its files, with its results' names: explicit ones, else beside the source."""
    named = run["paths"]
    mode = spark.range(1).select(settings.mode_of(run).alias("mode")).first()["mode"]
    if mode not in ("audio", "text"):
        raise ValueError("no input: give a sound file with its subtitles, a text, or a folder to scan")
    source = named["audio" if mode == "audio" else "text"]
    folder = source.rpartition("/")[0]
    name = lambda p: (p or "").rpartition("/")[2] or None
    rows = [(folder, 0 if mode == "audio" else 1, mode, name(named["audio"]), name(named["lrc"]), name(named["text"]), source, named["output"], named["output_lrc"], run["output"]["format"])]
    kept = [(d, k, m, a if m == "audio" else None, c if m == "audio" else None, t if m == "text" else None, *rest) for d, k, m, a, c, t, *rest in rows]
    df = spark.createDataFrame(kept, "dir string, kind_ord int, mode string, audio string, lrc string, text string, source string, output string, output_lrc string, ext string")
    audio_out, lrc_out = paths.output_paths(F.col("mode"), F.col("source"), F.col("output"), F.col("output_lrc"), F.col("ext"))
    return df.select("dir", "kind_ord", "mode", paths.stem(scan.label()).alias("stem"), "audio", "lrc", "text", audio_out.alias("audio_out"), lrc_out.alias("lrc_out"), F.lit(False).alias("skipped"), F.col("source").alias("item_id"))


def item_segments(spark: SparkSession, folder: str, items: DataFrame, delimiter: str = "|||", strategy: str = "last", lengths: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Segments of all items: cues of paired subtitles (the last one ends with the sound, where ``lengths`` has its ``duration_ms``) and lines of texts.

    Subtitles and texts are read from ``folder``: those of ``names``, or all with their endings.
    """
    contents = files.text_files(spark, folder, names=names) if names else files.text_files(spark, folder, TEXTS)
    contents = contents.select(files.leaf(F.col("item_id")).alias("name"), "content")
    sources = items.select("item_id", "mode", F.coalesce("lrc", "text").alias("name"))
    lines = files.numbered_lines(sources.join(contents, "name").select(F.struct("item_id", "mode").alias("item"), "content"), "item")
    lines = lines.select("item.item_id", "item.mode", "line_no", "line")
    cues = segments.cues(lines.filter("mode = 'audio'"), delimiter, strategy)
    cues = cues.withColumn("duration_ms", F.lit(None).cast("bigint")) if lengths is None else cues.join(lengths.select("item_id", "duration_ms"), "item_id", "left")
    texts = files.without_comments(lines.filter("mode = 'text'"))
    return segments.segments(cues, duration=F.col("duration_ms")).unionByName(segments.text_segments(texts, delimiter, strategy))


def _asked(table: DataFrame, run: Mapping, side: str) -> DataFrame:
    """Requests for one side, with the engine's own voice and options."""
    engine, own = run["tts"]["engine"], run["tts"]
    cloud, prompted = run["google"], run["openai"]
    voice = {"google": cloud[f"{side}_voice"], "openai": prompted["voice"]}.get(engine, own[f"{side}_voice"])
    speed = {"google": cloud["speaking_rate"], "openai": prompted["speed"]}.get(engine, 1.0)
    pitch = cloud["pitch"] if engine == "google" else 0.0
    asked = media.requests(table, side, F.lit(voice), F.lit(float(speed)), F.lit(float(pitch)), F.lit(prompted["instructions"] if engine == "openai" else ""), F.lit(engine))
    more = {"rate": own["rate"], "pitch_shift": own["pitch"]} if engine == "edge" else {"model": prompted["model"]} if engine == "openai" else {}
    return asked.select("item_id", "idx", "side", "spoken", "engine", "voice", "language", "speaking_rate", "pitch", "instructions", *(F.lit(v).alias(k) for k, v in more.items()))


def item_clips(table: DataFrame, sounds: DataFrame, run: Mapping, speak: Mapping[str, voices.Voice], decoder: sound.Decoder = sound.read_wav) -> DataFrame:
    """The clips of both sides of all segments: ``item_id``, ``idx``, ``side``, sound, ``error``, ``elapsed_s``; null sound where all attempts failed.

    Targets of an item with a sound (``sounds``: ``item_id`` and its sound) are cut out of it; all else is spoken.
    """
    keys = ["item_id", "idx", "side"]
    cut = segments.slices(table.join(sounds, "item_id"), F.col("duration_ms"))
    pcm = segments.pcm_slice(F.col("pcm"), F.col("from_ms"), F.col("to_ms"), F.col("frame_rate"), F.col("channels") * 2)
    none = F.lit(None).cast("string")
    cut = cut.select("item_id", "idx", F.lit("target").alias("side"), F.col("length_ms").alias("duration_ms"), "frame_rate", "channels", "dbfs", pcm.alias("pcm"), none.alias("error"), F.lit(0.0).alias("elapsed_s"))
    alone = table.join(sounds.select("item_id"), "item_id", "left_anti")
    told = voices.spoken(_asked(table, run, "native").unionByName(_asked(alone, run, "target")), speak, decoder)
    normalize = F.lit(run["tts"]["normalize"]).cast("double")
    gain = media.applied_gain(F.col("dbfs"), F.lit(run["tts"]["gain"]).cast("double"), normalize)
    told = told.withColumn("pcm", F.when(gain == 0, F.col("pcm")).otherwise(sound.amplified("pcm", F.coalesce(gain, F.lit(0.0)))))
    return cut.unionByName(told.select(*keys, *sound.NAMES, "error", "elapsed_s"))


def _parts(table: DataFrame, clips: DataFrame, timing: loops.Timing, variant: str, rate: int) -> DataFrame:
    """``item_id``, ``place``, ``channels`` and ``pcm`` of all parts of all tracks, at one rate and each item's number of channels."""
    channels = clips.groupBy("item_id").agg(F.coalesce(F.max("channels"), F.lit(1)).alias("n"))
    parts = loops.loop_parts(table, timing, variant).select("item_id", "idx", "pass", "part", "kind", "part_ms").join(channels, "item_id")
    heard = clips.filter("pcm IS NOT NULL").select("item_id", "idx", F.col("side").alias("kind"), "frame_rate", "channels", "pcm")
    parts = parts.join(heard, ["item_id", "idx", "kind"], "left")
    pcm = F.coalesce(sound.at_rate("pcm", "frame_rate", "channels", F.lit(rate), F.col("n")), sound.silence(F.col("part_ms"), F.lit(rate), F.col("n")))
    return parts.select("item_id", F.struct("idx", "pass", "part").alias("place"), F.col("n").alias("channels"), pcm.alias("pcm"))


def run_items(
    spark: SparkSession, folder: str, items: DataFrame, run: Mapping, out: str, speak: Mapping[str, voices.Voice] = STAND_INS, decoder: sound.Decoder = sound.read_wav, tool: str = "ffmpeg", texts_in: str | None = None, sound_names: Sequence[str] = (), text_names: Sequence[str] = (), counts: dict[str, object] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Makes the results of all items that are not skipped, below the URI ``out``, which all executors reach.

    Subtitles and texts lie in ``texts_in``, by default in ``folder`` as the sound; ``sound_names`` and ``text_names`` may name the only files to read. ``run`` holds the settings (:func:`settings.of_run`). Returns the re-timed lines, and the outcomes: ``item``, ``status``, ``n_segments``,
    ``n_fallback`` (clips that became silence), ``error``, ``elapsed_s`` (of its speech). ``counts`` is given the run's totals, which the jobs that write
    clips and tracks take on the way: clips, silent ones, seconds of speech, tracks, failed ones, and bytes of both.
    """
    todo = items.filter("NOT skipped")
    wanted = todo.filter("mode = 'audio'").select("item_id", F.col("audio").alias("name"))
    found = sound.decoded(spark, folder, decoder, wanted, sound_names)
    sounds = written(found.withColumn("name", files.leaf(F.col("path"))).join(wanted, "name").select("item_id", *sound.NAMES))
    unread = sounds.filter("pcm IS NULL").select("item_id", F.lit("source sound cannot be decoded").alias("unread"))
    readable = sounds.filter("pcm IS NOT NULL")

    table = item_segments(spark, texts_in or folder, todo, run["lrc"]["delimiter"] or "|||", run["lrc"]["split_strategy"], readable, text_names)
    table = table.join(unread, "item_id", "left_anti")
    silent = F.col("pcm").isNull()
    clips, taken = written_and_counted(
        item_clips(table, readable, run, speak, decoder),
        n_clips=F.count("*"), n_silent=F.coalesce(F.sum(silent.cast("bigint")), F.lit(0)), spoken_s=F.coalesce(F.sum("elapsed_s"), F.lit(0.0)), clip_bytes=F.coalesce(F.sum(F.length("pcm")), F.lit(0)),
    )
    length = lambda side: F.max(F.when(F.col("side") == side, F.coalesce("duration_ms", F.lit(media.MISSING_MS)))).alias(f"{side}_ms")
    table = loops.with_clips(table, clips.groupBy("item_id", "idx").agg(length("target"), length("native")))

    timing, variant, output = timing_of(run), run["loop"]["variant"], run["output"]
    results = todo.select("item_id", "audio_out", "lrc_out")
    parts = _parts(table, clips, timing, variant, int(output["sample_rate"])).join(results, "item_id").withColumnRenamed("audio_out", "path")
    made_all = sinks.write_tracks(parts, out, int(output["sample_rate"]), output["format"], output["bitrate"], tool)
    tracks, more = written_and_counted(made_all, n_tracks=F.count("*"), track_bytes=F.coalesce(F.sum("n_bytes"), F.lit(0)), n_failed_tracks=F.count("error"))
    if counts is not None:
        counts.update(taken | more)
    made = tracks.join(results, F.col("path") == F.col("audio_out")).select("item_id", "n_bytes", F.col("error").alias("track_error"))

    lines = loops.retimed_lines(loops.loop_offsets(table, timing, variant), run["lrc"]["delimiter"] or "|||").select("item_id", "idx", "pass", "pos_ms", "line")
    good = lines.join(made.filter("track_error IS NULL"), "item_id", "left_semi")
    sinks.write_lines(good.join(results, "item_id").withColumnRenamed("lrc_out", "path"), out)

    spoken = clips.groupBy("item_id").agg(F.countDistinct("idx").alias("n_segments"), F.count_if(F.col("pcm").isNull()).alias("n_fallback"), F.sum("elapsed_s").alias("elapsed_s"))
    all_ = items.join(spoken, "item_id", "left").join(made, "item_id", "left").join(unread, "item_id", "left")
    nothing = F.when(F.col("n_segments").isNull(), "no segments found")
    error = F.when(~F.col("skipped"), F.coalesce("unread", nothing, "track_error"))
    outcomes = all_.select(
        F.coalesce(scan.label(), "item_id").alias("item"),
        F.when(F.col("skipped"), "skipped").when(error.isNull(), "succeeded").otherwise("failed").alias("status"),
        F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
        F.coalesce("n_fallback", F.lit(0)).alias("n_fallback"),
        error.alias("error"),
        F.coalesce("elapsed_s", F.lit(0.0)).alias("elapsed_s"),
    )
    return lines, outcomes


def run_folder(spark: SparkSession, folder: str, out: str | None = None, run: Mapping | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """A folder's run. Results go to the URI ``out``, by default the folder itself, and items whose results are there already are skipped."""
    run = run or settings.of_run(spark)
    folder = _uri(spark, folder.rstrip("/"))
    done = None if out is None else written(files.listing(spark, out))
    items = folder_items(spark, folder, run["mode"] or "", run["output"]["format"], done)
    return run_items(spark, folder, items, run, out or folder, **options)


def run_single(spark: SparkSession, run: Mapping, out: str | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """The run of one item that the settings name. Its results' paths are those of the settings, below ``out`` (by default as they are)."""
    item = single_item(spark, run)
    one = item.first()
    # Sound and subtitles may lie in different folders.
    texts_in = (run["paths"]["lrc" if one["mode"] == "audio" else "text"]).rpartition("/")[0]
    names = {"sound_names": [one["audio"]] if one["audio"] else [], "text_names": [one["lrc"] or one["text"]]}
    return run_items(spark, one["dir"] or ".", item, run, out or _uri(spark, "/" if one["audio_out"].startswith("/") else "."), texts_in=texts_in or ".", **names, **options)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _uri(spark: SparkSession, path: str) -> str:
    system, p = _hadoop(spark, path)
    return system.makeQualified(p).toString()


def log_files(outcomes: DataFrame, session: str | None = None) -> DataFrame:
    """``path`` and ``content`` of the run's log: a line for each item with time, level and what became of it."""
    at = datetime.now(UTC)
    session = session or at.strftime("%Y%m%d_%H%M%S")
    return sinks.file_contents(scan.log_lines(outcomes, at), "path", ("item",)).withColumn("path", F.lit(f"echo_run_{session}.log"))


def summary(outcomes: DataFrame) -> DataFrame:
    """Counts and seconds by status."""
    return scan.run_outcomes(outcomes)


def shown_failures(outcomes: DataFrame) -> DataFrame:
    """Failed items with their errors, shortened to a line."""
    return scan.failures(outcomes, 100).withColumn("error", text.shortened(F.col("error"), 100))

"""Column functions over file names and voice names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of audio and video files, of texts and subtitles, and the ending of results' names.
AUDIO = ("mp3", "m4a", "wav", "flac", "ogg", "aac", "wma")
EXTRA_AUDIO = ("m4r",)
VIDEO = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "ts", "m2ts", "mpg", "mpeg", "3gp")
TEXT, SUBTITLE = "txt", "lrc"
RESULT_ENDING = "_echo"


def suffix(name: Column) -> Column:
    """The extension as written, without its dot; '' for names without one or that only begin with a dot."""
    return F.regexp_extract(name, r"[^.].*\.([^.]+)$", 1)


def extension(name: Column) -> Column:
    return F.lower(suffix(name))


def stem(name: Column) -> Column:
    """The name up to the last dot that begins an extension."""
    return F.when(suffix(name) != "", F.substr(name, F.lit(1), F.length(name) - F.length(suffix(name)) - 1)).otherwise(name)


def is_result(name: Column) -> Column:
    """Results of an earlier run, by the (case-sensitive) ending of the stem."""
    return F.endswith(stem(name), F.lit(RESULT_ENDING))


def with_extension(name: Column, ext: str) -> Column:
    return F.concat(stem(name), F.lit(f".{ext}"))


def result_names(name: Column, ext: str) -> tuple[Column, Column]:
    """Names of the audio and the subtitles made from a source file, beside it."""
    base = F.concat(stem(name), F.lit(RESULT_ENDING))
    return F.concat(base, F.lit(f".{ext}")), F.concat(base, F.lit(f".{SUBTITLE}"))


def output_paths(mode: Column, source: Column, explicit: Column, explicit_lrc: Column, ext: Column) -> tuple[Column, Column]:
    """Explicit paths, else beside the source, else fixed names; the subtitles follow the audio's name."""
    named = F.nullif(explicit, F.lit(""))
    folder, name = F.regexp_extract(source, r"^(.*/)?[^/]*$", 1), F.regexp_extract(source, r"([^/]*)$", 1)
    beside = F.when(mode.isin("audio", "text"), F.concat(F.coalesce(folder, F.lit("")), stem(F.nullif(name, F.lit(""))), F.lit(RESULT_ENDING + "."), ext))
    audio = F.coalesce(named, beside, F.concat(F.lit(f"output{RESULT_ENDING}."), ext))
    leaf = F.regexp_extract(audio, r"([^/]*)$", 1)
    swapped = F.concat(F.substr(audio, F.lit(1), F.length(audio) - F.length(leaf)), stem(leaf), F.lit(f".{SUBTITLE}"))
    return audio, F.coalesce(F.nullif(explicit_lrc, F.lit("")), swapped)


def numbered_name(prefix: Column, number: Column, total: Column, ext: str) -> Column:
    """``prefix_NN.ext``, as wide as the total's digits, two at least."""
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    return F.concat(prefix, F.lit("_"), F.lpad(number.cast("string"), width, F.lit("0")), F.lit(f".{ext}"))


def clip_name(prefix: Column, idx: Column) -> Column:
    digits = idx.cast("string")
    return F.concat(prefix, F.lit("_"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")), F.lit(".mp3"))


# Containers that decoders know by the extension.
CONTAINERS = ("mp3", "wav", "m4a", "aac", "ogg", "flac", "wma")


def container(name: Column, named: Mapping[str, str] | None = None) -> Column:
    """The container that a decoder is asked for: by the lower-case extension, as ``named`` calls it; others pass through."""
    known = {c: c for c in CONTAINERS} | dict(named or {})
    ext = extension(name)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), ext), ext)


def voice_language(voice: Column) -> Column:
    """The first two parts of a voice's name; null if it has fewer."""
    parts = F.split(voice, "-")
    return F.when(F.size(parts) >= 2, F.concat_ws("-", F.slice(parts, 1, 2)))

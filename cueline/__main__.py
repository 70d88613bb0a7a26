"""``python -m cueline``: makes the tracks and subtitles of a folder, or of one item, and prints what became of each; ``extract FOLDER`` takes sound out of media files."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from cueline.operators import settings
from cueline.plans import batch, extract
from cueline.sources import sinks

# The options, and the setting (section and name) that each overrides. Options of settings are made from the table of defaults.
OPTIONS: dict[str, tuple[str, str]] = {
    "--text": ("paths", "text"),
    "--scan": ("paths", "scan"),
    "--output": ("paths", "output"),
    "--output-lrc": ("paths", "output_lrc"),
    "--after-first-target": ("timing", "after_first_target"),
    "--after-native": ("timing", "after_native"),
    "--after-second-target": ("timing", "after_second_target"),
    "--variant": ("loop", "variant"),
    "--engine": ("tts", "engine"),
    "--target-voice": ("tts", "target_voice"),
    "--native-voice": ("tts", "native_voice"),
    "--voice": ("tts", "native_voice"),
    "--rate": ("tts", "rate"),
    "--gain": ("tts", "gain"),
    "--normalize": ("tts", "normalize"),
    "--openai-voice": ("openai", "voice"),
    "--openai-instructions": ("openai", "instructions"),
    "--google-voice": ("google", "native_voice"),
    "--google-target-voice": ("google", "target_voice"),
    "--delimiter": ("lrc", "delimiter"),
    "--split-strategy": ("lrc", "split_strategy"),
    "--format": ("output", "format"),
}
SHORT = {"--text": "-t", "--scan": "-s", "--output": "-o"}
CHOICES = {"--variant": ("full", "progressive", "shadow"), "--engine": ("edge", "openai", "google"), "--split-strategy": ("first", "last")}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cueline", description=__doc__)
    parser.add_argument("audio", nargs="?", help="sound file")
    parser.add_argument("lrc", nargs="?", help="its subtitles")
    parser.add_argument("-c", "--config", help="settings file")
    parser.add_argument("--mode", choices=["audio", "text"])
    parser.add_argument("--out", help="URI of the folder for all results (by default beside the sources)")
    parser.add_argument("--voices", help="module:name of a dictionary of voices by engine; a stand-in hums by default")
    parser.add_argument("--log", action="store_true", help="write a log file beside the results")
    for option, (section, name) in OPTIONS.items():
        kind = float if settings.DEFAULTS[section][name][0] == "double" or option == "--normalize" else str
        parser.add_argument(*filter(None, [SHORT.get(option), option]), type=kind, choices=CHOICES.get(option), dest=option.strip("-").replace("-", "_"))
    return parser


def overrides(a: argparse.Namespace) -> dict:
    """The layer of settings that the options make; an option that is left out, or is empty text, names nothing."""
    out: dict[str, dict] = {"paths": {k: getattr(a, k) for k in ("audio", "lrc") if getattr(a, k)}}
    for option, (section, name) in OPTIONS.items():
        value = getattr(a, option.strip("-").replace("-", "_"))
        if value is not None and value != "":
            place = out.setdefault("tts", {}).setdefault(section, {}) if section in settings.NESTED else out.setdefault(section, {})
            place[name] = value
    return out | ({"mode": a.mode} if a.mode else {})


def _voices(name: str | None) -> dict:
    if name is None:
        return batch.STAND_INS
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def run(spark: SparkSession, arguments: list[str]) -> int:
    a = _parser().parse_args(arguments)
    own = settings.of_run(spark, a.config and settings.document(spark, a.config), overrides(a))
    scan = own["paths"]["scan"]
    try:
        _, outcomes = batch.run_folder(spark, scan, a.out, own, speak=_voices(a.voices)) if scan else batch.run_single(spark, own, a.out, speak=_voices(a.voices))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    outcomes.orderBy("item").show(100, truncate=False)
    batch.summary(outcomes).orderBy("status").show()
    batch.shown_failures(outcomes).show(100, truncate=False)
    if a.log:
        sinks.write_files(batch.log_files(outcomes), a.out or batch._uri(spark, scan or "."))
    return 0


def run_extract(spark: SparkSession, arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="cueline extract")
    parser.add_argument("folder")
    parser.add_argument("-b", "--bitrate", default="192k")
    parser.add_argument("-r", "--sample-rate", type=int, default=44100)
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("-t", "--split-threshold", type=float, default=900.0)
    parser.add_argument("-c", "--chunk-duration", type=float, default=600.0)
    a = parser.parse_args(arguments)
    done = extract.extract_folder(spark, a.folder, a.overwrite, a.split_threshold, a.chunk_duration, a.bitrate, a.sample_rate)
    done.orderBy("dir", "source").show(100, truncate=False)
    done.groupBy("status").count().orderBy("status").show()
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("cueline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run_extract(spark, sys.argv[2:]) if sys.argv[1:2] == ["extract"] else run(spark, sys.argv[1:])
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())

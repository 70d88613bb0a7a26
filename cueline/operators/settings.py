"""Layered settings: defaults, a user's document and overrides, as one row of typed columns per run.

Layers are JSON texts of one shape, so that any number of runs are settled in one query. A
layer only replaces what it names. User settings may be empty or zero; an override that is
empty text counts as not given, a zero counts.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.operators import control

# The sections, the settings in them, their types and defaults.
DEFAULTS: dict[str, dict[str, tuple[str, object]]] = {
    "paths": {k: ("string", "") for k in ("scan", "audio", "lrc", "text", "output", "output_lrc")},
    "timing": {"after_first_target": ("double", 0.8), "after_native": ("double", 0.5), "after_second_target": ("double", 1.2)},
    "tts": {
        "engine": ("string", "google"),
        "target_voice": ("string", "ja-JP-NanamiNeural"),
        "native_voice": ("string", "zh-CN-XiaoxiaoNeural"),
        "rate": ("string", "+0%"),
        "pitch": ("string", "+0Hz"),
        "gain": ("double", 0.0),
        "normalize": ("string", None),
    },
    "openai": {"model": ("string", "gpt-4o-mini-tts"), "voice": ("string", "coral"), "speed": ("double", 1.0), "instructions": ("string", "")},
    "google": {"target_voice": ("string", "ja-JP-Neural2-B"), "native_voice": ("string", "cmn-CN-Chirp3-HD-Kore"), "speaking_rate": ("double", 1.0), "pitch": ("double", 0.0)},
    "output": {"format": ("string", "m4a"), "bitrate": ("string", "192k"), "sample_rate": ("int", 44100)},
    "lrc": {"delimiter": ("string", "|||"), "split_strategy": ("string", "last")},
    "loop": {"variant": ("string", "full")},
}
#: Sections that a document nests in ``tts``.
NESTED = ("openai", "google")


def _setting(document: Column, section: str, name: str, kind: str) -> Column:
    path = f"$.tts.{section}.{name}" if section in NESTED else f"$.{section}.{name}"
    text = F.get_json_object(document, path)
    return text if kind == "string" else text.try_cast(kind)


def settled(runs: DataFrame, user: str = "user", override: str = "override") -> DataFrame:
    """``runs`` with ``mode`` and a struct column for each section; ``user`` and ``override`` hold the layers' JSON, or null.

    A document that is no JSON names nothing. An unknown engine is the default one, an empty loudness is unset.
    """
    sections: dict[str, Column] = {}
    for section, settings in DEFAULTS.items():
        fields = []
        for name, (kind, default) in settings.items():
            own, over = (_setting(F.col(c), section, name, kind) for c in (user, override))
            value = control.layered(F.lit(default).cast(kind), own, over, empty_counts=kind != "string")
            if (section, name) == ("tts", "engine"):
                value = control.settled_engine(value)
            if (section, name) == ("tts", "normalize"):
                value = control.settled_loudness(value)
            fields.append(value.alias(name))
        sections[section] = F.struct(*fields)
    mode = control.layered(F.lit(""), F.get_json_object(F.col(user), "$.mode"), F.get_json_object(F.col(override), "$.mode"))
    return runs.withColumns({"mode": mode, **sections})


def resolved(table: DataFrame) -> DataFrame:
    """With ``run_mode``: batch, audio or text; null if the paths do not allow what is asked."""
    return table.withColumn("run_mode", control.resolved_mode(F.col("paths.scan"), F.col("mode"), F.col("paths.audio"), F.col("paths.lrc"), F.col("paths.text")))


def for_items(items: DataFrame, table: DataFrame) -> DataFrame:
    """Each item with its run's settings, and only the paths that its mode uses. Both have ``run_id``."""
    path = lambda mode, column: F.when(F.col("_item.mode") == mode, F.col(f"_item.{column}")).otherwise("")
    rows = items.select("run_id", F.struct(*(c for c in items.columns if c != "run_id")).alias("_item")).join(table, "run_id")
    own = F.col("paths").withField("scan", F.lit("")).withField("audio", path("audio", "audio")).withField("lrc", path("audio", "lrc")).withField("text", path("text", "text"))
    return rows.withColumn("paths", own).withColumn("mode", F.col("_item.mode")).withColumnRenamed("_item", "item")


def mode_of(run: Mapping) -> Column:
    """:func:`resolved`'s mode of one run's settings."""
    given = {k: F.lit(run["paths"][k]) for k in ("scan", "audio", "lrc", "text")}
    return control.resolved_mode(given["scan"], F.lit(run["mode"]), given["audio"], given["lrc"], given["text"])


def document(spark: SparkSession, path: str) -> str | None:
    """A settings file as JSON, from any path that Spark reads: YAML where that library is installed, else JSON. A missing file is an error."""
    content = "\n".join(r["value"] for r in spark.read.option("lineSep", "\n").text(path, wholetext=True).collect())
    try:
        import yaml
    except ImportError:
        return json.dumps(json.loads(content))
    found = yaml.safe_load(content)
    return None if found is None else json.dumps(found, default=str)


def of_run(spark: SparkSession, user: str | None = None, override: Mapping | None = None) -> dict:
    """The settings of one run as a dictionary of sections: defaults, the JSON document ``user`` and ``override`` (a nested dictionary)."""
    rows = spark.createDataFrame([(user, None if override is None else json.dumps(override))], "user string, override string")
    return settled(rows).drop("user", "override").first().asDict(recursive=True)

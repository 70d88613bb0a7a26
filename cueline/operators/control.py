"""Errors and retries, layered settings, and the splitting levels of rejected texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions import text
from cueline.functions.workers import reach_in_small_batches

# What a passing failure's message contains, in the order in which it is looked for, and its kind.
PASSING = (
    ("503", "503"),
    ("Invalid response status", "bad-status"),
    ("Cannot connect to host", "connect"),
    ("nodename nor servname", "dns"),
    ("Name or service not known", "dns"),
    ("Temporary failure in name resolution", "dns"),
    ("Connection reset", "reset"),
    ("Connection refused", "refused"),
    ("Connection aborted", "aborted"),
    ("ServerDisconnected", "disconnected"),
    ("TimeoutError", "timeout"),
    ("ClientConnectorError", "connect"),
    ("ConnectionError", "connect"),
)
# Codes of a cloud engine that pass too, and what its messages say of sentences that are too long.
CLOUD_CODES, CLOUD_KIND = ("429", "RESOURCE_EXHAUSTED", "UNAVAILABLE", "DEADLINE_EXCEEDED"), "google-transient"
TOO_LONG = ("sentences that are too long", "is too long")
ENGINES, DEFAULT_ENGINE = ("edge", "openai", "google"), "google"
#: Attempts in all, and the seconds before the second; each later pause is twice the one before.
ATTEMPTS, BASE_S = 4, 2.0
#: Levels of splitting a rejected text: the least limits, and how many times it is split again.
LEAST_TARGET, LEAST_WEAK, DEPTH = 20, 15, 3
#: Leaves that a task holds before it passes them on (and those of one text).
LEAVES = 4096


def error_kind(message: Column, cloud: bool = False) -> Column:
    """The kind of a passing failure, by the first needle that the message contains; null for others."""
    kind = F.lit(None).cast("string")
    if cloud:
        kind = F.when(_any(message, CLOUD_CODES), CLOUD_KIND)
    for needle, label in reversed(PASSING):
        kind = F.when(F.contains(message, F.lit(needle)), label).otherwise(kind)
    return kind


def kind_of(message: str, cloud: bool = False) -> str | None:
    """:func:`error_kind` of one message."""
    found = next((kind for needle, kind in PASSING if needle in message), None)
    return found or (CLOUD_KIND if cloud and any(code in message for code in CLOUD_CODES) else None)


def _any(message: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(message, F.lit(needle))
    return found


def too_long(message: Column) -> Column:
    return _any(message, TOO_LONG)


def retry_plan(errors: DataFrame, kind: Column, attempts: int = ATTEMPTS, base: float = BASE_S) -> DataFrame:
    """A row for each attempt that an item makes if it keeps failing: ``attempt``, ``delay_s`` after it and ``gives_up``.

    A failure that does not pass is tried once.
    """
    rows = errors.withColumn("kind", kind)
    tries = F.when(F.col("kind").isNull(), F.lit(1)).otherwise(F.lit(attempts))
    rows = rows.withColumn("_tries", tries).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.col("_tries"))))
    last = F.col("attempt") == F.col("_tries")
    return rows.withColumns({"delay_s": F.when(~last, base * F.pow(F.lit(2.0), F.col("attempt") - 1)), "gives_up": last}).drop("_tries")


def layered(default: Column, user: Column, override: Column, empty_counts: bool = False) -> Column:
    """Override, else the user's setting, else the default. An empty text is no override, unless ``empty_counts``; a zero is one."""
    return F.coalesce(override if empty_counts else F.nullif(override, F.lit("")), user, default)


def settled_engine(engine: Column) -> Column:
    return F.when(engine.isin(*ENGINES), engine).otherwise(DEFAULT_ENGINE)


def settled_gain(gain: Column) -> Column:
    return F.coalesce(gain.cast("double"), F.lit(0.0))


def settled_loudness(normalize: Column) -> Column:
    """Null for an unset or empty setting."""
    return F.nullif(normalize.cast("string"), F.lit("")).cast("double")


def resolved_mode(scan: Column, mode: Column, audio: Column, lrc: Column, texts: Column) -> Column:
    """``batch``, ``audio`` or ``text``; null where nothing, or not what the mode needs, is given."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    mode, has_audio, has_text = F.lower(text.strip_all(F.coalesce(mode, F.lit("")))), given(audio) & given(lrc), given(texts)
    return (
        F.when(given(scan), "batch")
        .when(mode == "audio", F.when(has_audio, "audio"))
        .when(mode == "text", F.when(has_text, "text"))
        .when(has_audio, "audio")
        .when(has_text, "text")
    )


def engine_label(engine: Column, model: Column, voice: Column, target_voice: Column, native_voice: Column) -> Column:
    return (
        F.when(engine == "openai", F.concat(F.lit("openai ("), model, F.lit(", voice="), voice, F.lit(")")))
        .when(engine == "google", F.concat(F.lit("google (target="), target_voice, F.lit(", native="), native_voice, F.lit(")")))
        .otherwise("edge-tts")
    )


def split_limits(depth: int, target: int = 80, weak: int = 50) -> tuple[int, int]:
    """Limits of a splitting level: halved at each, down to the least ones."""
    for _ in range(depth):
        target, weak = max(LEAST_TARGET, target // 2), max(LEAST_WEAK, weak // 2)
    return target, weak


def longest_sentence(piece: str) -> int:
    return max(map(len, text.sentences_of(piece)), default=0)


def leaves(whole: str, accepted: int, path: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], str, bool]]:
    """Path, piece and whether it stays rejected, of every leaf of the splitting tree under one text."""
    depth, found = len(path), []
    pieces = text.speakable(whole, *split_limits(depth))
    if path and len(pieces) <= 1:
        return []
    for i, piece in enumerate(pieces):
        rejected = longest_sentence(piece) > accepted
        below = leaves(piece, accepted, (*path, i)) if rejected and depth < DEPTH else []
        found += below or [((*path, i), piece, rejected)]
    return found


def split_levels(rows: DataFrame, accepted: int, key: str = "item_id", column: str = "text") -> DataFrame:
    """Leaves of splitting a rejected text again and again: ``path`` (places at each level), ``depth``, ``piece``, ``rejected``.

    An engine is taken to reject pieces with a sentence of over ``accepted`` characters. A rejected piece
    is split again under tighter limits; one that is left at the last level, or cannot be split, stays rejected.
    """
    reach_in_small_batches(rows.sparkSession)
    names = [key, "path", "depth", "piece", "rejected"]
    kinds = [pa.list_(pa.int32()), pa.int32(), pa.string(), pa.bool_()]

    def told(keys: pa.Array, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*((path, len(path) - 1, piece, rejected) for path, piece, rejected in found), strict=True)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=names)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []
            for i, whole in enumerate(batch.column(1)):
                for leaf in () if (t := whole.as_py()) is None else leaves(t, accepted):
                    at.append(i)
                    found.append(leaf)
                if len(found) >= LEAVES:
                    yield told(batch.column(0), at, found)
                    at, found = [], []
            if found:
                yield told(batch.column(0), at, found)

    schema = f"`{key}` {dict(rows.dtypes)[key]}, path array<int>, depth int, piece string, rejected boolean"
    return rows.select(key, column).mapInArrow(split, schema)

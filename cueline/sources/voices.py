"""Speech engines as functions of the caller, and the attempts that a request gets.

A voice is a function from a request (a dictionary of the columns that :func:`media.requests` makes) to the content
of a sound file. It raises on failure. Calls run in tasks, a row at a time; use ``repartition``
beforehand to bound how many run at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame

from cueline.functions import text
from cueline.functions.workers import reach_package
from cueline.operators import control
from cueline.sources import sound

Voice = Callable[[dict], bytes]
#: Calls to an engine that run at a time.
CONCURRENCY = 3
#: Columns that :func:`spoken` adds: the sound (null if all failed), the last failure with its kind, attempts, pieces and seconds.
RESULTS = f"{sound.SOUND}, error string, kind string, attempts int, n_pieces int, elapsed_s double"
#: Engines that try again after a passing failure, and those of them that know a cloud's codes and split texts that are too long.
RETRIES, CLOUD = ("edge", "google"), ("google",)


class _Failed(Exception):
    pass


def _decoded(content: bytes, decoder: sound.Decoder) -> tuple:
    found = decoder(content)
    if not content or found is None:
        raise _Failed("no sound came back")
    return found


def _by_pieces(speak: Voice, request: dict, decoder: sound.Decoder, depth: int = 0) -> list[tuple]:
    """Sounds of the pieces of a text that is too long; a piece that is too long itself is split again, under tighter limits."""
    pieces = text.speakable(request["spoken"], *control.split_limits(depth))
    if len(pieces) <= 1:
        raise _Failed("text could not be split into smaller pieces")
    found: list[tuple] = []
    for piece in pieces:
        own = request | {"spoken": piece}
        try:
            found.append(_decoded(speak(own), decoder))
        except Exception as e:
            if depth == control.DEPTH or not any(x in str(e) for x in control.TOO_LONG):
                raise
            found += _by_pieces(speak, own, decoder, depth + 1)
    return found


def _joined(sounds: list[tuple]) -> tuple:
    """One sound of several, at the first one's rate and channels."""
    rate, channels = sounds[0][1:3]
    pcm = b"".join(sound.reshaped(s[4], s[1], s[2], rate, channels) for s in sounds)
    return sound.milliseconds(len(pcm), rate, channels), rate, channels, sound.loudness(pcm), pcm


def attempted(speak: Voice, request: dict, decoder: sound.Decoder = sound.read_wav, attempts: int = control.ATTEMPTS, base: float = control.BASE_S, pause: Callable[[float], None] = time.sleep) -> tuple:
    """The values of ``RESULTS`` but the seconds, for one request. A failure is a value, never an error of the task."""
    engine = request.get("engine")
    cloud = engine in CLOUD
    tries = attempts if engine in RETRIES else 1
    for n in range(1, tries + 1):
        try:
            return *_decoded(speak(request), decoder), None, None, n, 1
        except Exception as e:
            message = str(e) or type(e).__name__
        if cloud and any(x in message for x in control.TOO_LONG):
            try:
                sounds = _by_pieces(speak, request, decoder)
                return *_joined(sounds), None, None, n, len(sounds)
            except Exception as e:
                return *(None,) * 5, str(e) or type(e).__name__, "too-long", n, 0
        kind = control.kind_of(message, cloud)
        if kind is None or n == tries:
            return *(None,) * 5, message, kind or "non-retryable", n, 0
        pause(base * 2 ** (n - 1))
    raise AssertionError("unreachable")


def spoken(requests: DataFrame, voices: Mapping[str, Voice], decoder: sound.Decoder = sound.read_wav, attempts: int = control.ATTEMPTS, base: float = control.BASE_S, concurrency: int = CONCURRENCY) -> DataFrame:
    """``requests`` with ``RESULTS``: each row goes to the voice that ``voices`` has for its ``engine``, and is tried again after passing failures.

    An engine without a voice fails its rows, alone.
    """
    reach_package(requests.sparkSession)
    columns = requests.columns

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def missing(request: dict) -> bytes:
            raise _Failed(f"no voice for engine {request['engine']}")

        for frame in frames:
            rows = []
            for request in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                began = time.monotonic()
                found = attempted(voices.get(request["engine"], missing), request, decoder, attempts, base)
                rows.append((*(request[c] for c in columns), *found, time.monotonic() - began))
            yield pd.DataFrame(rows, columns=[*columns, *sound.NAMES, "error", "kind", "attempts", "n_pieces", "elapsed_s"], dtype=object)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.repartition(concurrency).mapInPandas(run, f"{schema}, {RESULTS}")

"""Sound as rows: decoded WAV files, slices of tracks, volume, and parts of tracks.

Samples are 16-bit PCM in a binary column. A row is one clip or one source file; a new track is
the ordered rows of its parts and never one row. Other formats need a decoder: pass one to :func:`decoded`.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cueline.functions import paths
from cueline.functions.workers import reach_package
from cueline.sources.folders import folder_files

SOUND = "duration_ms bigint, frame_rate int, channels int, dbfs double, pcm binary"
NAMES = ["duration_ms", "frame_rate", "channels", "dbfs", "pcm"]
#: What a decoder gives: ``NAMES`` of a file's content, or none if it cannot read it.
Decoder = Callable[[bytes], tuple[int, int, int, float, bytes] | None]
#: Loudness of silence.
SILENCE_DBFS = -200.0


def loudness(pcm: bytes) -> float:
    """dB of the root mean square, full scale being 0."""
    samples = np.frombuffer(pcm, "<i2").astype(np.float64)
    level = float(np.sqrt(np.mean(samples**2))) if len(samples) else 0.0
    return 20 * float(np.log10(level / 32768)) if level else SILENCE_DBFS


def read_wav(content: bytes) -> tuple[int, int, int, float, bytes] | None:
    """Duration, rate, channels, loudness and samples of a 16-bit WAV file; none if it is no such file."""
    try:
        with wave.open(io.BytesIO(content)) as f:
            if f.getsampwidth() != 2:
                return None
            pcm = f.readframes(f.getnframes())
            return milliseconds(len(pcm), f.getframerate(), f.getnchannels()), f.getframerate(), f.getnchannels(), loudness(pcm), pcm
    except (wave.Error, EOFError):
        return None


def milliseconds(n_bytes: int, frame_rate: int, channels: int) -> int:
    return round(1000 * n_bytes / (2 * channels * frame_rate))


def decoded(spark: SparkSession, folder: str, decoder: Decoder | Mapping[str, Decoder] = read_wav, wanted: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """``path`` and the sound of a folder's files, all or those whose ``name`` is among ``names`` or ``wanted``; null columns where ``decoder`` gives none.

    There may be a decoder for each container (by extension, see :func:`paths.container`); a file without one is not decoded. The names are few (a single item's) and keep other files from being opened; what is ``wanted`` may be a table of any size.
    """
    reach_package(spark)

    def decode(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            of = (decoder.get(kind) if isinstance(decoder, Mapping) else decoder for kind in frame["container"])
            rows = [(read and read(c)) or (None,) * 5 for read, c in zip(of, frame["content"], strict=True)]
            yield pd.concat([frame[["path"]].reset_index(drop=True), pd.DataFrame(rows, columns=NAMES, dtype=object)], axis=1)

    read = folder_files(spark, folder, "content")
    if names:
        read = read.filter(F.col("name").isin(*names))
    if wanted is not None:
        read = read.join(wanted.select("name").distinct(), "name", "left_semi")
    return read.select(F.concat_ws("/", "dir", "name").alias("path"), paths.container(F.col("name")).alias("container"), "content").mapInPandas(decode, f"path string, {SOUND}")


def silence(ms: Column, frame_rate: Column, channels: Column) -> Column:
    """Samples of so many ms of silence."""
    frames = F.floor(ms * frame_rate / 1000)
    return F.unhex(F.repeat(F.lit("00"), (frames * channels * 2).cast("int")))


@F.pandas_udf(BinaryType())
def amplified(pcm: pd.Series, db: pd.Series) -> pd.Series:
    """Samples louder by so many dB, cut at full scale."""

    def one(data: bytes, gain: float) -> bytes:
        samples = np.frombuffer(data, "<i2") * 10 ** (gain / 20)
        return np.clip(np.round(samples), -32768, 32767).astype("<i2").tobytes()

    return pd.Series([None if d is None else one(d, g) for d, g in zip(pcm, db, strict=True)])


def reshaped(pcm: bytes, rate: int, channels: int, to_rate: int, to_channels: int) -> bytes:
    """Samples at another rate (linear between the old ones) and number of channels (the first is repeated, or all are averaged)."""
    frames = np.frombuffer(pcm, "<i2").reshape(-1, channels)
    if channels != to_channels:
        one = frames.mean(axis=1, keepdims=True) if channels > 1 else frames
        frames = np.repeat(one, to_channels, axis=1)
    if rate != to_rate and len(frames):
        at = np.arange(round(len(frames) * to_rate / rate)) * (rate / to_rate)
        frames = np.stack([np.interp(at, np.arange(len(frames)), frames[:, k]) for k in range(to_channels)], axis=1)
    return np.round(frames).astype("<i2").tobytes()


@F.pandas_udf(BinaryType())
def at_rate(pcm: pd.Series, frame_rate: pd.Series, channels: pd.Series, to_rate: pd.Series, to_channels: pd.Series) -> pd.Series:
    """:func:`reshaped` for a column."""
    rows = zip(pcm, frame_rate, channels, to_rate, to_channels, strict=True)
    return pd.Series([None if x[0] is None else reshaped(x[0], *map(int, x[1:])) for x in rows])


def wav_header(n_bytes: int, rate: int, channels: int) -> bytes:
    """The header of a WAV file of so many bytes of samples, which follow it."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.setnframes(n_bytes // (2 * channels))
        f.writeframesraw(b"")
    head = bytearray(out.getvalue())
    head[4:8], head[40:44] = (36 + n_bytes).to_bytes(4, "little"), n_bytes.to_bytes(4, "little")
    return bytes(head)


def wav_bytes(pcm: bytes, rate: int, channels: int) -> bytes:
    return wav_header(len(pcm), rate, channels) + pcm


def stand_in_voice(request: dict) -> bytes:
    """WAV of a stand-in voice, which hums for a fixed time for each character: 60 ms (target) or 80 ms (native), and 200 ms more."""
    ms = len(request["spoken"]) * (60 if request["side"] == "target" else 80) + 200
    tone = np.sin(np.arange(8 * ms) * (0.2 if request["side"] == "target" else 0.3)) * 6000
    return wav_bytes(tone.astype("<i2").tobytes(), 8000, 1)

"""Writers: re-timed subtitle files and tracks, one per item, and the commands of media tools, planned or run in tasks."""

from __future__ import annotations

import itertools
import subprocess
import tempfile
import wave
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cueline.functions.workers import reach_package

#: An export below this many bytes counts as failed.
LEAST_BYTES = 1024


def file_contents(lines: DataFrame, item: str = "item_id", order: tuple[str, ...] = ("idx", "pass"), line: str = "line") -> DataFrame:
    """``item`` and ``content``: its lines in order, each ended by a line feed. An item is one file."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line)))
    return lines.groupBy(item).agg(F.concat(F.array_join(F.transform(rows, lambda r: r[line]), "\n"), F.lit("\n")).alias("content"))


class _NamedFiles(DataSource):
    """Writes rows (``path``, ``content``) as files of these names through pyarrow's file systems."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _NamedFilesWriter(self.options["root"])


class _NamedFilesWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterable) -> WriterCommitMessage:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        for row in iterator:
            path = f"{base}/{row['path']}"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            # A retry writes the same bytes to the same name.
            with system.open_output_stream(path) as out:
                out.write(row["content"].encode())
        return WriterCommitMessage()


class _StreamedFiles(DataSource):
    """Writes rows (``path``, ``line``) as lines of files of these names; a task's rows of one file come one after the other."""

    @classmethod
    def name(cls) -> str:
        return "streamed_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _StreamedFilesWriter(self.options["root"])


class _StreamedFilesWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterable) -> WriterCommitMessage:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        for name, rows in itertools.groupby(iterator, key=lambda row: row["path"]):
            path = f"{base}/{name}"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            # A retry writes the same lines to the same name.
            with system.open_output_stream(path) as out:
                for row in rows:
                    out.write(f"{row['line']}\n".encode())
        return WriterCommitMessage()


def write_lines(lines: DataFrame, root: str, order: tuple[str, ...] = ("idx", "pass")) -> None:
    """Writes the rows (``path`` below ``root``, ``line``) of each path, in order, to a UTF-8 file, each ended by a line feed.

    A file's rows are sorted and pass its task one by one, so that a file of any length is never held as a whole.
    """
    reach_package(lines.sparkSession)
    lines.sparkSession.dataSource.register(_StreamedFiles)
    rows = lines.select("path", "line", *order).repartition("path").sortWithinPartitions("path", *order)
    rows.select("path", "line").write.format("streamed_files").mode("append").option("root", root).save()


def write_files(contents: DataFrame, root: str) -> None:
    """Writes each row (``path`` below ``root``, ``content``) to its own UTF-8 file. ``root`` is a URI that all executors reach."""
    reach_package(contents.sparkSession)
    contents.sparkSession.dataSource.register(_NamedFiles)
    contents.select("path", "content").write.format("named_files").mode("append").option("root", root).save()


def extract_command(source: Column, output: Column, bitrate: Column, sample_rate: Column, start: Column, duration: Column) -> Column:
    """Arguments that extract (a part of) a file's sound; null start or duration leaves its option out."""
    part = lambda option, seconds: F.when(seconds.isNotNull(), F.array(F.lit(option), F.format_string("%.3f", seconds))).otherwise(F.array().cast("array<string>"))
    return F.concat(
        F.array(F.lit("ffmpeg"), F.lit("-y")),
        part("-ss", start),
        F.array(F.lit("-i"), source),
        part("-t", duration),
        F.array(F.lit("-vn"), F.lit("-acodec"), F.lit("libmp3lame"), F.lit("-ab"), bitrate, F.lit("-ar"), sample_rate.cast("string"), output),
    )


def export_command(source: Column, output: Column, container: Column, bitrate: Column, sample_rate: Column) -> Column:
    """Arguments that encode a raw track: m4a goes through AAC, other formats directly."""
    m4a = F.lower(container) == "m4a"
    codec = F.when(m4a, F.array(F.lit("-acodec"), F.lit("aac"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(m4a, "ipod").otherwise(F.lower(container))
    return F.concat(F.array(F.lit("ffmpeg"), F.lit("-y"), F.lit("-i"), source), codec, F.array(F.lit("-b:a"), bitrate, F.lit("-ar"), sample_rate.cast("string"), F.lit("-f"), kind, output))


def export_failed(size: Column) -> Column:
    """True for a missing or too small result."""
    return F.coalesce(size < LEAST_BYTES, F.lit(True))


def _tool_error(arguments: list[str]) -> str | None:
    """Runs a media tool in this task; what it says if it fails."""
    try:
        done = subprocess.run(arguments, capture_output=True, text=True, check=False)
    except OSError as e:
        return str(e)
    return None if done.returncode == 0 else f"{arguments[0]} failed: {done.stderr.strip()[-500:]}"


def _sent(local: str, root: str, path: str) -> None:
    """Copies a file of this task to ``path`` below ``root``. A retry writes the same bytes to the same name."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
    fs.copy_files(local, f"{base}/{path}", source_filesystem=fs.LocalFileSystem(), destination_filesystem=system)


def write_tracks(parts: DataFrame, root: str, sample_rate: int, container: str = "wav", bitrate: str = "192k", tool: str = "ffmpeg") -> DataFrame:
    """Writes each ``path`` below ``root`` from its parts (``path``, ``place``, ``channels``, ``pcm``); ``path``, ``n_bytes`` and ``error`` of each, as they are written.

    A track's parts come to one task in the order of ``place`` and go to its file one after the other, so a track never
    has to fit in memory. WAV is written as it is; other containers are encoded by ``tool``. Too small a
    result counts as failed. The tracks are written when the result is evaluated.
    """
    reach_package(parts.sparkSession)

    def finished(folder: str, path: str) -> tuple[str, int | None, str | None]:
        made, error = f"{folder}/track.wav", None
        if container.lower() != "wav":
            made = f"{folder}/track.{container}"
            error = _tool_error(encode_arguments(f"{folder}/track.wav", made, container, bitrate, sample_rate, tool))
        size = Path(made).stat().st_size if Path(made).exists() else None
        if error is None and (size is None or size < LEAST_BYTES):
            error = f"result is missing or too small ({size or 0} bytes)"
        if error is None:
            _sent(made, root, path)
        return path, size, error

    def write(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for frame in frames for r in zip(frame["path"], frame["channels"], frame["pcm"], strict=True))
        for path, own in itertools.groupby(rows, key=lambda r: r[0]):
            with tempfile.TemporaryDirectory() as folder:
                with wave.open(f"{folder}/track.wav", "wb") as track:
                    track.setsampwidth(2)
                    track.setframerate(sample_rate)
                    for k, (_, channels, pcm) in enumerate(own):
                        if not k:
                            track.setnchannels(int(channels))
                        track.writeframesraw(pcm)
                yield pd.DataFrame([finished(folder, path)], columns=["path", "n_bytes", "error"], dtype=object)

    ordered = parts.select("path", "place", "channels", "pcm").repartition("path").sortWithinPartitions("path", "place")
    return ordered.mapInPandas(write, "path string, n_bytes bigint, error string")


def encode_arguments(source: str, output: str, container: str, bitrate: str, sample_rate: int, tool: str = "ffmpeg") -> list[str]:
    """:func:`export_command` for one file that a task has at hand."""
    codec = ["-acodec", "aac"] if container.lower() == "m4a" else []
    kind = "ipod" if container.lower() == "m4a" else container.lower()
    return [tool, "-y", "-i", source, *codec, "-b:a", bitrate, "-ar", str(sample_rate), "-f", kind, output]


def executed(plan: DataFrame, run: Callable[[list[str]], str | None] = _tool_error) -> DataFrame:
    """``dir``, ``source``, ``status`` (``ok`` or ``failed``), ``outputs`` and ``error`` of a plan's commands (``dir``, ``source``, ``chunk_no``, ``output``, ``command``).

    ``run`` takes a command's arguments and gives its error, if any. A source's chunks are made in order in one task and end at its first failure.
    """
    reach_package(plan.sparkSession)

    def one(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for frame in frames for r in zip(frame["dir"], frame["source"], frame["output"], frame["command"], strict=True))
        for (folder, source), own in itertools.groupby(rows, key=lambda r: r[:2]):
            outputs, error = [], None
            for *_, output, command in own:
                error = error or run(list(command))
                outputs += [output] if error is None else []
            yield pd.DataFrame([(folder, source, "ok" if error is None else "failed", outputs, error)], columns=["dir", "source", "status", "outputs", "error"], dtype=object)

    ordered = plan.select("dir", "source", "chunk_no", "output", "command").repartition("dir", "source").sortWithinPartitions("dir", "source", "chunk_no")
    return ordered.mapInPandas(one, "dir string, source string, status string, outputs array<string>, error string")

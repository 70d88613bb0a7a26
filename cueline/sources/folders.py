"""A folder's files as a data source: names and sizes, whole contents, or numbered lines, in batch and as they arrive.

Files of any name are read, those that begin with a dot or an underscore as well, which Spark's own sources pass over, and
empty ones. Files are packed into partitions of about equal bytes; filters on ``name`` (equal, one of, begins, ends, contains) are pushed down, so that
no file that they exclude is opened. Tasks open the files through pyarrow's file systems.

    spark.dataSource.register(FolderFiles)
    spark.read.format("folder_files").option("path", folder).option("rows", "lines").load()

A stream reads each file once, by the time of its last change: an offset is that time. A file that is changed later comes again, as a whole.
Times within ``settle`` seconds of now are left for the next batch, so that files of one time are taken together.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from cueline.functions.workers import reach_package

#: Bytes of files that one partition reads, about; a file is not divided.
PARTITION_BYTES = 32 << 20
#: Columns of each kind of rows.
ROWS = {
    "names": "dir string, name string, size bigint",
    "content": "dir string, name string, size bigint, content binary",
    "lines": "dir string, name string, line_no int, line string",
}


@dataclass
class _Files(InputPartition):
    """Paths, names and sizes of the files of one partition."""

    files: list[tuple[str, str, int]]


def _opened(root: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", root) else (fs.LocalFileSystem(), root)


def _listed(root: str, pattern: str) -> list[tuple[str, str, int, int]]:
    """Path, name, size and time of the last change (in ns) of the regular files of a folder whose names ``pattern`` finds; none if there is no such folder."""
    from pyarrow import fs

    system, base = _opened(root)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((f.path, f.base_name, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and re.search(pattern, f.base_name))


def _packed(files: Sequence[tuple[str, str, int]], most: int) -> list[_Files]:
    out: list[_Files] = []
    held = 0
    for path, name, size in files:
        if not out or held + size > most:
            out.append(_Files([]))
            held = 0
        out[-1].files.append((path, name, size))
        held += size + 4096
    return out


def _rows(root: str, kind: str, files: list[tuple[str, str, int]]) -> Iterator[tuple]:
    system, _ = _opened(root)
    folder = root.rstrip("/")
    for path, name, size in files:
        if kind == "names":
            yield folder, name, size
            continue
        with system.open_input_stream(path, compression=None) as source:
            data = source.read()
        if kind == "content":
            yield folder, name, size, data
            continue
        for number, line in enumerate(re.split("\r\n|\r|\n", data.decode("utf-8", "replace"))):
            yield folder, name, number, line


def _admits(test: Filter, name: str) -> bool:
    if isinstance(test, EqualTo):
        return name == test.value
    if isinstance(test, In):
        return name in test.value
    plain = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}
    return plain[type(test)](name, test.value)


class _Reader(DataSourceReader):
    def __init__(self, root: str, kind: str, pattern: str, most: int) -> None:
        self.root, self.kind, self.pattern, self.most = root, kind, pattern, most
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if isinstance(test, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and test.attribute == ("name",):
                self.pushed.append(test)
            else:
                yield test

    def partitions(self) -> list[_Files]:
        # Names alone are listed by the task that returns them.
        return [_Files([])] if self.kind == "names" else _packed(self._admitted(), self.most) or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        return _rows(self.root, self.kind, self._admitted() if self.kind == "names" else partition.files)

    def _admitted(self) -> list[tuple[str, str, int]]:
        return [f[:3] for f in _listed(self.root, self.pattern) if all(_admits(test, f[1]) for test in self.pushed)]


class _StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, kind: str, pattern: str, most: int, settle: float) -> None:
        self.root, self.kind, self.pattern, self.most, self.settle = root, kind, pattern, most, settle

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        return {"changed": max((f[3] for f in _listed(self.root, self.pattern) if f[3] <= until), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        return _packed([f[:3] for f in _listed(self.root, self.pattern) if start["changed"] < f[3] <= end["changed"]], self.most)

    def read(self, partition: _Files) -> Iterator[tuple]:
        return _rows(self.root, self.kind, partition.files)


class FolderFiles(DataSource):
    """``folder_files``: options ``path``, ``rows`` (see :data:`ROWS`; names by default), ``pattern`` (a regular expression that names must have), ``partitionBytes`` and, of streams, ``settle``."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def _kind(self) -> str:
        kind = self.options.get("rows", "names")
        if kind not in ROWS:
            raise ValueError(f"rows may be {', '.join(ROWS)}")
        return kind

    def _most(self) -> int:
        return int(self.options.get("partitionBytes", PARTITION_BYTES))

    def schema(self) -> str:
        return ROWS[self._kind()]

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], self._kind(), self.options.get("pattern", ""), self._most())

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self._kind(), self.options.get("pattern", ""), self._most(), float(self.options.get("settle", 0.5)))


#: Pushing filters down to Python sources is off by default.
_PUSHED = "spark.sql.python.filterPushdown.enabled"


def folder_files(spark: SparkSession, folder: str, rows: str = "names", **options: object) -> DataFrame:
    """A folder's files (a path of this machine, or a URI that all executors reach)."""
    reach_package(spark)
    spark.dataSource.register(FolderFiles)
    if spark.conf.get(_PUSHED, "false") != "true":
        spark.conf.set(_PUSHED, "true")
    return spark.read.format("folder_files").options(rows=rows, **options).option("path", folder).load()


def arriving_files(spark: SparkSession, folder: str, rows: str = "lines", **options: object) -> DataFrame:
    """A stream of a folder's files."""
    reach_package(spark)
    spark.dataSource.register(FolderFiles)
    return spark.readStream.format("folder_files").options(rows=rows, **options).option("path", folder).load()

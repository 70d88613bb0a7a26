"""Table functions for SQL: cues of subtitle lines, and loops of segments, over any table.

    register(spark)
    SELECT * FROM loop_parts(TABLE(segments), 'progressive')
    SELECT * FROM loop_positions(TABLE(segments) PARTITION BY (item_id) ORDER BY (idx), 'full')
    SELECT * FROM parsed_cues(TABLE(lines), 'line', '|||')

All columns of the table come first in the result. They are for use from SQL: the operators do the same within the JVM, and place items of any size.
``loop_positions`` passes an item's rows one by one, in the order of the call; an item is one task's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from cueline.functions.workers import reach_package
from cueline.operators.loops import Timing, passes

#: Pauses in ms after the three clips of a pass.
_PAUSES = tuple(round(1000 * x) for x in astuple(Timing()))
_CUE = re.compile(r"\[(\d{2}):(\d{2})\.(\d{2,3})\](.+)", re.DOTALL)


def _schema(table: AnalyzeArgument, needed: tuple[str, ...], added: dict[str, Any]) -> AnalyzeResult:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    names = [f.name for f in table.dataType.fields]
    missing = [c for c in needed if c not in names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    schema = StructType(list(table.dataType.fields))
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return AnalyzeResult(schema=schema)


def _length(row: Row) -> int:
    return 2 * row["target_ms"] + row["native_ms"] + sum(_PAUSES)


class LoopParts:
    """A row for each part of each pass of a segment (``target_ms``, ``native_ms``): ``pass``, ``part``, ``kind`` and ``part_ms``."""

    @staticmethod
    def analyze(segments: AnalyzeArgument, variant: AnalyzeArgument) -> AnalyzeResult:
        return _schema(segments, ("target_ms", "native_ms"), {"pass": IntegerType(), "part": IntegerType(), "kind": StringType(), "part_ms": LongType()})

    def eval(self, segments: Row, variant: str) -> Iterator[tuple]:
        own = tuple(segments)
        for number, heard in enumerate(passes(variant)):
            clips = (("target", segments["target_ms"]), ("native" if heard else "silence", segments["native_ms"]), ("target", segments["target_ms"]))
            for k, ((kind, ms), pause) in enumerate(zip(clips, _PAUSES, strict=True)):
                yield *own, number, 2 * k, kind, ms
                yield *own, number, 2 * k + 1, "silence", pause


class LoopPositions:
    """A row for each pass of a segment: ``pass``, ``loop_ms`` and ``pos_ms``, where it begins in its item's new track."""

    def __init__(self) -> None:
        self.at = 0

    @staticmethod
    def analyze(segments: AnalyzeArgument, variant: AnalyzeArgument) -> AnalyzeResult:
        return _schema(segments, ("target_ms", "native_ms"), {"pass": IntegerType(), "loop_ms": LongType(), "pos_ms": LongType()})

    def eval(self, segments: Row, variant: str) -> Iterator[tuple]:
        for number in range(len(passes(variant))):
            yield *segments, number, _length(segments), self.at
            self.at += _length(segments)


class ParsedCues:
    """Lines that are cues and have a native part, with ``start_ms``, ``target_text`` and ``native_text``; the delimiter's last place counts."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, column: AnalyzeArgument, delimiter: AnalyzeArgument) -> AnalyzeResult:
        return _schema(lines, (str(column.value),), {"start_ms": LongType(), "target_text": StringType(), "native_text": StringType()})

    def eval(self, lines: Row, column: str, delimiter: str) -> Iterator[tuple]:
        found = _CUE.match(lines[column] or "")
        if found and delimiter in found[4]:
            target, _, native = found[4].rpartition(delimiter)
            fraction = int(found[3]) * (10 if len(found[3]) == 2 else 1)
            if native.strip():
                yield *lines, int(found[1]) * 60_000 + int(found[2]) * 1000 + fraction, target.strip(), native.strip()


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    reach_package(spark)
    for name, function in (("loop_parts", LoopParts), ("loop_positions", LoopPositions), ("parsed_cues", ParsedCues)):
        spark.udtf.register(name, udtf(function))

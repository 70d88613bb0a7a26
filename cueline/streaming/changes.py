"""Subtitle files kept up to date: a state for each file tells new and changed ones from those seen before.

The stream brings whole files, some of them again and again, some late. For each file the state holds the version that was last
re-timed: its time of change and a hash of its content. A version that is no later, or has the same content, is ignored; a
changed one is re-timed, and its number tells readers which lines stand. A timer drops the state of a file that was not seen for so
long, measured by the stream's watermark, so that the state does not grow with all files that ever were.

The state is Spark's (``transformWithState`` in a RocksDB store, through its checkpoint), so a query that is stopped or loses an executor goes on
where it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Of each new version of a file: its number from 1, and the whole content.
VERSIONS = "item_id string, changed timestamp, version int, content string"
#: The store that keeps the state; set in the session before a stream begins.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Versions(StatefulProcessor):
    """A file's last version; ``keep_ms`` after it was last seen the state is dropped."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "changed long, digest string, version int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        changed, digest, version = self.seen.get() if self.seen.exists() else (-1, "", 0)
        arrived = pd.concat(list(rows)).sort_values(["changed", "content"])
        latest = changed
        out: list[tuple] = []
        for row in arrived.itertuples():
            at, own = int(row.changed.value // 1000), hashlib.sha256(row.content.encode()).hexdigest()
            latest = max(latest, at)
            if at > changed:
                if own != digest:
                    version += 1
                    out.append((key[0], row.changed, version, row.content))
                changed, digest = at, own
        self.seen.update((changed, digest, version))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest // 1000 + self.keep_ms)
        yield pd.DataFrame(out, columns=["item_id", "changed", "version", "content"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame([], columns=["item_id", "changed", "version", "content"])

    def close(self) -> None:
        pass


def milliseconds(interval: str) -> int:
    """Of an interval such as ``2 hours``."""
    n, unit = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", interval).groups()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit] * 1000


def versions(files: DataFrame, late: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """New and changed versions (:data:`VERSIONS`) of a stream of whole files (``item_id``, ``changed``: a timestamp, ``content``).

    Files later than ``late`` behind the newest are left out, as for any watermark; a file that was not seen for ``keep`` counts as new when it comes again. Null contents count as empty; rows without id or time are left out.
    """
    spark: SparkSession = files.sparkSession
    if spark.conf.get(STORE[0], "") != STORE[1]:
        spark.conf.set(*STORE)
    known = files.filter("item_id IS NOT NULL AND changed IS NOT NULL").select("item_id", "changed", F.coalesce("content", F.lit("")).alias("content"))
    keyed = known.withWatermark("changed", late).groupBy("item_id")
    return keyed.transformWithStateInPandas(statefulProcessor=_Versions(milliseconds(keep)), outputStructType=StructType.fromDDL(VERSIONS), outputMode="Append", timeMode="EventTime")

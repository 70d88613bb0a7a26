"""URL filters by a temporal list join.

A list is a log of dated entries: on a date a host (and below it a path) is put on a
list or taken off. Each entry is in force until the next one of the same list, host and path:
entries become validity intervals. A capture is judged by the intervals that hold when it was
fetched: an as-of join, on suffixes of its host and beginnings of its path, with the fetch time inside the interval.
A path stands for itself and what lies below it, whole segments at a time: ``/es`` is not ``/escape``.

Of a host only suffixes of as many labels as some entry's host has are looked up, and of a path only beginnings of as many segments as
an entry of that host has. So the work for a URL grows with its length, times the few depths that entries have, and a URL
of a megabyte is judged like any other. Captures meet hosts by hash and name, and then intervals by host and beginning; both sides of these joins are
shuffled for themselves, so that Spark splits a host that holds a third of all captures, and entries of other paths of a host meet no capture. Only matches are grouped, per
capture.

Times are compared in UTC. Dates and times without a zone (dates, texts, zone-less timestamps) are taken as UTC,
whatever the session's zone is; a text may name its own zone.

Defined results: an address in numbers or brackets has no domains above it. A capture without a URL, host or time is judged by no entry and passes. An
entry without host, list or date is void; an action other than ``add`` takes off; of entries of
one date the last action in alphabetical order counts, so a removal wins. Repeated captures
get equal verdicts (rows are told by 64 bits of id, URL and time, and by the last two). URLs, hosts and paths may be of any length. Empty tables block nothing. Input columns named like a result column are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.tables import apart, apart_from_its_rows, settled

ADD = "add"


#: The beginning of a URL up to its host; hosts that are numbers or in brackets.
_SCHEME = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://"
_NUMBERS = r"^(\[.*|[0-9.]+)$"
#: How a text that names its own zone ends.
_ZONED = r"\d[ T]\d{1,2}:\d{1,2}.*(Z|[A-Za-z]{3,}|[+-]\d{1,2}(:?\d{2})?)\s*$"


def url_host(url: Column) -> Column:
    """Lower-case host without port, user and final dot, an IPv6 address with its brackets; null if there is none."""
    host = F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:\s]*)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def url_path(url: Column) -> Column:
    """Path without query and fragment; ``/`` if it is empty."""
    path = F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def labels(host: Column) -> Column:
    """Number of labels of a host; an address in numbers or brackets is one."""
    return F.when(host.rlike(_NUMBERS), 1).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)


def host_suffix(host: Column, n: Column) -> Column:
    """The last ``n`` labels of a host, which has as many."""
    return F.when(host.rlike(_NUMBERS), host).otherwise(F.call_function("substring_index", host, F.lit("."), -n))


def plain_path(path: Column) -> Column:
    return F.rtrim(path, F.lit("/"))


def depth(path: Column) -> Column:
    """Number of segments of a path without a final slash."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def beginning(path: Column, n: Column) -> Column:
    """The first ``n`` segments of a path: '' of none, ``/a`` of one."""
    return F.call_function("substring_index", path, F.lit("/"), n + 1)


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 in UTC of a date, timestamp or text column; null for what is none. The session's zone has no part in it."""
    column, kind = F.col(name), df.schema[name].dataType.typeName()
    instant = F.unix_micros(column.try_cast("timestamp"))
    if kind == "timestamp":
        return instant
    wall = column.try_cast("timestamp_ntz")
    second = (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("bigint")
    plain = (F.unix_date(wall.cast("date")).cast("bigint") * 86_400 + F.hour(wall) * 3600 + F.minute(wall) * 60) * 1_000_000 + second
    return F.when(column.rlike(_ZONED), instant).otherwise(plain) if kind in ("string", "char", "varchar") else plain


def intervals(entries: DataFrame) -> DataFrame:
    """``list``, ``host``, ``path`` (without a final slash), ``valid_from`` and ``valid_to`` (past the end; null if still in force), in microseconds, of a log.

    ``entries`` has ``list``, ``host``, ``path`` (null for the whole host), ``date`` and ``action``.
    """
    host, path = F.rtrim(F.lower("host"), F.lit(".")), plain_path(F.coalesce("path", F.lit("")))
    log = entries.select("list", host.alias("host"), path.alias("path"), utc_micros(entries, "date").alias("valid_from"), "action")
    log = log.filter("list IS NOT NULL AND host <> '' AND valid_from IS NOT NULL")
    # The last entry of a date stands for it.
    log = log.groupBy("list", "host", "path", "valid_from").agg(F.max(F.coalesce("action", F.lit("remove"))).alias("action"))
    order = Window.partitionBy("list", "host", "path").orderBy("valid_from")
    return log.withColumn("valid_to", F.lead("valid_from").over(order)).filter(F.col("action") == ADD).drop("action")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Every row of ``captures`` with ``host``, ``lists`` (names, sorted) and ``blocked``."""
    captures = captures.drop("host", "lists", "blocked")
    name = F.xxhash64(F.col(id_col), F.col(url_col), utc_micros(captures, time_col))
    keys = captures.select(name.alias("key"), F.col(url_col).alias("url"), utc_micros(captures, time_col).alias("at")).filter("url IS NOT NULL AND at IS NOT NULL")
    keys = keys.select("key", "at", "url", url_host(F.col("url")).alias("of"), plain_path(url_path(F.col("url"))).alias("below")).filter("of IS NOT NULL")
    held = settled(intervals(entries).withColumns({"labels": labels(F.col("host")), "depth": depth(F.col("path")), "host_key": F.xxhash64("host")}))
    # Few numbers: hosts of k different counts of labels have k * k / 2 labels at least.
    counts = [r[0] for r in held.select("labels").distinct().collect()]
    hosts = held.groupBy("host_key", "host").agg(F.collect_set("depth").alias("depths")).select(apart_from_its_rows("host_key"), "host", "depths")

    fitting = F.filter(F.array(*(F.lit(c) for c in counts)).cast("array<int>"), lambda c: c <= labels(F.col("of")))
    probes = keys.withColumn("suffix", F.explode(F.array_distinct(F.transform(fitting, lambda c: host_suffix(F.col("of"), c)))))
    met = probes.join(hosts, (F.xxhash64("suffix") == F.col("host_key")) & (F.col("suffix") == F.col("host"))).drop("host_key", "host")
    deep = F.explode(F.filter("depths", lambda d: d <= depth(F.col("below")))).alias("deep")
    met = met.select("key", "at", "url", "suffix", "below", deep).withColumn("beginning", beginning(F.col("below"), F.col("deep"))).drop("below", "deep")
    in_force = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    found = met.join(held.drop("host_key", "labels", "depth"), (F.col("suffix") == F.col("host")) & (F.col("beginning") == F.col("path")) & in_force)
    n = apart(captures, "key", "url", "at", "lists", "own")
    per_capture = found.groupBy(*(F.col(c).alias(n[c]) for c in ("key", "url", "at"))).agg(F.array_sort(F.collect_set("list")).alias(n["lists"]))
    per_capture = per_capture.select(apart_from_its_rows(n["key"]), n["url"], n["at"], n["lists"])
    same = (F.col(n["own"]) == F.col(n["key"])) & (F.col(url_col) == F.col(n["url"])) & (utc_micros(captures, time_col) == F.col(n["at"]))
    out = captures.withColumn(n["own"], name).join(per_capture, same, "left")
    names = F.coalesce(n["lists"], F.array().cast("array<string>"))
    return out.select(*captures.columns, url_host(F.col(url_col)).alias("host"), names.alias("lists"), (F.size(names) > 0).alias("blocked"))


def allowed(captures: DataFrame, entries: DataFrame, **options: object) -> DataFrame:
    """The rows of ``captures`` that no list in force blocks, as they came."""
    return filter_urls(captures, entries, **options).filter("NOT blocked").select(*captures.columns)

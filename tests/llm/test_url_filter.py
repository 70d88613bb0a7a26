from __future__ import annotations

from datetime import UTC, datetime

import time

from cueline.llm.url_filter import allowed, beginning, depth, filter_urls, host_suffix, intervals, labels, plain_path, url_host, url_path, utc_micros
from pyspark.sql import functions as F

LOG = [
    ("a", "Bad.org", None, "2024-01-10", "add"), ("a", "bad.org", None, "2024-02-10", "remove"), ("a", "bad.org", None, "2024-03-10", "add"),
    ("b", "x.bad.org.", "/p/", "2024-01-01", "add"), ("b", "both.org", None, "2024-01-01", "add"), ("b", "both.org", None, "2024-01-01", "remove"),
    ("a", "twice.org", None, "2024-01-01", "add"), ("a", "twice.org", None, "2024-02-01", "add"), (None, "bad.org", None, "2020-01-01", "add"), ("c", None, None, "2020-01-01", "add"), ("c", "bad.org", None, None, "add"), ("c", "odd.org", None, "2020-01-01", None),
    ("d", "seg.org", "/es", "2024-01-01", "add"), ("d", "[::1]", None, "2024-01-01", "add"), ("d", "4", None, "2024-01-01", "add"), ("d", "10.0.0.4", None, "2024-01-01", "add"), ("e", "zone.org", None, "2024-01-01", "add"), ("e", "late.org", None, "2024-01-01T02:00:00+02:00", "add"),
]
CAPTURES = [
    (1, "http://bad.org", "2024-01-09 23:59:59", []), (2, "http://bad.org/", "2024-01-10 00:00:00", ["a"]), (3, "https://u:p@www.BAD.org:80/x?y#z", "2024-02-09 23:59:59", ["a"]),
    (4, "http://bad.org", "2024-02-10 00:00:00", []), (5, "http://x.bad.org/p/q", "2024-03-11 00:00:00", ["a", "b"]), (6, "http://x.bad.org/P/q", "2024-02-11 00:00:00", []),
    (7, "http://notbad.org", "2024-04-01 00:00:00", []), (8, "http://both.org", "2024-04-01 00:00:00", []), (9, "http://twice.org.", "2024-04-01 00:00:00", ["a"]),
    (10, None, "2024-04-01 00:00:00", []), (11, "http://bad.org", None, []), (12, "mailto:x", "2024-04-01 00:00:00", []), (13, "", "2024-04-01 00:00:00", []), (None, "http://bad.org", "2024-04-01 00:00:00", ["a"]), (2, "http://bad.org/", "2024-01-10 00:00:00", ["a"]), (14, "http://odd.org/", "2024-01-10 00:00:00", []),
    (15, "http://seg.org/escape", "2024-02-01", []), (16, "http://seg.org/es", "2024-02-01", ["d"]), (17, "http://seg.org/es/x?y", "2024-02-01", ["d"]), (18, "http://[::1]:80/x", "2024-02-01", ["d"]), (19, "http://1.2.3.4/", "2024-02-01", []), (20, "http://10.0.0.4/", "2024-02-01", ["d"]),
    (21, "http://zone.org/", "2023-12-31 23:00:00", []), (22, "http://zone.org/", "2023-12-31 23:00:00 UTC", []), (23, "http://zone.org/", "2024-01-01T08:00:00+09:00", []), (24, "http://late.org/", "2023-12-31 23:59:59", []), (25, "http://late.org/", "2024-01-01 00:00:00.000001", ["e"]), (26, "http://late.org/", "no time", []),
]
SCHEMA = "page_id bigint, url string, fetched_at string, want array<string>, id string, host string, suffix string"


def frames(spark):
    captures = spark.createDataFrame([(*c, "i", "h", "s") for c in CAPTURES], SCHEMA).repartition(3)
    return captures, spark.createDataFrame(LOG, "list string, host string, path string, date string, action string")


def test_verdicts_as_of_fetch_time(spark):
    captures, log = frames(spark)
    found = filter_urls(captures, log)
    assert found.columns == [*(c for c in captures.columns if c != "host"), "host", "lists", "blocked"]
    rows = found.collect()
    assert len(rows) == len(CAPTURES)
    for r in rows:
        assert list(r["lists"]) == list(r["want"]) and r["blocked"] == bool(r["want"]), r
    kept = allowed(captures, log)
    assert kept.columns == captures.columns and sorted(r["page_id"] for r in kept.collect()) == [1, 4, 6, 7, 8, 10, 11, 12, 13, 14, 15, 19, 21, 22, 23, 24, 26]


def test_intervals(spark):
    _, log = frames(spark)
    day = lambda t: "None" if t is None else str(datetime.fromtimestamp(t / 1e6, UTC))[:10]
    rows = sorted((r["host"], day(r["valid_from"]), day(r["valid_to"])) for r in intervals(log).filter("list = 'a'").collect())
    assert rows == [("bad.org", "2024-01-10", "2024-02-10"), ("bad.org", "2024-03-10", "None"), ("twice.org", "2024-01-01", "2024-02-01"), ("twice.org", "2024-02-01", "None")]


def test_hosts_and_paths(spark):
    urls = ["HTTP://A.b:8/c?d", "https://a.b?x", "//a.b/c", "ftp://user@a.b./"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(url_host(F.col("u")), url_path(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("a.b", "/c"), ("a.b", "/"), (None, "/"), ("a.b", "/")]
    path = plain_path(F.col("p"))
    df = spark.createDataFrame([("/",), ("/a/b/",), ("/a//b",)], "p string")
    got = df.select(F.transform(F.sequence(F.lit(0), depth(path)), lambda d: beginning(path, d))).collect()
    assert [list(r[0]) for r in got] == [[""], ["", "/a", "/a/b"], ["", "/a", "/a/", "/a//b"]]
    host = F.col("h")
    got = spark.createDataFrame([("a.b.c",), ("10.0.0.4",), ("[::1.2]",)], "h string").select(F.transform(F.sequence(F.lit(1), labels(host)), lambda n: host_suffix(host, n))).collect()
    assert [list(r[0]) for r in got] == [["c", "b.c", "a.b.c"], ["10.0.0.4"], ["[::1.2]"]]


def test_long_urls_and_a_hot_host(spark):
    """Megabytes of segments, labels and slashes cost what their length costs; a host of a third of the captures meets its own entries."""
    schema = "page_id bigint, url string, fetched_at string"
    log = [("a", "bad.org", "/x/y", "2024-01-01", "add"), ("b", "bad.org", None, "2024-06-01", "add"), ("deep", "d.org", "/" + "/".join("s" * 3000), "2024-01-01", "add")]
    log += [(f"l{k % 7}", f"h{k}.net", f"/p{k % 3}", f"2024-0{1 + k % 9}-01", "add") for k in range(300)]
    log = spark.createDataFrame(log, "list string, host string, path string, date string, action string")
    long = [("http://bad.org/x/y" + "/a" * 500_000, ["a"]), ("http://" + "l." * 500_000 + "bad.org/x/z", []), ("http://bad.org/" + "/" * 1_000_000, []), ("http://d.org" + "/s" * 400_000, ["deep"]), ("http://" + "." * 300_000 + "/", [])]
    captures = [(i, u, "2024-05-01") for i, (u, _) in enumerate(long)] + [(100 + i, "http://www.h4.net/p1/q", "2024-05-01") for i in range(2000)] + [(5000 + i, f"http://h{i % 300}.net/p0", "2024-05-01") for i in range(4000)]
    df = spark.createDataFrame(captures, schema).repartition(4)
    filter_urls(df.filter("page_id >= 100"), log).collect()
    began = time.perf_counter()
    found = {r["page_id"]: r["lists"] for r in filter_urls(df, log).collect()}
    assert time.perf_counter() - began < 60
    assert [found[i] for i in range(len(long))] == [want for _, want in long]
    assert all(found[100 + i] == ["l4"] for i in range(2000)) and len(found) == len(captures)
    for i in range(4000):
        k = i % 300
        assert found[5000 + i] == ([f"l{k % 7}"] if k % 3 == 0 and 1 + k % 9 <= 5 else [])


def test_the_sessions_zone_has_no_part(spark):
    captures, log = frames(spark)
    kinds = spark.sql("SELECT DATE '2024-03-31' AS d, TIMESTAMP_NTZ '2024-03-31 02:30:00' AS n, '2024-03-31 02:30:00.5' AS s, TIMESTAMP '2024-03-31 02:30:00 UTC' AS t, '2024-03-31 02:30:00 +0100' AS z, 'x' AS x")
    got = []
    try:
        for zone in ("UTC", "Asia/Tokyo", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = [(r["page_id"], list(r["lists"])) for r in filter_urls(captures, log).collect()]
            got.append((sorted(rows, key=str), tuple(kinds.select(*(utc_micros(kinds, c) for c in kinds.columns)).first())))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0] == got[1] == got[2]
    day = 1_711_843_200_000_000
    assert got[0][1] == (day, day + 9_000_000_000, day + 9_000_500_000, day + 9_000_000_000, day + 5_400_000_000, None)


def test_empty(spark):
    captures, log = frames(spark)
    assert filter_urls(captures.limit(0), log).count() == 0
    assert not any(r["blocked"] for r in filter_urls(captures, log.limit(0)).collect())

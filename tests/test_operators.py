"""Operators on small hand-written inputs."""

from __future__ import annotations

import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cueline.operators import control, in_sql, loops, media, scan, segments
from cueline.sources import files, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


LRC = "﻿[00:00.00]lost|||bom\r\n[ti:x]\n[00:09.00]c|||d\r[00:02.00]a|||b\n\n[00:02.00]tie|||e\n[00:05.50]no native\n[01:01.250]last|||f"


def test_lrc_file_to_segments(spark):
    df = spark.createDataFrame([("f", LRC)], "item_id string, content string")
    found = segments.segments(segments.cues(files.numbered_lines(df)))
    assert rows(found, "idx") == [
        ("f", 0, 2000, 2000, "a", "b"), ("f", 1, 2000, 9000, "tie", "e"), ("f", 2, 9000, 61_250, "c", "d"), ("f", 3, 61_250, 66_250, "last", "f"),
    ]
    known = segments.segments(segments.cues(files.numbered_lines(df)), duration=F.lit(60_000))
    assert known.filter("idx = 3").first()["end_ms"] == 60_000
    cut = segments.slices(known, F.lit(60_000)).filter("idx = 3").first()
    assert (cut["from_ms"], cut["to_ms"], cut["length_ms"]) == (61_250, 60_000, 0)


def test_text_file_to_segments(spark):
    content = "# note\nbonjour ||| hello\n\n　au revoir|||bye　\nnone\n|||right\nleft|||\nun|||deux|||three\n"
    df = spark.createDataFrame([("t", content), ("empty", "")], "item_id string, content string")
    found = segments.text_segments(files.without_comments(files.numbered_lines(df)))
    assert [r[1:] for r in rows(found, "idx")] == [(0, 0, 0, "bonjour", "hello"), (1, 0, 0, "au revoir", "bye"), (2, 0, 0, "un|||deux", "three")]


def voiced(spark):
    return spark.createDataFrame([("i", k, 1000 * k, 0, f"t{k}", f"n{k}", 500 + k, 700) for k in range(3)], "item_id string, idx bigint, start_ms bigint, end_ms bigint, target_text string, native_text string, target_ms bigint, native_ms bigint")


def test_loops_add_up(spark):
    table = voiced(spark)
    for variant, n in (("full", 1), ("shadow", 1), ("progressive", 2), ("unknown", 1)):
        parts, offsets = loops.loop_parts(table, variant=variant), loops.loop_offsets(table, variant=variant)
        assert parts.count() == 3 * 6 * n and offsets.count() == 3 * n
        total = parts.agg(F.sum("part_ms")).first()[0]
        assert total == loops.track_lengths(offsets).first()["track_ms"] == sum(n * (2 * (500 + k) + 700 + 2500) for k in range(3))
        kinds = [r["kind"] for r in parts.filter("idx = 0").orderBy("pass", "part").collect()]
        spoken = ["target", "silence", "native", "silence", "target", "silence"]
        silent = ["target", "silence", "silence", "silence", "target", "silence"]
        assert kinds == {"shadow": silent, "progressive": spoken + silent}.get(variant, spoken)
    lines = [r["line"] for r in loops.retimed_lines(loops.loop_offsets(table, variant="progressive")).orderBy("idx", "pass").collect()]
    assert lines[:3] == ["[00:00.00]t0|||n0", "[00:04.20]t0|||n0", "[00:08.40]t1|||n1"]


def test_retimed_lines_parse_back(spark):
    made = loops.retimed_lines(loops.loop_offsets(voiced(spark)))
    content = sinks.file_contents(made)
    back = segments.segments(segments.cues(files.numbered_lines(content)))
    for (_, _, start, _, target, native), r in zip(rows(back, "idx"), made.orderBy("idx").collect(), strict=True):
        assert abs(start - r["pos_ms"]) <= 5 and (target, native) == (r["target_text"], r["native_text"])


def test_clip_counts_must_match(spark):
    table = voiced(spark)
    clips = spark.createDataFrame([("i", 0), ("i", 2), ("i", 9)], "item_id string, idx bigint")
    assert rows(loops.unmatched(table, clips), "item_id") == [("i", 1, 1)]


LISTING = ["a.mp3", "a.lrc", "a.txt", "b.MP3", "b.LRC", "c.wav", "c.m4a", "c.lrc", "d.txt", "d_echo.m4a", "e_echo.txt", "f.TXT", ".hidden", "g.flac", "h.lrc"]


def test_scan(spark):
    listing = spark.createDataFrame([("d", n) for n in LISTING], "dir string, name string")
    items = [(r["mode"], r["audio"] or r["text"], r["lrc"]) for r in scan.work_items(listing).orderBy("kind_ord", "stem").collect()]
    assert items == [("audio", "a.mp3", "a.lrc"), ("audio", "c.wav", "c.lrc"), ("text", "d.txt", None), ("text", "f.TXT", None)]
    assert [r["text"] for r in scan.work_items(listing, "text").orderBy("stem").collect()] == ["a.txt", "d.txt", "f.TXT"]
    assert scan.work_items(listing, "audio").count() == 2 and scan.work_items(listing, "other").count() == 4
    assert rows(scan.unpaired(listing), "name") == [("d", "b.MP3"), ("d", "g.flac")]
    there = listing.unionByName(spark.createDataFrame([("d", "a_echo.m4a"), ("d", "a_echo.lrc"), ("d", "c_echo.m4a")], "dir string, name string"))
    plan = {r["stem"]: r["skipped"] for r in scan.planned(scan.work_items(there), there).collect()}
    assert plan == {"a": True, "c": False, "d": False, "f": False}
    assert not any(r["skipped"] for r in scan.planned(scan.work_items(there), there, overwrite=True).collect())
    assert scan.scan_summary(scan.work_items(listing)).first()["summary"] == "2 audio items, 2 text items"
    assert scan.scan_summary(scan.work_items(listing.limit(0))).first()["summary"] == "no items"
    both = scan.work_items(listing, "audio").unionByName(scan.work_items(listing, "text"))
    assert rows(scan.colliding(both), "stem") == [("d", "a", 2)]


def test_listing_reads_folders(spark, tmp_path):
    for name in ("a.mp3", "a.lrc", "clip_target_0003.mp3"):
        (tmp_path / name).write_bytes(b"x" * 10)
    (tmp_path / "sub").mkdir()
    found = files.listing(spark, str(tmp_path))
    assert [(r["name"], r["size"]) for r in found.orderBy("name").collect()] == [("a.lrc", 10), ("a.mp3", 10), ("clip_target_0003.mp3", 10)]
    assert [r["name"] for r in files.media_listing(found).collect()] == ["a.mp3", "clip_target_0003.mp3"]


def plan_of(d, split_over, chunk):
    import math

    if split_over <= 0 or d <= 0 or d <= split_over:
        return 1
    full, rest = int(d // chunk), d % chunk
    return full if 0 < rest < chunk * 0.3 and full > 0 else math.ceil(d / chunk)


def test_chunk_plan(spark):
    lengths = [0.0, 1.0, 900.0, 900.5, 1200.0, 1200.1, 1379.9, 1380.0, 1800.0, 59_999.0, 100_000.0]
    df = spark.createDataFrame([(f"v{i}", d) for i, d in enumerate(lengths)], "stem string, duration_s double")
    plan = media.chunk_plan(df).collect()
    for i, d in enumerate(lengths):
        own = sorted((r for r in plan if r["stem"] == f"v{i}"), key=lambda r: r["chunk_no"])
        assert len(own) == own[0]["n_chunks"] == plan_of(d, 900, 600)
        if d > 900:
            assert [r["start_s"] for r in own] == [600.0 * k for k in range(len(own))] and own[-1]["length_s"] is None
            assert own[0]["output"] == f"v{i}_{1:0{max(2, len(str(len(own))))}d}.mp3"
        else:
            assert own[0]["output"] == f"v{i}.mp3" and own[0]["start_s"] is None
    assert media.chunk_plan(df, chunk=0).count() == 0


def test_volume_and_fallback(spark):
    df = spark.createDataFrame([(-70.0, 3.0, -20.0), (-30.0, 3.0, -20.0), (-60.0, 3.0, -20.0), (-30.0, 3.0, None), (-30.0, 0.0, None)], "d double, g double, n double")
    got = df.select(media.applied_gain(F.col("d"), F.col("g"), F.col("n")), media.volume_label(F.col("g"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(0.0, "normalize to -20.0 dBFS"), (10.0, "normalize to -20.0 dBFS"), (0.0, "normalize to -20.0 dBFS"), (3.0, "+3.0 dB"), (0.0, "default")]
    wanted = spark.createDataFrame([("i", k, "native") for k in range(12)], "item_id string, idx bigint, side string")
    clips = spark.createDataFrame([("i", 0, "native", 900, 10), ("i", 1, "native", 900, 0)], "item_id string, idx bigint, side string, duration_ms bigint, size bigint")
    lengths = media.clip_lengths(wanted, clips)
    assert [r["clip_ms"] for r in lengths.orderBy("idx").collect()] == [900] + [500] * 11
    assert rows(media.fallback_summary(lengths, "item_id"), "item_id") == [("i", 11, 12, "1, 2, 3, 4, 5, 6, 7, 8, ... (3 more)")]


def test_errors_and_retries(spark):
    messages = [n for n, _ in control.PASSING] + ["TimeoutError then 503", "quota RESOURCE_EXHAUSTED", "x is too long", "other", None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m string")
    plain = [r[0] for r in df.orderBy("i").select(control.error_kind(F.col("m"))).collect()]
    assert plain == [k for _, k in control.PASSING] + ["503", None, None, None, None]
    assert df.filter("i = 14").select(control.error_kind(F.col("m"), cloud=True)).first()[0] == "google-transient"
    assert [r[0] for r in df.filter("i >= 14").orderBy("i").select(control.too_long(F.col("m"))).collect()][:3] == [False, True, False]
    plan = control.retry_plan(df.filter("i IN (0, 16)"), control.error_kind(F.col("m")))
    assert [(r["i"], r["attempt"], r["delay_s"], r["gives_up"]) for r in plan.orderBy("i", "attempt").collect()] == [(0, 1, 2.0, False), (0, 2, 4.0, False), (0, 3, 8.0, False), (0, 4, None, True), (16, 1, None, True)]


def test_settings(spark):
    df = spark.createDataFrame([("a", "b", "c"), ("a", "b", ""), ("a", None, None), ("a", "", None)], "d string, u string, o string")
    assert [r[0] for r in df.select(control.layered(F.col("d"), F.col("u"), F.col("o"))).collect()] == ["c", "b", "a", ""]
    cases = [("s", None, None, None, None, "batch"), (None, "audio", "a", "l", None, "audio"), (None, "audio", "a", None, "t", None), (None, "text", None, None, "t", "text"), (None, "", "a", "l", "t", "audio"), (None, "junk", "a", "", "t", "text"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(cases, "s string, m string, a string, l string, t string, want string")
    assert df.filter(~control.resolved_mode(*(F.col(c) for c in "smalt")).eqNullSafe(F.col("want"))).count() == 0


def test_split_levels(spark):
    assert [control.split_limits(d) for d in range(4)] == [(80, 50), (40, 25), (20, 15), (20, 15)]
    content = "a, " * 60 + "End. " + "x" * 200
    df = spark.createDataFrame([("i", content)], "item_id string, text string")
    leaves = control.split_levels(df, 30).orderBy("path").collect()
    assert "".join(r["piece"] for r in leaves).replace(" ", "") == content.replace(" ", "")
    assert not any(r["rejected"] for r in leaves)
    # An engine that takes 12 characters rejects what the last level cannot cut to that: a piece counts by its longest sentence.
    leaves = control.split_levels(df, 12).orderBy("path").collect()
    longest = lambda piece: max(len(x.strip()) for x in re.findall(r"[^.]*[.]+|[^.]+", piece))
    assert all(r["rejected"] == (longest(r["piece"]) > 12) for r in leaves)
    # The last two levels have the same limits, so nothing is left to do at the last one.
    assert {r["depth"] for r in leaves if r["rejected"]} == {control.DEPTH - 1} and any(not r["rejected"] for r in leaves)


def test_commands(spark):
    df = spark.createDataFrame([(None, None), (600.0, 600.0)], "s double, d double")
    got = [r[0] for r in df.select(sinks.extract_command(F.lit("v.mp4"), F.lit("v.mp3"), F.lit("192k"), F.lit(44100), F.col("s"), F.col("d"))).collect()]
    assert "-ss" not in got[0] and got[1][2:4] == ["-ss", "600.000"] and got[1][6:8] == ["-t", "600.000"]


def test_files_are_written_by_name(spark, tmp_path):
    contents = spark.createDataFrame([("x/a.lrc", "[00:00.00]é\n"), ("b.lrc", "b\n")], "path string, content string")
    sinks.write_files(contents, tmp_path.as_uri())
    assert (tmp_path / "x/a.lrc").read_text(encoding="utf-8") == "[00:00.00]é\n" and (tmp_path / "b.lrc").read_text() == "b\n"


def test_requests(spark):
    asked = media.requests(voiced(spark), "native", F.lit("ja-JP-Chirp3-X"), F.lit(1.0), F.lit(2.0), F.lit(""))
    first = asked.orderBy("idx").first()
    assert (first["speaking_rate"], first["pitch"], first["instructions"], first["clip"], first["language"]) == (None, None, None, "native_0000.mp3", "ja-JP")


def test_fallback_summary_gathers_only_what_it_shows(spark):
    rows = [("hot", i, i % 3 > 0) for i in range(300)] + [(None, 5, True), (None, None, True), ("void", None, True), ("none", 1, False), ("two", 7, True), ("two", 7, True)]
    lengths = spark.createDataFrame(rows, "item_id string, idx bigint, fallback boolean").repartition(3)
    found = media.fallback_summary(lengths, "item_id")
    want = [("hot", 200, 300, "1, 2, 4, 5, 7, 8, 10, 11, ... (192 more)"), ("two", 2, 2, "7, 7"), ("void", 1, 1, ""), (None, 2, 2, "5")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    before_shuffle = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle.split("WindowGroupLimit", 2)[-1].splitlines()[0]


def test_lines_of_files_are_streamed(spark, tmp_path):
    """Files longer than any batch, in order, each line ended; a file's rows come from many partitions."""
    lines = spark.range(60_000).select(F.concat(F.lit("x/"), (F.col("id") % 2).cast("string"), F.lit(".lrc")).alias("path"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("line"), F.col("id").alias("idx"), F.lit(0).alias("pass"))
    sinks.write_lines(lines.repartition(7), tmp_path.as_uri())
    for k in (0, 1):
        assert (tmp_path / f"x/{k}.lrc").read_text(encoding="utf-8") == "".join(f"é {i}\n" for i in range(k, 60_000, 2))


def test_table_functions_in_sql(spark):
    in_sql.register(spark)
    lines = spark.createDataFrame([("i", 0, "[01:02.50]a ||| b|||c"), ("i", 1, "[00:00.123]x|||y"), ("i", 2, "[ti:none]"), ("i", 3, "[00:01.00]x||| "), ("i", 4, None), ("i", 5, "[00:01.00]alone")], "item string, no int, line string")
    cues = spark.sql("SELECT no, start_ms, target_text, native_text FROM parsed_cues(TABLE({lines}), 'line', '|||') ORDER BY no", lines=lines).collect()
    assert [tuple(r) for r in cues] == [tuple(r) for r in segments.cues(lines.drop("item")).select("no", "start_ms", "target_text", "native_text").orderBy("no").collect()]
    table = spark.createDataFrame([("i", 1, 30, 5), ("i", 0, 10, 20), ("j", 0, 1, 1)], "item_id string, idx int, target_ms bigint, native_ms bigint")
    found = spark.sql("SELECT item_id, idx, pass, pos_ms FROM loop_positions(TABLE({t}) PARTITION BY (item_id) ORDER BY (idx), 'progressive')", t=table).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, loops.loop_offsets(table, variant="progressive").select("item_id", "idx", "pass", "pos_ms").collect()))
    with pytest.raises(AnalysisException, match="no column"):
        spark.sql("SELECT * FROM loop_parts(TABLE({t}), 'full')", t=table.drop("native_ms")).collect()

"""Text functions against plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from cueline.functions import paths, text


def values(spark, rows, kind, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_strip_takes_all_white_space(spark):
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace()]
    assert len(spaces) == 29
    rows = [f"{c}a{c}b{c}" for c in spaces] + ["", "　", "​x​"]
    assert [r[0] for r in values(spark, rows, "string", text.strip_all(F.col("x")))] == [r.strip() for r in rows]


def split(t, d, strategy):
    at = t.rfind(d) if strategy == "last" else t.find(d)
    return (t.strip(), "") if at < 0 else (t[:at].strip(), t[at + len(d) :].strip())


def test_split_bilingual(spark):
    rows = ["a ||| b", "a|||b|||c", "a||||b", "|||b", "a|||", "none", "", "　x　|||　y　", "two-three tree-drei"]
    for d in ("|||", "-", "||", ""):
        for strategy in ("last", "first"):
            assert values(spark, rows, "string", *text.split_bilingual(F.col("x"), d, strategy)) == [split(r, d, strategy) for r in rows], (d, strategy)


def test_stamp_rounds_like_binary_seconds(spark):
    ms = [*range(5, 200_000, 10), *range(0, 3000), 59_995, 59_999, 60_000, 5_999_995, 6_000_000, 123_456_785]
    got = [r[0] for r in values(spark, ms, "bigint", text.lrc_stamp(F.col("x")))]
    assert got == [f"[{int((m / 1000.0) // 60):02d}:{(m / 1000.0) % 60:05.2f}]" for m in ms]


def test_parsed_cue(spark):
    rows = ["[00:01.50]a ||| b", "[01:75.123]x|||y", "[00:01.5]a|||b", "[ti:name]", "[00:01.00]only", "[00:01.00]|||n", "[０１:０２.３４]f|||g", "[00:01.00][00:02.00]t|||u", "[00:01.1234]a|||b", "[100:00.00]a|||b", "[00:01.00]a b|||c"]
    got = [r[0] for r in values(spark, rows, "string", text.parsed_cue(F.col("x")))]
    pattern = re.compile(r"\[(\d{2}):(\d{2})\.(\d{2,3})\](.+)")
    for row, cue in zip(rows, got, strict=True):
        want = []
        if m := pattern.match(row):
            target, native = split(m[4], "|||", "last")
            if native:
                want = [(int(m[1]) * 60_000 + int(m[2]) * 1000 + int(m[3]) * (10 if len(m[3]) == 2 else 1), target, native)]
        assert [tuple(c) for c in cue] == want, row


def test_sizes_and_durations(spark):
    n = [0, 1, 1023, 1024, 1075, 1076, 1126, 51_251, 1_048_575, 1_048_576, 1_101_004, 99_999_999]
    sizes = [f"{b} B" if b < 1024 else f"{b / 1024:.1f} KB" if b < 1 << 20 else f"{b / (1 << 20):.1f} MB" for b in n]
    assert values(spark, n, "bigint", text.byte_size(F.col("x")), text.short_duration(F.col("x"))) == [(s, f"{b // 60:02d}:{b % 60:02d}") for s, b in zip(sizes, n, strict=True)]
    assert values(spark, [0.8, 1.0056, 0.29, 1.2], "double", text.seconds_to_ms(F.col("x"))) == [(int(s * 1000),) for s in (0.8, 1.0056, 0.29, 1.2)]


def on_punct(t, marks):
    return [x.strip() for x in re.findall(f"[^{marks}]*[{marks}]+|[^{marks}]+", t) if x.strip()]


def split_long(t, target, weak):
    t = t.strip()
    pieces = []
    for s in on_punct(t, text.STRONG) or ([t] if t else []):
        clauses = on_punct(s, text.WEAK)
        pieces += [s] if len(s) <= target else clauses if len(clauses) > 1 else [s[i : i + weak] for i in range(0, len(s), weak)]
    out, now = [], ""
    for p in pieces:
        strong = any(c in text.STRONG for c in now + p)
        if not now or len(now + p) <= (target if strong else weak):
            now += p
        else:
            out, now = [*out, now], p
    return [*out, now] if now else out


def test_split_long_text(spark):
    rng = random.Random(3)
    rows = ["", "  ", "。。", "bar\x01 in. it; twice\x01!", "run?!.\n。 end", "a\n.\nb" * 30, "a" * 170, "x" * 50 + "." + "y" * 50, "a、" * 60, "Hello. " * 20, "短い。" * 30 + "long without any mark " * 9]
    rows += ["".join(rng.choice("ab c。.!,、，；\n 　") if rng.random() < 0.3 else rng.choice("abcdef") for _ in range(rng.randrange(400))) for _ in range(150)]
    for target, weak in ((80, 50), (40, 25), (20, 15)):
        got = [r[0] for r in values(spark, rows, "string", text.split_long_text(F.col("x"), target, weak))]
        assert got == [split_long(r, target, weak) for r in rows]


def test_log_texts(spark):
    rows = ["short", "x" * 80, "y" * 81, "line\nbreak" * 9]
    got = values(spark, rows, "string", text.shortened(F.col("x"), 80), text.snippet(F.col("x")))
    assert got == [(r if len(r) <= 80 else r[:77] + "...", r[:30].replace("\n", " ")) for r in rows]


def test_paths(spark):
    rows = ["a.mp3", "b.tar.GZ", ".hidden", "noext", "x_echo.m4a", "X_ECHO.m4a", "..a.b"]
    got = values(spark, rows, "string", paths.stem(F.col("x")), paths.extension(F.col("x")), paths.is_result(F.col("x")))
    assert got == [("a", "mp3", False), ("b.tar", "gz", False), (".hidden", "", False), ("noext", "", False), ("x_echo", "m4a", True), ("X_ECHO", "m4a", False), ("..a", "b", False)]
    assert values(spark, ["cmn-CN-Chirp3-HD-Kore", "ja-JP-Neural2-B", "one"], "string", paths.voice_language(F.col("x"))) == [("cmn-CN",), ("ja-JP",), (None,)]
    assert values(spark, [1, 12], "int", paths.numbered_name(F.lit("v"), F.col("x"), F.lit(120), "mp3"), paths.clip_name(F.lit("t"), F.col("x") * 1000)) == [("v_001.mp3", "t_1000.mp3"), ("v_012.mp3", "t_12000.mp3")]


def test_output_paths(spark):
    df = spark.createDataFrame([("audio", "in/a.b.mp3", None, None), ("text", "t.txt", "", ""), ("", "", None, None), ("audio", "a.mp3", "out/x.wav", None), ("audio", "a.mp3", None, "s.lrc")], "m string, s string, o string, l string")
    audio, lrc = paths.output_paths(F.col("m"), F.col("s"), F.col("o"), F.col("l"), F.lit("m4a"))
    assert [tuple(r) for r in df.select(audio, lrc).collect()] == [
        ("in/a.b_echo.m4a", "in/a.b_echo.lrc"), ("t_echo.m4a", "t_echo.lrc"), ("output_echo.m4a", "output_echo.lrc"), ("out/x.wav", "out/x.lrc"), ("a_echo.m4a", "s.lrc"),
    ]

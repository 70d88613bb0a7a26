from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from cueline.functions import paths
from cueline.plans import batch, extract
from cueline.sources import files, sound
from cueline.sources.folders import arriving_files, folder_files
from test_runs import settings_of, tone


def write(folder, **contents):
    folder.mkdir(exist_ok=True)
    for name, content in contents.items():
        (folder / name.replace("__dot__", ".")).write_bytes(content)


def test_names_contents_and_lines(spark, tmp_path):
    """Files of any name, empty ones and ones without a final line end; folders are none."""
    write(tmp_path, _intro__dot__txt=b"a\r\nb\rc\n", __dot__hidden=b"", plain__dot__lrc="é\n\n x".encode(), bad__dot__txt=b"\xff\n")
    (tmp_path / "sub").mkdir()
    for root in (str(tmp_path), tmp_path.as_uri()):
        assert sorted((r["name"], r["size"]) for r in folder_files(spark, root).collect()) == [(".hidden", 0), ("_intro.txt", 7), ("bad.txt", 2), ("plain.lrc", 6)]
        lines = folder_files(spark, root, "lines", partitionBytes=1)
        assert lines.rdd.getNumPartitions() == 4
        assert sorted((r["name"], r["line_no"], r["line"]) for r in lines.collect()) == [
            (".hidden", 0, ""), ("_intro.txt", 0, "a"), ("_intro.txt", 1, "b"), ("_intro.txt", 2, "c"), ("_intro.txt", 3, ""), ("bad.txt", 0, "�"), ("bad.txt", 1, ""), ("plain.lrc", 0, "é"), ("plain.lrc", 1, ""), ("plain.lrc", 2, " x"),
        ]
    assert files.listing(spark, str(tmp_path / "none")).count() == 0
    found = files.numbered_lines(files.text_files(spark, str(tmp_path), r"^_.*\.txt$"))
    assert [(r["line_no"], r["line"]) for r in found.orderBy("line_no").collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_filters_are_pushed_down(spark, tmp_path):
    write(tmp_path, a__dot__txt=b"1", b__dot__txt=b"2", c__dot__lrc=b"3")
    (tmp_path / "c.lrc").chmod(0)
    for test, want in ((F.col("name") == "a.txt", ["1"]), (F.col("name").isin("a.txt", "b.txt"), ["1", "2"]), (F.col("name").endswith(".txt") & ~F.col("name").startswith("b"), ["1"]), (F.col("name").contains(".t"), ["1", "2"])):
        found = folder_files(spark, str(tmp_path), "lines", partitionBytes=1).filter(test)
        # What is pushed down is not tested again.
        assert ".t" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["line"] for r in found.collect()) == want
    # Each file is a partition here; those that the filters leave out are not there.
    assert folder_files(spark, str(tmp_path), "lines", partitionBytes=1).filter(F.col("name") == "a.txt").rdd.getNumPartitions() == 1


def test_stream_takes_new_and_changed_files(spark, tmp_path):
    source, out, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "point")
    write(source, a__dot__lrc=b"1\n2", _b__dot__lrc=b"3")

    def drained():
        arriving_files(spark, str(source), settle=0).writeStream.format("parquet").option("checkpointLocation", point).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r["name"], r["line"]) for r in spark.read.parquet(out).collect())

    first = [("_b.lrc", "3"), ("a.lrc", "1"), ("a.lrc", "2")]
    assert drained() == first and drained() == first
    time.sleep(0.05)
    write(source, c__dot__lrc=b"4", a__dot__lrc=b"5")
    os.utime(source / "_b.lrc", ns=(1, 1))
    assert drained() == sorted([*first, ("a.lrc", "5"), ("c.lrc", "4")])


def test_sound_and_subtitles_in_different_folders(spark, tmp_path):
    write(tmp_path / "sound", _intro__dot__wav=tone(4000))
    write(tmp_path / "text", words__dot__lrc=b"[00:01.00]un|||one\n", other__dot__lrc=b"[00:01.00]x|||y\n")
    run = settings_of(spark, paths={"audio": str(tmp_path / "sound/_intro.wav"), "lrc": str(tmp_path / "text/words.lrc"), "output": str(tmp_path / "o/new.wav")})
    lines, outcomes = batch.run_single(spark, run)
    assert [tuple(r)[:4] for r in outcomes.collect()] == [("_intro.wav", "succeeded", 1, 0)]
    assert (tmp_path / "o/new.lrc").read_text() == "[00:00.00]un|||one\n" and (tmp_path / "o/new.wav").stat().st_size > 1024


def test_hidden_names_in_a_folder_run(spark, tmp_path):
    write(tmp_path / "in", _intro__dot__wav=tone(3000), _intro__dot__lrc=b"[00:01.00]un|||one\n", __dot__note__dot__txt=b"x|||y\n")
    _, outcomes = batch.run_folder(spark, str(tmp_path / "in"), run=settings_of(spark))
    assert {r["item"]: r["status"] for r in outcomes.collect()} == {"_intro.wav": "succeeded", ".note.txt": "succeeded"}
    assert (tmp_path / "in/_intro_echo.lrc").exists() and (tmp_path / "in/.note_echo.wav").exists()


def test_a_probe_that_fails(tmp_path, monkeypatch):
    tool = tmp_path / "ffprobe"
    tool.write_text("#!/bin/sh\necho 12.5\nexit $(basename $7)\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    assert extract.probe("/x/0") == "12.5\n" and extract.probe("/x/3") == ""


def test_decoders_by_container(spark, tmp_path):
    write(tmp_path, a__dot__WAV=tone(1000), b__dot__raw=b"\x01\x00" * 80, c__dot__mp3=b"?", none=b"?")
    raw = lambda content: (len(content) // 2 // 8, 8000, 1, 0.0, content)
    found = {r["path"].rpartition("/")[2]: r["duration_ms"] for r in sound.decoded(spark, str(tmp_path), {"wav": sound.read_wav, "raw": raw}).collect()}
    assert found == {"a.WAV": 1000, "b.raw": 10, "c.mp3": None, "none": None}
    names = spark.createDataFrame([("x.MP3",), ("x.opus",), ("x",)], "n string").select(paths.container(F.col("n"), {"opus": "ogg"}))
    assert [r[0] for r in names.collect()] == ["mp3", "ogg", ""]

"""Settings, sound, speech attempts, and whole runs of folders and single items."""

from __future__ import annotations

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline import __main__ as cli
from cueline.operators import control, settings
from cueline.plans import batch, extract
from cueline.sources import files, sinks, sound, voices


def tone(ms, rate=8000, channels=1):
    frames = (np.sin(np.arange(ms * rate // 1000) / 5) * 8000).astype("<i2")
    return sound.wav_bytes(np.repeat(frames, channels).tobytes(), rate, channels)


def read(path):
    with wave.open(str(path)) as f:
        return f.getframerate(), f.getnchannels(), f.readframes(f.getnframes())


def test_settings_layers(spark):
    user = json.dumps({"mode": None, "tts": {"engine": "other", "gain": -6, "normalize": "", "google": {"pitch": 1.5}, "voice": "old"}, "loop": {"variant": "progressive"}, "timing": 3})
    over = json.dumps({"tts": {"gain": 0, "rate": ""}, "lrc": {"delimiter": ""}, "paths": {"text": "t.txt"}})
    runs = spark.createDataFrame([(1, user, over), (2, None, None), (3, "no json", None), (4, json.dumps({"mode": "audio", "tts": {"normalize": "-18.5", "engine": "edge"}}), None)], "run_id int, user string, override string")
    table = settings.resolved(settings.settled(runs))
    one, two, three, four = table.orderBy("run_id").collect()
    assert one["tts"].asDict() == {"engine": "google", "target_voice": "ja-JP-NanamiNeural", "native_voice": "zh-CN-XiaoxiaoNeural", "rate": "+0%", "pitch": "+0Hz", "gain": 0.0, "normalize": None}
    assert (one["google"]["pitch"], one["loop"]["variant"], one["timing"]["after_native"], one["lrc"]["delimiter"], one["run_mode"]) == (1.5, "progressive", 0.5, "|||", "text")
    assert two["output"].asDict() == {"format": "m4a", "bitrate": "192k", "sample_rate": 44100} and two["run_mode"] is None and three["tts"] == two["tts"]
    assert (four["tts"]["normalize"], four["tts"]["engine"], four["mode"], four["run_mode"]) == (-18.5, "edge", "audio", None)
    items = spark.createDataFrame([(1, "audio", "a.mp3", "a.lrc", None), (1, "text", None, None, "b.txt")], "run_id int, mode string, audio string, lrc string, text string")
    own = sorted(tuple(r["paths"][k] for k in ("audio", "lrc", "text")) for r in settings.for_items(items, table).collect())
    assert own == [("", "", "b.txt"), ("a.mp3", "a.lrc", "")]


def test_sound(spark, tmp_path):
    content = tone(1000)
    (tmp_path / "a.wav").write_bytes(content)
    (tmp_path / "b.wav").write_bytes(b"no sound")
    pcm = content[44:]
    rows = {r["path"].rsplit("/", 1)[1]: r for r in sound.decoded(spark, str(tmp_path)).collect()}
    a = rows["a.wav"]
    assert (a["duration_ms"], a["frame_rate"], a["channels"], bytes(a["pcm"])) == (1000, 8000, 1, pcm) and -16 < a["dbfs"] < -14
    assert rows["b.wav"]["pcm"] is None
    df = sound.decoded(spark, str(tmp_path), wanted=spark.createDataFrame([("a.wav",)], "name string"))
    assert df.count() == 1
    louder = bytes(df.select(sound.amplified("pcm", F.lit(6.0206))).first()[0])
    assert np.abs(np.frombuffer(louder, "<i2") - 2.0 * np.frombuffer(pcm, "<i2")).max() <= 1
    quiet = bytes(spark.range(1).select(sound.silence(F.lit(500), F.lit(8000), F.lit(1))).first()[0])
    assert quiet == b"\0" * 8000
    assert sound.reshaped(pcm, 8000, 1, 8000, 1) == pcm and len(sound.reshaped(pcm, 8000, 1, 4000, 2)) == len(pcm)
    assert sound.read_wav(sound.wav_bytes(b"\0" * 400, 8000, 2))[:3] == (12, 8000, 2) and sound.read_wav(b"") is None


def test_tracks_are_written_part_by_part(spark, tmp_path):
    parts = [("x/a.wav", [i], 1, bytes([i, 0]) * 500) for i in range(8)] + [("b.wav", [0], 1, b"\1\0")]
    df = spark.createDataFrame(parts, "path string, place array<int>, channels int, pcm binary").repartition(4)
    found = {r["path"]: (r["n_bytes"], r["error"]) for r in sinks.write_tracks(df, tmp_path.as_uri(), 8000).collect()}
    assert found["x/a.wav"] == (8044, None) and "too small" in found["b.wav"][1] and not (tmp_path / "b.wav").exists()
    assert read(tmp_path / "x/a.wav") == (8000, 1, b"".join(p for *_, p in parts[:8]))
    script = tmp_path / "tool"
    script.write_text('#!/bin/sh\n[ "$7" = 8000 ] || exit 3\nfor last; do :; done\ncp "$3" "$last"\n')
    script.chmod(0o755)
    kept = df.filter("path = 'x/a.wav'").withColumn("path", F.lit("a.mp3"))
    assert sinks.write_tracks(kept, tmp_path.as_uri(), 8000, "mp3", tool=str(script)).first()["error"] is None
    assert "failed" in sinks.write_tracks(kept.withColumn("path", F.lit("a.m4a")), tmp_path.as_uri(), 8000, "m4a", tool="false").first()["error"]
    assert sinks.write_tracks(kept, tmp_path.as_uri(), 8000, "ogg", tool="/no/such/tool").first()["error"]
    got = spark.range(1).select(sinks.export_command(F.lit("t.wav"), F.lit("t.m4a"), F.lit("m4a"), F.lit("192k"), F.lit(44100))).first()[0]
    assert list(got) == sinks.encode_arguments("t.wav", "t.m4a", "m4a", "192k", 44100)
    assert [r[0] for r in spark.createDataFrame([(None,), (1023,), (1024,)], "n int").select(sinks.export_failed(F.col("n"))).collect()] == [True, True, False]


def flaky():
    """The voice goes to tasks, which cannot import this module: so its class is made here."""

    class Flaky:
        """A voice that fails in known ways, by the text that it is given."""

        def __init__(self):
            self.calls = []

        def __call__(self, request):
            words = request["spoken"]
            self.calls.append(words)
            if words.startswith("twice") and self.calls.count(words) < 3:
                raise ConnectionError("Connection reset by peer")
            if words.startswith("never"):
                raise TimeoutError("TimeoutError")
            if words.startswith("busy"):
                raise RuntimeError("429 RESOURCE_EXHAUSTED")
            if words.startswith("bad"):
                raise ValueError("unsupported")
            if max(map(len, words.split("."))) > 30:
                raise RuntimeError("request has sentences that are too long")
            return b"" if words == "mute" else sound.stand_in_voice(request)

    return Flaky()


@pytest.mark.parametrize(
    ("engine", "words", "want"),
    [
        ("edge", "plain", (None, 1, 1, [])),
        ("edge", "twice", (None, 3, 1, [2.0, 4.0])),
        ("openai", "twice", ("reset", 1, 0, [])),
        ("google", "never", ("timeout", 4, 0, [2.0, 4.0, 8.0])),
        ("google", "busy", (control.CLOUD_KIND, 4, 0, [2.0, 4.0, 8.0])),
        ("edge", "busy", ("non-retryable", 1, 0, [])),
        ("edge", "bad", ("non-retryable", 1, 0, [])),
        ("edge", "mute", ("non-retryable", 1, 0, [])),
        ("google", "a, " * 60 + "x" * 28, (None, 1, 7, [])),
        ("google", "y" * 10 + "z" * 25, ("too-long", 1, 0, [])),
        ("edge", "x" * 40, ("non-retryable", 1, 0, [])),
    ],
)
def test_attempts(engine, words, want):
    voice, pauses = flaky(), []
    request = {"spoken": words, "side": "native", "engine": engine}
    *heard, error, kind, attempts, n_pieces = voices.attempted(voice, request, pause=pauses.append)
    assert (kind, attempts, pauses) == (want[0], want[1], want[3])
    assert (heard[4] is None) == (kind is not None) == (error is not None)
    assert n_pieces == want[2] or want[2] > 1 and n_pieces > 1
    if n_pieces > 1:  # the leaves, each at the stand-in voice's length
        assert heard[0] == 80 * len(words.replace(" ", "")) + 200 * n_pieces


def test_rows_go_to_their_engines_and_fail_alone(spark):
    df = spark.createDataFrame([(1, "native", "hello", "edge", None), (2, "native", "bad", "edge", 1.5), (3, "native", "hello", "other", None)], "idx long, side string, spoken string, engine string, speaking_rate double")
    found = {r["idx"]: r for r in voices.spoken(df, {"edge": flaky()}).collect()}
    assert found[1]["duration_ms"] == 600 and found[1]["error"] is None and found[1]["elapsed_s"] >= 0
    assert found[2]["pcm"] is None and found[2]["error"] == "unsupported" and found[2]["speaking_rate"] == 1.5
    assert found[3]["error"] == "no voice for engine other"


def settings_of(spark, **more):
    return settings.of_run(spark, None, {"output": {"format": "wav", "sample_rate": 8000}, "tts": {"engine": "edge"}} | more)


def test_folder_run(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("a.wav", "c.wav", "e.wav", "lonely.wav"):
        (src / name).write_bytes(tone(4000))
    for name, content in {
        "a.lrc": "[00:01.00]un|||one\n[00:03.00]deux|||bad\n", "b.TXT": "# c\nx|||y\n", "c.lrc": "[ti:none]\n", "d.txt": "p|||q\n", "d_echo.wav": "", "d_echo.lrc": "",
        "e.lrc": "", "f.wav": "no sound", "f.lrc": "[00:01.00]un|||one\n", "g+h i.txt": "x|||y\n",
    }.items():
        (src / name).write_text(content)
    listed = {r["name"]: r["size"] for r in files.listing(spark, str(src)).collect()}
    assert len(listed) == 14 and listed["e.lrc"] == 0 and listed["g+h i.txt"] == 6
    run = settings_of(spark, loop={"variant": "progressive"})
    counts = {}
    lines, outcomes = batch.run_folder(spark, str(src), run=run, speak={"edge": flaky()}, counts=counts)
    found = {r["item"]: (r["status"], r["n_segments"], r["n_fallback"]) for r in outcomes.collect()}
    assert found == {"a.wav": ("succeeded", 2, 1), "b.TXT": ("succeeded", 1, 0), "c.wav": ("failed", 0, 0), "d.txt": ("skipped", 0, 0), "e.wav": ("failed", 0, 0), "f.wav": ("failed", 0, 0), "g+h i.txt": ("succeeded", 1, 0)}
    # Both sides of four segments; one clip is silent.
    assert (counts["n_clips"], counts["n_silent"], counts["n_tracks"], counts["n_failed_tracks"]) == (8, 1, 3, 0)
    assert counts["track_bytes"] == sum((src / f"{x}_echo.wav").stat().st_size for x in ("a", "b", "g+h i")) and counts["clip_bytes"] > 0
    errors = {r["item"]: r["error"] for r in outcomes.collect() if r["error"]}
    assert errors == {"c.wav": "no segments found", "e.wav": "no segments found", "f.wav": "source sound cannot be decoded"}
    # Targets are cut out of the sound (2000 and 1000 ms), natives are the voice's (80 ms a character and 200) or 500 ms of silence.
    loop = [2 * 2000 + (80 * 3 + 200) + 2500, 2 * 1000 + 500 + 2500]
    starts = [0, loop[0], 2 * loop[0], 2 * loop[0] + loop[1]]
    assert [r["pos_ms"] for r in lines.filter("item_id LIKE '%a.wav'").orderBy("pos_ms").collect()] == starts
    assert (src / "a_echo.lrc").read_text().splitlines()[1] == f"[00:{loop[0] / 1000:05.2f}]un|||one"
    rate, channels, pcm = read(src / "a_echo.wav")
    assert (rate, channels, len(pcm)) == (8000, 1, 16 * 2 * sum(loop))
    assert pcm[: 2 * 16000] == tone(4000)[44:][2 * 8000 : 2 * 24000]
    log = batch.log_files(outcomes, "20240101_000000").first()
    assert log["path"] == "echo_run_20240101_000000.log" and "[WARNING] a.wav: 2 segments" in log["content"] and "[ERROR  ] f.wav: failed: source" in log["content"]
    again = batch.run_folder(spark, str(src), run=run, speak={"edge": flaky()})[1]
    assert {r["item"]: r["status"] for r in again.collect()} == {k: "skipped" if v[0] == "succeeded" else v[0] for k, v in found.items()}
    assert {r["status"]: r["n"] for r in batch.summary(outcomes).collect()} == {"succeeded": 3, "failed": 3, "skipped": 1}
    assert sorted(r["item"] for r in batch.shown_failures(outcomes).collect()) == ["c.wav", "e.wav", "f.wav"]


@pytest.mark.parametrize(("names", "want"), [(("a.wav", "a.lrc"), {"a.wav": "succeeded"}), (("b.txt",), {"b.txt": "succeeded"}), (("lonely.wav",), {})])
def test_folder_of_one_kind_and_another_place_for_results(spark, tmp_path, names, want):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for name in names:
        (src / name).write_bytes(tone(2000) if name[-3:] == "wav" else b"[00:01.00]un|||one\n" if name[-3:] == "lrc" else b"x|||y\n")
    run = settings_of(spark)
    assert {r["item"]: r["status"] for r in batch.run_folder(spark, str(src), out.as_uri(), run)[1].collect()} == want
    assert sorted(p.name for p in src.iterdir()) == sorted(names) and (not want or len([p for p in out.iterdir() if p.suffix in (".wav", ".lrc")]) == 2)
    if want:
        assert {r["status"] for r in batch.run_folder(spark, str(src), out.as_uri(), run)[1].collect()} == {"skipped"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.wav").write_bytes(tone(2000, channels=2))
    (tmp_path / "a.lrc").write_text("[00:00.50]un-one\n")
    (tmp_path / "c.json").write_text(json.dumps({"lrc": {"delimiter": "-"}, "output": {"format": "wav", "sample_rate": 8000}, "tts": {"engine": "openai"}}))
    config = str(tmp_path / "c.json")
    assert cli.run(spark, [str(tmp_path / "a.wav"), str(tmp_path / "a.lrc"), "-c", config, "--after-native", "0.25", "--variant", "shadow"]) == 0
    rate, channels, pcm = read(tmp_path / "a_echo.wav")
    assert (rate, channels, len(pcm)) == (8000, 2, 32 * (2 * 1500 + 440 + 2250)) and (tmp_path / "a_echo.lrc").read_text() == "[00:00.00]un-one\n"
    (tmp_path / "t [1].md").write_text("x|||y\n")
    assert cli.run(spark, ["--text", str(tmp_path / "t [1].md"), "-c", config, "--delimiter", "|||", "-o", str(tmp_path / "o/t.wav"), "--mode", "text"]) == 0
    assert (tmp_path / "o/t.lrc").read_text() == "[00:00.00]x|||y\n" and (tmp_path / "o/t.wav").exists()
    assert cli.run(spark, ["--mode", "audio", "--text", "x.txt"]) == 1 and "no input" in capsys.readouterr().err
    assert cli.run(spark, ["--scan", str(tmp_path), "-c", config, "--log", "--out", (tmp_path / "r").as_uri()]) == 0
    assert len(list((tmp_path / "r").glob("echo_run_*.log"))) == 1
    got = cli.overrides(cli._parser().parse_args(["--voice", "v", "--google-voice", "g", "--gain", "0", "--rate", ""]))
    assert got["tts"] == {"native_voice": "v", "google": {"native_voice": "g"}, "gain": 0.0} and "mode" not in got


def test_extraction(spark, tmp_path):
    for name in ("a.mp4", "b.mkv", "c.mp3", "d.avi", "e.mov", "d.mp3", "b_02.mp3", "n.txt"):
        (tmp_path / name).write_bytes(b"x")
    lengths = {"a.mp4": "100.0\n", "b.mkv": "1300", "c.mp3": "10", "d.avi": "20", "e.mov": "oops", "d.mp3": "3", "b_02.mp3": "9"}
    calls = tmp_path / "calls"
    calls.mkdir()

    def run(arguments):
        (calls / arguments[-1].rpartition("/")[2]).write_text(" ".join(arguments))
        return "broken" if arguments[-1].endswith("b_02.mp3") else None

    done = extract.extract_folder(spark, str(tmp_path), ask=lambda p: lengths[p.rpartition("/")[2]], run=run)
    found = {r["source"]: (r["status"], list(r["outputs"]), r["error"]) for r in done.collect()}
    assert found == {
        "a.mp4": ("ok", ["a.mp3"], None), "b.mkv": ("failed", ["b_01.mp3"], "broken"), "c.mp3": ("skipped", [], None), "d.avi": ("skipped", [], None),
        "e.mov": ("ok", ["e.mp3"], None), "d.mp3": ("skipped", [], None), "b_02.mp3": ("skipped", [], None),
    }
    assert sorted(p.name for p in calls.iterdir()) == ["a.mp3", "b_01.mp3", "b_02.mp3", "e.mp3"] and "-ss 600.000" in (calls / "b_02.mp3").read_text()
    assert extract.probe("/no/such/file") == ""

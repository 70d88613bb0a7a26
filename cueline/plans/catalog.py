"""The query catalog over the driver's tables, and the DuckDB counterpart of each query.

A track is a user of ``events``: its cues start at the whole seconds since 2024-01-01 taken as
ms, and speak the event's type (target) and properties (native). Lengths of clips come from
the stand-in voice. File listings and media lengths are derived from ``part`` and ``orders``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions import paths, text
from cueline.operators import control, loops, media, scan, segments, settings
from cueline.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Length of a track in the queries that know it, and where the slicing query ends it.
TRACK_MS, CUT_MS = 2_600_000, 2_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return files.without_comments(files.numbered_lines(docs, "doc_id", "text"))


def track_cues(spark: SparkSession, sf_dir: str, every_s: int = 1) -> DataFrame:
    """One cue for each event; starts are cut to multiples of ``every_s``, so that some tie."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)
    start = (F.floor(seconds / every_s) * every_s).cast("bigint")
    return table(spark, sf_dir, "events").select("user_id", "event_id", start.alias("start_ms"), F.col("event_type").alias("target_text"), F.col("props").alias("native_text"))


def track_segments(spark: SparkSession, sf_dir: str, duration: Column | None = None, every_s: int = 1) -> DataFrame:
    return segments.segments(track_cues(spark, sf_dir, every_s), ("event_id",), "user_id", duration)


def voiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stub_lengths(track_segments(spark, sf_dir))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder listing made up from ``part``: sound, subtitles, texts and earlier results."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("item"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 11 == 0, paths.RESULT_ENDING).otherwise(""))
    exts = F.array_compact(
        F.array(
            F.when(F.col("p_size") % 3 != 0, "mp3"),
            F.when(F.col("p_size") % 7 == 0, "WAV"),
            F.when(F.col("p_size") % 2 == 0, "lrc"),
            F.when(F.col("p_size") % 5 == 0, "txt"),
        )
    )
    return p.select(F.col("p_brand").alias("dir"), name.alias("base"), F.explode(exts).alias("ext")).select("dir", F.concat("base", F.lit("."), "ext").alias("name"))


def media_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("stem"), (F.col("o_totalprice") / 50).alias("duration_s"))


def event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made up from events: a needle, two needles, a cloud code, a length complaint or nothing known."""
    needles = F.lit([n for n, _ in control.PASSING] + ["RESOURCE_EXHAUSTED", "the sentence is too long", "TimeoutError after 503", "permission denied"])
    pick = F.element_at(needles, (F.col("event_id") % F.size(needles) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("call failed: "), pick, F.lit(" ["), "event_type", F.lit("]")).alias("message"))


# SQL that several counterparts share.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = f"""lines AS (
  SELECT doc_id, i - 1 AS line_no, trim(l[i], {_BLANKS}) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)
  WHERE trim(l[i], {_BLANKS}) <> '' AND NOT starts_with(trim(l[i], {_BLANKS}), '#'))"""
_CUES = """cues AS (
  SELECT user_id, event_id, floor(epoch(ts))::BIGINT - 1704067200 AS start_ms, event_type AS target_text, props AS native_text FROM events)"""
_SEGMENTS = f"""{_CUES},
segs AS (
  SELECT user_id, row_number() OVER w - 1 AS idx, start_ms, coalesce(lead(start_ms) OVER w, start_ms + 5000) AS end_ms, target_text, native_text
  FROM cues WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id))"""
_VOICED = f"""{_SEGMENTS},
voiced AS (SELECT *, length(target_text) * 60 + 200 AS target_ms, length(native_text) * 80 + 200 AS native_ms FROM segs)"""
_STAMP = "printf('[%02d:%05.2f]', floor(({0} / 1000.0::DOUBLE) / 60)::BIGINT, ({0} / 1000.0::DOUBLE) % 60)"


def _offsets_sql(n: int) -> str:
    return f"""{_VOICED},
loops AS (SELECT v.*, 2 * target_ms + native_ms + 2500 AS loop_ms, p::INTEGER AS pass FROM voiced v, unnest(range({n})) AS t(p)),
offsets AS (
  SELECT user_id, idx, target_text, native_text, pass, loop_ms,
         coalesce(sum(loop_ms) OVER (PARTITION BY user_id ORDER BY idx, pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_ms
  FROM loops)"""


@query(f"WITH {_LINES} SELECT doc_id, line_no::INTEGER AS line_no, line FROM lines")
def q01_lines_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir)


_TRIM = f"trim({{}}, {_BLANKS})"
_SPLIT_LAST = f"""splits AS (
  SELECT doc_id, line_no, CASE WHEN k = 0 THEN line ELSE {_TRIM.format("line[1 : length(line) - k - 1]")} END AS target,
         CASE WHEN k = 0 THEN '' ELSE {_TRIM.format("line[length(line) - k + 2 :]")} END AS native
  FROM (SELECT *, position(' ,' IN reverse(line)) AS r, CASE WHEN position(' ,' IN reverse(line)) = 0 THEN 0 ELSE position(' ,' IN reverse(line)) END AS k FROM lines))"""


@query(f"WITH {_LINES}, {_SPLIT_LAST} SELECT doc_id, line_no::INTEGER AS line_no, target, native FROM splits")
def q02_split_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, native = text.split_bilingual(F.col("line"), ", ", "last")
    return document_lines(spark, sf_dir).select("doc_id", "line_no", target.alias("target"), native.alias("native"))


@query(
    f"""WITH {_LINES}
SELECT doc_id, line_no::INTEGER AS line_no, CASE WHEN k = 0 THEN line ELSE {_TRIM.format("line[1 : k - 1]")} END AS target,
       CASE WHEN k = 0 THEN '' ELSE {_TRIM.format("line[k + 2 :]")} END AS native
FROM (SELECT *, position(', ' IN line) AS k FROM lines)"""
)
def q03_split_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, native = text.split_bilingual(F.col("line"), ", ", "first")
    return document_lines(spark, sf_dir).select("doc_id", "line_no", target.alias("target"), native.alias("native"))


@query(
    f"""WITH {_LINES}, {_SPLIT_LAST}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS idx, 0::BIGINT AS start_ms, 0::BIGINT AS end_ms, target AS target_text, native AS native_text
FROM splits WHERE target <> '' AND native <> ''"""
)
def q04_text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.text_segments(document_lines(spark, sf_dir), ", ", item="doc_id")


@query(
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, text AS target_text, native AS native_text
FROM (SELECT *, lead(role) OVER w AS role_next, lead(text) OVER w AS native FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND role_next = 'assistant'"""
)
def q05_pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.turn_pairs(table(spark, sf_dir, "conversations"))


def cue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(text.lrc_stamp(F.col("start_ms")), "target_text", F.lit("|||"), "native_text")
    return track_cues(spark, sf_dir).select("user_id", "event_id", line.alias("line"))


@query(f"WITH {_CUES} SELECT user_id, event_id, {_STAMP.format('start_ms')} || target_text || '|||' || native_text AS line FROM cues")
def q06_lrc_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_lines(spark, sf_dir)


@query(
    f"""WITH {_CUES}, formatted AS (SELECT *, {_STAMP.format("start_ms")} AS stamp FROM cues)
SELECT user_id, event_id, regexp_extract(stamp, '(\\d\\d):', 1)::BIGINT * 60000 + regexp_extract(stamp, ':(\\d\\d)', 1)::BIGINT * 1000 + regexp_extract(stamp, '\\.(\\d\\d)', 1)::BIGINT * 10 AS start_ms,
       target_text, native_text
FROM formatted WHERE native_text <> ''"""
)
def q07_lrc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.cues(cue_lines(spark, sf_dir)).select("user_id", "event_id", "start_ms", "target_text", "native_text")


@query(f"WITH {_SEGMENTS} SELECT * FROM segs")
def q08_lrc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_segments(spark, sf_dir)


@query(
    f"""WITH {_CUES}
SELECT user_id, row_number() OVER w - 1 AS idx, start_ms, coalesce(lead(start_ms) OVER w, {TRACK_MS}) AS end_ms, target_text, native_text
FROM cues WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)"""
)
def q09_lrc_segments_known_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_segments(spark, sf_dir, F.lit(TRACK_MS))


@query(
    f"""WITH {_CUES}
SELECT user_id, row_number() OVER w - 1 AS idx, start_ms // 3600 * 3600 AS start_ms, coalesce(lead(start_ms // 3600 * 3600) OVER w, start_ms // 3600 * 3600 + 5000) AS end_ms, target_text, native_text
FROM cues WINDOW w AS (PARTITION BY user_id ORDER BY start_ms // 3600, event_id)"""
)
def q09b_lrc_segments_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_segments(spark, sf_dir, every_s=3600)


@query(
    f"""WITH {_SEGMENTS}
SELECT user_id, idx, greatest(0, start_ms) AS from_ms, least({CUT_MS}, end_ms) AS to_ms, greatest(least({CUT_MS}, end_ms) - greatest(0, start_ms), 0) AS length_ms FROM segs"""
)
def q10_slice_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.slices(track_segments(spark, sf_dir), F.lit(CUT_MS)).select("user_id", "idx", "from_ms", "to_ms", "length_ms")


@query(
    f"""WITH {_SEGMENTS}
SELECT user_id, idx, start_ms / 1000.0::DOUBLE AS start_sec, end_ms / 1000.0::DOUBLE AS end_sec, end_ms - start_ms AS duration_ms,
       'Segment(' || idx || ', ' || trim({_STAMP.format("start_ms")}, '[]') || ' - ' || trim({_STAMP.format("end_ms")}, '[]') || ', ' || left(target_text, 20) || ' / ' || left(native_text, 20) || ')' AS label
FROM segs"""
)
def q10b_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.described(track_segments(spark, sf_dir)).select("user_id", "idx", "start_sec", "end_sec", "duration_ms", "label")


def _parts_sql(kinds: tuple[str, ...]) -> str:
    rows = ", ".join(f"({i}, 0, 'target', target_ms), ({i}, 1, 'silence', 800), ({i}, 2, '{k}', native_ms), ({i}, 3, 'silence', 500), ({i}, 4, 'target', target_ms), ({i}, 5, 'silence', 1200)" for i, k in enumerate(kinds))
    return f"WITH {_VOICED} SELECT user_id, idx, p.pass, p.part, p.kind, p.part_ms::BIGINT AS part_ms FROM voiced, LATERAL (VALUES {rows}) AS p(pass, part, kind, part_ms)"


def _parts(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return loops.loop_parts(voiced(spark, sf_dir), variant=variant).select("user_id", "idx", "pass", "part", "kind", "part_ms")


@query(_parts_sql(("native",)))
def q11_loop_parts_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "full")


@query(_parts_sql(("silence",)))
def q11b_loop_parts_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "shadow")


@query(_parts_sql(("native", "silence")))
def q11c_loop_parts_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "progressive")


def _offsets(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return loops.loop_offsets(voiced(spark, sf_dir), variant=variant, item="user_id")


def _offsets_select(n: int) -> str:
    return f"WITH {_offsets_sql(n)} SELECT user_id, idx, pass, loop_ms, pos_ms::BIGINT AS pos_ms FROM offsets"


@query(_offsets_select(1))
def q12_loop_offsets_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir, "full").select("user_id", "idx", "pass", "loop_ms", "pos_ms")


@query(_offsets_select(2))
def q13_loop_offsets_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir, "progressive").select("user_id", "idx", "pass", "loop_ms", "pos_ms")


@query(_offsets_select(1))
def q14_loop_offsets_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir, "shadow").select("user_id", "idx", "pass", "loop_ms", "pos_ms")


@query(f"WITH {_offsets_sql(1)} SELECT user_id, sum(loop_ms)::BIGINT AS track_ms, count(DISTINCT idx) AS n_segments FROM offsets GROUP BY user_id")
def q14b_track_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.track_lengths(_offsets(spark, sf_dir, "full"), "user_id")


@query(f"WITH {_offsets_sql(2)} SELECT user_id, idx, pass, {_STAMP.format('pos_ms::BIGINT')} || target_text || '|||' || native_text AS line FROM offsets")
def q15_retimed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.retimed_lines(_offsets(spark, sf_dir, "progressive")).select("user_id", "idx", "pass", "line")


@query(
    f"""WITH {_offsets_sql(2)}
SELECT user_id, string_agg({_STAMP.format("pos_ms::BIGINT")} || target_text || '|||' || native_text, chr(10) ORDER BY idx, pass) || chr(10) AS content FROM offsets GROUP BY user_id"""
)
def q15b_retimed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.file_contents(loops.retimed_lines(_offsets(spark, sf_dir, "progressive")), "user_id")


@query(
    f"""WITH {_SEGMENTS}, have AS (SELECT user_id, idx FROM segs WHERE idx % 7 <> 3 UNION ALL SELECT user_id, idx + 100000 FROM segs WHERE idx % 11 = 5)
SELECT coalesce(s.user_id, h.user_id) AS user_id, count(*) FILTER (h.idx IS NULL) AS no_clip, count(*) FILTER (s.idx IS NULL) AS no_segment
FROM segs s FULL JOIN have h USING (user_id, idx) GROUP BY 1 HAVING count(*) FILTER (h.idx IS NULL OR s.idx IS NULL) > 0"""
)
def q15c_unmatched_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = track_segments(spark, sf_dir)
    have = segs.filter("idx % 7 <> 3").select("user_id", "idx").unionAll(segs.filter("idx % 11 = 5").select("user_id", F.col("idx") + 100000))
    return loops.unmatched(segs, have, "user_id")


_STRONG_RUNS = "list_filter(list_transform(regexp_extract_all({0}, '[^。！？!?.;；\\n]*[。！？!?.;；\\n]+|[^。！？!?.;；\\n]+'), lambda x: {1}), lambda x: x <> '')".format("{0}", f"trim(x, {_BLANKS})")
_WEAK_RUNS = "list_filter(list_transform(regexp_extract_all({0}, '[^，、,]*[，、,]+|[^，、,]+'), lambda x: {1}), lambda x: x <> '')".format("{0}", f"trim(x, {_BLANKS})")


def _split_ctes(source: str, target: int, weak: int, n: str = "", key: str = "doc_id") -> str:
    """``out{n}(key, i, piece)``: the pieces of ``source(key, text)``. The fold over pieces is a list_reduce with a struct; pieces come from regular expressions."""
    strong, clauses = _STRONG_RUNS.format("whole"), _WEAK_RUNS.format("s")
    return f"""docs{n} AS (SELECT {key}, trim(text, {_BLANKS}) AS whole FROM {source}),
sentences{n} AS (SELECT {key}, CASE WHEN len({strong}) = 0 AND whole <> '' THEN [whole] ELSE {strong} END AS ss FROM docs{n}),
each{n} AS (SELECT {key}, k, ss[k] AS s FROM sentences{n}, unnest(range(1, len(ss) + 1)) AS t(k)),
parted{n} AS (
  SELECT {key}, k, CASE WHEN length(s) <= {target} THEN [s] WHEN len({clauses}) > 1 THEN {clauses}
                         ELSE list_transform(range(0, length(s), {weak}), lambda o: s[o + 1 : o + {weak}]) END AS ps FROM each{n}),
pieces{n} AS (SELECT {key}, flatten(list(ps ORDER BY k)) AS ps FROM parted{n} GROUP BY {key}),
folded{n} AS (
  SELECT {key}, list_reduce(list_transform(ps, lambda q: {{'done': []::VARCHAR[], 'now': q, 'strong': regexp_matches(q, '[。！？!?.;；\\n]')}}),
    lambda a, b: CASE WHEN length(a.now) + length(b.now) <= (CASE WHEN a.strong OR b.strong THEN {target} ELSE {weak} END)
      THEN {{'done': a.done, 'now': a.now || b.now, 'strong': a.strong OR b.strong}}
      ELSE {{'done': list_append(a.done, a.now), 'now': b.now, 'strong': b.strong}} END) AS f
  FROM pieces{n}),
out{n} AS (
  SELECT {key}, i - 1 AS i, found[i] AS piece
  FROM (SELECT {key}, list_append(f.done, f.now) AS found FROM folded{n}), unnest(range(1, len(found) + 1)) AS t(i))"""


def _split_sql(target: int, weak: int) -> str:
    return f"WITH {_split_ctes('documents', target, weak)} SELECT doc_id, i::INTEGER AS piece_no, piece FROM out"


def _split_levels_sql(accepted: int) -> str:
    """Level by level: pieces with too long a sentence are split again where that makes more than one of them."""
    key, ctes, found = "doc_id, path", ["starts AS (SELECT doc_id, '' AS path, text FROM documents)"], []
    for d in range(control.DEPTH + 1):
        rejected = f"coalesce(list_max(list_transform({_STRONG_RUNS.format('piece')}, lambda x: length(x))), 0) > {accepted}"
        ctes.append(_split_ctes("starts" if d == 0 else f"again{d - 1}", *control.split_limits(d), str(d), key))
        only = "" if d == 0 else " QUALIFY count(*) OVER (PARTITION BY doc_id, path) > 1"
        ctes.append(f"level{d} AS (SELECT doc_id, path AS above, path || CASE WHEN path = '' THEN '' ELSE '.' END || i AS path, piece, {rejected} AS rejected FROM out{d}{only})")
        ctes.append(f"again{d} AS (SELECT doc_id, path, piece AS text FROM level{d} WHERE rejected)")
        kept = "" if d == control.DEPTH else f" WHERE NOT EXISTS (SELECT 1 FROM level{d + 1} n WHERE n.doc_id = l.doc_id AND n.above = l.path)"
        found.append(f"SELECT doc_id, path, {d} AS depth, piece, rejected FROM level{d} l{kept}")
    # Parts that several others read are kept; DuckDB would work them out again for each, and for each of a level's readers those of the level above.
    kept_once = re.sub(r"^(\w+) AS \(|(?<=\),\n)(\w+) AS \(", lambda m: f"{m[1] or m[2]} AS MATERIALIZED (", ",\n".join(ctes))
    return f"WITH {kept_once} {' UNION ALL '.join(found)}"


def _split(spark: SparkSession, sf_dir: str, target: int, weak: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(text.split_long_text(F.col("text"), target, weak)).alias("piece_no", "piece"))


@query(_split_sql(80, 50))
def q16_split_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 80, 50)


@query(_split_sql(40, 25))
def q17_split_level_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 40, 25)


@query(_split_sql(20, 15))
def q17b_split_level_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 20, 15)


@query(_split_levels_sql(40))
def q17c_split_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of all splitting levels for an engine that takes sentences of 40 characters."""
    leaves = control.split_levels(table(spark, sf_dir, "documents").select("doc_id", "text"), 40, "doc_id")
    return leaves.withColumn("path", F.array_join("path", "."))


_FILES = """files AS (
  SELECT p_brand AS dir, 'item' || p_partkey AS base0, CASE WHEN p_size % 11 = 0 THEN '_echo' ELSE '' END AS ending, e AS ext
  FROM part, unnest(list_filter([CASE WHEN p_size % 3 <> 0 THEN 'mp3' END, CASE WHEN p_size % 7 = 0 THEN 'WAV' END,
                                 CASE WHEN p_size % 2 = 0 THEN 'lrc' END, CASE WHEN p_size % 5 = 0 THEN 'txt' END], lambda x: x IS NOT NULL)) AS t(e)),
fresh AS (SELECT dir, base0 AS stem, ext FROM files WHERE ending = ''),
sound AS (SELECT dir, stem, stem || '.' || arg_max(ext, lower(ext)) AS audio FROM fresh WHERE lower(ext) IN ('mp3', 'wav') GROUP BY dir, stem),
paired AS (SELECT s.dir, s.stem, audio, s.stem || '.lrc' AS lrc FROM sound s JOIN fresh f ON f.dir = s.dir AND f.stem = s.stem AND f.ext = 'lrc'),
items AS (
  SELECT dir, 0 AS kind_ord, 'audio' AS mode, stem, audio, lrc, NULL::VARCHAR AS text FROM paired
  UNION ALL
  SELECT dir, 1, 'text', stem, NULL, NULL, stem || '.txt' FROM fresh f
  WHERE ext = 'txt' AND NOT EXISTS (SELECT 1 FROM paired p WHERE p.dir = f.dir AND p.stem = f.stem))"""


@query(f"WITH {_FILES} SELECT * FROM items")
def q18_scan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.work_items(part_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT dir, stem || '.' || ext AS name FROM fresh f WHERE lower(ext) IN ('mp3', 'wav') AND NOT EXISTS (SELECT 1 FROM fresh l WHERE l.dir = f.dir AND l.stem = f.stem AND l.ext = 'lrc')")
def q18b_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.unpaired(part_files(spark, sf_dir))


def _done_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are there already: both of every fourth stem's, the sound alone of others."""
    stems = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dir"), F.concat(F.lit("item"), F.col("p_partkey").cast("string"), F.lit(paths.RESULT_ENDING)).alias("base"), F.col("p_partkey").alias("k"))
    sound = stems.filter("k % 2 = 0").select("dir", F.concat("base", F.lit(".m4a")).alias("name"))
    return sound.unionByName(stems.filter("k % 4 = 0").select("dir", F.concat("base", F.lit(".lrc")).alias("name")))


@query(
    f"""WITH {_FILES}
SELECT dir, mode, stem, stem || '_echo.m4a' AS audio_out, stem || '_echo.lrc' AS lrc_out, substr(stem, 5)::BIGINT % 4 = 0 AS skipped FROM items"""
)
def q19_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = scan.planned(scan.work_items(part_files(spark, sf_dir)), _done_files(spark, sf_dir))
    return plan.select("dir", "mode", "stem", "audio_out", "lrc_out", "skipped")


@query(
    f"""WITH {_FILES}
SELECT count(*) FILTER (mode = 'audio') AS n_audio, count(*) FILTER (mode = 'text') AS n_text,
       count(*) FILTER (mode = 'audio') || ' audio items, ' || count(*) FILTER (mode = 'text') || ' text items' AS summary FROM items"""
)
def q20_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_summary(scan.work_items(part_files(spark, sf_dir)))


@query(
    """WITH m AS (SELECT o_orderkey, 'm' || o_orderkey AS stem, o_totalprice / 50 AS d FROM orders),
n AS (SELECT *, CASE WHEN d <= 900 THEN 1 WHEN d % 600 > 0 AND d % 600 < 180 THEN floor(d / 600) ELSE ceil(d / 600) END::BIGINT AS n_chunks FROM m)
SELECT o_orderkey, n_chunks, k AS chunk_no,
       CASE WHEN d > 900 THEN stem || '_' || lpad(k::VARCHAR, greatest(2, length(n_chunks::VARCHAR))::INTEGER, '0') || '.mp3' ELSE stem || '.mp3' END AS output,
       CASE WHEN d > 900 THEN (k - 1) * 600.0::DOUBLE END AS start_s, CASE WHEN d > 900 AND k < n_chunks THEN 600.0::DOUBLE END AS length_s
FROM n, unnest(range(1, n_chunks + 1)) AS t(k)"""
)
def q21_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.chunk_plan(media_lengths(spark, sf_dir)).select("o_orderkey", "n_chunks", "chunk_no", "output", "start_s", "length_s")


_ERRORS = f"""errors AS (
  SELECT event_id, 'call failed: ' || l[(event_id % len(l) + 1)::INTEGER] || ' [' || event_type || ']' AS message
  FROM events, (SELECT {[n for n, _ in control.PASSING] + ["RESOURCE_EXHAUSTED", "the sentence is too long", "TimeoutError after 503", "permission denied"]}::VARCHAR[] AS l)),
kinds AS (
  SELECT *, CASE {" ".join(f"WHEN contains(message, '{n}') THEN '{k}'" for n, k in control.PASSING)}
                 {" ".join(f"WHEN contains(message, '{n}') THEN '{control.CLOUD_KIND}'" for n in control.CLOUD_CODES)} END AS kind,
         {" OR ".join(f"contains(message, '{n}')" for n in control.TOO_LONG)} AS is_too_long
  FROM errors)"""


@query(f"WITH {_ERRORS} SELECT event_id, kind, is_too_long FROM kinds")
def q22_classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.col("message")
    return event_errors(spark, sf_dir).select("event_id", control.error_kind(message, cloud=True).alias("kind"), control.too_long(message).alias("is_too_long"))


@query(
    f"""WITH {_ERRORS}
SELECT event_id, kind, a::INTEGER AS attempt, CASE WHEN a < n THEN 2.0::DOUBLE * pow(2, a - 1) END AS delay_s, a = n AS gives_up
FROM (SELECT *, CASE WHEN kind IS NULL THEN 1 ELSE 4 END AS n FROM kinds), unnest(range(1, n + 1)) AS t(a)"""
)
def q23_retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.retry_plan(event_errors(spark, sf_dir), control.error_kind(F.col("message"), cloud=True)).drop("message")


_CLIPS = f"""{_SEGMENTS},
clips AS (SELECT user_id, idx, (idx * 37) % 900 + 100 AS duration_ms, CASE WHEN idx % 5 = 2 THEN 0 ELSE 4096 END AS size FROM segs WHERE idx % 7 <> 3),
lengths AS (
  SELECT s.user_id, s.idx, coalesce(c.duration_ms, 500) AS clip_ms, c.duration_ms IS NULL AS fallback
  FROM segs s LEFT JOIN (SELECT * FROM clips WHERE size > 0) c USING (user_id, idx))"""


def _clip_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = track_segments(spark, sf_dir)
    clips = segs.filter("idx % 7 <> 3").select("user_id", "idx", (F.col("idx") * 37 % 900 + 100).alias("duration_ms"), F.when(F.col("idx") % 5 == 2, 0).otherwise(4096).alias("size"))
    return media.clip_lengths(segs.select("user_id", "idx"), clips, ("user_id", "idx"))


@query(f"WITH {_CLIPS} SELECT user_id, idx, clip_ms::BIGINT AS clip_ms, fallback FROM lengths")
def q24_synth_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clip_lengths(spark, sf_dir)


@query(
    f"""WITH {_CLIPS}
SELECT user_id, count(*) FILTER (fallback) AS n_fallback, count(*) AS total,
       array_to_string((list(idx ORDER BY idx) FILTER (fallback))[1:8], ', ') || CASE WHEN count(*) FILTER (fallback) > 8 THEN ', ... (' || (count(*) FILTER (fallback) - 8) || ' more)' ELSE '' END AS indices
FROM lengths GROUP BY user_id HAVING count(*) FILTER (fallback) > 0"""
)
def q24b_fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fallback_summary(_clip_lengths(spark, sf_dir), "user_id")


@query(
    """SELECT event_id, CASE WHEN n IS NOT NULL THEN CASE WHEN -value > -60 THEN n + value ELSE 0 END ELSE g END::DOUBLE AS applied_db,
       CASE WHEN n IS NOT NULL THEN 'normalize to ' || n || ' dBFS' WHEN g <> 0 THEN CASE WHEN g > 0 THEN '+' ELSE '' END || g || ' dB' ELSE 'default' END AS label
FROM (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN -20.0::DOUBLE END AS n, (event_id % 5 - 2)::DOUBLE AS g FROM events)"""
)
def q25_volume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, gain = F.when(F.col("event_id") % 3 == 0, F.lit(-20.0)), (F.col("event_id") % 5 - 2).cast("double")
    events = table(spark, sf_dir, "events")
    return events.select("event_id", media.applied_gain(-F.col("value"), gain, normal).alias("applied_db"), media.volume_label(gain, normal).alias("label"))


@query(
    """SELECT c_custkey, CASE WHEN e IN ('edge', 'openai', 'google') THEN e ELSE 'google' END AS engine, coalesce(g_cli, g_user, 0)::DOUBLE AS gain,
       nullif(n_user, '')::DOUBLE AS normalize, coalesce(nullif(d_cli, ''), '|||') AS delimiter
FROM (SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN 'edge' END, ''),
                                 CASE c_mktsegment WHEN 'BUILDING' THEN 'openai' WHEN 'MACHINERY' THEN 'edge' WHEN 'FURNITURE' THEN 'other' END, 'google') AS e,
             CASE WHEN c_custkey % 4 = 0 THEN 0 END AS g_cli, CASE WHEN c_custkey % 3 = 0 THEN -6 END AS g_user,
             CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '-18.5' END AS n_user,
             CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN '-' END AS d_cli FROM customer)"""
)
def q26_config_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, a user's settings and overrides made up from customers."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    engine_cli = F.when(k % 7 == 0, "").when(k % 7 == 1, "edge")
    segment = F.col("c_mktsegment")
    engine_user = F.when(segment == "BUILDING", "openai").when(segment == "MACHINERY", "edge").when(segment == "FURNITURE", "other")
    gain = control.layered(F.lit(0), F.when(k % 3 == 0, F.lit(-6)), F.when(k % 4 == 0, F.lit(0)), empty_counts=True)
    normalize = control.layered(none, F.when(k % 5 == 0, "").when(k % 5 == 1, "-18.5"), none)
    delimiter = control.layered(F.lit("|||"), none, F.when(k % 6 == 0, "").when(k % 6 == 1, "-"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        control.settled_engine(control.layered(F.lit("google"), engine_user, engine_cli)).alias("engine"),
        control.settled_gain(gain).alias("gain"),
        control.settled_loudness(normalize).alias("normalize"),
        delimiter.alias("delimiter"),
    )


@query(
    """SELECT c_custkey, CASE WHEN scan THEN 'batch' WHEN mode = 'audio' THEN CASE WHEN a AND l THEN 'audio' END WHEN mode = 'text' THEN CASE WHEN t THEN 'text' END
       WHEN a AND l THEN 'audio' WHEN t THEN 'text' END AS mode
FROM (SELECT c_custkey, c_custkey % 9 = 0 AS scan, c_custkey % 2 = 0 AS a, c_custkey % 3 <> 0 AS l, c_custkey % 5 < 3 AS t,
             CASE c_custkey % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'text' WHEN 2 THEN '' END AS mode FROM customer)"""
)
def q27_resolve_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mode = F.when(k % 4 == 0, " Audio ").when(k % 4 == 1, "text").when(k % 4 == 2, "")
    given = lambda test: F.when(test, "x")
    resolved = control.resolved_mode(given(k % 9 == 0), mode, given(k % 2 == 0), given(k % 3 != 0), given(k % 5 < 3))
    return table(spark, sf_dir, "customer").select("c_custkey", resolved.alias("mode"))


@query(
    """SELECT user_id, event_id, current, total FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current, count(*) OVER (PARTITION BY user_id) AS total FROM events)
WHERE current * 10 // total > (current - 1) * 10 // total OR current = total"""
)
def q28_progress_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return scan.checkpoints(events, "user_id", ("ts", "event_id")).select("user_id", "event_id", F.col("current").cast("bigint").alias("current"), "total")


@query(
    f"""WITH {_LINES}
SELECT doc_id, idx::INTEGER AS idx, left(line, 40) AS shown, greatest(n - 3, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) WHERE idx < 3"""
)
def q29_preview_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.first_rows(document_lines(spark, sf_dir), "doc_id", ("line_no",), F.col("line"))


@query(
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'skipped' END AS status, count(*) AS n, sum(o_orderkey % 100)::BIGINT AS elapsed_s
FROM orders GROUP BY 1"""
)
def q30_run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("skipped")
    return scan.run_outcomes(table(spark, sf_dir, "orders").select(status.alias("status"), (F.col("o_orderkey") % 100).alias("elapsed_s")))


@query(
    """SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) ELSE printf('%.1f MB', b / 1048576.0::DOUBLE) END AS size,
       printf('%02d:%02d', b // 60, b % 60) AS duration
FROM (SELECT doc_id, n_chars * 97 AS b FROM documents)"""
)
def q31_sizes_and_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") * 97
    return table(spark, sf_dir, "documents").select("doc_id", text.byte_size(n).alias("size"), text.short_duration(n).alias("duration"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE lower(left(n_name, 2)) || '-' || left(n_name, 2) END AS language FROM nation")
def q32_voice_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.substring("n_name", 1, 2)
    voice = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.concat_ws("-", F.lower(two), two, F.lit("Voice"), F.lit("A")))
    return table(spark, sf_dir, "nation").select("n_nationkey", paths.voice_language(voice).alias("language"))


@query(
    f"""WITH {_SEGMENTS}
SELECT user_id, idx, 'ja-JP' AS language, CASE WHEN idx % 3 <> 0 THEN 1.25::DOUBLE END AS speaking_rate, CASE WHEN idx % 4 <> 0 AND idx % 2 = 1 THEN 2.0::DOUBLE END AS pitch,
       CASE WHEN idx % 5 <> 0 THEN 'slowly' END AS instructions, 'native_' || lpad(idx::VARCHAR, greatest(4, length(idx::VARCHAR))::INTEGER, '0') || '.mp3' AS clip, native_text AS spoken
FROM segs"""
)
def q33_synthesis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.col("idx")
    voice = F.when(idx % 2 == 0, "ja-JP-Chirp3-HD-Kore").otherwise("ja-JP-Neural2-B")
    speed, pitch, say = F.when(idx % 3 == 0, 1.0).otherwise(1.25), F.when(idx % 4 == 0, 0.0).otherwise(2.0), F.when(idx % 5 == 0, "").otherwise("slowly")
    asked = media.requests(track_segments(spark, sf_dir), "native", voice, speed, pitch, say)
    return asked.select("user_id", "idx", "language", "speaking_rate", "pitch", "instructions", "clip", "spoken")


@query(
    """WITH m AS (SELECT o_orderkey, 'm' || o_orderkey AS stem, o_totalprice / 50 AS d FROM orders),
n AS (SELECT *, CASE WHEN d <= 900 THEN 1 WHEN d % 600 > 0 AND d % 600 < 180 THEN floor(d / 600) ELSE ceil(d / 600) END::BIGINT AS n_chunks FROM m)
SELECT stem || '.mp4' AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'skipped' ELSE 'run' END AS status, n_chunks AS n_outputs FROM n"""
)
def q34_extract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file's outputs are there; of others all but the first may be."""
    plan = media.chunk_plan(media_lengths(spark, sf_dir)).withColumn("source", F.concat("stem", F.lit(".mp4")))
    there = plan.filter("o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND chunk_no > 1)").select(F.col("output").alias("name"))
    return media.extract_status(plan, there)


@query(
    """SELECT c_custkey, CASE WHEN e IN ('edge', 'openai', 'google') THEN e ELSE 'google' END AS engine, coalesce(g_cli, g_user, 0)::DOUBLE AS gain,
       nullif(n_user, '')::DOUBLE AS normalize, coalesce(p_user, 0)::DOUBLE AS pitch, 0.5::DOUBLE AS after_native, coalesce(r_user, 44100)::INTEGER AS sample_rate,
       CASE WHEN scan THEN 'batch' WHEN mode = 'audio' THEN NULL WHEN t THEN 'text' END AS run_mode
FROM (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 1 THEN 'edge' END, CASE c_mktsegment WHEN 'BUILDING' THEN 'openai' WHEN 'FURNITURE' THEN 'other' END, 'google') AS e,
             CASE WHEN c_custkey % 4 = 0 THEN 0 END AS g_cli, CASE WHEN c_custkey % 3 = 0 THEN -6.5 END AS g_user,
             CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '-18.5' END AS n_user,
             CASE WHEN c_custkey % 2 = 0 THEN 1.5 END AS p_user, CASE WHEN c_custkey % 11 = 0 THEN 8000 END AS r_user,
             c_custkey % 9 = 0 AS scan, c_custkey % 5 < 3 AS t, CASE WHEN c_custkey % 6 = 0 THEN 'audio' END AS mode FROM customer)"""
)
def q26b_settled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' documents and overrides as JSON, through the whole settings table: sections, nested ones, types, modes."""
    k = F.col("c_custkey")
    section = lambda **fields: F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    engine = F.when(F.col("c_mktsegment") == "BUILDING", "openai").when(F.col("c_mktsegment") == "FURNITURE", "other")
    google = F.struct(F.when(k % 2 == 0, F.lit(1.5)).alias("pitch"))
    tts = F.struct(engine.alias("engine"), F.when(k % 3 == 0, F.lit(-6.5)).alias("gain"), F.when(k % 5 == 0, "").when(k % 5 == 1, "-18.5").alias("normalize"), google.alias("google"))
    user = section(mode=F.when(k % 6 == 0, "audio"), tts=tts, output=F.struct(F.when(k % 11 == 0, F.lit(8000)).alias("sample_rate")))
    own = F.struct(F.when(k % 9 == 0, "folder").alias("scan"), F.when(k % 5 < 3, "t.txt").alias("text"))
    override = section(paths=own, tts=F.struct(F.when(k % 7 == 0, "").when(k % 7 == 1, "edge").alias("engine"), F.when(k % 4 == 0, F.lit(0)).alias("gain")))
    found = settings.resolved(settings.settled(table(spark, sf_dir, "customer").select("c_custkey", user.alias("user"), override.alias("override"))))
    return found.select("c_custkey", "tts.engine", "tts.gain", "tts.normalize", "google.pitch", "timing.after_native", "output.sample_rate", "run_mode")


@query(
    f"""WITH {_FILES}
SELECT 'audio' AS asked, dir, mode, stem FROM items WHERE mode = 'audio' UNION ALL SELECT 'text', dir, 'text', stem FROM fresh WHERE ext = 'txt'"""
)
def q18c_scan_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of a run that is asked for sound only, and that of one for texts only, where nothing is paired."""
    found = part_files(spark, sf_dir)
    one = lambda mode: scan.work_items(found, mode).select(F.lit(mode).alias("asked"), "dir", "mode", "stem")
    return one("audio").unionByName(one("text"))


@query(
    f"""WITH {_FILES}, counts AS (SELECT o.dir || o.size AS part, count(i.stem) FILTER (mode = 'audio') AS a, count(i.stem) FILTER (mode = 'text') AS t
  FROM (SELECT DISTINCT p_brand AS dir, p_size AS size, 'item' || p_partkey AS stem FROM part) o LEFT JOIN items i ON i.dir = o.dir AND i.stem = o.stem GROUP BY 1)
SELECT part, a AS n_audio, t AS n_text, CASE WHEN a + t = 0 THEN 'no items' ELSE
       concat_ws(', ', CASE WHEN a > 0 THEN a || ' audio item' || CASE WHEN a = 1 THEN '' ELSE 's' END END, CASE WHEN t > 0 THEN t || ' text item' || CASE WHEN t = 1 THEN '' ELSE 's' END END) END AS summary
FROM counts"""
)
def q20b_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary for each brand and size of part: some have no item, or one."""
    items = scan.work_items(part_files(spark, sf_dir)).select("dir", "stem", "mode")
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dir"), F.col("p_size").alias("size"), F.concat(F.lit("item"), F.col("p_partkey").cast("string")).alias("stem")).distinct()
    found = parts.join(items, ["dir", "stem"], "left").withColumn("part", F.concat("dir", F.col("size").cast("string")))
    return scan.scan_summary(found, "part")


@query(
    f"""WITH {_FILES}
SELECT dir, coalesce(audio, text) AS label, 'in/' || stem || '_echo.m4a' AS audio_out, 'in/' || stem || '_echo.lrc' AS lrc_out FROM items
UNION ALL SELECT dir, coalesce(audio, text), 'out/' || stem || '.wav', 'out/' || stem || '.lrc' FROM items"""
)
def q19b_output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results beside the source, and those that the settings name."""
    items = scan.work_items(part_files(spark, sf_dir)).withColumn("label", scan.label())
    none, source = F.lit(None).cast("string"), F.concat(F.lit("in/"), "label")
    beside = paths.output_paths(F.col("mode"), source, none, none, F.lit("m4a"))
    named = paths.output_paths(F.col("mode"), source, F.concat(F.lit("out/"), "stem", F.lit(".wav")), F.lit(""), F.lit("m4a"))
    one = lambda found: items.select("dir", "label", found[0].alias("audio_out"), found[1].alias("lrc_out"))
    return one(beside).unionByName(one(named))


@query(
    f"""WITH {_SEGMENTS}, spoken AS (SELECT * FROM segs WHERE idx % 7 <> 3)
SELECT s.user_id, s.idx, (s.idx * 37) % 900 + 100 AS target_ms, (s.idx * 11) % 500 AS native_ms FROM spoken s"""
)
def q15d_with_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined to their clips by number; those without clips are left out."""
    segs = track_segments(spark, sf_dir)
    idx = F.col("idx")
    clips = segs.filter("idx % 7 <> 3").select("user_id", "idx", (idx * 37 % 900 + 100).alias("target_ms"), (idx * 11 % 500).alias("native_ms"))
    return loops.with_clips(segs, clips, "user_id").select("user_id", "idx", "target_ms", "native_ms")


@query(
    f"""SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS shortened, replace(left(text, 30), chr(10), ' ') AS snippet,
       array_to_string(string_split(text, ' ')[-3:], ' ') AS tail, regexp_matches(text, '[。！？!?.;；\\n]') AS strong FROM documents"""
)
def q35_log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    tail = F.array_join(text.last_items(F.split(t, " "), 3), " ")
    return table(spark, sf_dir, "documents").select("doc_id", text.shortened(t, 100).alias("shortened"), text.snippet(t).alias("snippet"), tail.alias("tail"), text.has_strong(t).alias("strong"))


@query(
    f"""WITH {_FILES}, found AS (SELECT dir, dir || '/' || base0 || ending || '.' || ext AS source, base0 || ending AS stem, ext, ext = 'mp3' AS itself FROM files WHERE lower(ext) IN ('mp3', 'wav'))
SELECT dir, source, CASE WHEN itself OR EXISTS (SELECT 1 FROM files f WHERE f.dir = found.dir AND f.base0 || f.ending = stem AND f.ext = 'mp3') THEN 'skipped' ELSE 'run' END AS status FROM found"""
)
def q34b_extract_sound_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound files themselves: one that would overwrite itself is skipped, and one whose result lies beside it in the same folder."""
    listed = part_files(spark, sf_dir)
    known = listed.filter(paths.extension(F.col("name")).isin("mp3", "wav"))
    plan = media.chunk_plan(known.withColumns({"stem": paths.stem(F.col("name")), "duration_s": F.lit(60.0)})).withColumnRenamed("name", "source")
    return media.extract_status(plan, listed).select("dir", F.concat_ws("/", "dir", "source").alias("source"), "status")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN length(o_comment_like) > 100 THEN left(o_comment_like, 97) || '...' ELSE o_comment_like END END AS error
FROM (SELECT o_orderkey, o_orderstatus, 'reason ' || repeat(o_orderpriority || ' ', 1 + (o_orderkey % 12)::INTEGER) || 'end' AS o_comment_like FROM orders) WHERE o_orderstatus = 'F'"""
)
def q30b_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each failed item's error, shortened."""
    told = F.concat(F.lit("Traceback\n  at 1\nreason "), F.repeat(F.concat("o_orderpriority", F.lit(" ")), (1 + F.col("o_orderkey") % 12).cast("int")), F.lit("end\n"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), status.alias("status"), told.alias("error"))
    return scan.failures(runs).withColumnRenamed("item", "o_orderkey")

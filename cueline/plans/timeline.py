"""Queries along time and over runs: joins of spans, last values as of a time, sessions, moving sums, totals and sketches.

They are part of the catalog (:mod:`cueline.plans.catalog`), with the same tables and tracks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.operators import in_sql, intervals, ordered, run_log, scan, segments, sessions
from cueline.plans.catalog import _FILES, _SEGMENTS, _done_files, _offsets_select, _parts_sql, part_files, query, table, track_cues, voiced

#: How long before an event its segment is looked up, and the spans of the other queries, in seconds.
EARLIER_S, GAP_S, NEAR_S, TOLERANCE_S = 30, 6 * 3600, 6 * 3600, 12 * 3600


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def days(time: Column) -> Column:
    return F.unix_date(time.cast("date"))


@query(
    f"""WITH {_SEGMENTS}
SELECT c.user_id, c.event_id, c.start_ms - {EARLIER_S} AS at, s.idx, s.target_text FROM cues c JOIN segs s
ON s.user_id = c.user_id AND s.start_ms <= c.start_ms - {EARLIER_S} AND c.start_ms - {EARLIER_S} <= greatest(s.start_ms, s.end_ms - 1)"""
)
def q36_segment_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that a track was at some time before each event."""
    at = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200) - EARLIER_S
    points = table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("at"))
    spoken = track_cues(spark, sf_dir).withColumn("native_text", F.lit(None).cast("string"))  # not asked for, so not sorted along
    held = segments.segments(spoken, ("event_id",), "user_id").select("user_id", "start_ms", "end_ms", "idx", "target_text")
    return intervals.overlaps(points, held, ("at", "at"), ("start_ms", "end_ms"), ["user_id"]).select("user_id", "event_id", "at", "idx", "target_text")


@query(
    """WITH spans AS (SELECT l_shipdate::DATE - DATE '1970-01-01' AS low, l_shipdate::DATE - DATE '1970-01-01' + l_quantity::BIGINT AS high, count(*) AS n FROM lineitem GROUP BY ALL),
points AS (SELECT o_orderdate::DATE - DATE '1970-01-01' AS day, count(*) AS n_orders FROM orders GROUP BY ALL)
SELECT day, n_orders, sum(n)::BIGINT AS n_items, count(*) AS n_spans FROM points JOIN spans ON low <= day AND day < high GROUP BY ALL"""
)
def q36b_in_transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day with orders, the items under way, each for as many days as its quantity; equal spans are counted before they are joined."""
    low = days(F.col("l_shipdate"))
    spans = table(spark, sf_dir, "lineitem").select(low.alias("low"), (low + F.col("l_quantity").cast("int")).alias("high")).groupBy("low", "high").agg(F.count("*").alias("n"))
    points = table(spark, sf_dir, "orders").groupBy(days(F.col("o_orderdate")).cast("bigint").alias("day")).agg(F.count("*").alias("n_orders"))
    found = intervals.overlaps(points, spans, ("day", "day"), ("low", "high"))
    return found.groupBy("day", "n_orders").agg(F.sum("n").alias("n_items"), F.count("*").alias("n_spans"))


@query(
    f"""WITH views AS (SELECT user_id, epoch_us(ts) AS t, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.user_id, p.event_id, CASE WHEN epoch_us(ts) <= t + {TOLERANCE_S}000000 THEN view_id END AS view_id, CASE WHEN epoch_us(ts) <= t + {TOLERANCE_S}000000 THEN t END AS since
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN views v ON v.user_id = p.user_id AND epoch_us(p.ts) >= v.t"""
)
def q37_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's last view by its user, unless that is too long ago."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", micros(F.col("ts")).alias("t"))
    views = events.filter("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("view_id"))
    found = ordered.as_of(events.filter("event_type = 'purchase'"), views, "user_id", "t", ["view_id"], ["view_id"], F.lit(TOLERANCE_S * 1_000_000), matched="since")
    return found.select("user_id", "event_id", "view_id", "since")


@query(
    """WITH earlier AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS before FROM orders GROUP BY ALL)
SELECT a.o_orderkey, b.before, b.o_orderdate::DATE - DATE '1970-01-01' AS since FROM orders a ASOF LEFT JOIN earlier b ON b.o_custkey = a.o_custkey AND a.o_orderdate > b.o_orderdate"""
)
def q37b_previous_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's last earlier one by the same customer; of several of a day, the one of the largest number."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", days(F.col("o_orderdate")).cast("bigint").alias("day"))
    right = orders.withColumnRenamed("o_orderkey", "before")
    return ordered.as_of(orders, right, "o_custkey", "day", ["before"], ["before"], earlier=True, matched="since").select("o_orderkey", "before", "since")


@query(
    """SELECT user_id, event_id, CASE WHEN epoch_us(ts) >= t THEN t END AS last_order, o_orderkey
FROM events e ASOF LEFT JOIN (SELECT o_custkey, epoch_us(o_orderdate) AS t, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON o.o_custkey = e.user_id AND epoch_us(e.ts) >= o.t"""
)
def q37c_order_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last order of the customer of the user's number."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("t"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), micros(F.col("o_orderdate")).alias("t"), "o_orderkey")
    return ordered.as_of(events, orders, "user_id", "t", ["o_orderkey"], ["o_orderkey"], matched="last_order").select("user_id", "event_id", "last_order", "o_orderkey")


@query(
    f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT user_id, t, sum((t - before > {GAP_S}000000)::BIGINT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, coalesce(session, 0)::BIGINT AS session, count(*) AS n, min(t) AS begins, max(t) AS ends FROM s GROUP BY ALL"""
)
def q38_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user's events."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("t"))
    return sessions.session_summary(sessions.sessions(events, "user_id", "t", GAP_S * 1_000_000, ["event_id"]), "user_id", "t")


@query(
    f"""SELECT user_id, event_id, count(*) OVER w AS n_near, sum(cents) OVER w ::BIGINT AS sum_near
FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t, round(value * 100)::BIGINT AS cents FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {NEAR_S} PRECEDING AND {NEAR_S} FOLLOWING)"""
)
def q39_moving_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sum of the values around each event of a user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(micros(F.col("ts")) / 1_000_000).alias("t"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return sessions.moving(events, "user_id", "t", "cents", NEAR_S, NEAR_S).select("user_id", "event_id", "n_near", "sum_near")


@query("SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id)::INTEGER AS tile FROM events")
def q39b_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter of its user's events that each one's value is in."""
    return sessions.tiles(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", ["value", "event_id"], 4).select("event_id", "tile")


_PLANNED = f"{_FILES}, planned AS (SELECT dir, mode, CASE WHEN substr(stem, 5)::BIGINT % 4 = 0 THEN 'skipped' ELSE 'run' END AS status FROM items)"


@query(f"WITH {_PLANNED} SELECT dir, mode, status, count(*) AS n, grouping(dir, mode, status)::INTEGER AS level FROM planned GROUP BY CUBE (dir, mode, status)")
def q40_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by folder, mode and status, with all totals."""
    plan = scan.planned(scan.work_items(part_files(spark, sf_dir)), _done_files(spark, sf_dir))
    return run_log.totals(plan.select("dir", "mode", F.when(F.col("skipped"), "skipped").otherwise("run").alias("status")), "dir", "mode", "status")


@query(
    """WITH a AS (SELECT p_brand AS dir, p_size AS size FROM part), b AS (SELECT p_brand AS dir, p_size AS size FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_brand, p_size + 1 FROM part WHERE p_partkey % 5 = 0),
c AS (SELECT dir, size, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 2) AS y FROM (SELECT *, 1 AS side FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY ALL)
SELECT dir, size, least(x, y) AS "both", greatest(x - y, 0) AS missing, greatest(y - x, 0) AS extra FROM c"""
)
def q41_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and sizes of the parts against another listing of them, in which some are missing and others are new."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("dir"), F.col("p_size").alias("size"))
    found = part.filter("p_partkey % 3 <> 0").select("dir", "size").unionByName(part.filter("p_partkey % 5 = 0").select("dir", (F.col("size") + 1).alias("size")))
    return run_log.reconciled(part.select("dir", "size"), found)


@query(
    """WITH clips AS (SELECT user_id % 7 AS week, user_id AS voice FROM events)
SELECT week, count(*) AS n, true AS voices_near, true AS lengths_near FROM clips GROUP BY week"""
)
def q42_merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices and clip lengths of many runs, from sketches kept for each run (a user and day), within the stated errors of the exact ones."""
    length = F.col("event_id") * 7919 % 10_007
    clips = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("week"), "user_id", F.col("ts").cast("timestamp").cast("date").alias("day"), length.alias("length_ms"))
    log = run_log.run_sketches(clips.withColumn("run", F.struct("week", "day")), "run", F.col("user_id"), F.col("length_ms"))
    merged = run_log.over_runs(log.select("run.week", "n", "voices", "lengths"), "week")
    exact = clips.groupBy("week").agg(F.countDistinct("user_id").alias("voices"), *(F.percentile("length_ms", r).alias(f"p{i}") for i, r in enumerate((0.5 - 0.02, 0.5 + 0.02, 0.95 - 0.02, 0.95 + 0.02))))
    near = F.abs(F.col("n_voices") - F.col("voices")) <= F.greatest(F.lit(1), run_log.DISTINCT_ERROR * F.col("voices"))
    within = lambda i, low, high: (F.col("lengths_at")[i] >= F.floor(low)) & (F.col("lengths_at")[i] <= F.ceil(high))
    return merged.join(exact, "week").select("week", "n", near.alias("voices_near"), (within(0, "p0", "p1") & within(1, "p2", "p3")).alias("lengths_near"))


@query(_parts_sql(("native", "silence")))
def q43_loop_parts_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all loops, from a table function that SQL calls."""
    in_sql.register(spark)
    return spark.sql("SELECT user_id, idx, pass, part, kind, part_ms FROM loop_parts(TABLE({segments}), 'progressive')", segments=voiced(spark, sf_dir))


@query(_offsets_select(2))
def q43b_loop_positions_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each loop begins, from a table function over each track's rows in order."""
    in_sql.register(spark)
    return spark.sql("SELECT user_id, idx, pass, loop_ms, pos_ms FROM loop_positions(TABLE({segments}) PARTITION BY (user_id) ORDER BY (idx), 'progressive')", segments=voiced(spark, sf_dir))

"""A log of runs: totals at all levels, listings that are reconciled, and sketches that are kept and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least relative error that the sketches are made for: distinct counts (2**12 registers), and ranks of percentiles.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.02


def totals(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts for each combination of ``by`` and for all totals of it, in one aggregation.

    A total has null where it sums up, and ``level`` tells it from a null value: a bit for each of ``by``, the first one highest, set where it is summed up.
    """
    return outcomes.cube(*by).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def reconciled(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of two listings of the same columns, each once, with ``both``, ``missing`` (of ``found``) and ``extra`` counts.

    ``both`` rows are those of INTERSECT ALL, ``missing`` and ``extra`` those of EXCEPT ALL either way: one aggregation of signed counts. Nulls are equal.
    """
    columns = expected.columns
    both = expected.withColumn("_side", F.lit(1)).unionByName(found.select(*columns).withColumn("_side", F.lit(-1)))
    n = lambda side: F.count_if(F.col("_side") == side)
    counts = both.groupBy(*columns).agg(n(1).alias("_a"), n(-1).alias("_b"))
    more = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    return counts.select(*columns, F.least("_a", "_b").alias("both"), more("_a", "_b").alias("missing"), more("_b", "_a").alias("extra"))


def run_sketches(clips: DataFrame, run: str, voice: Column, length_ms: Column) -> DataFrame:
    """A row for each run: ``n`` clips, sketches ``voices`` (HyperLogLog) and ``lengths`` (KLL); to be appended to a log."""
    return clips.groupBy(run).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(voice, 12).alias("voices"),
        F.kll_sketch_agg_bigint(length_ms.cast("bigint")).alias("lengths"),
    )


def over_runs(log: DataFrame, *by: str, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The log's runs merged, for each of ``by``: ``n``, ``n_voices`` and ``lengths_at`` (percentiles of clip lengths at ``ranks``).

    Distinct counts are within ``DISTINCT_ERROR``, and a percentile's rank within ``RANK_ERROR``, of the true ones.
    """
    merged = log.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("voices").alias("voices"), F.kll_merge_agg_bigint("lengths").alias("lengths"))
    at = F.array(*(F.kll_sketch_get_quantile_bigint("lengths", F.lit(r)) for r in ranks))
    return merged.select(*by, "n", F.hll_sketch_estimate("voices").alias("n_voices"), at.alias("lengths_at"))

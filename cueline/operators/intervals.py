"""Joins of intervals that overlap, by bins of several widths.

The narrowest bins are as wide as the data's usual interval; those of the next level are eight times as wide, and so on. An interval is
of the first level whose bins are at least as wide as it is, so that it lies in two bins of its level at most, and in two
of each wider one. Two intervals meet at the higher of their levels, in the bin where their overlap begins: each pair meets once, whatever
the lengths, and long intervals are not dealt to many bins. So a row goes to its own level and to those higher ones at which the other side has
intervals of its own: where one side is points, the other's rows go to one level each. The join is by equal bins, never by nested loops.

A bin with very many rows is split: the rows of one side are dealt to parts of it, and those of the other side go to each part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.operators.ordered import apart

#: Rows of one side that a bin may have before it is split.
HOT = 20_000
#: Doublings of a bin's width from a level to the next: fewer levels are fewer rows, and wider bins more pairs that are compared in vain.
DOUBLINGS = 3


def usual_width(spans: DataFrame, low: str, high: str, share: float = 0.5) -> int:
    """The length that ``share`` of the intervals do not exceed (about; 1 at least, also of no intervals)."""
    found = spans.select(F.percentile_approx(F.col(high) - F.col(low), share).alias("width")).first()["width"]
    return max(1, int(found or 1))


def _level(length: Column, width: int) -> Column:
    """The first level, in doublings of ``width``, whose bins are as wide as ``length``."""
    return F.greatest(F.lit(0), F.ceil(F.ceil(F.log2(F.greatest(length, F.lit(1)) / F.lit(float(width)))) / DOUBLINGS) * DOUBLINGS).cast("int")


def _own_levels(level: Column, others: Sequence[int]) -> Column:
    """The levels of a row: its own, and the higher ones of the other side; nothing that it could meet is at any other."""
    return F.concat(F.array(level), F.filter(F.lit(list(others) or [0]), lambda x: x > level))


def overlaps(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    keys: Sequence[str] = (),
    width: int | None = None,
    hot: int = HOT,
) -> DataFrame:
    """All pairs of rows of equal ``keys`` whose spans share a point: all columns of ``left``, then those of ``right`` but the keys.

    Spans are two whole-number columns, from the first to before the second; if both name one column, or hold one
    number, the span is that point. A span that ends before it begins, or has a null end, overlaps nothing, and null keys match nothing. ``width``
    is the narrowest bins' (by default the usual length of the right spans). Columns but the keys must differ in name.
    """
    width = width or usual_width(right, *right_span)
    n = apart([*left.columns, *right.columns], "low", "level", "bin", "salt", "parts")

    def spanned(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        low, high = (F.col(c).cast("bigint") for c in span)
        df = df.filter(low.isNotNull() & (high >= low))
        for key in keys:
            df = df.filter(F.col(key).isNotNull())
        return df

    def ends(span: tuple[str, str]) -> tuple[Column, Column, Column]:
        """The first and the last point of a span, and its level."""
        low, high = (F.col(c).cast("bigint") for c in span)
        last = F.greatest(low, high - 1)
        return low, last, _level(last - low, width)

    a, b = spanned(left, left_span), spanned(right, right_span)
    (l_low, l_last, l_level), (r_low, r_last, r_level) = ends(left_span), ends(right_span)
    # At most as many as there are doublings from the narrowest to the longest span.
    levels_of = lambda df, level: sorted(r[0] for r in df.select(level.alias("level")).distinct().collect())
    l_levels, r_levels = levels_of(a, l_level), levels_of(b, r_level)
    top = max([0, *l_levels, *r_levels])
    place = lambda point, level: F.floor(point / (F.lit(float(width)) * F.pow(F.lit(2.0), level))).cast("bigint")

    def binned(df: DataFrame, low: Column, last: Column, level: Column, others: list[int]) -> DataFrame:
        rows = df.withColumn(n["level"], F.explode(_own_levels(level, others)))
        return rows.withColumn(n["bin"], F.explode(F.sequence(place(low, F.col(n["level"])), place(last, F.col(n["level"])))))

    at = [*keys, n["level"], n["bin"]]
    x, y = binned(a, l_low, l_last, l_level, r_levels), binned(b, r_low, r_last, r_level, l_levels)
    # A row of a bin begins in the bin of the highest level around it, or in the one before: where those have few rows, none within is crowded. Of
    # either kind there are at most a few for each ``hot`` rows, so each task may have them all, and the rows themselves are not shuffled for them.
    wide = [*keys, n["low"]]
    begun = lambda df: df.withColumn(n["low"], place(l_low, F.lit(float(top))))
    full = begun(a).groupBy(*wide).agg(F.count("*").alias(n["parts"])).filter(F.col(n["parts"]) * 2 > hot).drop(n["parts"])
    near = full.withColumn(n["low"], F.explode(F.array(F.col(n["low"]) - 1, F.col(n["low"]), F.col(n["low"]) + 1))).distinct()
    counts = begun(x).join(F.broadcast(near), wide, "left_semi").groupBy(*at).agg(F.ceil(F.count("*") / hot).cast("int").alias(n["parts"]))
    crowded = counts.filter(F.col(n["parts"]) > 1)
    split = lambda df, salt: df.join(F.broadcast(crowded), at, "left").withColumn(n["salt"], salt(F.coalesce(n["parts"], F.lit(1)))).drop(n["parts"])
    x = split(x, lambda k: F.pmod(F.xxhash64(*left.columns, F.monotonically_increasing_id()), k).cast("int"))
    y = split(y, lambda k: F.explode(F.sequence(F.lit(0), k - 1)))
    met = x.join(y, [*at, n["salt"]])
    # Each pair is of one bin: that in which its overlap begins, at the higher of its levels. Levels and ends are worked out again here, not shuffled.
    once = (F.col(n["level"]) == F.greatest(l_level, r_level)) & (place(F.greatest(l_low, r_low), F.col(n["level"])) == F.col(n["bin"]))
    share = (l_low <= r_last) & (r_low <= l_last)
    return met.filter(once & share).select(*left.columns, *(c for c in right.columns if c not in keys))

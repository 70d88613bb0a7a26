"""Sessions, moving sums and tiles along time, for items of any size.

All of them are sums along a range sort (:mod:`cueline.operators.ordered`) and lookups of such sums, so that no
window gathers an item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.functions.workers import written
from cueline.operators.ordered import as_of, in_order


def sessions(rows: DataFrame, item: str, time: str, gap: int, order: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``session``, from 0: a row more than ``gap`` after the item's row before opens a new one.

    ``time`` is a whole-number column; rows without one are left out.
    """
    known = rows.filter(F.col(time).isNotNull())
    ahead = in_order(known, item, [time, *order], leads={"_next": time})
    marked = ahead.withColumn("_closes", (F.coalesce(F.col("_next") - F.col(time), F.lit(0)) > gap).cast("bigint")).drop("_next")
    return in_order(marked, item, [time, *order], sums={"session": "_closes"}).drop("_closes")


def session_summary(found: DataFrame, item: str, time: str) -> DataFrame:
    """Rows (``n``) and first and last time of each session."""
    return found.groupBy(item, "session").agg(F.count("*").alias("n"), F.min(time).alias("begins"), F.max(time).alias("ends"))


def moving(rows: DataFrame, item: str, time: str, value: str, back: int, ahead: int) -> DataFrame:
    """``rows`` with ``n_near`` and ``sum_near``: number and sum of ``value`` of the item's rows from ``back`` before to ``ahead`` after the row's time.

    ``time`` and ``value`` are whole-number columns; a null value counts 0, and a row without a time has nulls. The sum of a span is the difference of two
    running sums, which are looked up as of its ends.
    """
    known = rows.filter(F.col(time).isNotNull()).select(item, F.col(time).cast("bigint").alias("_time"), F.coalesce(F.col(value), F.lit(0)).cast("bigint").alias("_value"))
    placed = in_order(known, item, ["_time"], "_place", sums={"_before": "_value"})
    upto = written(placed.select(item, "_time", (F.col("_place") + 1).alias("_n"), (F.col("_before") + F.col("_value")).alias("_sum")))
    last = as_of(rows.withColumn("_time", F.col(time) + ahead), upto, item, "_time", ["_n", "_sum"], ["_n"])
    last = last.withColumnsRenamed({"_n": "_n_to", "_sum": "_sum_to"})
    first = as_of(last.withColumn("_time", F.col(time) - back), upto, item, "_time", ["_n", "_sum"], ["_n"], earlier=True)
    less = lambda c: F.col(f"{c}_to") - F.when(F.col(f"{c}_to").isNotNull(), F.coalesce(c, F.lit(0)))
    return first.select(*rows.columns, less("_n").alias("n_near"), less("_sum").alias("sum_near"))


def tiles(rows: DataFrame, item: str, order: Sequence[str], n: int) -> DataFrame:
    """``rows`` with ``tile`` (1 to ``n``): the item's rows in order, in ``n`` parts of which the first have a row more if they cannot be equal."""
    totals = written(rows.groupBy(F.col(item).alias("_item")).agg(F.count("*").alias("_rows")))
    placed = in_order(rows, item, order, "_place").join(totals, F.col(item).eqNullSafe(F.col("_item")))
    low, more, place = F.expr(f"_rows DIV {int(n)}"), F.col("_rows") % n, F.col("_place")
    inside = F.when(place < more * (low + 1), F.floor(place / (low + 1))).otherwise(more + F.floor((place - more * (low + 1)) / F.greatest(low, F.lit(1))))
    return placed.select(*rows.columns, (inside + 1).cast("int").alias("tile"))

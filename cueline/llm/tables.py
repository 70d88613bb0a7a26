"""Helpers that every corpus operator shares: lineage cuts, word counts and clash-free column names."""

from __future__ import annotations

from collections.abc import Sequence
from threading import Lock

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.workers import BATCHES, reach_in_small_batches, shared_folder, written  # noqa: F401

#: The letters that "lower-case A-Z" speaks of.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _none_of(characters: str) -> str:
    """A pattern for runs of other characters.

    The characters stand one by one: Java looks such a class up in a table, and goes through a class of
    ranges member by member, which took fifteen times as long.
    """
    return "[^" + "".join(f"\\x{ord(c):02X}" for c in characters) + "]+"


_ASCII = [chr(i) for i in range(128)]
#: Words of the two kinds that the operators use: of digits, a-z and all beyond ASCII (before or after A-Z are lower-cased), and parted by blanks.
ALNUM_WORD = _none_of("".join(c for c in _ASCII if not (c.isdigit() or c.islower())))
ANY_CASE_WORD = _none_of("".join(c for c in _ASCII if not c.isalnum()))
BLANK_WORD = _none_of(" \t\n\v\f\r")
#: The blanks that part words, as members of a character class.
BLANKS_CLASS = BLANK_WORD.removeprefix("[^").removesuffix("]+")


#: Spark's setting (from 4.1 on; earlier ones ignore it) by which the shuffle files of a table go at the end of each action on it.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SETTING = Lock()


def passing(df: DataFrame) -> DataFrame:
    """``df``, for a single action: what was shuffled for that goes when it ends, not when the driver happens to collect its garbage.

    Spark takes the setting as it builds a table; the session has its own again before anything runs.
    """
    conf = df.sparkSession.conf
    with _SETTING:
        own = conf.get(RELEASE, None)
        conf.set(RELEASE, "true")
        try:
            return df.select("*")
        finally:
            if own is None:
                conf.unset(RELEASE)
            else:
                conf.set(RELEASE, own)


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, checkpointed once to the shared folder, so that later plans start from them. Its shuffle files go at once."""
    shared_folder(df.sparkSession)
    return passing(df).checkpoint()


def apart_from_its_rows(key: str) -> Column:
    """The same 64-bit key, as a value that no partitioning is known for.

    A table that was grouped by a key is joined where its groups are; the other side's rows of one hot
    key then meet in one task. With this key the join shuffles both sides for itself, and Spark
    splits skewed partitions of such joins.
    """
    return F.col(key).bitwiseXOR(F.lit(0)).alias(key)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in ``order``, by a range sort and the row counts of its partitions.

    Rows that tie in all of ``order`` may be very many: they are parted by where they came from.
    """
    n = apart(df, "from", "at", "part", "before")
    placed = df.withColumn(n["from"], F.monotonically_increasing_id()).orderBy(*order, n["from"]).drop(n["from"])
    placed = settled(placed.withColumn(n["at"], F.monotonically_increasing_id())).withColumn(n["part"], F.shiftright(n["at"], 33))
    counts = placed.groupBy(n["part"]).agg(F.count("*").alias(name))
    before_it = Window.orderBy(n["part"]).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select(n["part"], F.coalesce(F.sum(name).over(before_it), F.lit(0)).alias(n["before"]))
    # As many rows as the sort has partitions, so each task may have them all.
    out = placed.join(F.broadcast(offsets), n["part"])
    return out.withColumn(name, F.col(n["before"]) + F.col(n["at"]).bitwiseAND((1 << 33) - 1)).drop(n["at"], n["part"], n["before"])


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small.

    Whole texts pass through Python workers here. A batch is held several times (by the JVM's
    writer, the worker and the JVM's reader), beside a full heap; 8 MB keep that small. A longer
    text is a batch of its own. What the session sets itself stays.
    """
    reach_in_small_batches(df.sparkSession)
    return df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of blank-separated words as bigint; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("bigint")


def apart(df: DataFrame, *names: str) -> dict[str, str]:
    """A name for each of ``names`` that no column of ``df`` has (names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        out[name] = next(x for x in (f"_{name}{'_' * i}" for i in range(1, len(taken) + 3)) if x.lower() not in taken)
    return out

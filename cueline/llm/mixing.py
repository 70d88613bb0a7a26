"""Mixing sources to target weights.

Sources weigh by their place in code-point order and share a budget of words. A
source's target stops at a limit of epochs; what is over is shared again by weight.
Its documents get hash-random keys and are sorted by them; a distributed prefix sum
of their sizes finds where the source's exact budget ends. Whole epochs repeat every
document; the last, partial one takes documents in key order, and the document on
the cut for the words that fit.

The prefix sum has two levels: sums over equal slices of the key range of each
source, then within a slice. A slice, not a source, is what one task sorts; there are as many as keep it to about ``SLICE_ROWS`` rows, should all be of one source. As keys
are uniform, a source of any size deals evenly to its slices. Keys and sizes alone are sorted; the rows join what is taken of them.

Defined results: a null text has no words; null is a source of its own, the last.
Rows of equal id are ordered by their text's hash and each counts; rows without an id are ordered by that hash alone. A source without
words has the target 0. An empty table gives an empty result. Input columns named like
a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.tables import BLANKS_CLASS, apart, numbered, settled, word_count

WEIGHTS = (5, 2, 1)
#: Words to take as a share of all there are, and the most times that a source is repeated.
SHARE, EPOCHS = 1.5, 2.0
#: Rows of one source that a slice of its key range has, about.
SLICE_ROWS = 8192


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (``source_key``, ``source``, ``source_size``) with ``target``.

    Each open source gets ``level`` times its weight. Sources whose limit is below that are
    closed at it, and the rest is shared anew, until none is above; each round gathers
    one row of sums.
    """
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "rank")
    ranked = settled(ranked.withColumns({"weight": weight, "limit": F.col("source_size") * F.lit(float(epochs))}).drop("rank"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        closed = F.col("limit") < F.lit(level) * F.col("weight")
        taken, open_ = ranked.agg(F.sum(F.when(closed, F.col("limit")).otherwise(0.0)), F.sum(F.when(~closed, F.col("weight")).otherwise(0.0))).first()
        if not open_ or (reached := (share * total - taken) / open_) <= level:
            break
        level = reached
    return ranked.withColumn("target", F.least("limit", F.lit(level) * F.col("weight"))).drop("weight", "limit")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
    seed: str = "mix",
    slice_rows: int = SLICE_ROWS,
    keep_text: bool = True,
) -> DataFrame:
    """Every row of ``df`` with ``size``, ``source_size``, ``target`` (its source's) and ``taken`` (words, repeats counted)."""
    df = df.drop("size", "source_size", "target", "taken")
    n = apart(df, "source", "key", "slice", "before", "tie", "base", "row")
    source, key, part, before, tie, base, row = n.values()
    named = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    rows = df.withColumns(
        {
            "size": word_count(F.col(text_col)),
            source: named,
            tie: F.xxhash64(text_col),
        }
    )
    # Rows without an id are dealt by their texts, so that they are not one key.
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.col(tie).cast("string")))
    rows = rows.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed), own)))
    # Sums and rows both start from here, so that words are counted once; a row keeps its number.
    whole = settled((rows if keep_text else rows.drop(text_col)).withColumn(row, F.monotonically_increasing_id()))
    slices = max(1, -(-whole.count() // slice_rows))
    rows = whole.select(row, source, F.col(source_col).alias("source"), key, F.col(id_col).alias("id"), tie, "size")
    rows = rows.withColumn(part, F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * slices / (1 << 32)).cast("int"))
    sums = settled(rows.groupBy(source, part).agg(F.first("source").alias("source"), F.sum("size").alias("slice_size")))
    totals = sums.groupBy(F.col(source).alias("source_key")).agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size"))
    shares = targets(totals, weights, share, epochs).select(F.col("source_key").alias(source), "source_size", "target")
    lower = Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(source, part, F.coalesce(F.sum("slice_size").over(lower), F.lit(0)).alias("slice_start")).join(shares, source)
    starts = settled(starts.withColumnRenamed("slice_start", base))

    inside = Window.partitionBy(source, part).orderBy(key, "id", tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(before, F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, [source, part])
    words = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    rest = words - full * F.col("source_size") - F.col(base) - F.col(before)
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    found = rows.select(F.col(row).alias(base), "source_size", "target", taken.cast("bigint").alias("taken"))
    kept = [c for c in df.columns if keep_text or c != text_col]
    return whole.join(found.hint("shuffle_hash"), F.col(row) == F.col(base)).select(*kept, "size", "source_size", "target", "taken")


def mixture(df: DataFrame, **options: object) -> DataFrame:
    """The mix itself: a row for each time that a document is taken.

    ``epoch`` counts from 0, ``words`` are those taken then (the whole document but for one on the
    cut); ``cut_text`` is null but on the cut, where it is the text up to the last word taken and stands for
    the text. Documents of which nothing is taken are left out.
    """
    mixed = mix_sources(df, **options)
    text = F.col(options.get("text_col", "text"))
    df = df.drop("epoch", "words", "cut_text")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.filter("taken > 0").drop("epoch").withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    # Parted at the end of each word, so that the parts are the text.
    parts = F.split(text, f"(?<=[^{BLANKS_CLASS}])(?=[{BLANKS_CLASS}])", (words + 1).cast("int"))
    cut = F.when(words < F.col("size"), F.array_join(F.slice(parts, 1, words.cast("int")), ""))
    return rows.select(*df.columns, *(c for c in ("size", "source_size", "target", "taken") if c not in df.columns), "epoch", words.alias("words"), cut.alias("cut_text"))

"""Exact deduplication by skew-safe combining.

Copies are combined three times, each time by digest *and* full content: within
each task, then within salted digest groups, then across the salts of a digest.
A text that a third of all rows repeat leaves at most one row per task and salt,
then one per salt. Decisions go back to the rows along the same tree, by digest
and salt, so that no task meets all rows of one text either.

Defined results: a null text is an empty text. Of equal texts the largest id
stays; a null id is smaller than any other. Rows that repeat both id and text are
the same document: :func:`exact_groups` gives them the same decision, and
:func:`exact_dedup` leaves one row of them. An empty table gives an empty result.
Input columns named like a result column are replaced; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.llm.tables import apart, settled

#: Parts that a digest's rows are dealt to before they meet.
SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _dealt(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int, n: dict[str, str]) -> DataFrame:
    """``df`` with the text to compare, its digest and the row's salt."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({n["text"]: whole, n["digest"]: digest(whole), n["salt"]: F.pmod(F.xxhash64(id_col), F.lit(salts))})


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row of ``df`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``digest`` only deals the rows out. Texts that share a digest and differ are told
    apart by content; that is looked for once, and costs a second pass only where there are any.
    """
    df = df.drop("keep_id", "group_size", "kept", "text_sha256")
    n = apart(df, "text", "digest", "salt", "keep", "size", "texts")
    text, key, salt, keep, size, texts = n.values()
    rows = _dealt(df, id_col, text_col, digest, salts, n).withColumn("text_sha256", sha256(F.col(text)))

    salted = rows.groupBy(key, salt, text).agg(F.max(id_col).alias(keep), F.count("*").alias(size))
    whole = salted.repartition(key).groupBy(key, text).agg(F.max(keep).alias(keep), F.sum(size).alias(size))
    digests = settled(whole.groupBy(key).agg(F.max(keep).alias("keep_id"), F.sum(size).alias("group_size"), F.count("*").alias(texts)))

    single = digests.filter(F.col(texts) == 1).drop(texts)
    back = rows.select(key, salt).distinct().join(single, key)
    out = rows.join(back, [key, salt])
    shared = digests.filter(F.col(texts) > 1).select(key)
    if not shared.isEmpty():
        both = rows.join(shared, key, "left_semi")
        found = whole.join(shared, key, "left_semi").withColumnsRenamed({keep: "keep_id", size: "group_size"})
        out = out.unionByName(both.join(found, [key, text]))
    kept = F.col(id_col).eqNullSafe(F.col("keep_id"))
    return out.select(*df.columns, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``df`` that stay, as they came: of each text the one with the largest id; of several of that id, the one of the largest hash of its columns.

    The other columns travel with the text, so nothing is joined back.
    """
    n = apart(df, "text", "digest", "salt", "row")
    text, key, salt, row = n.values()
    rows = _dealt(df, id_col, text_col, digest, salts, n)
    fields = [F.col(c) for c in df.columns if c != text_col]
    was_null = F.col(text_col).isNull().alias(salt)
    rows = rows.select(key, salt, text, F.struct(*fields, was_null).alias(row))

    def last(df: DataFrame, *by: str) -> DataFrame:
        # Rows of one id and text are ordered by a hash of all their columns.
        return df.groupBy(*by, text).agg(F.max_by(row, F.struct(f"{row}.{id_col}", F.xxhash64(F.to_json(row)))).alias(row))

    won = last(last(rows, key, salt).repartition(key), key)
    value = {c: F.col(f"{row}.{c}") for c in df.columns if c != text_col}
    value[text_col] = F.when(~F.col(f"{row}.{salt}"), F.col(text))
    return won.select(*(value[c].alias(c) for c in df.columns))

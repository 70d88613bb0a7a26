"""License scans as an exact set-similarity join of text blocks with license templates.

A text's words are cut into overlapping blocks; a template is the set of its words. A
template is found in a block that contains at least its share of them: all words for the
phrases, which then must stand consecutively as well, and ``NOTICE_SHARE`` for the notices and
licenses, whose wording varies. Blocks follow the templates: a template is looked for in blocks that start
at every so many words as the next power of two from its own length, ``STRIDE`` at least, and have twice as many. So a
template of any length that stands in a text lies in one block.

The join orders the templates' words by their frequency in the whole corpus, rarest
first. Words of a block that no template has cannot be shared; the others are sorted by the same order.
A block that reaches the share has one of the template's first ``size - least + 1`` words
(prefix filter) and at least ``least`` words of templates (length filter). At a shared word, no more
words can be shared than are left from there on, on either side: what is left of the template suffices at
all places of its prefix, and what is left of the block is asked for (positional filter). Each pair of block and template
that passes is compared once, at its first shared word. The templates are arguments of the caller and fit any plan; they are
broadcast. Documents are never grouped, and blocks are not shuffled.

Defined results: null and wordless texts have no words and no places. Rows of equal id
and text get equal results. An empty table gives an empty result. Input columns named
like a result column are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.llm.license_texts import NOTICES, PHRASES
from cueline.llm.tables import ALNUM_WORD, ANY_CASE_WORD, apart

NOTICE_SHARE = 0.8
#: The least distance of two blocks of one kind; a block has twice as many words.
STRIDE = 64
_WORD = re.compile(ALNUM_WORD)


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def stride_of(n_words: int, least: int = STRIDE) -> int:
    """The distance of the blocks in which a template of so many words is looked for."""
    return max(least, 1 << max(0, n_words - 1).bit_length())


def words_of(text: Column) -> Column:
    """Lower-cased words, to be compared with the templates' ASCII words.

    ``lower`` is many times faster than a translation of A-Z. It changes other letters too, which no
    template has; the one of them that would become ASCII, the Kelvin sign, is put out of its reach.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00aa"))
    return F.regexp_extract_all(F.lower(plain), F.lit(ALNUM_WORD), F.lit(0))


def frequencies(df: DataFrame, text_col: str, vocabulary: Sequence[str]) -> dict[str, int]:
    """How often each word of the templates occurs in the whole corpus."""
    found = df.select(F.explode(words_of(F.col(text_col))).alias("word")).filter(F.col("word").isin(*vocabulary))
    return {w: 0 for w in vocabulary} | {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def template_index(df: DataFrame, text_col: str, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]], share: float, stride: int) -> tuple[list[str], list[tuple]]:
    """The templates' words in their order, and rows (word, stride, template, label, tokens, least, phrase) for the words of every template's prefix."""
    templates = [(template_words(text), label, 1.0, True) for text, label in phrases] + [(template_words(text), label, share, False) for text, label in notices]
    often = frequencies(df, text_col, sorted({w for words, *_ in templates for w in words}))
    order = lambda w: (often[w], w)
    rows = []
    for number, (words, label, part, phrase) in enumerate(templates):
        tokens = sorted(set(words), key=order)
        least = math.ceil(round(part * len(tokens), 6))
        rows += [(w, stride_of(len(words), stride), number, label, tokens, least, words if phrase else None) for w in tokens[: len(tokens) - least + 1]]
    return sorted(often, key=order), rows


def blocks_of(texts: DataFrame, rows: list[tuple]) -> DataFrame:
    """``stride``, ``start`` and ``words`` of the blocks of texts (``words`` and any other columns) that have a word of a prefix, for every stride of the index."""
    strides = sorted({r[1] for r in rows})
    prefix = {s: F.lit(sorted({r[0] for r in rows if r[1] == s})) for s in strides}
    # A text needs a phrase's prefix word, or as many words as the least that any notice asks for.
    of_phrases = F.lit(sorted({r[0] for r in rows if r[6] is not None})).cast("array<string>")
    of_notices = F.lit(sorted({w for r in rows if r[6] is None for w in r[4]})).cast("array<string>")
    enough = F.arrays_overlap("words", of_phrases) | (F.size(F.array_intersect(of_notices, "words")) >= min((r[5] for r in rows if r[6] is None), default=1 << 30))
    others = [c for c in texts.columns if c != "words"]

    def cut(stride: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(stride))
        return F.transform(starts, lambda i: F.struct(F.lit(stride).alias("stride"), i.alias("start"), F.slice("words", i + 1, F.lit(2 * stride)).alias("words")))

    found = texts.filter((F.size("words") > 0) & enough).select(*others, F.explode(F.concat(*map(cut, strides))).alias("block")).select(*others, "block.*")
    has = F.lit(False)
    for s in strides:
        has = has | ((F.col("stride") == s) & F.arrays_overlap("words", prefix[s]))
    return found.filter(has)


def candidates(blocks: DataFrame, vocabulary: list[str], rows: list[tuple], positional: bool = True) -> DataFrame:
    """Pairs of blocks and templates to compare, each at the first word that they share, with ``shared`` words."""
    index = F.broadcast(blocks.sparkSession.createDataFrame(rows, "probe string, of_stride int, template int, label string, tokens array<string>, least int, phrase array<string>"))
    prefix = F.lit(sorted({r[0] for r in rows}))
    # A block's words of templates, rarest first: the order of the first array is kept.
    probes = blocks.withColumn("ordered", F.array_intersect(F.lit(vocabulary), "words"))
    others = [c for c in probes.columns if c != "ordered"]
    probes = probes.select(*others, F.size("ordered").alias("n_ordered"), F.posexplode("ordered").alias("place", "word")).filter(F.array_contains(prefix, F.col("word")))
    shared = F.array_intersect("tokens", "words")
    left = F.col("n_ordered") - F.col("place") if positional else F.col("n_ordered")
    pairs = probes.join(index, (F.col("word") == F.col("probe")) & (F.col("stride") == F.col("of_stride")))
    return pairs.filter(left >= F.col("least")).withColumn("shared", shared).filter(F.element_at("shared", 1) == F.col("word"))


def license_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
    share: float = NOTICE_SHARE,
    stride: int = STRIDE,
) -> DataFrame:
    """Every row of ``df`` with ``n_words``, the phrases' places and the labels.

    Results: ``n_base`` (places where a phrase stands), ``first_word`` and ``last_word`` (their least and
    greatest first word, from 0, else null), ``base_labels`` and ``labels`` (distinct, sorted, comma-joined; the
    latter with those of notices), ``score`` (largest share of a found template; 0 if there is none).
    """
    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    df = df.drop(*results)
    vocabulary, rows = template_index(df, text_col, phrases, notices, share, stride)
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), words_of(F.col(text_col)).alias("words"))
    pairs = candidates(blocks_of(texts, rows), vocabulary, rows).filter(F.size("shared") >= F.col("least"))
    # A phrase's places are counted by the block that begins before them and not after its own half.
    own = F.sequence(F.lit(0), F.least(F.col("stride"), F.size("words")) - 1)
    places = F.transform(F.filter(own, lambda i: F.slice("words", i + 1, F.size("phrase")) == F.col("phrase")), lambda i: i + F.col("start"))
    found = pairs.select("id", "key", "start", "template", "label", (F.size("shared") / F.size("tokens")).alias("share"), F.when(F.col("phrase").isNotNull(), places).alias("places"))
    found = found.filter(F.col("places").isNull() | (F.size("places") > 0)).distinct()
    base = F.col("places").isNotNull()
    per_text = found.groupBy("id", "key").agg(
        F.sum(F.when(base, F.size("places")).otherwise(0)).alias("n_base"),
        F.min(F.array_min("places")).cast("bigint").alias("first_word"),
        F.max(F.array_max("places")).cast("bigint").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("share").alias("score"),
    )
    n = apart(df, "id", "key", "row_key")
    per_text = per_text.withColumnsRenamed({"id": n["id"], "key": n["key"]})
    keyed = df.withColumns({n["row_key"]: F.xxhash64(text_col), "n_words": F.coalesce(F.regexp_count(F.col(text_col), F.lit(ANY_CASE_WORD)), F.lit(0)).cast("bigint")})
    out = keyed.join(per_text, (F.col(n["row_key"]) == F.col(n["key"])) & F.col(id_col).eqNullSafe(F.col(n["id"])), "left")
    joined = {c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c) for c in ("base_labels", "labels")}
    return out.select(
        *df.columns, "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        joined["base_labels"], joined["labels"], F.coalesce("score", F.lit(0.0)).alias("score"),
    )

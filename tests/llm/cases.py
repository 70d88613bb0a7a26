"""Documents for the operators' tests: prose with copies, near copies and the awkward rows that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Columns of documents, and others that clash with names that the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, id string, node string, key string, _text string, Row string, Readable string, readable_ string, _readable_ string, _before0 string, _key_ string"
CLASHING = ("kept", "size", "id", "node", "key", "_text", "Row", "Readable", "readable_", "_readable_", "_before0", "_key_")
WORDS = {
    "en": "the of and that with from this over under river stone light garden window table quiet small green early train".split(),
    "de": "der die und das mit von über straße fluß stein licht garten fenster tisch ruhig klein grün früh zug nicht".split(),
    "fr": "le la et que avec depuis rivière pierre lumière jardin fenêtre table calme petit vert tôt été élève déjà où".split(),
}


def prose(rng: random.Random, lang: str = "en", n: int = 60) -> str:
    words = [rng.choice(WORDS[lang]) + (rng.choice("abcdefgh") * rng.randrange(3)) for _ in range(n)]
    return "".join(w + ("\n" if i % 13 == 12 else " ") for i, w in enumerate(words)).strip()


def changed(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
    return " ".join(words)


def texts(rng: random.Random, n: int = 120) -> list[str | None]:
    out: list[str | None] = []
    for i in range(n):
        out.append(prose(rng, ("en", "de", "fr")[i % 3], rng.randrange(20, 90)))
    base = [t for t in out if t]
    for i in range(40):
        out.append(changed(rng, rng.choice(base), rng.randrange(0, 6)))
    out += [base[0]] * 15 + [base[1].upper()] + [" ".join(base[2].split())]
    out += [None, None, "", "", " \n\t", "one", "one", "One", "two words", "!!!", "12 34", "Ünï çödé", "a b c d", prose(rng, "en", 9000), prose(rng, "de", 9000)]
    return out


def documents(spark: SparkSession, seed: int = 1, clashing: bool = True) -> DataFrame:
    rng = random.Random(seed)
    rows = []
    for i, t in enumerate(texts(rng)):
        lang = None if i % 17 == 5 else ("en", "de", "fr")[i % 3]
        source = (None, "b", "a", "hot", "hot", "hot", "é")[i % 7]
        rows.append((i, t, lang, source, len(t or ""), *[f"{c}{i}" for c in CLASHING]))
    rows.append(rows[3])  # a repeated row
    rows.append((None, "a text of some words without any id at all", "en", "a", 1, *[None] * len(CLASHING)))
    rows.append((None, None, None, None, None, *[None] * len(CLASHING)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5, "n_chars")
    return df if clashing else df.drop(*CLASHING)


def plain(df: DataFrame) -> DataFrame:
    return df.drop(*CLASHING)


def lower(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})

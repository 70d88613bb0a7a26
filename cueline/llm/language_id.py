"""Language identification: averaged hashed subword embeddings under a linear softmax.

The subwords of a text are its byte n-grams inside words, a blank marking a word's
ends, hashed to a fixed number of rows of an embedding table. A text is the mean of
its subwords' embeddings, and a linear softmax over that gives the languages. Both
are trained in numpy by stochastic gradient descent on a bounded sample of labelled
texts; part of the sample is held back to fit the temperature of the softmax and the
score below which a text is rejected.

Every text is read whole, to learn from as well: tasks count the subwords of a text of the sample, and the counts of at most
``BUCKETS`` rows are what comes to the driver. The sample is bounded in texts (``SAMPLE_ALL``). Languages
may be any number, and so may labels that are none; a model of many keeps embeddings and class weights apart, one of
few their product (the score of each subword for each class), which is then the smaller.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is
rejected. Without any labelled text every row is ``und``. Rows without an id are never
learnt from. Equal texts get equal results. An empty table gives an empty result.
Input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.hashing import byte_classes, steps, utf8_view
from cueline.llm.tables import apart, small_batches, written

#: N-gram lengths in bytes, and the rows of the table that they are hashed to.
LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 16
UNKNOWN = "und"
#: Labelled texts that are drawn for each language (expected number), those for all languages, and the part that only calibrates.
SAMPLE, SAMPLE_ALL, HELD_BACK = 500, 2000, 0.3
#: Short runs of words, up to so many, that are learnt beside each whole text of the sample.
PIECES, PIECE_WORDS = 2, 12
#: Share of the calibration texts that rejection may cost, and how many texts in two languages are made of each: such a
#: document scores low for either, and stays.
REJECT, MIXES = 0.001, 10

_LOWER, _APART = byte_classes("".join(c for c in map(chr, range(128)) if not c.isalpha()))
_CLEAN = np.where(_APART, ord(" "), _LOWER).astype(np.uint32)


@dataclass
class Model:
    """Languages, a row of values per subword, class weights of such rows (scaled by the temperature; none: the values are the classes' scores), biases and the least score that is accepted."""

    languages: list[str]
    table: np.ndarray
    weight: np.ndarray | None
    bias: np.ndarray
    least: float

    @classmethod
    def of(cls, languages: list[str], embed: np.ndarray, weight: np.ndarray, bias: np.ndarray, scale: float, least: float) -> Model:
        weight, bias = (weight * scale).astype(np.float32), (bias * scale).astype(np.float32)
        few = len(languages) <= embed.shape[1]
        return cls(languages, (embed @ weight if few else embed).astype(np.float32), None if few else weight, bias, least)

    @classmethod
    def empty(cls) -> Model:
        return cls([], np.zeros((BUCKETS, 0), np.float32), None, np.zeros(0, np.float32), 0.0)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length, the rows of the subwords of some texts, and the text that each belongs to.

    N-grams cross neither texts nor two words; a single blank counts for nothing.
    """
    codes = _CLEAN[data]
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    blank = codes == ord(" ")
    gram = np.zeros(len(codes), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            return
        gram = gram[:size] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(1)
        if n not in LENGTHS:
            continue
        whole = owner[:size] == owner[n - 1 :]
        for i in range(1, n - 1):  # a blank may only be the first or the last byte
            whole &= ~blank[i : size + i]
        if n < 3:
            whole &= ~(blank[:size] & blank[n - 1 :])
        at = np.flatnonzero(whole)
        mixed = (gram[at] ^ (gram[at] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x9E3779B1 % (1 << 32))
        yield (mixed >> np.uint32(16)).astype(np.int32) % BUCKETS, owner[at]


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subword rows of one text, and how often each is there."""
    n = np.zeros(BUCKETS, np.int64)
    for rows, _ in subwords(data, offsets):
        n += np.bincount(rows, minlength=BUCKETS)
    found = np.flatnonzero(n)
    return found.astype(np.uint16), n[found].astype(np.uint16 if n.max() < 1 << 16 else np.uint32)


def pieces(text: str, rng: np.random.Generator) -> list[str]:
    """A few short runs of the text's words, so that short texts are learnt and calibrated too."""
    words = text.split()
    sizes = rng.integers(1, PIECE_WORDS + 1, PIECES)
    starts = [int(rng.integers(0, max(1, len(words) - int(n) + 1))) for n in sizes]
    return [" ".join(words[i : i + int(n)]) for i, n in zip(starts, sizes, strict=True)]


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, width: int = 16, epochs: int = 5, rate: float = 20.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings (rows x width), class weights (width x classes) and biases, by SGD over one text (its subword rows and their counts) at a time."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-0.5 / width, 0.5 / width, (BUCKETS, width)).astype(np.float32)
    weight = rng.normal(0, width**-0.5, (width, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    steps_all, done = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            rows, share = texts[i][0], _shares(texts[i][1])
            speed = rate * (1 - done / steps_all)
            done += 1
            mean = share @ embed[rows]
            logits = mean @ weight + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weight @ p
            weight -= 0.1 * speed / width * np.outer(mean, p).astype(np.float32)
            bias -= 0.002 * speed * p.astype(np.float32)
            embed[rows] -= speed * np.outer(share, back).astype(np.float32)
    return embed, weight, bias


def _shares(n: np.ndarray) -> np.ndarray:
    return n / np.float32(max(1, n.sum(dtype=np.int64)))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mixed_scores(logits: np.ndarray, labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Scores of texts that are one held-back text and another of a different language, at any share of the whole.

    A text's logits are means over its subwords, so those of two runs are the weighted mean of the runs' own.
    """
    rng = np.random.default_rng(seed)
    a = np.repeat(np.arange(len(labels)), MIXES)
    b, share = rng.integers(0, len(labels), len(a)), rng.random(len(a))[:, None]
    found, step = [np.zeros(0)], max(1, (1 << 22) // logits.shape[1])
    for rows in np.split(np.flatnonzero(labels[a] != labels[b]), range(step, len(a), step)):
        found.append(_softmax(share[rows] * logits[a[rows]] + (1 - share[rows]) * logits[b[rows]]).max(axis=1, initial=0))
    return np.concatenate(found)


def calibrate(logits: np.ndarray, labels: np.ndarray, reject: float) -> tuple[float, float]:
    """The inverse temperature of least log-loss, and the score that all but ``reject`` of the right answers reach, and of the texts in two languages."""
    if not len(labels):
        return 1.0, 0.0
    scales = np.geomspace(0.05, 4, 60)
    loss = [-np.log(np.maximum(_softmax(logits * s)[np.arange(len(labels)), labels], 1e-9)).mean() for s in scales]
    scale = float(scales[int(np.argmin(loss))])
    p = _softmax(logits * scale)
    accepted = np.sort(p.max(axis=1)[p.argmax(axis=1) == labels]), np.sort(_mixed_scores(logits * scale, labels))
    return scale, min((float(x[int(len(x) * reject)]) for x in accepted if len(x)), default=0.0)


def _sample(chosen: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Languages, and of each text and each of its pieces the language's number, whether it only calibrates, and its counts; in the order of the texts' places."""

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, text, place in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "place")), strict=True):
                rng = np.random.default_rng(int(place * 2**53))
                for i, own in enumerate([text, *pieces(text, rng)]):
                    data = np.frombuffer(own.encode(), np.uint8)
                    rows, n = counted(data, np.array([0, len(data)]))
                    if len(rows):
                        out.append((lang, place, i, rows.tobytes(), n.tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)

    schema = pa.schema([("lang", pa.string()), ("place", pa.float64()), ("piece", pa.int32()), ("rows", pa.binary()), ("n", pa.binary())])
    got = small_batches(chosen).mapInArrow(draw, "lang string, place double, piece int, rows binary, n binary").toArrow()
    got = got.sort_by([(c, "ascending") for c in ("place", "lang", "piece", "rows")])
    names = got.column("lang").to_pylist()
    languages = sorted(set(names))
    number = {lang: i for i, lang in enumerate(languages)}
    # Held back by document, as its pieces share its place.
    back = (got.column("place").to_numpy() * 1e9 % 1 < HELD_BACK) & (len(names) >= 20)
    texts = []
    for r, n in zip(got.column("rows"), got.column("n"), strict=True):
        rows, n = np.frombuffer(r.as_py(), np.uint16), n.as_py()
        texts.append((rows, np.frombuffer(n, np.uint16 if len(n) == 2 * len(rows) else np.uint32)))
    return languages, np.array([number[x] for x in names], np.int64), back, texts


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, sample: int = SAMPLE, sample_all: int = SAMPLE_ALL, reject: float = REJECT) -> Model:
    """A model of the labelled rows that ``learn`` admits (all by default) and that have an id.

    About ``sample`` texts of a language are drawn by a hash of their ids, fewer if the languages
    are many: about ``sample_all`` in all, of rows of one id and label one. Which ones is found from ids and labels alone, by joins; no label or count
    comes to the driver but those of the sample. Tasks turn the texts into counts of subwords, which do.
    """
    rows = df.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows if learn is None else rows.filter(learn)
    place = (F.shiftright(F.xxhash64(id_col), 11) / float(1 << 53) + 0.5).alias("place")
    keys = rows.select(F.col(lang_col).cast("string").alias("lang"), place)
    sizes = keys.groupBy("lang").agg(F.count("*").alias("n"))
    labels = sizes.count()
    if not labels:
        return Model.empty()
    most = min(sample, sample_all / labels)
    # A table of labels that is not broadcast is read back, so that rows of one label do not meet where its count is.
    drawn = keys.join(written(sizes), "lang").filter(F.col("place") < most / F.col("n")).select("lang", "place").distinct()
    texts_of = rows.filter(F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), place)
    # About ``sample_all`` keys, whatever the table's size.
    chosen = texts_of.join(F.broadcast(drawn), ["lang", "place"]).groupBy("lang", "place").agg(F.min("text").alias("text"))
    languages, labels, back, texts = _sample(chosen)
    if not languages:
        return Model.empty()
    embed, weight, bias = train([t for t, b in zip(texts, back, strict=True) if not b], labels[~back], len(languages))
    means = np.stack([np.zeros(embed.shape[1], np.float32), *(_shares(n) @ embed[rows] for (rows, n), b in zip(texts, back, strict=True) if b)])[1:]
    scale, least = calibrate(means @ weight + bias, labels[back], reject)
    return Model.of(languages, embed, weight, bias, scale, least)


def _logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    docs, width = len(offsets) - 1, model.table.shape[1]
    total, n = np.zeros((docs, width)), np.zeros(docs)
    piece = max(1, (1 << 22) // width)
    for all_rows, all_owner in subwords(data, offsets):
        for low in range(0, len(all_rows), piece):
            rows, owner = all_rows[low : low + piece], all_owner[low : low + piece]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            total[owner[first]] += np.add.reduceat(model.table[rows], first, axis=0, dtype=np.float64)
            n[owner[first]] += np.diff(np.append(first, len(rows)))
    means = total / np.maximum(n, 1)[:, None]
    return (means if model.weight is None else means @ model.weight) + model.bias


def predict(df: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of ``df`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``."""
    results = ("lang_pred", "score", "rejected")
    df = df.drop(*results)
    readable = apart(df, "readable")["readable"]
    df = df.withColumn(readable, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    kept = [c for c in df.columns if c != readable and (keep_text or c != text_col)]
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            data, offsets = utf8_view(batch.column(text_col))
            known = batch.column(readable).to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            best, score = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows)
            if known.any():
                p = np.concatenate([_softmax(_logits(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in steps(offsets)])
                best = np.where(known, p.argmax(axis=1), best)
                score = np.where(known, p.max(axis=1), 0.0)
            values = pa.array(names[best], pa.string()), pa.array(score), pa.array(~known | (score < model.least))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *values], names=[*kept, *results])

    fields = [f for f in df.schema.fields if f.name in kept]
    types = T.StringType(), T.DoubleType(), T.BooleanType()
    return small_batches(df).mapInArrow(read, T.StructType(fields + [T.StructField(n, t) for n, t in zip(results, types, strict=True)]))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of the documents that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep_text: bool = True, sample: int = SAMPLE) -> DataFrame:
    """:func:`fit` on the rows that are not held out, then :func:`predict` for all."""
    model = fit(df, id_col, text_col, lang_col, learn=~held_out(id_col), sample=sample)
    return predict(df, model, text_col, keep_text)


def keep_identified(df: DataFrame, **options: object) -> DataFrame:
    """The rows of ``df`` whose language is told, as they came; those that the model rejects go."""
    return identify(df, **options).filter("NOT rejected").select(*df.columns)

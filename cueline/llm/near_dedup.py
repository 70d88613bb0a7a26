"""Near-duplicate documents through SetSketch registers.

1. Every text becomes the set of its 64-bit five-word shingle hashes, and that set a
   sketch. Documents of the same set, told by 128 bits of its digest, are one *node* from here on, so copies cost nothing more.
2. Bands of four registers are bucket keys. In each bucket every node is paired with the
   least node. The pair's most likely similarity is estimated from both sketches; pairs that
   may be links are verified on the full sets.
3. Verified links form components. A bucket whose nodes are in one component is done.
   In the others, nodes of different components are compared block by block, by a bitmap that
   bounds their similarity from above, and what remains is verified too. So no
   pair of a bucket is left out, whatever the bucket's size, and pairs inside a component,
   which a large group of near copies would have many of, are never formed. (A bucket of n nodes that
   no links hold together is the worst case: all its blocks meet, n * n / ``BLOCK`` rows, and if its sets go
   well beyond ``BITS`` shingles nearly all pairs of similar sizes, n * n / 2 at most, are verified.)

Two sets of similarity 0.75 share no bucket about 5 times in a million.

Defined results: a text without words, or null, has an empty set, and links to nothing; a
text of fewer than five words is one shingle. Rows of equal id and set are one
document and share their decision. Null ids are ids like any other, larger than all. An
empty table gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.graph import components
from cueline.llm.hashing import BLANKS, byte_classes, shingle_hashes, steps, utf8_view, word_bounds, word_hashes
from cueline.llm.setsketch import BANDS, M, band_keys, jaccard, registers
from cueline.llm.tables import apart, apart_from_its_rows, settled, small_batches

#: Words to a shingle, and the similarity of a link in hundredths.
WIDTH, PERCENT = 5, 75
#: A pair is not verified if its estimated similarity is so far below the threshold: five times the estimate's standard deviation of 0.038.
MARGIN = 0.19
#: Bits of the bitmap that bounds a pair's similarity, and nodes to a block when a bucket is compared.
BITS, BLOCK = 2048, 512
#: Columns of pairs between components.
_ROOTED = ("a", "b", "root_a", "root_b")

_LOWER, _APART = byte_classes(BLANKS)


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    data, offsets = utf8_view(texts)
    for low, high in steps(offsets):
        part, at = _LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = word_bounds(part, at, _APART)
        hashes, bounds = shingle_hashes(word_hashes(part, starts, ends), first, width)
        for i in range(high - low):
            yield np.unique(hashes[bounds[i] : bounds[i + 1]])


def _digest(elements: np.ndarray) -> bytes | None:
    """The set's identity; none if it is empty."""
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _bitmaps(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bit of ``BITS`` for each element; packed, one row per set."""
    n = len(bounds) - 1
    bits = np.zeros((n, BITS), bool)
    bits[np.repeat(np.arange(n), np.diff(bounds)), (elements >> np.uint64(40)) & np.uint64(BITS - 1)] = True
    return np.packbits(bits, axis=1)


def sketches(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``id``, ``key``, ``digest`` (null for an empty set), ``n_shingles``, ``registers`` and ``bitmap`` of every row (``id``, ``key``, ``text``)."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests: list[bytes | None] = []
            sizes: list[int] = []
            drawn: list[bytes] = []
            marks: list[bytes] = []
            some: list[np.ndarray] = []

            def flush() -> None:
                bounds = np.cumsum([0, *map(len, some)])
                elements = np.concatenate([np.zeros(0, np.uint64), *some])
                drawn.extend(x.tobytes() for x in registers(elements, bounds))
                marks.extend(x.tobytes() for x in _bitmaps(elements, bounds))
                some.clear()

            held = 0
            for elements in _sets(batch.column("text"), width):
                digests.append(_digest(elements))
                sizes.append(len(elements))
                some.append(elements)
                held += len(elements) + 100
                if held > 200_000:
                    flush()
                    held = 0
            flush()
            columns = pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(drawn, pa.binary()), pa.array(marks, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *columns], names=["id", "key", "digest", "n_shingles", "registers", "bitmap"])

    return small_batches(rows).mapInArrow(sketch, f"id {dict(rows.dtypes)['id']}, key long, digest binary, n_shingles long, registers binary, bitmap binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """``node`` and ``bucket`` for every band."""

    def band(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, M)
            keys = band_keys(regs).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(keys)], names=["node", "bucket"])

    return nodes.select("node", "registers").mapInArrow(band, "node long, bucket long")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches admit a link, with the estimate."""

    def estimate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("registers_a", "registers_b")]
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            likely = jaccard(*regs, *sizes) >= percent / 100 - MARGIN
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[likely]) for c in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(estimate, "a long, b long")


def _across(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of nodes of different roots in a bucket that may be links, with their roots.

    ``members`` has ``bucket``, ``node``, ``root``, ``n_shingles`` and ``bitmap``. The largest component of a
    bucket and the rest are dealt to blocks apart, and every block of the rest meets every
    other block: the work grows with the rest, not with the square of a large group of copies.
    """
    roots = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    sizes = roots.groupBy("bucket").agg(F.max_by("root", "n").alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    blocks = sizes.filter("n_all > n_main").select(apart_from_its_rows("bucket"), "main", F.ceil(F.col("n_main") / block).cast("int").alias("k_main"), F.ceil((F.col("n_all") - F.col("n_main")) / block).cast("int").alias("k_rest"))
    main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(main, F.col("k_main")).otherwise(F.col("k_rest"))).cast("int")
    rows = members.join(blocks, "bucket").withColumn("own", own)
    # A meeting is of block i of the rest and block j, which is one of the rest (i <= j) or, numbered after those, of the main component.
    low, high = (lambda j: F.least(j, F.col("own"))), (lambda j: F.greatest(j, F.col("own")))
    side = lambda j: F.when(j == F.col("own"), 2).when(j > F.col("own"), 0).otherwise(1)
    within = F.transform(F.sequence(F.lit(0), F.col("k_rest") - 1), lambda j: F.struct(low(j).alias("i"), high(j).alias("j"), side(j).alias("side")))
    beyond = F.transform(F.sequence(F.col("k_rest"), F.col("k_rest") + F.col("k_main") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_main = F.transform(F.sequence(F.lit(0), F.col("k_rest") - 1), lambda i: F.struct(i.alias("i"), (F.col("own") + F.col("k_rest")).alias("j"), F.lit(1).alias("side")))
    meeting = F.explode(F.when(main, as_main).otherwise(F.concat(within, beyond))).alias("meeting")
    dealt = rows.select("bucket", "node", "root", "n_shingles", "bitmap", meeting).select("bucket", "meeting.*", "node", "root", "n_shingles", "bitmap")

    def compare(group: pa.Table) -> pa.Table:
        node, root, size, side = (group.column(c).to_numpy() for c in ("node", "root", "n_shingles", "side"))
        bits = np.frombuffer(b"".join(group.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        found: list[np.ndarray] = []
        for i in np.flatnonzero(side != 1):
            j = np.arange(i + 1, len(node)) if side[i] == 2 else np.flatnonzero(side == 1)
            j = j[(root[j] != root[i]) & (np.minimum(size[j], size[i]) * 100 >= percent * np.maximum(size[j], size[i]))]
            # Each bit that only one side has is an element that only this side has.
            both = size[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64)
            both = np.minimum(both, size[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1, dtype=np.int64))
            j = j[both * 100 >= percent * (size[i] + size[j] - both)]
            ahead = node[i] < node[j]
            sides = (node[i], node[j], root[i], root[j])
            found.append(np.stack([np.where(ahead, sides[k], sides[k ^ 1]) for k in range(4)]))
        pairs = np.unique(np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1), axis=1)
        return pa.table(dict(zip(_ROOTED, pairs, strict=True)))

    # Else Spark would keep all meetings of a bucket in the one task that the join dealt the bucket to.
    dealt = dealt.repartition("bucket", "i", "j")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, ", ".join(f"{c} long" for c in _ROOTED)).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b`` and any more bigint columns) whose full sets reach the threshold. ``texts`` may have more rows to a node; those of another set are passed over."""
    kept = pairs.columns

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            digests = zip(*(batch.column(f"digest_{x}").to_pylist() for x in "ab"), strict=True)
            for i, (x, y, (a, b)) in enumerate(zip(_sets(batch.column("text_a"), width), _sets(batch.column("text_b"), width), digests, strict=True)):
                if _digest(x) == a and _digest(y) == b:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(linked)) for c in kept], names=kept)

    first, second = (texts.select(F.col("node").alias(x), F.col("digest").alias(f"digest_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    sides = pairs.join(first, "a").join(second, "b").select(*kept, "digest_a", "digest_b", "text_a", "text_b")
    return sides.mapInArrow(verify, ", ".join(f"{c} long" for c in kept))


def _roots(nodes: DataFrame, rows: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """``node`` and ``root`` of every node that is linked to a smaller one."""
    buckets = _buckets(nodes)
    multi = buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select(apart_from_its_rows("bucket"), "least")
    members = settled(buckets.join(multi, "bucket").filter("node <> least"))

    star = settled(members.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    ends = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = settled(nodes.join(ends, "node"))
    texts = some.select("node", "digest", F.col("id").alias("of"), F.col("key").alias("of_key"))
    texts = texts.join(rows, (F.col("of_key") == F.col("key")) & F.col("of").eqNullSafe(F.col("id"))).select("node", "digest", "text")
    texts = settled(texts)
    first, second = (some.select(apart_from_its_rows("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}")) for x in "ab")
    links = _verified(_likely(star.join(first, "a").join(second, "b"), percent), texts, width, percent)
    roots = components(links)

    labelled = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = labelled.join(some.select("node", "n_shingles", "bitmap"), "node")
    # Links between components only: their roots are the nodes of a smaller graph.
    more = _verified(_across(labelled, percent, block), texts, width, percent)
    tops = components(more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    tops = tops.select(apart_from_its_rows("node").alias("lower"), F.col("root").alias("top"))
    # A root that is linked to another is a node that has a root now.
    above = roots.join(tops, F.col("root") == F.col("lower"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return above.unionByName(tops.select(F.col("lower").alias("node"), F.col("top").alias("root")))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Every row of ``df`` with ``n_shingles``, ``component_id`` (least id it is linked to, over any number of links) and ``kept``."""
    df = df.drop("n_shingles", "component_id", "kept")
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    drawn = settled(sketches(rows, width))
    # A node's text is that of one row, told by its id and text, so that many rows of one id (or of none) don't all meet.
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("row")
    nodes = drawn.filter("digest IS NOT NULL").groupBy("digest").agg(one, *(F.first(c).alias(c) for c in ("n_shingles", "registers", "bitmap")))
    nodes = settled(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "row.id", "row.key", "n_shingles", "registers", "bitmap"))
    roots = _roots(nodes, rows, width, percent, block)

    of = settled(nodes.select("node", "digest", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = of.groupBy("root").agg(F.min("id").alias("component_id")).select(apart_from_its_rows("root"), "component_id")
    groups = of.select("digest", "root").join(least, "root").drop("root")
    # Rows of one set may be very many; both sides are shuffled, so that Spark may split them.
    found = drawn.select("id", "key", "digest", "n_shingles").distinct().join(groups, "digest", "left")
    n = apart(df, "id", "key", "row_key")
    found = found.select(F.col("id").alias(n["id"]), F.col("key").alias(n["key"]), "n_shingles", "component_id")
    keyed = df.withColumn(n["row_key"], F.xxhash64(text_col))
    out = keyed.join(found, (F.col(n["row_key"]) == F.col(n["key"])) & F.col(id_col).eqNullSafe(F.col(n["id"])))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col))
    return out.select(*df.columns, "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col(id_col)).alias("kept"))


def near_dedup(df: DataFrame, **options: object) -> DataFrame:
    """The rows of ``df`` that stay, as they came: one document of each component, the one with the least id."""
    return near_groups(df, **options).filter("kept").select(*df.columns)

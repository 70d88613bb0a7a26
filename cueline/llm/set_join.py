"""Exact Jaccard join of shingle sets by partitioned universes.

Two sets of sizes a and b and similarity p or more differ in at most (a + b)(1 - p)/(1 + p) elements. So:

1. *Schemes.* Sizes are dealt to bands. The scheme of a band is for pairs whose smaller set is in it; it cuts the range of
   hashes into segments, an eighth more than such sets may differ in elements, plus one. A set's *subset* in a segment is a
   token (64 bits of its elements, segment and scheme). Sets that link agree in all segments but as many as they
   differ in.
2. *Index of subsets.* Tokens are sorted once; those that two sets have stay. Tasks first settle what their own sets share, so a token of a
   third of all sets brings each task's least set to its meeting place and the rest elsewhere. A set goes on if enough of its tokens
   are shared (or empty: an empty subset is nobody's token, and counts as agreed).
3. *Cheapest tokens first.* In any common order of all tokens, linked sets share one of each one's first h + 1, where h is the most
   that they may differ in. Rare tokens come first, and empty subsets last. Each set of a token is verified against the token's least; verified links make components.
4. *Costs.* What a token still costs are its sets outside its largest component. In a new order by that cost, sets of different components that share one of their first h + 1 are compared, if
   the token costs little.
5. *One-deletion neighbourhoods.* A set that has costly tokens among those drops them for others of its segments in which one
   element may differ: the subset, and the subset without each of its elements, are looked up among those of other such sets. A segment in
   which one may differ counts twice, so half of them suffice. What each lookup costs is counted, and each set takes the cheapest segments; if they cost more than the costly tokens would,
   or cannot make up for all of them, the cheapest of the costly tokens are looked up too.
6. Pairs are compared by blocks, by bitmaps that bound their similarity from above, and what remains on the full sets. Links between components join them.

So no link is lost, by chance or by a cap: the tokens, orders and costs only choose among complete searches.

Defined results: a text without words, or null, has an empty set, and links to nothing; a text of fewer words than
``width`` is one shingle. Rows of equal id and set are one document. Null ids are ids like any other, larger
than all. Shingles are told by 64 bits, sets by 128. An empty table gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.graph import components
from cueline.llm.hashing import mix
from cueline.llm.near_dedup import BITS, BLOCK, WIDTH, _bitmaps, _digest, _sets, _verified
from cueline.llm.tables import apart, apart_from_its_rows, settled, small_batches

#: Similarity of a link in hundredths.
PERCENT = 80
#: A token is costly if more sets than this are outside its largest component.
COSTLY = 256
#: Tokens that a task sorts at a time (24 bytes each).
HELD = 1 << 20

#: Least tokens of a set that its rows carry, so that a pair of many common tokens is not told at each.
TOLD = 8
_LAST = 2**63 - 1

#: Bits of a token that name its scheme.
_NAMED = 6
_SUBSET, _LESS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _edges() -> list[int]:
    """Least sizes of the bands: each 8/5 of the one before."""
    out = [1]
    while len(out) < 1 << _NAMED:
        out.append(max(out[-1] + 1, out[-1] * 8 // 5))
    return out


EDGES = _edges()


def _band(n: int) -> int:
    return int(np.searchsorted(EDGES, n, "right")) - 1


def most_apart(a: int, b: int, percent: int) -> int:
    """Elements that linked sets of these sizes may differ in."""
    return (a + b) * (100 - percent) // (100 + percent)


def segments_of(scheme: int, percent: int) -> int:
    """Segments of a scheme; 0 if its sets link to no other."""
    top = EDGES[scheme + 1] - 1
    most = most_apart(top, 100 * top // percent, percent) + 1
    return 0 if most == 1 else most + -(-most // 8)


@lru_cache(maxsize=1 << 16)
def schemes_of(n: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """Scheme, its segments, and the most elements that a set of this size may differ in from a partner there."""
    out = []
    for scheme in range(_band(max(1, -(-percent * n // 100))), _band(n) + 1):
        partner = 100 * n // percent if scheme == _band(n) else EDGES[scheme + 1] - 1
        most = most_apart(n, partner, percent)
        if most:
            out.append((scheme, segments_of(scheme, percent), most))
    return tuple(out)


def _subsets(elements: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A set's segments that are not empty, the first element of each (elements are sorted), and the sums of their mixed elements."""
    segment = ((elements >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    return segment[starts], starts, np.add.reduceat(mix(elements), starts)


def _token(sums: np.ndarray, segment: np.ndarray, scheme: int, kind: np.uint64 = _SUBSET) -> np.ndarray:
    low = np.uint64((1 << _NAMED) - 1)
    hashed = mix(sums ^ mix(segment * kind + np.uint64(scheme + 1)))
    return ((hashed & ~low) | np.uint64(scheme)).view(np.int64)


def _empty_segments(segment: np.ndarray, count: int, n: int) -> np.ndarray:
    """The first n segments that are none of ``segment``."""
    return np.setdiff1d(np.arange(count, dtype=np.uint64), segment, assume_unique=True)[:n]


def described(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``id``, ``key``, ``digest`` (null for an empty set), ``code`` (64 bits of it), ``n_shingles``, ``bitmap`` and ``schemes`` of every row (``id``, ``key``, ``text``).

    Of each scheme: its number, the tokens that are not empty, the most elements to differ in, and, where those are too few, tokens of empty subsets.
    """

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests: list[bytes | None] = []
            sizes: list[int] = []
            marks: list[bytes] = []
            of: list[list[dict]] = []
            for elements in _sets(batch.column("text"), width):
                n = len(elements)
                digests.append(_digest(elements))
                sizes.append(n)
                marks.append(_bitmaps(elements, np.array([0, n]))[0].tobytes())
                own = []
                for scheme, count, most in schemes_of(n, percent) if n else ():
                    segment, _, _ = _subsets(elements, count)
                    empty = _empty_segments(segment, count, max(0, most + 1 - len(segment)))
                    own.append({"scheme": scheme, "used": len(segment), "most": most, "empty": _token(np.zeros(len(empty), np.uint64), empty, scheme).tolist()})
                of.append(own)
            code = [None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in digests]
            kind = pa.list_(pa.struct([("scheme", pa.int32()), ("used", pa.int32()), ("most", pa.int32()), ("empty", pa.list_(pa.int64()))]))
            columns = pa.array(digests, pa.binary()), pa.array(code, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(of, kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *columns], names=["id", "key", "digest", "code", "n_shingles", "bitmap", "schemes"])

    kind = "array<struct<scheme:int,used:int,most:int,empty:array<long>>>"
    return small_batches(rows).mapInArrow(describe, f"id {dict(rows.dtypes)['id']}, key long, digest binary, code long, n_shingles long, bitmap binary, schemes {kind}")


def _tokens(rows: DataFrame, width: int, percent: int, held: int) -> DataFrame:
    """``token``, ``code`` and ``kind``: 0 if the token was a set's alone among those that the task sorted with it; else 1 for its least set there, and 2 for others."""

    def sort(tokens: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        token, code = np.concatenate(tokens), np.concatenate(codes)
        order = np.lexsort((code, token))
        token, code = token[order], code[order]
        new = np.append(True, (token[1:] != token[:-1]) | (code[1:] != code[:-1]))
        token, code = token[new], code[new]
        first = np.append(True, token[1:] != token[:-1])
        shared = ~first | np.append(~first[1:], False)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(code), pa.array(np.where(shared, np.where(first, 1, 2), 0).astype(np.int8))], names=["token", "code", "kind"])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for elements in _sets(batch.column("text"), width):
                code = int.from_bytes(_digest(elements)[:8], "little", signed=True) if len(elements) else 0
                for scheme, count, _ in schemes_of(len(elements), percent) if len(elements) else ():
                    segment, _, sums = _subsets(elements, count)
                    tokens.append(_token(sums, segment, scheme))
                    codes.append(np.full(len(segment), code))
                    n += len(segment)
                if n >= held:
                    yield sort(tokens, codes)
                    tokens, codes, n = [], [], 0
        if n:
            yield sort(tokens, codes)

    return small_batches(rows.select("text")).mapInArrow(emit, "token long, code long, kind byte")


def _shared(tokens: DataFrame) -> DataFrame:
    """``token`` and ``code`` of all tokens that two sets have."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row of the batch before, whether its token is shared, and whether the row was passed on.
        carried: tuple[int, int, int, bool] | None = None
        for batch in batches:
            token, code, kind = (batch.column(c).to_numpy() for c in ("token", "code", "kind"))
            if not len(token):
                continue
            passed = np.zeros(len(token) + (carried is not None), bool)
            if carried is not None:
                token, code, kind = np.append(carried[0], token), np.append(carried[1], code), np.append(np.int8(carried[2]), kind)
                passed[0] = carried[3]
            opens = np.append(True, token[1:] != token[:-1])
            new = opens | np.append(True, code[1:] != code[:-1])
            begins, group = np.flatnonzero(opens), np.cumsum(opens) - 1
            many = (np.add.reduceat(new.astype(np.int64), begins) > 1) | (np.maximum.reduceat(kind, begins) > 0)
            out = new & many[group] & ~passed
            carried = (int(token[-1]), int(code[-1]), int(many[-1]), bool(many[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(code[out])], names=["token", "code"])

    place = F.when(F.col("kind") == 2, F.xxhash64("token", "code")).otherwise(F.col("token"))
    return tokens.repartition(place).sortWithinPartitions("token", "code").mapInArrow(keep, "token long, code long")


def _candidates(nodes: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets by scheme that may have a partner (``node``, ``scheme``, ``used``, ``most``, ``empty``), and their shared tokens (``token``, ``node``, ``scheme``, ``used``, ``most``, ``n``: the token's sets)."""
    scheme = F.col("token").bitwiseAND((1 << _NAMED) - 1).cast("int")
    members = shared.distinct().withColumn("scheme", scheme)
    hits = members.groupBy("code", "scheme").agg(F.count("*").alias("hits"))
    own = nodes.select("node", "code", F.inline("schemes"))
    some = own.join(hits, ["code", "scheme"], "left").filter(F.coalesce("hits", F.lit(0)) >= F.col("used") - F.col("most"))
    some = settled(some.select("node", "code", "scheme", "used", "most", "empty"))
    members = members.join(some.select(apart_from_its_rows("code"), "scheme", "node", "used", "most"), ["code", "scheme"])
    members = members.select("token", "node", "scheme", "used", "most")
    empty = some.select(F.explode("empty").alias("token"), "node", "scheme", "used", "most")
    # Tokens of empty subsets come last in every order, so those that their sets need are all that matter.
    members = settled(members.withColumn("void", F.lit(False)).unionByName(empty.withColumn("void", F.lit(True))))
    counts = members.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select(apart_from_its_rows("token"), "n")
    return some.drop("code"), settled(members.join(counts, "token"))


def _first_ones(members: DataFrame, cost: Column) -> DataFrame:
    """Of each set and scheme, the shared tokens among its first ``most`` + 1, where tokens that it shares with none come first, empty ones last and others by ``cost``."""
    own = Window.partitionBy("node", "scheme")
    hits = F.count_if(~F.col("void")).over(own)
    place = F.row_number().over(own.orderBy("void", cost, "token"))
    return members.withColumns({"hits": hits, "place": place}).filter(F.col("place") <= F.col("most") + 1 - (F.col("used") - F.col("hits"))).drop("hits", "place")


def _upper(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most elements that two sets can share: each bit that only one side has is an element that only this side has."""
    one = n_a - np.bitwise_count(bits_a & ~bits_b).sum(axis=1, dtype=np.int64)
    return np.minimum(one, n_b - np.bitwise_count(bits_b & ~bits_a).sum(axis=1, dtype=np.int64))


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that the sets' sizes and bitmaps admit."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            both = _upper(_bits(batch.column("bitmap_a")), _bits(batch.column("bitmap_b")), n_a, n_b)
            some = pa.array(both * 100 >= percent * (n_a + n_b - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(some) for c in "ab"], names=["a", "b"])

    first, second = (nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bitmap").alias(f"bitmap_{x}")) for x in "ab")
    return pairs.join(first, "a").join(second, "b").mapInArrow(check, "a long, b long")


def _least(rows: DataFrame) -> DataFrame:
    """``node`` and ``least``: the least ``TOLD`` of its tokens; where there are fewer, the largest number fills up."""
    place = F.row_number().over(Window.partitionBy("node").orderBy("token"))
    few = rows.withColumn("place", place).filter(F.col("place") <= TOLD).groupBy("node").agg(F.collect_list("token").alias("few"))
    return few.select("node", F.concat("few", F.array_repeat(F.lit(_LAST), TOLD - F.size("few"))).alias("least"))


def _meetings(probes: DataFrame, index: DataFrame, nodes: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of a probe and an indexed set (``token``, ``node``) of one token that may link, of different components: ``a``, ``b`` and their roots.

    The set of the smaller component (``n_root``, then ``root``) is the one that has to look; so what all sets of a token's largest
    component would look for is left out. Both sides are dealt to blocks, and each block of the one meets each of the other. Rows stay
    narrow until they are dealt. A pair meets at all tokens that it shares, and is told at the least of them: where both sets' least tokens show one
    below, it is passed over.
    """
    rank = F.struct("n_root", "root")
    ranks = nodes.select("node", "root", "n_root")
    index = index.join(ranks, "node")
    tops = index.groupBy("token").agg(F.max(rank).alias("top"))
    probes = probes.join(ranks, "node").join(tops.select(apart_from_its_rows("token"), "top"), "token").filter(rank < F.col("top"))
    probes = settled(probes.select("token", "node", "n_root", "root"))
    lows = probes.groupBy("token").agg(F.count("*").alias("n_probes"), F.min(rank).alias("low"))
    index = settled(index.join(lows.select(apart_from_its_rows("token"), "n_probes", "low"), "token").filter(rank > F.col("low")).select("token", "node", "n_probes"))
    sizes = index.groupBy("token").agg(F.max("n_probes").alias("n_probes"), F.count("*").alias("n_index"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = sizes.select(apart_from_its_rows("token"), blocks("n_probes").alias("k_probes"), blocks("n_index").alias("k_index"))
    deal = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = ["node", "root", "n_root", "n_shingles", "bitmap", "least"]
    left = probes.join(sizes, "token").select("token", "node", deal("k_probes").alias("i"), every("k_index").alias("j"), F.lit(0).alias("side"))
    right = index.join(sizes, "token").select("token", "node", every("k_probes").alias("i"), deal("k_index").alias("j"), F.lit(1).alias("side"))
    left, right = (dealt.join(nodes.join(_least(rows), "node"), "node").select("token", "i", "j", "side", *own) for dealt, rows in ((left, probes), (right, index)))
    names = ["a", "b", "root_a", "root_b"]

    def compare(meeting: np.ndarray, group: pa.Table) -> Iterator[np.ndarray]:
        token = group.column("token").to_numpy()
        node, root, n_root, size, side = (group.column(c).to_numpy() for c in ("node", "root", "n_root", "n_shingles", "side"))
        bits = _bits(group.column("bitmap").combine_chunks())
        least = group.column("least").combine_chunks().flatten().to_numpy().reshape(-1, TOLD)
        bounds = np.append(np.flatnonzero(np.append(True, meeting[1:] != meeting[:-1])), len(meeting))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            others = np.flatnonzero(side[low:high] == 1) + low
            for i in (np.flatnonzero(side[low:high] == 0) + low).tolist():
                j = others[(n_root[others] > n_root[i]) | ((n_root[others] == n_root[i]) & (root[others] > root[i]))]
                j = j[np.minimum(size[j], size[i]) * 100 >= percent * np.maximum(size[j], size[i])]
                both = _upper(bits[i], bits[j], size[i], size[j])
                j = j[both * 100 >= percent * (size[i] + size[j] - both)]
                below = least[i][least[i] < token[low]]
                j = j[~(least[j][:, :, None] == below).any(axis=(1, 2))]
                if len(j):
                    yield np.stack([np.full(len(j), node[i]), node[j], np.full(len(j), root[i]), root[j]])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            meeting = _meeting(held)
            last = int(np.searchsorted(meeting, meeting[-1])) if len(meeting) else 0
            if last:
                yield from told(compare(meeting[:last], held.slice(0, last)))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from told(compare(_meeting(held), held))

    def _meeting(rows: pa.Table) -> np.ndarray:
        """A number for each meeting of a table that is sorted by them."""
        columns = [rows.column(c).to_numpy() for c in ("token", "i", "j")]
        new = np.any([np.append(False, c[1:] != c[:-1]) for c in columns], axis=0) if rows.num_rows else np.zeros(0, bool)
        return np.cumsum(new)

    def told(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(pairs, axis=1)], names=names)

    dealt = left.unionByName(right).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(meet, ", ".join(f"{c} long" for c in names))


def _neighbourhoods(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``node``, ``scheme``, ``segment``, ``token`` (the subset's own; null if empty), ``key`` and ``own``: keys of each segment's subset, and of that without each of its elements."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "scheme", "segment", "token", "key", "own"]
        for batch in batches:
            for node, wanted, elements in zip(batch.column("node").to_pylist(), batch.column("wanted").to_pylist(), _sets(batch.column("text"), width), strict=True):
                for scheme, count, _ in schemes_of(len(elements), percent):
                    if scheme not in wanted:
                        continue
                    segment, starts, sums = _subsets(elements, count)
                    of = np.repeat(np.arange(len(segment)), np.diff(np.append(starts, len(elements))))
                    empty = _empty_segments(segment, count, count)
                    every = np.concatenate([segment, empty, segment[of]])
                    keys = _token(np.concatenate([sums, np.zeros(len(empty), np.uint64), sums[of] - mix(elements)]), every, scheme, _LESS)
                    token = _token(sums, segment, scheme)
                    tokens = pa.array(np.concatenate([token, np.zeros(len(empty), np.int64), token[of]]), mask=np.repeat([False, True, False], [len(segment), len(empty), len(of)]))
                    n, own = len(every), len(segment) + len(empty)
                    columns = [np.full(n, node), np.full(n, scheme, np.int32), every.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), tokens, pa.array(keys), pa.array(np.arange(n) < own)], names=names)

    return small_batches(texts.select("node", "wanted", "text")).mapInArrow(emit, "node long, scheme int, segment long, token long, key long, own boolean")


def _lookups(members: DataFrame, texts: DataFrame, width: int, percent: int, costly: int) -> tuple[DataFrame, DataFrame]:
    """Probes and index (``token``, ``node``) of all searches. ``members`` has each token's ``cost``."""
    first = settled(_first_ones(members, F.col("cost")))
    dear = F.col("cost") > costly
    cheap = first.filter(~dear & (F.col("cost") > 0)).select("token", "node")
    own = ["node", "scheme"]
    # Sets with costly tokens among their first. Those that they share with others but cheaply, or with none, are all before these.
    demand = first.filter(dear).select(*own).distinct()
    held = members.join(demand, own).withColumn("dear", dear)
    state = held.groupBy(*own).agg((F.max("used") - F.count_if(F.col("dear") & ~F.col("void"))).alias("cheap"), (F.max("most") + 1).alias("needed"), (F.max("used") > F.max("most")).alias("free"))
    state = settled(state.withColumn("twice", F.least(F.col("cheap"), F.col("needed") - F.col("cheap"))).withColumn("retained", F.greatest(F.lit(0), F.col("needed") - 2 * F.col("cheap"))))
    by_cost = Window.partitionBy(*own).orderBy("void", "cost", "token")
    ranked = held.filter("dear").withColumn("place", F.row_number().over(by_cost)).join(state, own).filter(F.col("place") <= F.col("needed") - F.col("cheap"))
    ranked = settled(ranked.select(*own, "token", "cost", "place", "retained"))

    wanted = state.groupBy("node").agg(F.collect_set("scheme").alias("wanted"))
    keys = settled(_neighbourhoods(texts.join(wanted, "node"), width, percent))
    sizes = keys.groupBy("key").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_less")).filter("n_own > 0 AND n_less > 0")
    dear_tokens = members.filter(dear).select(apart_from_its_rows("token")).distinct().withColumn("is_dear", F.lit(True))
    probing = keys.filter("token IS NOT NULL").join(dear_tokens, "token", "left").filter("is_dear IS NULL").drop("is_dear")
    probing = probing.join(sizes.select(apart_from_its_rows("key"), "n_own", "n_less"), "key", "left")
    costs = probing.groupBy(*own, "segment").agg(F.sum(F.coalesce(F.when(F.col("own"), F.col("n_less")).otherwise(F.col("n_own")), F.lit(0))).alias("cost"))
    chosen = costs.withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy("cost", "segment"))).join(state.select(*own, "twice"), own).filter(F.col("place") <= F.col("twice"))
    chosen = settled(chosen.select(*own, "segment", F.col("cost").alias("segment_cost")))
    less = chosen.groupBy(*own).agg(F.sum("segment_cost").alias("by_less"))
    tokens = ranked.groupBy(*own).agg(F.sum("cost").alias("by_tokens"), F.sum(F.when(F.col("place") <= F.col("retained"), F.col("cost")).otherwise(0)).alias("by_retained"))
    # A set that needs empty subsets keeps to its tokens: only sets of its kind have those.
    plan = tokens.join(state.select(*own, "free"), own).join(less, own, "left").select(*own, (F.col("free") & (F.coalesce("by_less", F.lit(0)) + F.col("by_retained") <= F.col("by_tokens"))).alias("use_less"))
    plan = settled(plan)

    kept = ranked.join(plan, own).filter(~F.col("use_less") | (F.col("place") <= F.col("retained"))).select("token", "node")
    kept_index = members.filter(dear).join(kept.select(apart_from_its_rows("token")).distinct(), "token").select("token", "node")
    # A subset meets those that have one element more; a subset less one meets those that are just that.
    met = lambda whole: F.xxhash64("key", whole)
    looking = probing.filter("n_own > 0").join(chosen.select(*own, "segment"), [*own, "segment"]).join(plan.filter("use_less").select(*own), own)
    looking = looking.select(met(~F.col("own")).alias("token"), "node")
    found = keys.join(sizes.select(apart_from_its_rows("key")), "key").select(met(F.col("own")).alias("token"), "node")
    probes = cheap.unionByName(kept).unionByName(looking).distinct()
    return settled(probes), settled(cheap.unionByName(kept_index).unionByName(found).distinct())


def jaccard_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, costly: int = COSTLY, block: int = BLOCK, held: int = HELD
) -> DataFrame:
    """Every row of ``df`` with ``n_shingles`` and ``component_id`` (least id it is linked to, over any number of links)."""
    df = df.drop("n_shingles", "component_id")
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    drawn = settled(described(rows, width, percent))
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("row")
    nodes = drawn.filter("digest IS NOT NULL").groupBy("digest").agg(one, *(F.first(c).alias(c) for c in ("code", "n_shingles", "bitmap", "schemes")))
    nodes = settled(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "row.id", "row.key", "code", "n_shingles", "bitmap", "schemes"))
    some, members = _candidates(nodes, settled(_shared(_tokens(rows, width, percent, held))))

    within = settled(members.select("node").distinct().join(nodes.drop("code", "schemes"), "node"))
    texts = within.select("node", "digest", F.col("id").alias("of"), F.col("key").alias("of_key"))
    texts = settled(texts.join(rows, (F.col("of_key") == F.col("key")) & F.col("of").eqNullSafe(F.col("id"))).select("node", "digest", "text"))
    sizes = within.select("node", "n_shingles", "bitmap")
    # Each set against the least of its rarest tokens.
    rare = settled(_first_ones(members, F.col("n")).select("token", "node"))
    least = rare.groupBy("token").agg(F.min("node").alias("least")).select(apart_from_its_rows("token"), "least")
    stars = rare.join(least, "token").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    roots = components(_verified(_possible(stars, sizes, percent), texts, width, percent))

    labelled = sizes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = labelled.groupBy("root").agg(F.count("*").alias("n_root")).select(apart_from_its_rows("root"), "n_root")
    labelled = settled(labelled.join(counted, "root"))
    by_root = members.select("token", "node").join(labelled.select("node", "root"), "node").groupBy("token", "root").agg(F.count("*").alias("n"))
    costs = by_root.groupBy("token").agg((F.sum("n") - F.max("n")).alias("cost")).select(apart_from_its_rows("token"), "cost")
    probes, index = _lookups(settled(members.drop("n").join(costs, "token")), texts, width, percent, costly)
    more = _verified(_meetings(probes, index, labelled, percent, block).distinct(), texts, width, percent)
    tops = components(more.select(F.least("root_a", "root_b").alias("b"), F.greatest("root_a", "root_b").alias("a")))
    tops = tops.select(apart_from_its_rows("node").alias("lower"), F.col("root").alias("top"))
    above = roots.join(tops, F.col("root") == F.col("lower"), "left").select("node", F.coalesce("top", "root").alias("root"))
    above = above.unionByName(tops.select(F.col("lower").alias("node"), F.col("top").alias("root")))

    of = settled(nodes.select("node", "digest", "id").join(above, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = of.groupBy("root").agg(F.min("id").alias("component_id")).select(apart_from_its_rows("root"), "component_id")
    groups = of.select("digest", "root").join(lowest, "root").drop("root")
    found = drawn.select("id", "key", "digest", "n_shingles").distinct().join(groups, "digest", "left")
    n = apart(df, "id", "key", "row_key")
    found = found.select(F.col("id").alias(n["id"]), F.col("key").alias(n["key"]), "n_shingles", "component_id")
    keyed = df.withColumn(n["row_key"], F.xxhash64(text_col))
    out = keyed.join(found, (F.col(n["row_key"]) == F.col(n["key"])) & F.col(id_col).eqNullSafe(F.col(n["id"])))
    return out.select(*df.columns, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))

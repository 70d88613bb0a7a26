"""Connected components of a link table, by contraction in the tasks and by pointer jumping.

Links point from a larger node to a smaller one. A round has two steps:

* Links of a node meet in one task, which replaces its links by stars of what they connect, each
  node linked to the least one. A node brings at most a link per task of the round
  before, so a node that a third of all nodes hang on is no hot key.
* A node whose root is linked itself is linked to that root's least root, by a join, which
  Spark may split at a hot root.

Both keep what is connected. When a round changes nothing, no node has two roots and no root
is linked: the links are the components' stars. A chain of n links takes about log n rounds,
and far fewer if its nodes meet in tasks. No node's neighbours are gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.tables import apart_from_its_rows, passing, settled

#: Links that a task contracts at a time (16 bytes each).
MEETING = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links but the least of each component, and that least one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contracted(links: DataFrame) -> DataFrame:
    """The same components, with the links of each task replaced by stars."""

    def contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= MEETING:
                yield meet(held)
                held = []
        if held:
            yield meet(held)

    def meet(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = stars(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return links.mapInArrow(contract, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every linked node but the roots.

    ``links`` has bigint columns ``a`` and ``b``; loops and repeated links do no harm.
    """
    links = settled(_contracted(_contracted(links.select("a", "b")).repartition("a")))
    seen = None
    while True:
        state = passing(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))).collect()[0]
        if state == seen or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        above = links.groupBy("a").agg(F.min("b").alias("above")).select(apart_from_its_rows("a").alias("linked"), "above")
        jumped = links.join(above, F.col("b") == F.col("linked"), "left").select("a", F.coalesce("above", "b").alias("b"))
        # The node's own links must stay beside the jumps of those below it; they do, as each node is an "a" of its own.
        links = settled(_contracted(_contracted(jumped).repartition("a")))

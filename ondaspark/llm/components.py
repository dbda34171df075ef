"""Connected components of an edge table by alternating large-star and small-star rounds.

Before and after each round every partition replaces its own edges, a bounded
block at a time, by stars that connect the same nodes. That needs no shuffle,
and leaves at most one edge for each node of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rounds double the reach of the smallest label, so 2**60 nodes in a path would still end.
MAX_ROUNDS = 60
#: Edges that a worker contracts at once: 16 MB of them.
BLOCK_EDGES = 1 << 20


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that hang every node but the smallest of each component of the edges (a, b) on that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if not (apart := low != high).any():
            hangs = root != np.arange(len(nodes))
            return nodes[hangs], nodes[root[hangs]]
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)  # of a root's smaller neighbours, the smallest
        while not np.array_equal(up := root[root], root):
            root = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def out() -> pa.RecordBatch:
        a, b = contracted(*(np.concatenate(side) for side in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        waiting += batch.num_rows
        if waiting >= BLOCK_EDGES:
            yield out()
            held, waiting = [], 0
    if waiting:
        yield out()


def _contracted(edges: DataFrame, scratch: list[str] | None) -> DataFrame:
    """Edges of the same components. They are written, since which edges share a block may differ when they are computed again."""
    return materialise(edges.where("a <> b").mapInArrow(_contract, "a long, b long"), scratch)


def _hang(edges: DataFrame, least: DataFrame, scratch: list[str] | None) -> DataFrame:
    """edges (a, b) with m of least(a, m). The table of least nodes is written first: a small one is broadcast by its measured size, and for a large one the join can split the partition of a node of very many edges, for both sides come straight from a shuffle."""
    return edges.join(materialise(least, scratch), "a")


def _large_star(edges: DataFrame, scratch: list[str] | None) -> DataFrame:
    """For each node, hang its larger neighbours on the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _hang(both.where("b > a"), least, scratch).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, scratch: list[str] | None) -> DataFrame:
    """For each node, hang it and its smaller neighbours on the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    hung = _hang(down, down.groupBy("a").agg(F.min("b").alias("m")), scratch)
    return hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node at most, and nothing hangs on one that hangs."""
    nodes = edges.select(F.col("a").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
    return nodes.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1").isEmpty()


def stars(edges: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(a, b) of every node a of edges(a, b) that isn't the smallest node b of its component. Loops and repeated edges are harmless, nulls are ignored. The folders it writes are added to scratch."""
    now = _contracted(edges.select("a", "b"), scratch)
    for _ in range(MAX_ROUNDS):
        if _only_stars(now):
            return now
        # distinct edges are written first, so that the reader packs small ones into few partitions, where contraction does most
        now = _contracted(materialise(_small_star(_large_star(now, scratch), scratch).distinct(), scratch), scratch)
    raise RuntimeError(f"components are not whole after {MAX_ROUNDS} rounds")


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: list[str] | None = None) -> DataFrame:
    """(node, label) of every node with an edge; label is the smallest node of its component. Edges as in stars."""
    now = stars(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), scratch)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())

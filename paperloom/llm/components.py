"""Connected components: local contraction, then alternating large-star and small-star steps.

Edges are dealt to tasks of at most ``BLOCK`` edges, and each task replaces its own by a
star forest over the same nodes. A graph of one block is done with that. A larger one
takes star steps, each a join on node ids plus a partially aggregated minimum, so a hub's
neighbours are never gathered in one task; the edges of each round are written to the
shared folder, which cuts the lineage, and those of the round before are deleted. The
number of rounds grows with the logarithm of the longest chain; a round's result tells by
itself whether it is the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, reused, stored

#: Edges of a task, 16 bytes each.
BLOCK = 1 << 19
_EDGES = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least) for every node of the edges a-b that isn't the least of its component."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as a star forest."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        found = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_EDGES)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("lo", "hi")).toDF("node", "near")
    least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
    return both.join(least, "node").filter("near > node AND near <> least").select(F.col("near").alias("hi"), F.col("least").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = edges.join(least, "hi").filter("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.union(least.toDF("hi", "lo")).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether all edges are stars: no node has two edges up, or one up and one down."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up")).union(edges.select("lo", F.lit(0)))
    met = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return met.filter("ups > 0 AND n > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", block: int = BLOCK) -> DataFrame:
    """(node, component) for each node that isn't the smallest of its component, which is the smallest node reachable.

    Edges are undirected, ends whole numbers; repeated edges, loops and both directions
    are fine. A null end drops the edge. A node that has only loops, or none, has no row.
    """
    given = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).filter(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}")
    edges = reused(given)
    n, rounds = edges.count(), 0
    while n > block:
        dealt = edges.repartition(-(-n // block), "hi", "lo").mapInArrow(_contracted, "hi long, lo long")
        after = stored(_small_star(_large_star(dealt)), "edges")
        if rounds:
            discard(edges)
        else:
            edges.unpersist()
        edges, n, rounds = after, after.count(), rounds + 1
        if _done(edges):
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return edges.coalesce(1).mapInArrow(_contracted, "hi long, lo long").toDF("node", "component")

"""Distributed union-find: connected components by alternating large and small stars.

A large star moves each edge's lesser end to the least node that this end is linked to; a small star links all
lesser neighbours of a node to the least of them. Both are a grouped minimum and a join of the edges with it, so no
task ever holds a component. Nodes of many edges (hubs) are joined by broadcast, so their edges stay dealt out as
they are; how many hubs there can be is bounded whatever the number of edges. A round's edges are a table in the
shared folder. The number of rounds grows with the logarithm of the longest path.

Before the rounds, tasks of a bounded number of edges each contract what they hold to a spanning forest; where one such
task holds all edges, that is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import forget, hub_join, hub_limit, keep, released

#: Edges that a task contracts.
CHUNK = 1 << 20


class Forest:
    """Union-find over numbers below ``n``, fed with arrays of links; the root is the least of a component."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            i, j = root[i], root[j]
            far = i != j
            i, j = i[far], j[far]
            least = np.minimum(i, j)
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
            while not np.array_equal(up := root[root], root):
                root = up
        self.root = root


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (a > b) that span what ``tasks`` tasks find connected in their share of ``edges``."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
        nodes, at = np.unique(np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64), return_inverse=True)
        forest = Forest(len(nodes))
        forest.link(*at.reshape(2, -1))
        moved = np.nonzero(forest.root != np.arange(len(nodes)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[forest.root[moved]])], ["a", "b"])

    return edges.coalesce(tasks).mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    """``edges`` (a > b), each with its lesser end moved to the least neighbour of that end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ends = edges.groupBy("b").agg(F.count("*").alias("n"))
    least = ends.join(least.withColumnRenamed("a", "b"), "b", "left")
    least = keep(least.where("m is not null or n > %d" % limit), "least")
    moved = hub_join(edges, least, "b", "n", limit, "left").select("a", F.coalesce("m", "b").alias("b"))
    out = keep(moved.distinct(), "edges")
    forget(least)
    return out


def _small_star(edges: DataFrame, limit: int) -> DataFrame:
    """For each node of ``edges`` (a > b) its least neighbour, and an edge to it from every other lesser neighbour."""
    least = keep(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    several = least.where("n > 1")
    moved = hub_join(edges, several, "a", "n", limit).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = keep(least.select("a", F.col("m").alias("b")).union(moved).distinct(), "edges")
    forget(least)
    return out


def components(edges: DataFrame, most_rounds: int = 60, limit: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(node, root)`` for each node of the edges ``(a, b)`` of longs; root is the least node of the component.

    Loops, nulls and repeated edges are ignored; no edges give no rows. Nodes without an edge to another node
    aren't returned. The result reads a table in the shared folder. ``limit`` is the number of edges beyond which
    a node is a hub, ``chunk`` the number that a task contracts.
    """
    first = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tasks = -(-first.count() // chunk)
    edges = keep(_contracted(first, max(1, tasks)), "edges")
    forget(first)
    before = None
    for _ in range(most_rounds):
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()) if tasks > 1 else None
        if now == before or not now[0]:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
            out._kept_at = edges._kept_at
            return out
        before, most = now, limit or hub_limit(now[0])
        large = _large_star(edges, most)
        small = _small_star(large, most)
        forget(edges, large)
        edges = small
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")

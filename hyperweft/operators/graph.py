"""Neighbourhoods, distances and components of graphs given as undirected edges (u, v)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.operators.blocks import gathered, in_blocks, members, neighbours, sets
from hyperweft.plans.storage import cut, join_hot, running_sum

#: Pairs are looked at in blocks whose ends are in about so many hyperedges.
BLOCK_DEGREES = 1 << 17

#: Nodes in a row that a task returns, at most.
PIECE = 1 << 16


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()


def hop_distances(edges: DataFrame, sources: DataFrame, radius: int) -> DataFrame:
    """(source, node, d): hop distances of at most radius from each of sources(source).

    Breadth-first rounds: each joins the last frontier with the edges and drops what is known.
    """
    step = both_ways(edges)
    known = sources.select("source", F.col("source").alias("node"), F.lit(0).alias("d")).distinct()
    frontier = known
    for d in range(1, radius + 1):
        reached = frontier.select("source", F.col("node").alias("u")).join(step, "u").select("source", F.col("v").alias("node")).distinct()
        frontier = cut(reached.join(known, ["source", "node"], "left_anti").withColumn("d", F.lit(d)), "frontier")
        known = known.unionByName(frontier)
    return known


def ball(edges: DataFrame, sources: DataFrame, radius: int) -> DataFrame:
    """(source, node) within radius hops."""
    return hop_distances(edges, sources, radius).select("source", "node")


def edge_ball(edges: DataFrame, pairs: DataFrame, radius: int) -> DataFrame:
    """(a, b, node) within radius hops of either end of each of pairs(a, b)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("source")).distinct()
    near = ball(edges, ends, radius)
    return pairs.join(near.withColumnRenamed("source", "a"), "a").select("a", "b", "node").unionByName(pairs.join(near.withColumnRenamed("source", "b"), "b").select("a", "b", "node")).distinct()


def ring(edges: DataFrame, pairs: DataFrame, inner: int, outer: int) -> DataFrame:
    """(a, b, node) more than inner and at most outer hops from the nearer end of each of pairs(a, b)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("source")).distinct()
    d = hop_distances(edges, ends, outer)
    both = pairs.join(d.withColumnRenamed("source", "a"), "a").select("a", "b", "node", "d").unionByName(pairs.join(d.withColumnRenamed("source", "b"), "b").select("a", "b", "node", "d"))
    return both.groupBy("a", "b", "node").agg(F.min("d").alias("d")).filter(F.col("d") > inner).select("a", "b", "node")


class _Block:
    """The hyperedges around a block of pairs, as incidences either way."""

    def __init__(self, sizes: np.ndarray, members: np.ndarray, inner: int, outer: int):
        self.labels, nodes = np.unique(members, return_inverse=True)
        self.nodes, self.edge_first = nodes.ravel(), np.concatenate([[0], np.cumsum(sizes)])
        self.edges = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(self.nodes, kind="stable")]
        self.node_first = np.concatenate([[0], np.cumsum(np.bincount(self.nodes, minlength=len(self.labels)))])
        self.inner, self.outer = inner, outer
        self.balls = lru_cache(256)(self._balls)

    def _balls(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """What is within the inner and within the outer radius of a node."""
        at = int(np.searchsorted(self.labels, end))
        near = np.array([at] if at < len(self.labels) and self.labels[at] == end else [], np.int64)
        inner, known, passed = near, np.zeros(len(self.labels), bool), np.zeros(len(self.edge_first) - 1, bool)
        known[near] = True
        for d in range(1, self.outer + 1):
            edges = gathered(near, self.node_first, self.edges)
            fresh = np.zeros(len(passed), bool)
            fresh[edges] = True
            fresh &= ~passed
            passed |= fresh
            reached = np.zeros(len(known), bool)
            reached[gathered(np.flatnonzero(fresh), self.edge_first, self.nodes)] = True
            reached &= ~known
            known |= reached
            near = np.flatnonzero(reached)
            if d == self.inner:
                inner = np.flatnonzero(known)
        return inner, np.flatnonzero(known)

    def ring(self, a: int, b: int) -> np.ndarray:
        found = np.zeros(len(self.labels), bool)
        balls = self.balls(a), self.balls(b)
        for _, outer in balls:
            found[outer] = True
        for inner, _ in balls:
            found[inner] = False
        return self.labels[found]


def ring_of_hyperedges(inc: DataFrame, pairs: DataFrame, inner: int, outer: int, edges: DataFrame | None = None) -> DataFrame:
    """ring() in the clique expansion of a hypergraph, which isn't made; edges: its hyperedges as (edge, nodes), if they have been written.

    Pairs are dealt out in blocks by their order. A block gets each hyperedge once that a walk of its pairs may take, packed, and its task walks
    over incidences: neither neighbours nor distances are shuffled, and the ring of a pair is a set in one task. What a walk may take is looked
    up where the hyperedges are read, so they are shuffled only to their blocks.
    """
    edges = sets(inc) if edges is None else edges
    degree = cut(members(edges).groupBy("node").agg(F.count("*").alias("n")), "degrees")
    weighed = pairs.select("a", "b").distinct()
    for c in "ab":
        weighed = weighed.join(degree.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    weight = 1 + F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
    upto = running_sum(weighed, [F.col("a"), F.col("b")], weight, "upto")
    blocks = cut(upto.select("a", "b", F.floor(F.col("upto") / BLOCK_DEGREES).alias("block")), "blocks")
    near = cut(blocks.select("block", F.explode(F.array("a", "b")).alias("node")).distinct(), "near")
    for _ in range(outer - 1):
        near = cut(neighbours(edges, near), "near")

    def rings(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = _Block(sizes, nodes, inner, outer)
        out, n = [], 0
        for k in np.lexsort((b, a)).tolist():
            ring = block.ring(int(a[k]), int(b[k]))
            for i in range(0, len(ring), PIECE):
                out.append((a[k], b[k], ring[i : i + PIECE]))
                n += len(out[-1][2])
                if n >= 16 * PIECE:
                    yield batch_of(out)
                    out, n = [], 0
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        at = np.concatenate([[0], np.cumsum([len(x[2]) for x in out])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([x[2] for x in out])))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), lists], ["a", "b", "nodes"])

    found = in_blocks(edges, near, blocks, rings, "a long, b long, nodes array<long>")
    return found.select("a", "b", F.explode("nodes").alias("node"))


def _least(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """(key, m, n): the smallest `other` of each key, and how many there are, written once."""
    return cut(pairs.groupBy(key).agg(F.min(other).alias("m"), F.count("*").alias("n")), "least")


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every node of pairs(low, high) is either the centre of a star or has one smaller neighbour and no other."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("high").alias("x"), F.lit(1).alias("up")), F.struct(F.col("low").alias("x"), F.lit(0).alias("up")))).alias("e"))
    counts = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    return counts.filter("up > 0 and n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges(u, v): root is the smallest node of the component.

    Alternating small-star and large-star rounds (Kiveris et al., 2014), whose number grows with the logarithm of the
    nodes, until only stars are left. Smallest neighbours are aggregates that combine before the shuffle, and hubs get theirs by a
    bounded broadcast, so that no task gathers a hub's edges.
    """
    pairs = cut(edges.select(F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).filter("low <> high").distinct(), "edges")
    while True:
        # small star: the smallest smaller neighbour of a node meets the node, and all other smaller ones
        least = _least(pairs, "high", "low")
        others = join_hot(pairs, least, ["high"], "n").filter("low > m").select(F.col("m").alias("low"), F.col("low").alias("high"))
        pairs = cut(least.select(F.col("m").alias("low"), "high").unionByName(others).distinct(), "edges")
        if _are_stars(pairs):
            break
        # large star: every larger neighbour of a node meets the smallest of the node and its neighbours
        both = pairs.select(F.explode(F.array(F.struct(F.col("low").alias("u"), F.col("high").alias("v")), F.struct(F.col("high").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
        large = join_hot(both.filter("v > u"), _least(both, "u", "v"), ["u"], "n").select(F.least("u", "m").alias("low"), F.col("v").alias("high"))
        pairs = cut(large.filter("low <> high").distinct(), "edges")
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(pairs.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def hypergraph_components(inc: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, part): components of a hypergraph by their smallest node; nodes of nodes(node) without a hyperedge are alone.

    Hyperedges become stars around their smallest node, which connects the same nodes as all pairs would.
    """
    hubs = inc.groupBy("edge").agg(F.min("node").alias("u"))
    found = components(inc.join(hubs, "edge").select("u", F.col("node").alias("v")))
    every = (nodes if nodes is not None else inc).select("node").distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("part"))

"""Curvatures from optimal transport: multi-marginal barycentres, dual networks, and pairs of nodes.

A hypergraph of up to BROADCAST_BYTES of incidences is held by every worker. Of a larger one, joins bring each hyperedge its own
neighbourhood, once for all hyperedges with the same nodes; the results are the same. A neighbourhood has to fit in a task, as
the kernels work on matrices of its nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.functions.kernels import FAR, Adjacency, barycentre, exact_barycentre, sinkhorn, transport, wasserstein
from hyperweft.operators.blocks import in_blocks, joined, members, sets
from hyperweft.operators.incidence import cooccurrence, hyperedges, with_card
from hyperweft.plans.storage import BROADCAST_BYTES, cut, running_sum

#: Nodes are looked at in blocks that are in about so many hyperedges.
BLOCK_DEGREES = 1 << 17

#: Neighbours in a row that a task returns, at most.
PIECE = 1 << 16


@dataclass(frozen=True)
class TransportParams:
    """solver: 'ibp', or 'lp' where the support has at most lp_support nodes, and a failure falls back to 'ibp'; with lp_strict the programme is solved whatever its size, and failures are raised."""

    alpha: float = 0.01
    reg: float = 0.1
    rounds: int = 500
    tolerance: float = 1e-6
    radius: int = 5
    lazy_support: bool = False
    solver: str = "ibp"
    lp_support: int = 12
    lp_strict: bool = False


def node_measure(inc: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(src, dst, mass): a lazy walk that stays with alpha, else picks an incident hyperedge and then another of its nodes.

    A hyperedge of one node gives its walker nowhere to go: its share stays at the node. Callers that have to refuse such
    hyperedges filter by cardinality. Nodes are dealt out in blocks by the hyperedges that they are in, each of which reaches a block once,
    and a task sums the pairs of one node after another: it holds the hyperedges around its block, and neither pairs nor masses are shuffled.
    """
    edges = sets(inc.select("edge", "node"))
    degree = cut(members(edges).groupBy("node").agg(F.count("*").alias("deg")), "degrees")
    blocks = cut(running_sum(degree, [F.col("node")], F.col("deg"), "upto").select("node", F.floor(F.col("upto") / BLOCK_DEGREES).alias("block")), "blocks")

    def masses(node: np.ndarray, _: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        labels = np.unique(nodes)
        at, first = np.searchsorted(labels, nodes).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
        sources, near = np.searchsorted(labels, np.sort(node)), np.zeros(len(labels), bool)
        near[sources] = True
        near = np.flatnonzero(near[at])
        near = near[np.argsort(at[near], kind="stable")]
        edge, node_first = np.searchsorted(first, near, side="right") - 1, np.searchsorted(at[near], np.append(sources, len(labels)))
        steps = 1 / np.maximum(sizes - 1, 1)
        out, n = [], 0
        for k, i, j in zip(sources.tolist(), node_first, node_first[1:]):
            own = edge[i:j]
            share = (1 - alpha) / len(own)
            reached, mass = joined(own, first, at), np.repeat(share * steps[own], sizes[own])
            if share and 8 * len(reached) > len(labels):
                total = np.bincount(reached, mass, len(labels))
                total[k] = 0
                to = np.flatnonzero(total)
                total = total[to]
            else:
                to, where = np.unique(reached, return_inverse=True)
                total = np.bincount(where.ravel(), mass)
                to, total = to[to != k], total[to != k]
            if stay := alpha + share * int((sizes[own] == 1).sum()):
                to, total = np.append(to, k), np.append(total, stay)
            for i in range(0, len(to), PIECE):
                out.append((labels[k], labels[to[i : i + PIECE]], total[i : i + PIECE]))
                n += len(out[-1][1])
                if n >= 8 * PIECE:
                    yield batch_of(out)
                    out, n = [], 0
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (1, 2)], ["dst", "mass"])
        at = np.concatenate([[0], np.cumsum([len(x[1]) for x in out])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.ListArray.from_arrays(pa.array(at), rows)], ["src", "to"])

    ends = blocks.select("block", F.col("node").alias("a"), F.col("node").alias("b"))
    found = in_blocks(edges, blocks, ends, masses, "src long, to array<struct<dst: long, mass: double>>")
    return found.select("src", F.inline("to"))


def supports(inc: DataFrame, measure: DataFrame, lazy: bool = False) -> DataFrame:
    """(edge, node): members, what their measures reach, and nodes within two hops of two members (of one, if lazy)."""
    pairs = cooccurrence(inc).select("u", "v")
    step = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    member = inc.select("edge", "node")
    nodes = inc.select(F.col("node").alias("u")).distinct()
    two = step.join(step.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v"))
    reach = step.unionByName(two).unionByName(nodes.select("u", F.col("u").alias("v"))).distinct()
    hits = member.join(reach.withColumnRenamed("u", "node"), "node").groupBy("edge", "v").agg(F.count("*").alias("n"))
    near = hits.filter(F.col("n") >= (1 if lazy else 2)).select("edge", F.col("v").alias("node"))
    walked = member.join(measure.withColumnRenamed("src", "node"), "node").select("edge", F.col("dst").alias("node"))
    return member.unionByName(near).unionByName(walked).distinct()


def _packed(inc: DataFrame) -> tuple[bytes, int] | None:
    """The incidences as bytes, for kernels, if they are within the broadcast bound."""
    n = inc.count()
    if 16 * n > BROADCAST_BYTES:
        return None
    t = inc.select("edge", "node").toArrow()
    return np.stack([t.column("edge").to_numpy(), t.column("node").to_numpy()]).astype(np.int64).tobytes(), n


class Local:
    """A hypergraph inside a task: adjacency, incidences by node, and lazily made measures."""

    def __init__(self, raw: bytes, n: int, p: TransportParams):
        self.p = p
        edge, node = np.frombuffer(raw, dtype=np.int64).reshape(2, n)
        order = np.lexsort((node, edge))
        self.edge, self.node = edge[order], node[order]
        self.ids, self.first, self.card = np.unique(self.edge, return_index=True, return_counts=True)
        by_node = np.argsort(self.node, kind="stable")
        self.nodes, self.node_first, self.degree = np.unique(self.node[by_node], return_index=True, return_counts=True)
        self.edges_by_node = np.searchsorted(self.ids, self.edge[by_node])
        u, v = [], []
        for c in np.unique(self.card):
            rows = self.first[self.card == c][:, None] + np.arange(c)
            members = self.node[rows]
            i, j = np.triu_indices(int(c), 1)
            u.append(members[:, i].ravel())
            v.append(members[:, j].ravel())
        pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1) if u else np.zeros((2, 0), np.int64)
        self.graph = Adjacency(pairs[0], pairs[1], self.nodes)
        self._measures: dict[int, dict[int, float]] = {}
        self._results: dict[tuple[int, ...], dict] = {}
        self._distances: dict[tuple, float] = {}

    def members(self, k: int) -> np.ndarray:
        return self.node[self.first[k] : self.first[k] + self.card[k]]

    def incident(self, node: int) -> np.ndarray:
        at = int(np.searchsorted(self.nodes, node))
        return self.edges_by_node[self.node_first[at] : self.node_first[at] + self.degree[at]]

    def measure(self, node: int) -> dict[int, float]:
        if node not in self._measures:
            edges = self.incident(node)
            out = {node: self.p.alpha} if self.p.alpha > 0 else {}
            share = (1.0 - self.p.alpha) / len(edges)
            for k in edges.tolist():
                if self.card[k] < 2:
                    raise ValueError(f"node {node} is the only node of hyperedge {self.ids[k]}: its measure isn't defined")
                w = share / (self.card[k] - 1)
                for o in self.members(k).tolist():
                    if o != node:
                        out[o] = out.get(o, 0.0) + w
            self._measures[node] = out
        return self._measures[node]

    def distances(self, at: np.ndarray, radius: int) -> np.ndarray:
        return self.graph.block(at, radius)

    def support(self, members: list[int]) -> np.ndarray:
        near = [self.graph.levels(int(s), 2)[0] for s in self.graph.index(members)]
        found, times = np.unique(np.concatenate(near), return_counts=True)
        found = found[times >= (1 if self.p.lazy_support else 2)]
        base = self.graph.index(sorted({*members, *(x for m in members for x in self.measure(m))}))
        return np.union1d(base, found)

    def curvature(self, k: int) -> dict:
        """The barycentre result of one hyperedge; equal hyperedges that a task meets share it."""
        members = tuple(self.members(k).tolist())
        if members not in self._results:
            if len(self._results) >= 10_000:
                self._results.clear()
            self._results[members] = self._curvature(list(members))
        return self._results[members]

    def _curvature(self, members: list[int]) -> dict:
        p = self.p
        out = {"card": len(members), "n_support": len(members), "rounds": 0, "gap": 0.0, "costs": [], "mean_cost": 0.0, "curvature": 0.0, "method": "trivial"}
        if len(members) <= 1:
            return out
        at = self.support(members)
        block = self.distances(at, p.radius)
        own = np.searchsorted(at, self.graph.index(members))
        if p.radius < 5 and (block == FAR).any():
            part = _parts(block != FAR)
            if len(set(part[own].tolist())) > 1:
                return out | {"n_support": len(at), "mean_cost": float("nan"), "curvature": float("nan"), "method": "disconnected"}
            keep = part == part[own[0]]
            at, block = at[keep], block[np.ix_(keep, keep)]
        mass = np.zeros((len(at), len(members)))
        for c, m in enumerate(members):
            walk = self.measure(m)
            to = self.graph.index(list(walk))
            rows = np.searchsorted(at, to)
            ok = (rows < len(at)) & (at[np.minimum(rows, len(at) - 1)] == to)
            mass[rows[ok], c] = np.fromiter(walk.values(), float)[ok]
        total = mass.sum(axis=0)
        if (np.abs(total - 1.0) > 1e-9).any():
            mass /= np.maximum(total, 1e-300)
        method, found = "ibp", None
        if p.solver == "lp" and (p.lp_strict or len(at) <= p.lp_support) and not (block == FAR).any():
            try:
                found, method = exact_barycentre(mass, block.astype(float)) | {"rounds": 0, "gap": 0.0}, "lp"
            except ValueError:
                if p.lp_strict:
                    raise
        if found is None:
            found = barycentre(mass, block, p.reg, p.rounds, p.tolerance)
        costs = found["costs"]
        return out | {"n_support": len(at), "rounds": found["rounds"], "gap": found["gap"], "costs": costs.tolist(), "mean_cost": float(costs.mean()), "curvature": float(1 - costs.sum() / (len(members) - 1)), "method": method}

    def pairwise(self, k: int, dispersion: str, aggregation: str, reg: float | None = None) -> float:
        """1 - the mean (or largest) transport distance over pairs of members; entropic if reg is given."""
        return self.among(self.members(k).tolist(), dispersion, aggregation, reg)

    def among(self, members: list[int], dispersion: str, aggregation: str, reg: float | None = None) -> float:
        if len(members) < 2:
            return float("nan")
        found = [self._distance(a, b, dispersion, reg) for i, a in enumerate(members) for b in members[i + 1 :]]
        return 1.0 - (max(found) if aggregation == "max" else sum(found) / len(found))

    def _distance(self, a: int, b: int, dispersion: str, reg: float | None) -> float:
        """Transport distance of two nodes' walks, remembered for at most a million pairs."""
        key = (a, b, dispersion, reg)
        if key not in self._distances:
            if len(self._distances) >= 1_000_000:
                self._distances.clear()
            p, q = self.dispersed(a, dispersion), self.dispersed(b, dispersion)
            at = self.graph.index(sorted({*p, *q}))
            block = self.distances(at, 5)
            label = {x: i for i, x in enumerate(self.graph.labels[at].tolist())}
            if reg is None:
                found = wasserstein(p, q, lambda x, y: block[label[x], label[y]])
            else:
                cost = block[np.ix_([label[x] for x in p], [label[y] for y in q])].astype(float)
                found = sinkhorn(np.array(list(p.values())), np.array(list(q.values())), cost, reg)
            self._distances[key] = found
        return self._distances[key]

    def dispersed(self, node: int, dispersion: str) -> dict[int, float]:
        """star: hyperedges weigh the same; clique: neighbours weigh the same; weighted_clique: by the number of common hyperedges."""
        if dispersion == "star":
            return self.measure(node)
        counts: dict[int, float] = {}
        for k in self.incident(node).tolist():
            for o in self.members(k).tolist():
                if o != node:
                    counts[o] = counts.get(o, 0.0) + 1.0
        if dispersion == "clique":
            counts = dict.fromkeys(counts, 1.0)
        total = sum(counts.values())
        return {node: self.p.alpha} | {o: (1 - self.p.alpha) * c / total for o, c in counts.items()} if total else {node: 1.0}


class Piece(Local):
    """The neighbourhood of one hyperedge: neighbours of all nodes within some hops of its members, and the members' walks.

    Distances that it doesn't show are the largest ones possible: supports lie within two hops of the members in
    barycentres (5 apart at most) and within one in pairs (3), and all shorter paths go through nodes whose neighbours are known.
    """

    def __init__(self, local: list[dict], p: TransportParams, far: int):
        self.p, self.far, self._distances = p, far, {}
        self._walks = {r["x"]: r["walk"] for r in local if r["walk"]}
        u = np.repeat([r["x"] for r in local], [len(r["near"]) for r in local]).astype(np.int64)
        v = np.array([y for r in local for y in r["near"]], dtype=np.int64)
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        self.graph = Adjacency(pairs[0], pairs[1], np.array([r["x"] for r in local], dtype=np.int64))

    def distances(self, at: np.ndarray, radius: int) -> np.ndarray:
        block = self.graph.block(at, radius)
        return np.minimum(block, self.far) if radius >= self.far else block

    def measure(self, node: int) -> dict[int, float]:
        walk = self._walks[node]
        if any(x["mass"] is None for x in walk):
            raise ValueError(f"node {node} is the only node of a hyperedge: its measure isn't defined")
        return {x["dst"]: x["mass"] for x in walk}

    def dispersed(self, node: int, dispersion: str) -> dict[int, float]:
        return self.measure(node)


def dispersed_walks(inc: DataFrame, dispersion: str, alpha: float) -> DataFrame:
    """(src, dst, mass): star, clique or weighted_clique; a null mass marks nodes whose star isn't defined, as a hyperedge holds them alone."""
    if dispersion == "star":
        alone = with_card(inc).filter("card = 1").select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("double").alias("mass"))
        return node_measure(inc, alpha).unionByName(alone.distinct())
    pairs = cooccurrence(inc).withColumn("w", F.lit(1.0) if dispersion == "clique" else F.col("w").cast("double"))
    both = pairs.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").unionByName(pairs.select(F.col("v").alias("src"), F.col("u").alias("dst"), "w"))
    total = both.groupBy("src").agg(F.sum("w").alias("total"))
    moved = both.join(total, "src").select("src", "dst", (F.col("w") * (1 - alpha) / F.col("total")).alias("mass"))
    stay = inc.select(F.col("node").alias("src")).distinct().join(total, "src", "left")
    return moved.unionByName(stay.select("src", F.col("src").alias("dst"), F.when(F.col("total").isNull(), 1.0).otherwise(float(alpha)).alias("mass")))


def _by_pieces(inc: DataFrame, todo: DataFrame, walks: DataFrame, hops: int, run, schema: str) -> DataFrame:
    """run's rows for each hyperedge of todo(edge, key): run takes batches of (edge, members, neighbourhood), one of each key."""
    reps = cut(todo.groupBy("key").agg(F.min("edge").alias("rep")), "reps")
    pairs = cooccurrence(inc).select("u", "v")
    member = cut(inc.join(reps.select(F.col("rep").alias("edge")), "edge", "left_semi").select("edge", F.col("node").alias("x")).distinct(), "members")
    out = _pieces(pairs, member, walks, hops, run, schema)
    return out.withColumnRenamed("edge", "rep").join(reps, "rep").join(todo.select("edge", "key"), "key").select("edge", *[c for c in out.columns if c != "edge"])


def _pieces(pairs: DataFrame, member: DataFrame, walks: DataFrame, hops: int, run, schema: str) -> DataFrame:
    """run's rows for the neighbourhoods of the edges of member(edge, x), in the graph of pairs(u, v)."""
    step = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), "step")
    ball = member
    for _ in range(hops):
        further = ball.join(step.withColumnRenamed("u", "x"), "x").select("edge", F.col("v").alias("x"))
        ball = cut(ball.unionByName(further).distinct(), "ball")
    near = step.groupBy(F.col("u").alias("x")).agg(F.collect_list("v").alias("near"))
    wanted = walks.join(member.select(F.col("x").alias("src")).distinct(), "src", "left_semi")
    walk = wanted.groupBy(F.col("src").alias("x")).agg(F.collect_list(F.struct("dst", "mass")).alias("walk"))
    held = ball.join(near, "x", "left").join(member.join(walk, "x"), ["edge", "x"], "left")
    local = F.struct("x", F.coalesce("near", F.array().cast("array<long>")).alias("near"), "walk")
    pieces = held.groupBy("edge").agg(F.array_sort(F.collect_list(F.when(F.col("walk").isNotNull(), F.col("x")))).alias("members"), F.collect_list(local).alias("local"))
    return cut(pieces.mapInArrow(run, schema), "pieces")


def _parts(linked: np.ndarray) -> np.ndarray:
    part, n = np.full(len(linked), -1), 0
    for i in range(len(linked)):
        if part[i] < 0:
            front = np.array([i])
            while len(front):
                part[front] = n
                front = np.flatnonzero(linked[front].any(axis=0) & (part < 0))
            n += 1
    return part


RESULT = "edge long, card int, n_support int, rounds int, gap double, costs array<double>, mean_cost double, curvature double, method string"


def mmot_curvature(inc: DataFrame, params: TransportParams = TransportParams(), only: DataFrame | None = None) -> DataFrame:
    """The barycentre curvature of all hyperedges (of only(edge), if given). Equal hyperedges meet in one task, and large ones come first."""
    todo = hyperedges(inc).select("edge", "card", "key")
    if only is not None:
        todo = todo.join(only.select("edge").distinct(), "edge", "left_semi")

    def batch(ids: pa.Array, found: list[dict]) -> pa.RecordBatch:
        cols = [[f[k] for f in found] for k in ("card", "n_support", "rounds", "gap", "costs", "mean_cost", "curvature", "method")]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.string()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["edge", "card", "n_support", "rounds", "gap", "costs", "mean_cost", "curvature", "method"])

    packed = _packed(inc)
    if packed is None:

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield batch(b.column(0), [Piece(x.as_py(), params, 5)._curvature(m.as_py()) for m, x in zip(b.column(1), b.column(2), strict=True)])

        return _by_pieces(inc, todo, dispersed_walks(inc, "star", params.alpha), 3, pieces, RESULT)
    shared, n = inc.sparkSession.sparkContext.broadcast(packed[0]), packed[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = None
        for b in batches:
            local = local or Local(shared.value, n, params)
            yield batch(b.column(0), [local.curvature(int(np.searchsorted(local.ids, e))) for e in b.column(0).to_pylist()])

    return todo.repartition("key").sortWithinPartitions(F.desc("card"), "key").select("edge").mapInArrow(run, RESULT)


def mmot_vertex(inc: DataFrame, curved: DataFrame) -> DataFrame:
    """(node, curvature): the sum over a node's hyperedges."""
    return inc.join(curved.select("edge", "curvature"), "edge", "left").groupBy("node").agg(F.sum(F.coalesce("curvature", F.lit(0.0))).alias("curvature"))


def refreshed(inc: DataFrame, curved: DataFrame, removed: DataFrame, params: TransportParams = TransportParams()) -> DataFrame:
    """(edge, curvature) after removed(edge): hyperedges within two rings of incidences around removed members are computed anew, others keep theirs."""
    left = inc.join(removed.select("edge"), "edge", "left_anti")
    touched = inc.join(removed.select("edge"), "edge", "left_semi").select("node").distinct()
    first = left.join(touched, "node", "left_semi").select("edge").distinct()
    ring = left.join(first, "edge", "left_semi").select("node").distinct()
    second = left.join(ring, "node", "left_semi").select("edge").distinct()
    new = mmot_curvature(left, params, second).select("edge", F.col("curvature").alias("new"))
    return curved.join(removed.select("edge"), "edge", "left_anti").join(new, "edge", "left").select("edge", F.coalesce("new", "curvature").alias("curvature"))


def pair_curvature(inc: DataFrame, dispersion: str = "star", aggregation: str = "mean", alpha: float = 0.01, reg: float | None = None) -> DataFrame:
    """(edge, curvature): 1 - the mean (max) of W1 over pairs of a hyperedge's nodes; entropic transport if reg is given."""
    params, packed = TransportParams(alpha=alpha), _packed(inc)
    if packed is None:

        return _by_pairs(inc, dispersion, aggregation, params, reg)
    shared, n = inc.sparkSession.sparkContext.broadcast(packed[0]), packed[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = None
        for b in batches:
            local = local or Local(shared.value, n, params)
            found = [local.pairwise(int(np.searchsorted(local.ids, e)), dispersion, aggregation, reg) for e in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["edge", "curvature"])

    return inc.select("edge").distinct().repartition(F.xxhash64("edge")).mapInArrow(run, "edge long, curvature double")


def _by_pairs(inc: DataFrame, dispersion: str, aggregation: str, params: TransportParams, reg: float | None) -> DataFrame:
    """pair_curvature by joins: each pair of neighbours is solved once, however many hyperedges hold it, and equal hyperedges are looked at once."""
    e = cut(hyperedges(inc).select("edge", "nodes", "card", "key"), "hyperedges")
    reps = cut(e.groupBy("key").agg(F.min("edge").alias("rep"), F.first("nodes").alias("nodes")), "reps")
    pairs = reps.filter(F.size("nodes") > 1).select("rep", "nodes", F.posexplode("nodes").alias("i", "u"))
    pairs = pairs.select("rep", "u", F.explode(F.expr("slice(nodes, i + 2, size(nodes) - i - 1)")).alias("v"))
    distinct = cut(pairs.select("u", "v").distinct().withColumn("edge", F.monotonically_increasing_id()), "pairs")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Piece(x.as_py(), params, 3)._distance(*m.as_py(), dispersion, reg) for m, x in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["edge", "distance"])

    member = distinct.select("edge", F.explode(F.array("u", "v")).alias("x"))
    solved = cut(_pieces(distinct.select("u", "v"), member, dispersed_walks(inc, dispersion, params.alpha), 1, pieces, "edge long, distance double").join(distinct, "edge").select("u", "v", "distance"), "solved")
    rows = pairs.join(F.broadcast(solved) if solved.count() * 64 <= BROADCAST_BYTES else solved, ["u", "v"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("u", "v", "distance"))).alias("p"))
    every = F.col("p.distance")
    value = 1 - (F.array_max(every) if aggregation == "max" else F.aggregate(every, F.lit(0.0), lambda total, x: total + x) / F.size("p"))
    known = rows.select("rep", value.alias("curvature")).join(reps.select("rep", "key"), "rep").select("key", "curvature")
    return e.select("edge", "key").join(known, "key", "left").select("edge", F.coalesce("curvature", F.lit(float("nan"))).alias("curvature"))


def dual_curvature(duals: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(card, e1, e2, curvature) of dual edges: 1 - W1 of lazy walks on the dual network of the cardinality.

    Joins bring each dual edge the neighbours of both ends and their neighbours, from which all distances (at most 3)
    follow; so no network has to be held as a whole.
    """
    both = duals.select("card", F.col("e1").alias("x"), F.col("e2").alias("y")).unionByName(duals.select("card", F.col("e2").alias("x"), F.col("e1").alias("y")))
    near = both.groupBy("x").agg(F.collect_set("y").alias("near"))
    e = duals.select("card", "e1", "e2").join(near.withColumnsRenamed({"x": "e1", "near": "n1"}), "e1").join(near.withColumnsRenamed({"x": "e2", "near": "n2"}), "e2")
    local = e.select("card", "e1", "e2", F.explode(F.array_union("n1", "n2")).alias("x")).join(near, "x")
    grouped = local.groupBy("card", "e1", "e2").agg(F.collect_list(F.struct("x", "near")).alias("local"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, c, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                nbrs = {r["x"]: frozenset(r["near"]) for r in known}

                def hops(s: int, t: int, nbrs=nbrs) -> int:
                    if s == t:
                        return 0
                    if t in nbrs[s]:
                        return 1
                    return 2 if nbrs[s] & nbrs[t] else 3

                walks = [{x: alpha} | {y: (1 - alpha) / len(nbrs[x]) for y in nbrs[x]} for x in (a, c)]
                out.append(1.0 - wasserstein(walks[0], walks[1], hops))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.float64())], ["card", "e1", "e2", "curvature"])

    return grouped.mapInArrow(run, "card int, e1 long, e2 long, curvature double")


def random_scores(inc: DataFrame, seed: int = 1) -> DataFrame:
    """(edge, score): a reproducible random number for each hyperedge."""
    return inc.select("edge").distinct().select("edge", F.md5(F.concat(F.col("edge").cast("string"), F.lit(f"/{seed}"))).alias("score"))


__all__ = ["TransportParams", "dual_curvature", "hyperedges", "mmot_curvature", "mmot_vertex", "node_measure", "pair_curvature", "random_scores", "refreshed", "supports", "transport"]

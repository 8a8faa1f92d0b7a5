"""h-Louvain: local moves that maximise (1 - alpha) * two-section modularity + alpha * hypergraph modularity.

Moves depend on each other, so the moves of one connected component run in order in one task; components are independent and run in
parallel (the degree tax uses the volumes of the whole hypergraph).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.operators.graph import hypergraph_components
from hyperweft.operators.incidence import with_card
from hyperweft.plans.storage import cut


@dataclass(frozen=True)
class LouvainParams:
    """alphas: weights of the hypergraph part, one level after the other. mode: the next level comes when the number of communities has fallen by the factor `frequency` ('communities'), after `frequency` moves ('modifications'), after each pass over the nodes ('iter') or after each phase ('phase')."""

    tau: float = 1.0
    resolution: float = 1.0
    seed: int = 123
    frequency: float = 0.5
    mode: str = "communities"
    alphas: tuple[float, ...] = tuple(1 - 0.2**i for i in range(30))
    phases: int = 50
    last_step: bool = True


class State:
    """One hypergraph with weights, its communities, and the tables that moves need."""

    def __init__(self, edges: dict[int, list[int]], weights: dict[int, float], sizes: dict[int, float], total: float, p: LouvainParams):
        self.p, self.weights, self.sizes, self.total = p, weights, sizes, total
        self.card = {e: len(m) for e, m in edges.items()}
        self.mass = sum(sizes.values())
        self.taxes: dict[float, float] = {}
        self.near: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for e, m in edges.items():
            for a in m:
                for b in m:
                    if a != b:
                        self.near[a][b] += weights[e] / (len(m) - 1)
        self.strength: dict[int, float] = defaultdict(float)
        self.at: dict[int, dict[int, int]] = defaultdict(dict)
        for e, m in edges.items():
            for v in m:
                self.at[v][e] = 1
                self.strength[v] += weights[e]
        self.community = {v: v for v in self.at}
        self.volume = dict(self.strength)
        self.inside: dict[int, dict[int, int]] = {v: dict(x) for v, x in self.at.items()}

    def weight(self, d: int, c: int) -> float:
        if math.isinf(self.p.tau):
            return float(c == d)
        return (c / d) ** self.p.tau if 2 * c > d else 0.0

    def tax(self, vol: float) -> float:
        """The expected weight of hyperedges in a community of this volume, of the whole hypergraph's."""
        key = round(vol, 9)
        if key not in self.taxes:
            x = min(1.0, max(0.0, vol / self.total))
            self.taxes[key] = sum(n * sum(math.comb(d, c) * x**c * (1 - x) ** (d - c) * self.weight(d, c) for c in range(d // 2 + 1, d + 1)) for d, n in self.sizes.items()) / self.mass
        return self.taxes[key]

    def gain(self, mults: dict[int, int], strength: float, links: dict[int, float], here: int, to: int, alpha: float) -> float:
        """What combined modularity gains if a (super)node with these multiplicities moves."""
        vh, vt = self.volume[here], self.volume.get(to, 0.0)
        total = 0.0
        if alpha > 0:
            a, b = self.inside[here], self.inside.get(to, {})
            for e, k in mults.items():
                d, w = self.card[e], self.weights[e]
                total += w * (self.weight(d, b.get(e, 0) + k) - self.weight(d, b.get(e, 0)) - self.weight(d, a[e]) + self.weight(d, a[e] - k))
            total = total / self.mass - self.p.resolution * (self.tax(vt + strength) - self.tax(vt) - self.tax(vh) + self.tax(vh - strength))
        flat = 0.0
        if alpha < 1:
            flat = 2 * (links.get(to, 0.0) - links.get(here, 0.0)) / self.total - self.p.resolution * 2 * strength * (strength + vt - vh) / self.total**2
        return (1 - alpha) * flat + alpha * total

    def move(self, mults: dict[int, int], strength: float, here: int, to: int) -> None:
        a, b = self.inside[here], self.inside.setdefault(to, {})
        for e, k in mults.items():
            a[e] -= k
            if not a[e]:
                del a[e]
            b[e] = b.get(e, 0) + k
        self.volume[here] -= strength
        self.volume[to] = self.volume.get(to, 0.0) + strength


def local_moves(state: State) -> dict[int, int]:
    """Phases of moves of supernodes until none improves, then moves of single nodes."""
    p = state.p
    rng = np.random.RandomState(p.seed)
    supernodes = [[v] for v in sorted(state.at)]
    level, changes, communities = 0, 0, len(supernodes)
    threshold = communities * p.frequency
    for _ in range(p.phases):
        moved_in_phase = False
        while True:
            improved = False
            for k in rng.permutation(len(supernodes)).tolist():
                group = supernodes[k]
                here = state.community[group[0]]
                own = set(group)
                mults: dict[int, int] = defaultdict(int)
                links: dict[int, float] = defaultdict(float)
                for v in group:
                    for e, m in state.at[v].items():
                        mults[e] += m
                    for o, w in state.near[v].items():
                        if o not in own:
                            links[state.community[o]] += w
                strength = sum(state.strength[v] for v in group)
                alpha = p.alphas[min(level, len(p.alphas) - 1)]
                best, to = 0.0, here
                for c in sorted(links):
                    if c != here and (g := state.gain(mults, strength, links, here, c, alpha)) > best + 1e-15:
                        best, to = g, c
                if to == here:
                    continue
                state.move(mults, strength, here, to)
                for v in group:
                    state.community[v] = to
                improved = moved_in_phase = True
                changes += 1
                communities -= not state.inside[here]
                if p.mode == "communities" and communities <= threshold:
                    level, threshold = level + 1, threshold * p.frequency
                elif p.mode == "modifications" and changes >= p.frequency:
                    level, changes = level + 1, 0
            level += p.mode == "iter"
            if not improved:
                break
        level += p.mode == "phase"
        groups: dict[int, list[int]] = defaultdict(list)
        for v in sorted(state.community):
            groups[state.community[v]].append(v)
        if not moved_in_phase:
            # go on with the hypergraph part alone before giving up
            if p.alphas[min(level, len(p.alphas) - 1)] >= 1.0 - 1e-9 or level >= len(p.alphas) - 1:
                break
            level = len(p.alphas) - 1
        supernodes = [groups[c] for c in sorted(groups)]
    if p.last_step:
        refine(state, rng)
    return state.community


def refine(state: State, rng: np.random.RandomState) -> None:
    """Moves of single nodes by hypergraph modularity alone, until a pass gains less than 0.01 in sum."""
    nodes = sorted(state.at)
    while True:
        gained = 0.0
        for k in rng.permutation(len(nodes)).tolist():
            v = nodes[k]
            here = state.community[v]
            best, to = 0.0, here
            for c in sorted({state.community[o] for o in state.near[v]} - {here}):
                g = state.gain(state.at[v], state.strength[v], {}, here, c, 1.0)
                if g > best + 1e-12:
                    best, to = g, c
            if to != here:
                state.move(state.at[v], state.strength[v], here, to)
                state.community[v] = to
                gained += best
        if gained < 0.01:
            return


def h_louvain(inc: DataFrame, params: LouvainParams = LouvainParams(), weights: DataFrame | None = None) -> DataFrame:
    """(node, part): communities named by one of their nodes; hyperedges of fewer than two nodes don't count, and nodes without others are alone."""
    e = with_card(inc, 2)
    e = e.join(weights.select("edge", "weight"), "edge") if weights is not None else e.withColumn("weight", F.lit(1.0))
    # equal hyperedges only ever count together: one of them has the weight of all
    sets = e.groupBy("edge").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.first("weight").alias("weight"))
    sets = cut(sets.groupBy("nodes").agg(F.min("edge").alias("edge"), F.sum("weight").alias("weight")), "sets")
    sizes = {r["card"]: r["n"] for r in sets.groupBy(F.size("nodes").alias("card")).agg(F.sum("weight").alias("n")).collect()}
    total = float(sum(d * n for d, n in sizes.items()))
    parts = hypergraph_components(sets.select("edge", F.explode("nodes").alias("node")))
    first = sets.select(F.col("nodes")[0].alias("node"), "edge", "nodes", "weight")
    placed = first.join(parts, "node").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("edge", "nodes", "weight"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = b.column(0).slice(k, 1).flatten()
                ids = rows.field("edge").to_pylist()
                edges = dict(zip(ids, rows.field("nodes").to_pylist(), strict=True))
                w = dict(zip(ids, rows.field("weight").to_pylist(), strict=True))
                found = local_moves(State(edges, w, sizes, total, params))
                yield pa.RecordBatch.from_pydict({"node": pa.array(list(found), pa.int64()), "part": pa.array(list(found.values()), pa.int64())})

    moved = placed.select("rows").mapInArrow(run, "node long, part long")
    return inc.select("node").distinct().join(moved, "node", "left").select("node", F.coalesce("part", "node").alias("part"))

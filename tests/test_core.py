"""Hand-worked fixtures, brute force on small hypergraphs, and properties."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperweft.functions import kernels, stats
from hyperweft.operators import blocks, dual, generators, graph, incidence, modularity, poset, transport
from hyperweft.plans import clustering, louvain, measures
from hyperweft.plans.storage import cut, mean_ranks, numbered, running_sum

# Small hypergraphs with known results.
STAR = [[1, 2, 3, 4], [1, 5], [1, 6], [2, 7], [2, 8], [3, 9], [3, 10], [4, 11], [4, 12]]
MINI = [[1, 2], [2, 3, 4]]
TOY = [[1, 2, 3, 4, 5], [2, 3], [5, 7, 3, 6], [1, 4, 7], [6, 7, 8], [2, 5, 8]]


def inc_of(spark, edges):
    return spark.createDataFrame([(k, n) for k, e in enumerate(edges) for n in e], "edge long, node long")


def as_dict(df, key, value="curvature"):
    return {r[key]: r[value] for r in df.collect()}


def test_forman(spark):
    inc = inc_of(spark, STAR)
    assert as_dict(poset.forman_hyperedges(inc), "edge") == {0: -12} | dict.fromkeys(range(1, 9), 0)
    assert as_dict(poset.forman_vertices(inc), "node") == {k: -12 if k < 5 else 0 for k in range(1, 13)}
    inc = inc_of(spark, MINI)
    assert as_dict(poset.forman_hyperedges(inc), "edge") == {0: 1, 1: -1}
    assert as_dict(poset.forman_vertices(inc), "node") == {1: 1, 2: 0, 3: -1, 4: -1}


def test_forman_with_inclusion(spark):
    inc = inc_of(spark, TOY)
    cover = cut(poset.covers(inc))
    up = defaultdict(set)
    for r in poset.named(cover, "low", "high").collect():
        up[r["low"]].add(r["high"])
    want = {1: {0, 3}, 2: {1, 5}, 3: {1, 2}, 4: {0, 3}, 5: {0, 2, 5}, 6: {2, 4}, 7: {2, 3, 4}, 8: {4, 5}}
    assert up == {f"v{k}": {f"e{x}" for x in v} for k, v in want.items()} | {"e1": {"e0"}}
    assert {tuple(r) for r in poset.named(poset.triangles(cover), "i", "j", "k").collect()} == {("v2", "e1", "e0"), ("v3", "e1", "e0")}
    assert poset.poset_edges(cover).count() == 21
    assert as_dict(poset.forman_hyperedges(inc), "edge") == {0: -16, 1: 3, 2: -11, 3: -4, 4: -4, 5: -5}
    assert as_dict(poset.forman_vertices(inc), "node") == {1: -20, 2: -18, 3: -24, 4: -20, 5: -32, 6: -15, 7: -19, 8: -9}


def test_forman_sums(spark):
    curved = poset.forman_graph(inc_of(spark, TOY))
    assert 2 * curved.agg(F.sum("curvature")).first()[0] == poset.forman_nodes(curved).agg(F.sum("curvature")).first()[0]


def test_positional_vertices(spark):
    inc = inc_of(spark, [[0, 1], [1, 2]])
    # edges 1-e0, 1-e1, 2-e1 have curvatures 1, 0, 1; so both hyperedges have 1
    assert as_dict(poset.forman_vertices_positional(inc, 3), "node") == {1: 2, 2: 1, 3: 0}


def test_containments_by_brute_force(spark):
    rng = random.Random(1)
    edges = [sorted(rng.sample(range(9), rng.randrange(1, 7))) for _ in range(60)] + [list(range(100, 150)), [100, 120], [149], list(range(100, 145))]
    found = {tuple(r)[:2] for r in poset.edge_containments(inc_of(spark, edges)).collect()}
    assert found == {(i, j) for i, a in enumerate(edges) for j, b in enumerate(edges) if len(a) < len(b) and set(a) < set(b)}


def test_poset_shuffles_no_whole_hyperedges_for_pairs(spark, monkeypatch):
    rng = random.Random(5)
    edges = [sorted(rng.sample(range(14), rng.choice([2, 2, 3, 3, 4, 5, 6]))) for _ in range(150)] + [list(range(60)), [0, 50], [3]]
    plans, kept = defaultdict(list), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def noted(df, tag="cut"):
        plans[tag].append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, tag)

    monkeypatch.setattr(poset, "cut", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        inc = inc_of(spark, edges)
        sums = as_dict(poset.forman_hyperedges(inc), "edge")
        with monkeypatch.context() as m:
            m.setattr(poset, "small", lambda df, n: False)  # no broadcast at all
            assert as_dict(poset.forman_hyperedges(inc), "edge") == sums
        assert as_dict(poset.forman_hyperedges(inc, poset.forman_graph(inc)), "edge") == sums
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    held = {k: set(e) for k, e in enumerate(edges)}
    want = {(a, b) for a in held for b in held if held[a] < held[b]}
    assert {(r["low"], r["high"]) for r in poset.edge_containments(inc).collect()} == want
    for plan in (plans["contained"][0], plans["chains"][0]):
        assert "Exchange hashpartitioning" not in plan


def test_ring_of_hyperedges(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_DEGREES", 9)
    monkeypatch.setattr(graph, "PIECE", 2)
    rng = random.Random(3)
    inc = inc_of(spark, [rng.sample(range(30), rng.choice([1, 2, 2, 2, 3])) for _ in range(40)])
    ends = [(rng.randrange(32), rng.choice([0, 0, rng.randrange(32)])) for _ in range(40)]
    pairs = spark.createDataFrame([*ends, ends[0], (5, 5), (99, 98)], "a long, b long")
    for inner, outer in ((1, 2), (0, 1), (1, 3)):
        found = graph.ring_of_hyperedges(inc, pairs, inner, outer)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.ring(incidence.cooccurrence(inc), pairs, inner, outer).collect()))
    assert graph.ring_of_hyperedges(inc.limit(0), pairs, 1, 2).isEmpty() and graph.ring_of_hyperedges(inc, pairs.limit(0), 1, 2).isEmpty()
    top = found._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert "MapInArrow" in top and "Aggregate" not in top  # rings aren't shuffled


def test_hyperedges_are_dealt_packed(spark, monkeypatch):
    rng = random.Random(5)
    edges = [rng.sample(range(-50, 250), rng.randrange(1, 6)) for _ in range(200)] + [[-(1 << 62), 1 << 62, 3], list(range(0, 250, 3))]
    sets = blocks.sets(inc_of(spark, edges))
    near = cut(spark.createDataFrame([(n % 4, n) for n in range(0, 250, 20)] + [(9, 0), (3, 1 << 62), (5, 9999)], "block long, node long"))
    want, around = defaultdict(set), set()
    for r in near.collect():
        for e in edges:
            if r["node"] in e:
                want[r["block"]].add(tuple(sorted(e)))
                around |= {(r["block"], n) for n in e}
    for bound in (64, 1 << 20):  # in passes, and at once
        monkeypatch.setattr(blocks, "BROADCAST_BYTES", bound)
        found, n = defaultdict(list), 0
        for r in blocks.dealt(sets, near).collect():
            sizes, members = blocks.unpacked(r["base"], r["sizes"], r["members"])
            found[r["block"]] += map(tuple, np.split(members, np.cumsum(sizes)[:-1]))
            n += len(r["members"]) + len(r["sizes"])
        assert {k: set(map(tuple, np.array(v, object))) for k, v in found.items()} == want
        assert {tuple(r) for r in blocks.neighbours(sets, near).collect()} == around
    assert len(blocks.packed(np.full(1000, 4), np.arange(4000))[2]) < 3 * 1000 + 2 * 1000 + 20
    plan = blocks.dealt(sets, near)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # only a block's own rows are shuffled, to it


def test_what_was_shuffled_for_a_table_goes(spark):
    from hyperweft.plans.storage import CLEANUP

    before = spark.conf.get(CLEANUP, None)
    assert cut(spark.range(100).repartition(3)).count() == 100 and spark.conf.get(CLEANUP, None) == before


def test_removal_from_the_poset(spark):
    inc = inc_of(spark, TOY)
    cover = cut(poset.covers(inc))
    left = poset.named(poset.without_members(poset.poset_edges(cover), poset.triangles(cover), spark.createDataFrame([(3,)], "member long")), "u", "v")
    assert left.filter("tri > 0").count() == 0 and left.count() == 21 - 3


def test_dual(spark):
    edges = [[1, 2], [2, 3], [4, 5], [1, 2, 3], [2, 3, 4], [2, 1], [7], [8]]
    inc = inc_of(spark, edges)
    found = dual.dual_edges(inc)
    assert {tuple(r) for r in found.collect()} == {(2, 0, 1, "2"), (3, 3, 4, "2,3"), (1, 6, 7, "")}
    shared = {(r["e1"], r["e2"]): r["shared"] for r in dual.dependent_nodes(inc, found).collect()}
    assert shared == {(0, 1): None, (3, 4): 1, (6, 7): None}
    values = as_dict(dual.by_hyperedge(transport.dual_curvature(found.filter("card > 1")), inc.select("edge").distinct()), "edge")
    assert math.isnan(values[2]) and values[0] == values[1]
    # two nodes joined by one edge swap 0.95 of their mass, of which 0.9 has to move
    assert values[0] == pytest.approx(1 - 0.9)


def test_barycentre_curvature(spark):
    inc = inc_of(spark, STAR)
    curved = transport.mmot_curvature(inc)
    rows = {r["edge"]: r for r in curved.collect()}
    assert rows[0]["curvature"] == pytest.approx(0.6631082935304122, abs=1e-13) and rows[0]["rounds"] == 4
    assert all(rows[k]["curvature"] == pytest.approx(0.0199763359706, abs=1e-12) and rows[k]["rounds"] == 15 for k in range(1, 9))
    vertices = as_dict(transport.mmot_vertex(inc, curved), "node")
    assert vertices[1] == pytest.approx(0.70306096547, abs=1e-10) and vertices[12] == pytest.approx(0.01997633597, abs=1e-10)


def test_exact_barycentre_and_pairs(spark):
    inc = inc_of(spark, STAR)
    exact = {r["edge"]: r for r in transport.mmot_curvature(inc, transport.TransportParams(solver="lp", lp_support=12)).collect()}
    assert exact[1]["method"] == "lp" and exact[1]["curvature"] == pytest.approx(0.02, abs=1e-8)
    assert exact[0]["curvature"] <= 0.12 + 1e-8
    pairs = as_dict(transport.pair_curvature(inc), "edge")
    assert pairs[1] == pytest.approx(0.02, abs=1e-12)
    toy = as_dict(transport.pair_curvature(inc_of(spark, TOY)), "edge")
    want = [0.46955578, 0.37453258, 0.46054421, 0.44933837, 0.40527229, 0.42858198]
    assert [toy[k] for k in range(6)] == pytest.approx(want, abs=5e-3)
    assert as_dict(transport.pair_curvature(inc, reg=0.02), "edge")[1] == pytest.approx(0.02, abs=1e-3)


def test_node_measure(spark):
    mass = defaultdict(dict)
    for r in transport.node_measure(inc_of(spark, STAR)).collect():
        mass[r["src"]][r["dst"]] = r["mass"]
    assert mass[1] == pytest.approx({1: 0.01, 2: 0.11, 3: 0.11, 4: 0.11, 5: 0.33, 6: 0.33})
    assert mass[5] == pytest.approx({5: 0.01, 1: 0.99})
    assert all(sum(m.values()) == pytest.approx(1) for m in mass.values())


def test_node_measure_sums_pairs_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(transport, "BLOCK_PAIRS", 7, raising=False)
    edges = [tuple(sorted({(k * 7 + j * j * (k % 5 + 1)) % 23 for j in range(k % 6 + 1)})) for k in range(40)]
    deg, want = defaultdict(int), defaultdict(float)
    for e in edges:
        for u in e:
            deg[u] += 1
    for e in edges:
        for u in e:
            for v in e:
                if u != v or len(e) == 1:
                    want[u, v] += 0.99 / deg[u] / max(len(e) - 1, 1)
    for u in deg:
        want[u, u] += 0.01
    found = transport.node_measure(inc_of(spark, edges))
    rows = found.collect()
    assert {(r["src"], r["dst"]): r["mass"] for r in rows} == pytest.approx(dict(want)) and len(rows) == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # pairs aren't shuffled
    assert transport.node_measure(inc_of(spark, [])).count() == 0
    assert {(r["src"], r["dst"]) for r in transport.node_measure(inc_of(spark, [(1,), (2, 3)]), 0.0).collect()} == {(1, 1), (2, 3), (3, 2)}


def test_node_measure_deals_a_hyperedge_once_to_each_block(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(transport, "BLOCK_PAIRS", 7, raising=False)  # blocks by pairs got a copy of a hyperedge for each of its nodes
    monkeypatch.setattr(transport, "BLOCK_DEGREES", 40, raising=False)
    monkeypatch.setattr(transport, "PIECE", 3, raising=False)
    monkeypatch.setattr(blocks, "dealt", lambda edges, near, f=blocks.dealt: dealt.append(f(edges, near)) or dealt[-1])
    edges = [range(60), range(0, 60, 2), [70], [70, 71], [3]]
    rows = transport.node_measure(inc_of(spark, edges)).collect()
    assert sum(len(blocks.decoded(r["sizes"])) for r in dealt[0].collect()) <= 3 * len(edges)
    mass = {(r["src"], r["dst"]): r["mass"] for r in rows}
    assert len(mass) == len(rows) == 60 * 60 + 4
    assert mass[3, 3] == pytest.approx(0.01 + 0.495) and mass[3, 5] == pytest.approx(0.495 / 59) and mass[2, 4] == pytest.approx(0.495 / 59 + 0.495 / 29)
    assert {(a, b) for a, b in mass if a > 60} == {(70, 70), (70, 71), (71, 70), (71, 71)} and mass[70, 70] == pytest.approx(0.505)
    assert {r["mass"] for r in transport.node_measure(inc_of(spark, [[1, 2]]), 1.0).collect()} == {0.0, 1.0}


def test_supports_match_the_kernel(spark):
    inc = inc_of(spark, TOY + STAR[4:])
    raw, n = transport._packed(inc)
    for lazy in (False, True):
        local = transport.Local(raw, n, transport.TransportParams(lazy_support=lazy))
        found = defaultdict(set)
        for r in transport.supports(inc, transport.node_measure(inc), lazy).collect():
            found[r["edge"]].add(r["node"])
        for k, e in enumerate(local.ids.tolist()):
            assert found[e] == set(local.graph.labels[local.support(local.members(k).tolist())].tolist())


def test_refresh_keeps_far_hyperedges(spark):
    edges = [[1, 2], [2, 3], [3, 4], [4, 5], [5, 6], [6, 7], [7, 8], [8, 9], [9, 10]]
    inc = inc_of(spark, edges)
    curved = transport.mmot_curvature(inc).select("edge", F.lit(9.0).alias("curvature"))
    out = as_dict(transport.refreshed(inc, curved, spark.createDataFrame([(0,)], "edge long")), "edge")
    assert out[1] != 9.0 and out[2] != 9.0 and out[8] == 9.0 and 0 not in out


def test_transport_by_linear_programming():
    rng = np.random.default_rng(0)
    for _ in range(25):
        n, m = rng.integers(1, 7, 2)
        a, b = rng.random(n), rng.random(m)
        a, b, c = a / a.sum(), b / b.sum(), rng.integers(0, 5, (n, m)).astype(float)
        rows = [np.repeat(np.arange(n) == i, m).astype(float) for i in range(n)] + [np.tile(np.arange(m) == j, n).astype(float) for j in range(m)]
        x = kernels.simplex(np.array(rows), np.concatenate([a, b]), c.ravel(), 5000)
        assert kernels.transport(a, b, c) == pytest.approx(x @ c.ravel(), abs=1e-9)


def test_modularity(spark):
    inc = inc_of(spark, [[0, 1, 2], [1, 2], [3, 4], [2, 3]])
    parts = spark.createDataFrame([(k, int(k > 2)) for k in range(5)], "node long, part int")
    want = {"strict": 0.25, "majority": 0.0833333, "linear": 0.1388889, "quadratic": 0.1759259}
    for name, q in want.items():
        assert modularity.modularity(inc, parts, modularity.TAU[name]).first()["q"] == pytest.approx(q, abs=1e-7)
        whole = modularity.modularity(inc, parts.withColumn("part", F.lit(0)), modularity.TAU[name]).first()["q"]
        assert whole == pytest.approx(0, abs=1e-12)
    score = clustering.BlockScores(inc, parts, 1.0)
    q = {r["part"]: r["q"] for r in modularity.contributions(inc, parts).collect()}
    assert score(frozenset([0])) == pytest.approx(q[0]) and score(frozenset([1])) == pytest.approx(q[1])


def test_weights_scale_out(spark):
    inc = inc_of(spark, TOY)
    parts = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "node long, part int")
    weights = inc.select("edge").distinct().withColumn("weight", F.lit(2.5))
    assert modularity.modularity(inc, parts, weights=weights).first()["q"] == pytest.approx(modularity.modularity(inc, parts).first()["q"])


def test_attach(spark):
    rng = random.Random(2)
    edges = [rng.sample(range(k * 5, k * 5 + 5), 3) for k in range(4) for _ in range(8)] + [[0, 5, 1], [10, 15, 11]] * 3
    inc = inc_of(spark, edges)
    parts = spark.createDataFrame([(n, n // 5) for n in range(20)], "node long, part int")
    score = clustering.BlockScores(inc, parts)
    blocks = [frozenset([k]) for k in range(4)]
    best, q = clustering.optimal_attach(blocks, score, 2)
    tries = [[a, frozenset(range(4)) - a] for r in (1, 2) for c in itertools.combinations(range(4), r) for a in [frozenset(c)]]
    assert q == pytest.approx(max(sum(map(score, t)) for t in tries)) and set(best) == {frozenset([0, 1]), frozenset([2, 3])}
    merged = clustering.greedy_attach({k: 5 for k in range(4)}, score, 2)
    assert sorted(map(sorted, merged)) == [[0, 1], [2, 3]]


@pytest.mark.parametrize(("sizes", "target", "stop"), [([60, 40], 2, False), ([59, 41], 2, True), ([70, 2, 1] + [1] * 27, 2, True), ([50, 50], 3, False), ([49, 30, 21], 3, True), ([50, 5, 5, 5] + [1] * 35, 3, True)])
def test_stop_rule(spark, sizes, target, stop):
    df = spark.createDataFrame(list(enumerate(sizes)), "part long, n_nodes long")
    assert clustering.should_stop(df, target).first()["stop"] is stop


def test_stop_rule_refuses_one_cluster(spark):
    with pytest.raises(ValueError):
        clustering.should_stop(spark.createDataFrame([(1, 1)], "part long, n_nodes long"), 1)


def two_groups():
    rng = random.Random(4)
    return [rng.sample(range(12), 3) for _ in range(25)] + [rng.sample(range(12, 24), 3) for _ in range(25)] + [[0, 12], [5, 20], [7, 15]]


def test_static_clustering(spark):
    edges = two_groups()
    inc = inc_of(spark, edges)
    scores = spark.createDataFrame([(k, 0.0 if len(e) == 2 else 1.0) for k, e in enumerate(edges)], "edge long, score double")
    clusters, removed, q = clustering.cluster_static(inc, scores)
    assert [r["edge"] for r in removed.orderBy("step").collect()] == [50, 51, 52]
    labels = as_dict(clusters, "node", "cluster")
    assert len({labels[n] for n in range(12)}) == 1 and len({labels[n] for n in range(12, 24)}) == 1 and labels[0] != labels[12]
    assert clustering.partition_modularity(inc, clusters).first()["q"] == pytest.approx(q)


def test_removals_are_looked_at_in_memory(spark, monkeypatch):
    edges = [*two_groups(), [3], list(range(0, 24, 5))]
    inc = cut(inc_of(spark, edges))
    order = cut(spark.createDataFrame([(k * 7 % 53 + 1, k) for k in range(53)], "step long, edge long"))
    nodes = inc.select("node").distinct()
    held = clustering._Held(inc, order)
    for n in (0, 20, 40, 47, 53):
        left = inc.join(order.filter(F.col("step") <= n).select("edge"), "edge", "left_anti")
        sizes = clustering.component_sizes(graph.hypergraph_components(left, nodes))
        assert [held.stops(n, k) for k in (2, 3, 5)] == [clustering.should_stop(sizes, k).first()["stop"] for k in (2, 3, 5)]
    monkeypatch.setattr(clustering, "BROADCAST_BYTES", 0)
    far = [clustering.first_stop(inc, order, 3, 53), clustering.first_stop(inc, order, 2, 10)]
    monkeypatch.setattr(clustering, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(clustering, "hypergraph_components", None)  # not a distributed search for each probe
    assert [clustering.first_stop(inc, order, 3, 53), clustering.first_stop(inc, order, 2, 10)] == far


def test_component_labels():
    rng = random.Random(9)
    for edges in ([[k, k + 1] for k in range(39)], [[39 - k, (k * 17) % 40] for k in range(25)], [rng.sample(range(40), rng.randrange(1, 5)) for _ in range(12)]):
        want = list(range(40))
        for _ in edges:
            for e in edges:
                low = min(want[x] for x in e)
                want = [low if x in {want[y] for y in e} else x for x in want]
        first = np.cumsum([0, *map(len, edges)])
        assert kernels.component_labels(first, np.concatenate(edges), 40).tolist() == want


@pytest.mark.parametrize("tau", [1.0, 2.0, math.inf])
def test_tax_of_large_hyperedges(spark, tau):
    score = clustering.BlockScores(inc_of(spark, [range(3), range(70), range(150), range(90, 300)]), spark.createDataFrame([(k, k % 2) for k in range(300)], "node long, part int"), tau)

    def term(d, c, x):
        return math.comb(d, c) * x**c * (1 - x) ** (d - c) * score.weight(d, c)

    for vol in (0, 1, score.all // 3, score.all // 2, score.all - 40, score.all):
        assert score.tax(vol) == pytest.approx(sum(term(d, c, vol / score.all) for d in score.sizes for c in range(d // 2 + 1, d + 1)), rel=1e-10, abs=1e-300)
    # coefficients that no float holds
    score = clustering.BlockScores(inc_of(spark, [range(3000)]), spark.createDataFrame([(k, k % 2) for k in range(3000)], "node long, part int"), 1.0)
    assert score.tax(1800) == pytest.approx(0.6) and score.tax(1200) < 1e-20


def test_no_component_is_left_unattached(spark, monkeypatch):
    # a bound on the parts that are looked at gave all others cluster 0
    monkeypatch.setattr(clustering, "DRIVER_PARTS", 3, raising=False)
    inc = inc_of(spark, two_groups())
    parts = spark.createDataFrame([(n, n // 12 * 12 if n % 12 < 8 else n) for n in range(24)], "node long, part long")
    clusters, q = clustering.finish(inc, parts, clustering.ClusterParams())
    score = clustering.BlockScores(inc, parts)
    sizes = {n if n % 12 >= 8 else n // 12 * 12: 1 if n % 12 >= 8 else 8 for n in range(24)}
    merged, best = clustering.optimal_attach(clustering.greedy_attach(sizes, score, 4), score, 2)
    labels = as_dict(clusters, "node", "cluster")
    assert all(labels[x] == k for k, b in enumerate(sorted(merged, key=min)) for x in b) and q == pytest.approx(best)
    assert clustering.partition_modularity(inc, clusters).first()["q"] == pytest.approx(q)


def test_dynamic_clustering(spark):
    edges = [[0, 1, 2], [1, 2, 3], [0, 3], [3, 4], [4, 5, 6], [5, 6, 7], [4, 7]]
    inc = inc_of(spark, edges)
    fake = lambda df: df.groupBy("edge").agg(F.when(F.max("edge") == 3, -1.0).otherwise(1.0).alias("curvature"))
    clusters, gone, _ = clustering.cluster_dynamic(inc, fake, lambda left, curved, removed: curved.join(removed, "edge", "left_anti"))
    labels = as_dict(clusters, "node", "cluster")
    assert gone == [3] and len({labels[n] for n in range(4)}) == 1 and labels[0] != labels[7]


def test_targeted_order(spark):
    inc = inc_of(spark, [[1, 2], [2, 3], [3, 4], [1, 2, 3], [2, 3, 4]])
    scores = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 3.0), (3, 4.0), (4, 2.0)], "edge long, score double")
    order = clustering.targeted_order(scores, inc, [0, 0, 0.5, 0.5])
    # pairs hold 3/5 > 1/2 of all: the pair with the lowest score goes; then both hold exactly their share
    assert order == [0]


@pytest.mark.parametrize("name", ["Forman", "OR_MMOT", "OR_Dual", "ORCHID", "random"])
def test_measures(spark, name):
    m = measures.measure(name)
    inc = inc_of(spark, TOY)
    assert m.edge_scores(inc).count() == 6 and m.vertex_scores(inc).count() == 8
    assert m.refreshed(inc, m.edge_scores(inc), spark.createDataFrame([(1,)], "edge long")).count() == 5


def test_components_balls_and_rings(spark):
    edges = [[1, 2], [2, 3, 4], [4, 5], [8, 9], [9, 10], [12]]
    inc = inc_of(spark, edges)
    assert as_dict(graph.hypergraph_components(inc), "node", "part") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8, 12: 12}
    pairs = incidence.cooccurrence(inc)
    d = {r["node"]: r["d"] for r in graph.hop_distances(pairs, spark.createDataFrame([(1,)], "source long"), 3).collect()}
    assert d == {1: 0, 2: 1, 3: 2, 4: 2, 5: 3}
    ends = spark.createDataFrame([(1, 2)], "a long, b long")
    assert {r["node"] for r in graph.ring(pairs, ends, 1, 2).collect()} == {5}
    assert {r["node"] for r in graph.edge_ball(pairs, ends, 1).collect()} == {1, 2, 3, 4}


def test_kernel_distances_match_joins(spark):
    rng = random.Random(3)
    inc = inc_of(spark, [rng.sample(range(40), 2) for _ in range(50)])
    pairs = [tuple(r)[:2] for r in incidence.cooccurrence(inc).collect()]
    adj = kernels.Adjacency(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    block = adj.block(np.arange(len(adj.labels)), 3)
    found = {(r["source"], r["node"]): r["d"] for r in graph.hop_distances(incidence.cooccurrence(inc), inc.select(F.col("node").alias("source")).distinct(), 3).collect()}
    for i, a in enumerate(adj.labels.tolist()):
        for j, b in enumerate(adj.labels.tolist()):
            assert found.get((a, b), kernels.FAR) == block[i, j]


def test_louvain(spark):
    edges = two_groups()
    inc = inc_of(spark, edges)
    for mode in ("communities", "modifications", "iter", "phase"):
        parts = as_dict(louvain.h_louvain(inc, louvain.LouvainParams(mode=mode)), "node", "part")
        assert len(parts) == 24
    rng = random.Random(11)
    inc = inc_of(spark, [rng.sample(range(k, k + 12), 3) for k in (0, 12) for _ in range(80)] + [[0, 12], [5, 20], [7, 15]])
    parts = louvain.h_louvain(inc)
    truth = spark.createDataFrame([(n, n // 12) for n in range(24)], "node long, truth int")
    agree = stats.partition_agreement(parts.join(truth, "node"), "part", "truth").first()
    assert agree["homogeneity"] > 0.99
    q = modularity.combined_modularity(inc, parts, 1.0).first()["q"]
    assert q > modularity.combined_modularity(inc, truth.select("node", (F.col("node") % 3).alias("part")), 1.0).first()["q"]


def test_louvain_gains_are_differences_of_modularity(spark):
    rng = random.Random(6)
    edges = {k: rng.sample(range(10), rng.randrange(2, 5)) for k in range(15)}
    inc = inc_of(spark, list(edges.values()))
    sizes = Counter(map(len, edges.values()))
    state = louvain.State(edges, dict.fromkeys(edges, 1.0), dict(sizes), float(sum(map(len, edges.values()))), louvain.LouvainParams())
    for alpha in (0.0, 0.4, 1.0):
        for v, to in ((0, 1), (2, 1), (3, 4)):
            here = state.community[v]
            if here == to:
                continue
            links = defaultdict(float)
            for o, w in state.near[v].items():
                links[state.community[o]] += w
            now = spark.createDataFrame(sorted(state.community.items()), "node long, part long")
            then = spark.createDataFrame(sorted((state.community | {v: to}).items()), "node long, part long")
            want = modularity.combined_modularity(inc, then, alpha).first()["q"] - modularity.combined_modularity(inc, now, alpha).first()["q"]
            assert state.gain(state.at[v], state.strength[v], links, here, to, alpha) == pytest.approx(want, abs=1e-9)
        state.move(state.at[2], state.strength[2], state.community[2], 1)
        state.community[2] = 1


def test_generators(spark):
    h = incidence.hyperedges(generators.random_hypergraph(spark, 200, {2: 150, 3: 120}))
    counts = {r["card"]: r["count"] for r in h.groupBy("card").count().collect()}
    assert abs(counts[2] - 150) < 15 and abs(counts[3] - 120) < 15
    assert h.count() == h.select("key").distinct().count()
    inc = generators.uniform_hsbm(spark, 120, 3, 3, 0.004, 0.0001)
    n = generators.within_between(inc, 3).first()
    assert n["n_within"] > 80 and n["n_between"] < 60 and inc.select("node").distinct().count() == 120
    b = generators.within_between(generators.block_hypergraph(spark, 200, 4, 240), 4).first()
    assert b["n_within"] > 3 * b["n_between"]
    assert generators.small_world(spark, 50, 3, 0.0).count() == 150


def test_agreement(spark):
    # 20 x 3 blocks of a known table, and its scores.
    rows = [(a, b) for a, b, n in [(0, 0, 5), (0, 1, 1), (1, 1, 7), (1, 2, 2), (2, 2, 5)] for _ in range(n)]
    one = stats.partition_agreement(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    h = lambda c: -sum(x / 20 * math.log(x / 20) for x in c)
    mutual = h([6, 9, 5]) + h([5, 8, 7]) - h([5, 1, 7, 2, 5])
    assert one["nmi"] == pytest.approx(2 * mutual / (h([6, 9, 5]) + h([5, 8, 7])))
    assert one["purity"] == 0.85 and one["inverse_purity"] == 0.85
    same = stats.partition_agreement(spark.createDataFrame([(1, 1), (2, 2)], "a int, b int"), "a", "b").first()
    assert same["ari"] == 1 and same["v_measure"] == pytest.approx(1)


def test_correlations(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 80).astype(float), rng.normal(size=80)
    rows = [(float(x), float(y), int(x) % 2) for x, y in zip(a, b)] + [(float("nan"), 1.0, 0), (1.0, None, 1)]
    one = stats.correlation(spark.createDataFrame(rows, "a double, b double, g int"), "a", "b").first()
    ranks = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert one["n"] == 80 and one["pearson"] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert one["spearman"] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
    flat = stats.correlation(spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double"), "a", "b").first()
    assert math.isnan(flat["pearson"]) and math.isnan(stats.correlation(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double"), "a", "b").first()["pearson"])


def test_normal_tail(spark):
    z = [-6.0, -2.9, -0.3, 0.0, 0.4, 1.9, 2.7, 2.9, 5.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(stats.normal_tail(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in z], rel=1e-10)


def test_rank_test_and_holm(spark):
    rows = [(x, True) for x in (5.0, 6.0, 7.0, 7.0)] + [(x, False) for x in (1.0, 2.0, 5.0, 3.0, 4.0)]
    one = stats.mann_whitney(spark.createDataFrame(rows, "v double, g boolean"), "v", "g").first()
    u = sum((a > b) + 0.5 * (a == b) for a, g in rows if g for b, k in rows if not k)
    assert one["u"] == u and one["r"] == pytest.approx(2 * u / 20 - 1) and 0 < one["p"] < 0.05
    ps = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, float("nan"))], "key int, p double")
    out = {r["key"]: r["p_holm"] for r in stats.holm(ps).collect()}
    assert [out[k] for k in (1, 2, 3)] == pytest.approx([0.03, 0.06, 0.06]) and math.isnan(out[4])


def test_within(spark):
    inc = inc_of(spark, [[1, 2], [1, 3], [1, 2, 3], [1, 9], [8, 9], [3, 9, 8]])
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "node long, label string")
    counts = stats.label_counts(inc, labels)
    rules = {r: as_dict(stats.within(counts, r), "edge", "within") for r in ("strict", "majority", "linear", "unassigned_strict", "impure")}
    assert rules["strict"] == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}
    assert rules["majority"] == {0: True, 1: False, 2: True, 3: False, 4: False, 5: False}
    assert rules["linear"] == {0: True, 1: None, 2: True, 3: True, 4: False, 5: True}
    assert rules["unassigned_strict"] == {0: True, 1: False, 2: False, 3: True, 4: False, 5: True}


def test_positional_join(spark):
    a = spark.createDataFrame([(0, "x", 1.0), (1, "x", 2.0)], "pos long, key string, value double")
    b = spark.createDataFrame([(0, "p", 3.0), (1, "q", 4.0)], "pos long, key string, value double")
    assert {(r["a"], r["b"]) for r in stats.joined_curvatures(a, b).collect()} == {(1.0, 3.0), (2.0, 4.0)}
    with pytest.raises(ValueError):
        stats.joined_curvatures(a, b.limit(1))


def test_order_statistics(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(20)) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, v long")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [r["k"] for r in numbered(df, [F.col("v"), F.col("k")]).orderBy("rank").collect()] == [k for k, _ in order]
    sums = {r["k"]: r["s"] for r in running_sum(df, [F.col("k")], F.col("v"), "s").collect()}
    assert sums == {k: sum(v for _, v in rows[: k + 1]) for k, _ in rows}
    ranks = {r["k"]: r["rk"] for r in mean_ranks(df, "v", "rk").collect()}
    vs = [v for _, v in rows]
    assert all(ranks[k] == sum(x < v for x in vs) + (vs.count(v) + 1) / 2 for k, v in rows)


def test_comparisons(spark):
    between = spark.createDataFrame([(0, True), (1, False), (2, True)], "edge long, is_between boolean")
    orders = {"a": spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "step long, edge long"), "b": spark.createDataFrame([(1, 1), (2, 0), (3, 2)], "step long, edge long")}
    rows = {(r["source"], r["step"]): (r["precision"], r["recall"]) for r in stats.compare_removals(orders, between, 2).collect()}
    assert rows == {("a", 1): (1.0, 0.5), ("a", 2): (0.5, 0.5), ("b", 1): (0.0, 0.0), ("b", 2): (0.5, 0.5)}
    inc = inc_of(spark, STAR)
    swept = stats.sweep(transport.mmot_curvature, inc, {str(r): {"params": transport.TransportParams(reg=r)} for r in (0.05, 0.1)})
    assert swept.count() == 18 and swept.filter("gap < 0").count() == 0


@pytest.mark.parametrize("radius", [5, 3])
def test_transport_without_broadcast(spark, monkeypatch, radius):
    rng = random.Random(radius)
    edges = [sorted(rng.sample(range(a, a + 9), rng.randrange(2, 5))) for a in range(0, 60, 4) for _ in range(3)]
    edges += [edges[0], [200, 201], [300, 301, 302]]
    inc = spark.createDataFrame([(k, n) for k, e in enumerate(edges) for n in e], "edge long, node long")
    params = transport.TransportParams(radius=radius)
    lazy = transport.TransportParams(radius=radius, lazy_support=True)
    options = [("star", "mean"), ("clique", "max"), ("weighted_clique", "mean")]

    def found():
        curved = [{r["edge"]: r for r in transport.mmot_curvature(inc, p).collect()} for p in (params, lazy)]
        only = transport.mmot_curvature(inc, params, spark.createDataFrame([(3,), (45,)], "edge long"))
        return curved, as_dict(only.select("edge", "curvature"), "edge"), [as_dict(transport.pair_curvature(inc, *o), "edge") for o in options]

    held, some, pairs = found()
    monkeypatch.setattr(transport, "BROADCAST_BYTES", 0)
    joined, some_joined, pairs_joined = found()
    for a, b in zip(held, joined, strict=True):
        assert a.keys() == b.keys() and len(a) == len(edges)
        for k, r in a.items():
            assert (r["card"], r["n_support"], r["rounds"], r["method"]) == (b[k]["card"], b[k]["n_support"], b[k]["rounds"], b[k]["method"])
            assert b[k]["curvature"] == pytest.approx(r["curvature"], abs=1e-9, nan_ok=True)
    assert some_joined == pytest.approx(some, abs=1e-9) and set(some) == {3, 45}
    for a, b in zip(pairs, pairs_joined, strict=True):
        assert len(a) == len(edges) and b == pytest.approx(a, abs=1e-9)


def test_lone_nodes_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(transport, "BROADCAST_BYTES", 0)
    inc = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "edge long, node long")
    curved = {r["edge"]: r for r in transport.mmot_curvature(inc).collect()}
    assert curved[2]["method"] == "trivial" and curved[2]["curvature"] == 0
    with pytest.raises(Exception, match="measure isn't defined"):
        transport.mmot_curvature(inc.unionByName(spark.createDataFrame([(5, 1)], "edge long, node long"))).collect()
    assert transport.mmot_curvature(inc.limit(0)).count() == 0


def _random_sets(spark):
    rng = random.Random(5)
    edges = [sorted(rng.sample(range(1, 9), rng.choice([1, 1, 2, 2, 3, 3, 4, 6]))) for _ in range(40)]
    return inc_of(spark, edges)


def test_forman_sums_are_those_of_the_graph(spark):
    inc = _random_sets(spark)
    curved = poset.forman_graph(inc)
    sums, _, _ = poset.forman_sums(inc)
    assert as_dict(sums.select("edge", "curvature"), "edge") == as_dict(poset.forman_hyperedges(inc, curved), "edge")
    assert as_dict(poset.forman_vertices(inc), "node") == as_dict(poset.forman_vertices(inc, curved), "node")


def test_edges_without_hyperedges(spark):
    inc = _random_sets(spark)
    gone = inc.groupBy("edge").agg(F.count("*").alias("card")).filter("card in (3, 6)")
    cover = cut(poset.covers(inc))
    whole = poset.without_members(poset.poset_edges(cover), poset.triangles(cover), gone.select((2 * F.col("edge") + 1).alias("member")))
    assert sorted(map(tuple, poset.edges_without(inc, gone).collect())) == sorted(map(tuple, whole.collect()))


def test_large_supersets_are_not_copied(spark):
    inc = inc_of(spark, [range(60), range(50), range(5, 40), range(1, 60, 2)])
    found = poset.edge_containments(inc)
    assert {tuple(r)[:2] for r in found.collect()} == {(1, 0), (2, 0), (2, 1), (3, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    exploded = re.findall(r"Generate explode\(\w*nodes#\d+L?\), (\[[\d, ]+\])?", plan)
    assert exploded and all(exploded), "rows of single nodes carry the whole set"


def test_block_scores_from_a_table(spark, monkeypatch):
    inc = _random_sets(spark)
    parts = spark.createDataFrame([(n, n) for n in range(1, 9)], "node long, part long")
    sizes = dict.fromkeys(range(1, 9), 1)

    def both():
        score = clustering.BlockScores(inc, parts)
        blocks = clustering.greedy_attach(sizes, score, 5)
        merged, q = clustering.optimal_attach(blocks, score, 3)
        return score, blocks, merged, q, score(frozenset([1, 2, 3]))

    held = both()
    monkeypatch.setattr(clustering, "PATTERN_ENTRIES", 0)
    left = both()
    assert left[0].patterns == [] and left[0].table is not None
    assert left[1:3] == held[1:3] and left[3:] == pytest.approx(held[3:])


def test_h_louvain_weighs_equal_hyperedges_once(spark, monkeypatch):
    sets = []
    monkeypatch.setattr(louvain, "cut", lambda df, tag: sets.append(cut(df, tag)) or sets[-1], raising=False)
    edges = [[1, 2, 3], [2, 3], [4, 5, 6], [5, 6], [3, 4]]
    found = as_dict(louvain.h_louvain(inc_of(spark, edges * 7)), "node", "part")
    assert sets[0].count() == len(edges) and {r["weight"] for r in sets[0].collect()} == {7.0}
    weights = spark.createDataFrame([(k, 7.0) for k in range(len(edges))], "edge long, weight double")
    assert found == as_dict(louvain.h_louvain(inc_of(spark, edges), weights=weights), "node", "part")


def test_pairs_are_solved_once(spark, monkeypatch):
    inc = inc_of(spark, [[1, 2, 3], [2, 3], [3, 4], [2, 3, 4]] * 5)
    held = as_dict(transport.pair_curvature(inc), "edge")
    members = []
    monkeypatch.setattr(transport, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(transport, "_pieces", lambda pairs, member, *a, f=getattr(transport, "_pieces", None): members.append(member.count()) or f(pairs, member, *a), raising=False)
    assert as_dict(transport.pair_curvature(inc), "edge") == pytest.approx(held, abs=1e-12)
    assert members == [2 * 5]  # of 1-2, 1-3, 2-3, 2-4 and 3-4

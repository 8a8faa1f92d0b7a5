"""More registered queries: files written and read back, and measures of small hypergraphs whose results are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.functions import stats
from hyperweft.operators import blocks, dual, generators, graph, incidence, poset, transport
from hyperweft.plans import clustering
from hyperweft.plans.queries import CARDS, COVERS, DUAL, KEYS, STEP, brands, nations, query, r6, view
from hyperweft.plans.storage import cut, new_path, numbered
from hyperweft.sources import sinks, text

NUMBERED = KEYS + ", lined AS (SELECT row_number() OVER (ORDER BY edge) - 1 AS line, card, key FROM keys)"


# --- files ----------------------------------------------------------------------------------------------------------


@query("scan_hyperedges", "SELECT line AS edge, CAST(card AS INTEGER) AS card, key FROM lined", "supply", NUMBERED)
def _(s, d):
    path = new_path(s, "scan")
    edges = incidence.hyperedges(view(s, d, "supply"))
    # separators are mixed, and one node is repeated
    sinks.write_lines(edges, path, F.concat(F.regexp_replace("key", ",", F.when(F.col("edge") % 2 == 0, " ").otherwise(", ")), F.lit(" "), F.element_at("nodes", 1)), [F.col("edge")])
    return text.read_hyperedges(s, path).select("edge", "card", "key")


@query("scan_written_hypergraph", "SELECT line AS edge, CAST(card AS INTEGER) AS card, key FROM lined", "supply", NUMBERED)
def _(s, d):
    path = new_path(s, "scan")
    sinks.write_hypergraph(incidence.hyperedges(view(s, d, "supply")), path)
    return text.read_hyperedges(s, path).select("edge", "card", "key")


@query("scan_labelled_hyperedges", "SELECT row_number() OVER (ORDER BY edge) - 1 AS edge, string_agg('s' || node, '|' ORDER BY node) AS labels FROM inc GROUP BY inc.edge", "supply")
def _(s, d):
    path = new_path(s, "scan")
    names = F.array_join(F.transform("nodes", lambda x: F.concat(F.lit("s"), x)), ";")
    sinks.write_lines(incidence.hyperedges(view(s, d, "supply")), path, names, [F.col("edge")])
    return text.read_labelled_hyperedges(s, path).select("edge", F.array_join("labels", "|").alias("labels"))


@query("label_index", "SELECT CAST(node AS VARCHAR) AS label, row_number() OVER (ORDER BY node) AS node FROM (SELECT DISTINCT node FROM inc)", "supply")
def _(s, d):
    edges = incidence.hyperedges(view(s, d, "supply")).select("edge", F.col("nodes").cast("array<string>").alias("labels"))
    return text.label_index(edges)


@query("scan_nodes", "SELECT DISTINCT node FROM inc", "basket")
def _(s, d):
    path = new_path(s, "scan")
    sinks.write_lines(view(s, d, "basket").select("node").distinct(), path, F.col("node").cast("string"))
    return text.read_nodes(s, path)


@query("scan_labels", "SELECT row_number() OVER (ORDER BY p_partkey) AS node, p_brand AS label FROM part")
def _(s, d):
    path = new_path(s, "scan")
    sinks.write_lines(brands(s, d), path, F.col("label"), [F.col("node")])
    return text.read_labels(s, path)


@query("scan_node_labels", "SELECT CAST(p_partkey AS BIGINT) AS node, p_brand AS label FROM part")
def _(s, d):
    path = new_path(s, "scan")
    sinks.write_lines(brands(s, d), path, F.concat_ws(" ", "node", "label"), [F.col("node")])
    return text.read_labels(s, path)


@query("scan_removals", "SELECT row_number() OVER (ORDER BY edge) AS step, key FROM keys", "session", KEYS)
def _(s, d):
    path = new_path(s, "scan")
    inc = view(s, d, "session")
    order = numbered(inc.select("edge").distinct(), [F.col("edge")], "step")
    sinks.write_removals(order, incidence.hyperedges(inc), path)
    return text.read_removals(s, path).select("step", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("key"))


@query("scan_curvature", "SELECT key, CAST(any_value(card) AS INTEGER) AS card, count(*) / 4.0 AS value FROM keys GROUP BY key", "supply", KEYS)
def _(s, d):
    path = new_path(s, "scan")
    edges = incidence.hyperedges(view(s, d, "supply")).groupBy("key").agg((F.count("*") / 4).alias("curvature"))
    sinks.write_curvature(edges, path)
    return text.read_curvature(s, path).select("key", "card", "value")


@query("scan_node_curvature", "SELECT CAST(node AS VARCHAR) AS key, 1 AS card, CASE WHEN count(*) % 2 = 0 THEN count(*) / 2.0 END AS value FROM inc GROUP BY node", "supply")
def _(s, d):
    path = new_path(s, "scan")
    # odd degrees are written as no number
    value = F.when(F.col("degree") % 2 == 0, (F.col("degree") / 2).cast("string")).otherwise("none")
    sinks.write_curvature(incidence.degrees(view(s, d, "supply")).select("node", value.alias("curvature")), path, "node")
    return text.read_curvature(s, path).select("key", "card", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query("scan_clusters", "SELECT CAST(c_custkey AS BIGINT) AS node, c_mktsegment AS truth, CAST(c_nationkey AS VARCHAR) AS pred FROM customer")
def _(s, d):
    path = new_path(s, "scan")
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("truth"), F.col("c_nationkey").alias("pred"))
    sinks.write_clusters(rows, path)
    return text.read_clusters(s, path)


@query("scan_dual", "SELECT CAST(dual.card - 1 AS INTEGER) AS k, a.key AS n1, b.key AS n2 FROM dual JOIN keys a ON a.edge = e1 JOIN keys b ON b.edge = e2", "basket", DUAL)
def _(s, d):
    nodes, edges = _dual_files(s, d)
    return text.read_dual(s, nodes, edges)[1].select("k", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("n1", "n2")])


@query("scan_dual_nodes", "SELECT DISTINCT CAST(card - 1 AS INTEGER) AS k, key, CAST(card AS INTEGER) AS card FROM keys WHERE card > 1", "basket", KEYS)
def _(s, d):
    nodes = text.read_dual(s, _dual_files(s, d)[0])[0]
    return nodes.select("k", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("key"), "card")


@query("scan_cardinalities", "SELECT CAST(card - 1 AS INTEGER) AS k, count(DISTINCT key) AS n_rows FROM keys WHERE card > 1 GROUP BY card", "basket", KEYS)
def _(s, d):
    return text.cardinalities(s, _dual_files(s, d)[0])


def _dual_files(s, d) -> tuple[str, str]:
    path = new_path(s, "scan")
    inc = cut(incidence.with_card(view(s, d, "basket"), 2).select("edge", "node"))
    edges = incidence.hyperedges(inc)
    sinks.write_dual_nodes(edges, f"{path}/nodes")
    sinks.write_dual(dual.dual_edges(inc, 2), edges, f"{path}/edges")
    return f"{path}/nodes/k=*", f"{path}/edges/k=*"


POSET_IDS = COVERS + """, ids AS (SELECT 'v' || node AS name, 2 * node AS id FROM inc UNION SELECT 'e' || edge, 2 * edge + 1 FROM inc)"""


@query("scan_poset_edges", "SELECT a.id AS u, b.id AS v, tri FROM pt JOIN ids a ON a.name = u JOIN ids b ON b.name = v", "session", POSET_IDS)
def _(s, d):
    return _poset_files(s, d)[1]


@query("scan_poset_triangles", "SELECT a.id AS i, b.id AS j, c.id AS k FROM tri JOIN ids a ON a.name = i JOIN ids b ON b.name = j JOIN ids c ON c.name = k", "session", POSET_IDS)
def _(s, d):
    return _poset_files(s, d)[2]


@query("scan_poset_nodes", "SELECT 2 * node AS id, 1 AS card FROM inc GROUP BY node UNION ALL SELECT 2 * edge + 1, CAST(count(*) AS INTEGER) FROM inc GROUP BY edge", "session")
def _(s, d):
    return _poset_files(s, d)[0]


def _poset_files(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    path, inc = new_path(s, "scan"), cut(view(s, d, "session"))
    cover = cut(poset.covers(inc))
    nodes = inc.select(poset.vertex().alias("id"), F.lit(1).alias("card")).distinct()
    nodes = nodes.unionByName(inc.groupBy("edge").agg(F.count("*").cast("int").alias("card")).select(poset.hyperedge().alias("id"), "card"))
    sinks.write_poset(nodes, cover, cut(poset.triangles(cover)), path, "session")
    return text.read_poset(s, path, "session")


@query("scan_poset_keys", "SELECT 'e' || edge AS name, key FROM keys", "supply", KEYS)
def _(s, d):
    path = new_path(s, "scan")
    return text.read_keys(s, text.ensured(s, path, lambda p: sinks.write_keys(poset.edges_with_keys(view(s, d, "supply")), p)))


# --- graphs and removals --------------------------------------------------------------------------------------------

DEALT = "pairs AS (SELECT node AS a, (SELECT min(node) FROM inc) AS b FROM (SELECT DISTINCT node FROM inc) WHERE node % 10 = 0)"


def _pairs(inc: DataFrame) -> DataFrame:
    """Every tenth node with the smallest one: pairs of which most are different nodes."""
    return inc.select(F.col("node").alias("a")).distinct().filter("a % 10 = 0").join(F.broadcast(inc.agg(F.min("node").alias("b"))))


@query("edge_ball", "SELECT DISTINCT a, b, node FROM (SELECT a, b, a AS node FROM pairs UNION ALL SELECT a, b, b FROM pairs UNION ALL SELECT a, b, v FROM pairs JOIN step ON u = a UNION ALL SELECT a, b, v FROM pairs JOIN step ON u = b)", "basket", STEP + ", " + DEALT)
def _(s, d):
    inc = view(s, d, "basket")
    return graph.edge_ball(cut(incidence.cooccurrence(inc)), cut(_pairs(inc)), 1)


@query(
    "ring_of_pairs",
    """, near AS (SELECT a, b, v AS node, 1 AS d FROM pairs JOIN step ON u = a UNION ALL SELECT a, b, v, 1 FROM pairs JOIN step ON u = b UNION ALL SELECT a, b, a, 0 FROM pairs UNION ALL SELECT a, b, b, 0 FROM pairs),
far AS (SELECT a, b, v AS node, 2 AS d FROM near JOIN step ON u = node)
SELECT a, b, node FROM (SELECT * FROM near UNION ALL SELECT * FROM far) GROUP BY a, b, node HAVING min(d) = 2""",
    "basket",
    STEP + ", " + DEALT,
)
def _(s, d):
    edges = blocks.sets(view(s, d, "basket", dealt=True))
    inc = blocks.members(edges)
    return graph.ring_of_hyperedges(inc, _pairs(inc), 1, 2, edges)


@query("hop_distance_all", ", two AS (SELECT DISTINCT a.u, b.v FROM step a JOIN step b ON a.v = b.u) SELECT source, node, CAST(min(d) AS INTEGER) AS d FROM (SELECT node AS source, node, 0 AS d FROM inc UNION ALL SELECT u, v, 1 FROM step UNION ALL SELECT u, v, 2 FROM two) GROUP BY source, node", "trade", STEP)
def _(s, d):
    inc = view(s, d, "trade")
    return graph.hop_distances(cut(incidence.cooccurrence(inc)), inc.select(F.col("node").alias("source")).distinct(), 2)


@query("within_between_counts", "SELECT CAST(count(*) FILTER (k = 1) AS BIGINT) AS n_within, CAST(count(*) FILTER (k > 1) AS BIGINT) AS n_between FROM (SELECT edge, count(DISTINCT node % 7) AS k FROM inc GROUP BY edge)", "supply")
def _(s, d):
    return generators.within_between(view(s, d, "supply"), 7)


CURVES = """b AS (SELECT edge, count(DISTINCT s_nationkey) > 1 AS bt FROM inc JOIN supplier ON node = s_suppkey GROUP BY edge),
o AS (SELECT 'first' AS source, edge, bt, row_number() OVER (ORDER BY edge) AS step FROM b UNION ALL SELECT 'last', edge, bt, row_number() OVER (ORDER BY edge DESC) FROM b),
c AS (SELECT source, step, edge, CAST(sum(CAST(bt AS BIGINT)) OVER (PARTITION BY source ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS removed_between FROM o)"""


@query("compare_removals", "SELECT source, step, edge, removed_between, round(removed_between / step, 6) AS precision FROM c WHERE step <= 500", "supply", CURVES)
def _(s, d):
    inc = view(s, d, "supply")
    between = stats.within(stats.label_counts(inc, nations(s, d).withColumnRenamed("part", "label")), "strict").select("edge", (~F.col("within")).alias("is_between"))
    edges = cut(inc.select("edge").distinct())
    orders = {"first": numbered(edges, [F.col("edge")], "step"), "last": numbered(edges, [F.desc("edge")], "step")}
    return stats.compare_removals(orders, between, 500).select("source", "step", "edge", "removed_between", r6("precision").alias("precision"))


@query("component_sizes_after_removals", ", left_ AS (SELECT * FROM inc WHERE edge IN (SELECT edge FROM cards WHERE card = 1)) SELECT node AS part, CAST(1 AS BIGINT) AS n_nodes FROM inc GROUP BY node", "basket", CARDS)
def _(s, d):
    inc = view(s, d, "basket")
    alone = incidence.without_edges(inc, incidence.with_card(inc, 2).select("edge"))
    return clustering.component_sizes(graph.hypergraph_components(alone, inc.select("node").distinct()))


# --- small hypergraphs with known curvatures --------------------------------------------------------------------------

# A star of pairs around a hyperedge of four nodes, and its published curvatures.
STAR = [[1, 2, 3, 4], [1, 5], [1, 6], [2, 7], [2, 8], [3, 9], [3, 10], [4, 11], [4, 12]]
STAR_MMOT = "VALUES (0, 0.6631082935), " + ", ".join(f"({k}, 0.0199763360)" for k in range(1, 9))


def _star(s) -> DataFrame:
    return s.createDataFrame([(k, n) for k, e in enumerate(STAR) for n in e], "edge long, node long")


@query("star_mmot", f"SELECT CAST(edge AS BIGINT) AS edge, CAST(x AS DOUBLE) AS curvature, CASE WHEN edge = 0 THEN 4 ELSE 15 END AS rounds FROM ({STAR_MMOT}) t(edge, x)")
def _(s, d):
    return transport.mmot_curvature(_star(s)).select("edge", F.round("curvature", 10).alias("curvature"), "rounds")


@query("star_mmot_vertex", "SELECT CAST(node AS BIGINT) AS node, CASE WHEN node < 5 THEN 0.703060965 ELSE 0.019976336 END::DOUBLE AS curvature FROM range(1, 13) t(node)")
def _(s, d):
    inc = _star(s)
    return transport.mmot_vertex(inc, transport.mmot_curvature(inc)).select("node", F.round("curvature", 9).alias("curvature"))


@query("star_pairwise", "SELECT CAST(edge AS BIGINT) AS edge, CAST(0.02 AS DOUBLE) AS curvature FROM range(1, 9) t(edge)")
def _(s, d):
    return transport.pair_curvature(_star(s)).filter("edge > 0").select("edge", F.round("curvature", 10).alias("curvature"))


@query("star_refreshed", "SELECT CAST(edge AS BIGINT) AS edge, true AS agrees FROM range(1, 9) t(edge)")
def _(s, d):
    """Whether the local refresh after a removal gives what a whole computation of the rest does."""
    inc = _star(s)
    curved = cut(transport.mmot_curvature(inc).select("edge", "curvature"))
    out = cut(transport.refreshed(inc, curved, s.createDataFrame([(0,)], "edge long")))
    whole = transport.mmot_curvature(inc.filter("edge > 0")).select("edge", F.col("curvature").alias("again"))
    return out.join(whole, "edge").select("edge", (F.abs(F.col("curvature") - F.col("again")) < 1e-12).alias("agrees"))

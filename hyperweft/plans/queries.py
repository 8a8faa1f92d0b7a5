"""The registered queries over the driver's tables, each with its SQL where SQL can express it.

Hypergraphs from the tables: supply (an order's suppliers), basket (an order's parts), session (the users of an hour), and trade
(the nations an order's suppliers are in).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweft.functions import stats
from hyperweft.operators import dual, generators, graph, incidence, modularity, poset, transport
from hyperweft.plans import clustering, louvain
from hyperweft.plans.storage import cut, numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VIEWS = {
    "supply": "inc AS (SELECT DISTINCT l_orderkey AS edge, CAST(l_suppkey AS BIGINT) AS node FROM lineitem)",
    "basket": "inc AS (SELECT DISTINCT l_orderkey AS edge, CAST(l_partkey AS BIGINT) AS node FROM lineitem)",
    "session": "inc AS (SELECT DISTINCT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS edge, CAST(user_id AS BIGINT) AS node FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)",
    "trade": "inc AS (SELECT DISTINCT l_orderkey AS edge, CAST(s_nationkey AS BIGINT) AS node FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)",
}
CARDS = "cards AS (SELECT edge, count(*) AS card FROM inc GROUP BY edge), ic AS (SELECT edge, node, card FROM inc JOIN cards USING (edge))"
KEYS = "keys AS (SELECT edge, count(*) AS card, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS key FROM inc GROUP BY edge)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def view(spark: SparkSession, d: str, name: str, dealt: bool = False) -> DataFrame:
    """dealt: by hyperedge already, so that grouping by it takes no other shuffle (of supply and basket)."""
    if name == "session":
        return incidence.incidence_of(table(spark, d, "events"), F.date_trunc("hour", "ts").cast("timestamp").cast("long"), "user_id")
    lines = table(spark, d, "lineitem")
    if name == "trade":
        nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        return incidence.incidence_of(lines.join(nations, "l_suppkey"), "l_orderkey", "s_nationkey")
    return incidence.incidence_of(lines.repartition("l_orderkey") if dealt else lines, "l_orderkey", "l_suppkey" if name == "supply" else "l_partkey")


def query(name: str, sql: str | None = None, on: str | None = None, extra: str = ""):
    """Register a query; its SQL is prefixed by the view it is on and by more common table expressions."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            parts = ([VIEWS[on]] if on else []) + ([extra] if extra else [])
            ORACLE_SQL[name] = (("WITH RECURSIVE " + ", ".join(parts) + " ") if parts else "") + sql
        return f

    return add


def r6(c) -> F.Column:
    """Rounded to six places; NaN and null are null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.when(~F.isnan(c), c), 6)


def r12(c: str) -> F.Column:
    """A number from 0 to 1 rounded to twelve places, as SQL rounds it: a decimal for each of very many rows would take longer than all else."""
    return F.floor(F.col(c) * 1e12 + 0.5) / F.lit(1e12)


# --- incidences ---------------------------------------------------------------------------------------------------


@query("incidence_degree", "SELECT node, count(*) AS degree FROM inc GROUP BY node", "basket")
def _(s, d):
    return incidence.degrees(view(s, d, "basket"))


@query("hypergraph_totals", "SELECT count(DISTINCT edge) AS n_edges, count(DISTINCT node) AS n_nodes, count(*) AS volume FROM inc", "basket")
def _(s, d):
    return incidence.totals(view(s, d, "basket"))


@query("cardinality_histogram", "SELECT CAST(card AS INTEGER) AS card, count(*) AS n_edges FROM cards GROUP BY card", "basket", CARDS)
def _(s, d):
    return incidence.card_histogram(view(s, d, "basket"))


@query("cardinality_distribution", "SELECT CAST(k AS INTEGER) AS card, round(coalesce(n, 0) / (SELECT count(*) FROM cards), 6) AS share FROM range(0, 11) t(k) LEFT JOIN (SELECT card, count(*) AS n FROM cards GROUP BY card) ON card = k", "basket", CARDS)
def _(s, d):
    return incidence.cardinality_distribution(view(s, d, "basket"), 10).select("card", r6("share").alias("share"))


@query("hyperedge_keys", "SELECT edge, CAST(card AS INTEGER) AS card, key FROM keys", "supply", KEYS)
def _(s, d):
    return incidence.hyperedges(view(s, d, "supply")).select("edge", "card", "key")


@query("inverse_incidence", "SELECT node, string_agg(CAST(edge AS VARCHAR), ',' ORDER BY edge) AS edges FROM inc GROUP BY node", "basket")
def _(s, d):
    return incidence.node_index(view(s, d, "basket")).select("node", F.array_join(F.col("edges").cast("array<string>"), ",").alias("edges"))


@query("edge_key_lookup", "SELECT DISTINCT key, max(edge) OVER (PARTITION BY key) AS edge FROM keys", "supply", KEYS)
def _(s, d):
    e = incidence.hyperedges(view(s, d, "supply"))
    return incidence.lookup(e, e.select("key").distinct())


@query("deduplicated_edges", "SELECT min(edge) AS edge, key FROM keys GROUP BY key", "supply", KEYS)
def _(s, d):
    return incidence.deduplicated(incidence.hyperedges(view(s, d, "supply"))).select("edge", "key")


@query("duplicate_stats", "SELECT count(*) AS n_edges, count(DISTINCT key) AS n_distinct, count(*) - count(DISTINCT key) AS n_duplicates FROM keys", "supply", KEYS)
def _(s, d):
    return incidence.duplicate_stats(incidence.hyperedges(view(s, d, "supply")))


@query("clique_cooccurrence", "SELECT a.node AS u, b.node AS v, count(*) AS w FROM inc a JOIN inc b ON a.edge = b.edge AND a.node < b.node GROUP BY ALL", "basket")
def _(s, d):
    return incidence.cooccurrence(view(s, d, "basket"))


@query("two_section_weights", "SELECT a.node AS u, b.node AS v, round(sum(1.0 / (a.card - 1)), 6) AS w FROM ic a JOIN ic b ON a.edge = b.edge AND a.node < b.node GROUP BY ALL", "basket", CARDS)
def _(s, d):
    return incidence.two_section(view(s, d, "basket")).select("u", "v", r6("w").alias("w"))


@query("shared_pair_edges", "SELECT count(DISTINCT edge) AS n_edges FROM (SELECT a.edge, count(*) OVER (PARTITION BY a.node, b.node) AS n FROM inc a JOIN inc b ON a.edge = b.edge AND a.node < b.node) WHERE n > 1", "basket")
def _(s, d):
    return incidence.shared_pair_edges(view(s, d, "basket"))


@query("dense_node_ids", "SELECT node, row_number() OVER (ORDER BY node) AS dense_id FROM (SELECT DISTINCT node FROM inc)", "basket")
def _(s, d):
    return numbered(view(s, d, "basket").select("node").distinct(), [F.col("node")], "dense_id").select("node", "dense_id")


@query("edges_removed", "SELECT node, count(*) AS degree FROM inc WHERE edge NOT IN (SELECT edge FROM cards WHERE card >= 5) GROUP BY node", "basket", CARDS)
def _(s, d):
    inc = view(s, d, "basket")
    return incidence.degrees(incidence.without_edges(inc, incidence.with_card(inc, 5).select("edge")))


@query("generated_nodes", "SELECT CAST(k AS BIGINT) AS node FROM range(1, (SELECT max(node) + 1 FROM inc)) t(k)", "supply")
def _(s, d):
    return incidence.generated_nodes(view(s, d, "supply"))


@query("node_collapse", "SELECT CAST(s_nationkey AS BIGINT) AS part, edge, count(*) AS mult FROM inc JOIN supplier ON node = s_suppkey GROUP BY ALL", "supply")
def _(s, d):
    return modularity.collapsed(view(s, d, "supply"), nations(s, d))


def nations(s, d) -> DataFrame:
    """(node, part): suppliers by nation."""
    return table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("node"), F.col("s_nationkey").cast("long").alias("part"))


def brands(s, d) -> DataFrame:
    """(node, label): parts by brand."""
    return table(s, d, "part").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_brand").alias("label"))


# --- poset and Forman ---------------------------------------------------------------------------------------------

CONTAINS = CARDS + """, sub AS (
  SELECT a.edge AS low, b.edge AS high, a.card AS low_card, b.card AS high_card FROM ic a JOIN ic b ON a.node = b.node AND a.card < b.card
  GROUP BY ALL HAVING count(*) = a.card),
contained AS (SELECT 'v' || node AS low, 'e' || edge AS high FROM ic WHERE card > 1 UNION ALL SELECT 'e' || low, 'e' || high FROM sub)"""
COVERS = CONTAINS + """, proper AS MATERIALIZED (SELECT low, high FROM sub WHERE low_card > 1),
pcov AS MATERIALIZED (SELECT low, high FROM proper EXCEPT SELECT a.low, b.high FROM proper a JOIN proper b ON a.high = b.low),
held AS (SELECT node, high AS edge FROM pcov JOIN inc ON inc.edge = pcov.low),
free AS MATERIALIZED (SELECT node, edge FROM ic WHERE card > 1 EXCEPT SELECT node, edge FROM held),
covers AS MATERIALIZED (SELECT 'e' || low AS low, 'e' || high AS high FROM pcov UNION ALL SELECT 'v' || node, 'e' || edge FROM free
  UNION ALL SELECT 'e' || s.edge, 'e' || free.edge FROM free JOIN (SELECT edge, node FROM ic WHERE card = 1) s ON s.node = free.node),
tri AS (SELECT a.low AS i, a.high AS j, b.high AS k FROM covers a JOIN covers b ON a.high = b.low),
pe AS (SELECT low AS u, high AS v FROM covers UNION SELECT i, k FROM tri),
sides AS (SELECT i AS u, j AS v FROM tri UNION ALL SELECT j, k FROM tri UNION ALL SELECT i, k FROM tri),
tc AS (SELECT u, v, count(*) AS tri FROM sides GROUP BY ALL),
pt AS (SELECT pe.u, pe.v, coalesce(tri, 0) AS tri FROM pe LEFT JOIN tc ON pe.u = tc.u AND pe.v = tc.v)"""
FORMAN = COVERS + """, deg AS (SELECT n, count(*) AS deg FROM (SELECT u AS n FROM pt UNION ALL SELECT v FROM pt) GROUP BY n),
fe AS (SELECT u, v, 4 - a.deg - b.deg + 3 * tri AS f FROM pt JOIN deg a ON u = a.n JOIN deg b ON v = b.n),
fn AS (SELECT n, CAST(sum(f) AS BIGINT) AS f FROM (SELECT u AS n, f FROM fe UNION ALL SELECT v, f FROM fe) GROUP BY n)"""


@query("poset_contains", "SELECT low, high, CAST(low_card AS INTEGER) AS low_card, CAST(high_card AS INTEGER) AS high_card FROM sub", "supply", CONTAINS)
def _(s, d):
    return poset.edge_containments(view(s, d, "supply"))


@query("poset_covers", "SELECT low, high FROM covers", "supply", COVERS)
def _(s, d):
    return poset.named(poset.covers(view(s, d, "supply")), "low", "high")


@query("poset_triangles", "SELECT i, j, k FROM tri", "supply", COVERS)
def _(s, d):
    return poset.named(poset.triangles(cut(poset.covers(view(s, d, "supply")))), "i", "j", "k")


@query("poset_edges", "SELECT u, v, tri FROM pt", "supply", COVERS)
def _(s, d):
    return poset.named(poset.poset_edges(poset.covers(view(s, d, "supply"))), "u", "v")


@query("forman_edge", "SELECT u, v, CAST(f AS BIGINT) AS curvature FROM fe", "supply", FORMAN)
def _(s, d):
    return poset.named(poset.forman_graph(view(s, d, "supply")), "u", "v")


@query("forman_hyperedge", "SELECT edge, coalesce(f, 0) AS curvature FROM cards LEFT JOIN fn ON n = 'e' || edge WHERE card > 1", "supply", FORMAN)
def _(s, d):
    return poset.forman_hyperedges(view(s, d, "supply"))


@query("forman_vertex", "SELECT node, CAST(coalesce(sum(fn.f), 0) AS BIGINT) AS curvature FROM (SELECT DISTINCT node FROM inc) LEFT JOIN fe ON u = 'v' || node LEFT JOIN fn ON v = n GROUP BY node", "supply", FORMAN)
def _(s, d):
    return poset.forman_vertices(view(s, d, "supply"))


@query(
    "poset_without_large",
    """, gone AS (SELECT 'e' || edge AS name FROM cards WHERE card >= 6),
left_tri AS (SELECT * FROM tri WHERE i NOT IN (SELECT name FROM gone) AND j NOT IN (SELECT name FROM gone) AND k NOT IN (SELECT name FROM gone)),
ls AS (SELECT u, v, count(*) AS tri FROM (SELECT i AS u, j AS v FROM left_tri UNION ALL SELECT j, k FROM left_tri UNION ALL SELECT i, k FROM left_tri) GROUP BY ALL)
SELECT pt.u, pt.v, coalesce(ls.tri, 0) AS tri FROM pt LEFT JOIN ls ON pt.u = ls.u AND pt.v = ls.v WHERE pt.u NOT IN (SELECT name FROM gone) AND pt.v NOT IN (SELECT name FROM gone)""",
    "supply",
    COVERS,
)
def _(s, d):
    inc = view(s, d, "supply")
    large = inc.groupBy("edge").agg(F.count("*").alias("card")).filter("card >= 6")
    return poset.named(poset.edges_without(inc, large), "u", "v")


# --- dual networks ------------------------------------------------------------------------------------------------

DUAL = KEYS + """, firsts AS (SELECT min(edge) AS edge, any_value(card) AS card FROM keys GROUP BY key),
fi AS (SELECT f.edge, f.card, node FROM firsts f JOIN inc USING (edge) WHERE card >= 2),
dual AS (SELECT a.card, a.edge AS e1, b.edge AS e2, string_agg(CAST(a.node AS VARCHAR), ',' ORDER BY a.node) AS shared_key
  FROM fi a JOIN fi b ON a.node = b.node AND a.card = b.card AND a.edge < b.edge GROUP BY a.card, a.edge, b.edge HAVING count(*) = a.card - 1)"""


@query("dual_edges", "SELECT CAST(card AS INTEGER) AS card, e1, e2, shared_key FROM dual", "basket", DUAL)
def _(s, d):
    return dual.dual_edges(view(s, d, "basket"), 2)


@query("dual_dependent", "SELECT e1, e2, shared FROM dual LEFT JOIN (SELECT key, max(edge) AS shared FROM keys GROUP BY key) ON key = shared_key", "basket", DUAL)
def _(s, d):
    inc = view(s, d, "basket")
    return dual.dependent_nodes(inc, dual.dual_edges(inc, 2))


@query("dual_degree", "SELECT CAST(card AS INTEGER) AS card, edge, count(*) AS degree FROM (SELECT card, e1 AS edge FROM dual UNION ALL SELECT card, e2 FROM dual) GROUP BY ALL", "basket", DUAL)
def _(s, d):
    return dual.dual_degrees(dual.dual_edges(view(s, d, "basket"), 2))


@query("dual_sums_hyperedge", "SELECT c.edge, CAST(sum(x) AS BIGINT) AS total FROM cards c LEFT JOIN (SELECT e1 AS edge, card AS x FROM dual UNION ALL SELECT e2, card FROM dual) p ON c.edge = p.edge GROUP BY c.edge", "basket", CARDS + ", " + DUAL)
def _(s, d):
    inc = view(s, d, "basket")
    marked = dual.dual_edges(inc, 2).select("e1", "e2", F.col("card").cast("double").alias("curvature"))
    return dual.by_hyperedge(marked, inc.select("edge").distinct()).select("edge", F.when(~F.isnan("curvature"), F.col("curvature").cast("long")).alias("total"))


@query("dual_sums_vertex", "SELECT node, CAST(sum(x) AS BIGINT) AS total FROM inc LEFT JOIN (SELECT e1 AS edge, card AS x FROM dual UNION ALL SELECT e2, card FROM dual) p ON inc.edge = p.edge GROUP BY node", "basket", DUAL)
def _(s, d):
    inc = view(s, d, "basket")
    marked = dual.dual_edges(inc, 2).select("e1", "e2", F.col("card").cast("double").alias("curvature"))
    sums = dual.by_vertex(inc, dual.by_hyperedge(marked, inc.select("edge").distinct()))
    return sums.select("node", F.when(~F.isnan("curvature"), F.col("curvature").cast("long")).alias("total"))


@query("dual_orc_curvature")
def _(s, d):
    return transport.dual_curvature(cut(dual.dual_edges(view(s, d, "basket"), 2)))


@query("dual_orc_hyperedge")
def _(s, d):
    inc = view(s, d, "basket")
    return dual.by_hyperedge(transport.dual_curvature(cut(dual.dual_edges(inc, 2))), inc.select("edge").distinct())


# --- transport ----------------------------------------------------------------------------------------------------


@query(
    "node_measure",
    """SELECT src, dst, round(sum(mass), 12) AS mass FROM (
  SELECT a.node AS src, b.node AS dst, 0.99 / deg / (a.card - 1) AS mass FROM ic a JOIN ic b ON a.edge = b.edge AND a.node <> b.node JOIN deg ON deg.node = a.node
  UNION ALL SELECT node, node, 0.01 FROM deg
  UNION ALL SELECT ic.node, ic.node, 0.99 / deg FROM ic JOIN deg USING (node) WHERE card = 1) GROUP BY src, dst""",
    "session",
    CARDS + ", deg AS (SELECT node, count(*) AS deg FROM inc GROUP BY node)",
)
def _(s, d):
    return transport.node_measure(view(s, d, "session")).select("src", "dst", r12("mass").alias("mass"))


@query(
    "mmot_support",
    """, step AS (SELECT DISTINCT a.node AS u, b.node AS v FROM inc a JOIN inc b ON a.edge = b.edge AND a.node <> b.node),
reach AS (SELECT u, v FROM step UNION SELECT a.u, b.v FROM step a JOIN step b ON a.v = b.u UNION SELECT node, node FROM inc),
near AS (SELECT edge, v AS node FROM inc JOIN reach ON inc.node = reach.u GROUP BY edge, v HAVING count(*) >= 2)
SELECT edge, node FROM inc UNION SELECT edge, node FROM near UNION SELECT edge, step.v FROM inc JOIN step ON inc.node = step.u""",
    "trade",
    "one AS (SELECT 1)",
)
def _(s, d):
    inc = view(s, d, "trade")
    return transport.supports(inc, transport.node_measure(inc))


@query("mmot_curvature")
def _(s, d):
    inc = incidence.with_card(view(s, d, "trade"), 2).select("edge", "node")
    return transport.mmot_curvature(inc).select("edge", "card", "n_support", "rounds", "curvature", "method")


@query("mmot_vertex")
def _(s, d):
    inc = incidence.with_card(view(s, d, "trade"), 2).select("edge", "node")
    return transport.mmot_vertex(inc, transport.mmot_curvature(inc))


@query("orchid_curvature")
def _(s, d):
    inc = incidence.with_card(view(s, d, "trade"), 2).select("edge", "node")
    return transport.pair_curvature(inc)


@query("random_score", "SELECT DISTINCT edge, md5(edge || '/1') AS score FROM inc", "basket")
def _(s, d):
    return transport.random_scores(view(s, d, "basket"))


# --- graphs -------------------------------------------------------------------------------------------------------

STEP = "step AS (SELECT DISTINCT a.node AS u, b.node AS v FROM inc a JOIN inc b ON a.edge = b.edge AND a.node <> b.node)"
HOPS = "hops AS (SELECT (SELECT min(node) FROM inc) AS source, (SELECT min(node) FROM inc) AS node, 0 AS d UNION SELECT source, v, d + 1 FROM hops JOIN step ON node = u WHERE d < 3), dist AS (SELECT source, node, CAST(min(d) AS INTEGER) AS d FROM hops GROUP BY source, node)"


def _first(inc: DataFrame) -> DataFrame:
    return inc.agg(F.min("node").alias("source"))


@query("hop_distance", "SELECT source, node, d FROM dist", "basket", STEP + ", " + HOPS)
def _(s, d):
    inc = view(s, d, "basket")
    return graph.hop_distances(cut(incidence.cooccurrence(inc)), _first(inc), 3)


@query("khop_ball", "SELECT source, node FROM dist WHERE d <= 2", "basket", STEP + ", " + HOPS)
def _(s, d):
    inc = view(s, d, "basket")
    return graph.ball(cut(incidence.cooccurrence(inc)), _first(inc), 2)


@query("ring_a_b", "SELECT source AS a, source AS b, node FROM dist WHERE d > 1 AND d <= 3", "basket", STEP + ", " + HOPS)
def _(s, d):
    inc = view(s, d, "basket")
    return graph.ring(cut(incidence.cooccurrence(inc)), _first(inc).select(F.col("source").alias("a"), F.col("source").alias("b")), 1, 3)


LINKS = "big AS (SELECT c_custkey AS edge, o_orderkey AS node FROM customer JOIN orders ON c_custkey = o_custkey), inc AS (SELECT DISTINCT edge, node FROM big)"


@query("components", "SELECT node, min(node) OVER (PARTITION BY edge) AS part FROM inc", None, LINKS)
def _(s, d):
    inc = incidence.incidence_of(table(s, d, "orders").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"), "o_custkey", "o_orderkey")
    return graph.hypergraph_components(inc)


ALL_ONE = "seen AS (SELECT min(node) AS node FROM inc UNION SELECT v FROM seen JOIN step ON seen.node = step.u)"


@query("component_stop_rule", "SELECT (1.0 * (SELECT count(*) FROM seen) / (SELECT count(DISTINCT node) FROM inc)) < 0.6 AS stop", "trade", STEP + ", " + ALL_ONE)
def _(s, d):
    return clustering.should_stop(clustering.component_sizes(graph.hypergraph_components(view(s, d, "trade"))), 2)


# --- modularity ---------------------------------------------------------------------------------------------------


def _weight_sql(tau: float | None) -> str:
    return "CASE WHEN c = d THEN 1.0 ELSE 0 END" if tau is None else f"CASE WHEN 2 * c > d THEN pow(1.0 * c / d, {tau}) ELSE 0 END"


def _modularity_sql(tau: float | None, resolution: float = 1.0) -> str:
    w = _weight_sql(tau)
    return f""", e AS (SELECT * FROM ic WHERE card >= 2), m AS (SELECT count(DISTINCT edge) AS m, count(*) AS total FROM e),
hist AS (SELECT card AS d, count(DISTINCT edge) AS n FROM e GROUP BY card),
mem AS (SELECT e.edge, e.card AS d, CAST(s_nationkey AS BIGINT) AS part FROM e JOIN supplier ON node = s_suppkey),
obs AS (SELECT part, sum({w}) AS o FROM (SELECT edge, d, part, count(*) AS c FROM mem GROUP BY ALL) GROUP BY part),
vol AS (SELECT part, 1.0 * count(*) / (SELECT total FROM m) AS p FROM mem GROUP BY part),
terms AS (SELECT d, c, n * exp(lgamma(d + 1) - lgamma(c + 1) - lgamma(d - c + 1)) * ({w}) AS f FROM hist, range(1, 100) t(c) WHERE c <= d),
ex AS (SELECT part, sum(f * pow(p, c) * pow(1 - p, d - c)) AS x FROM vol, terms GROUP BY part),
contrib AS (SELECT part, o / m AS observed, x / m AS expected, o / m - {resolution} * x / m AS q FROM obs JOIN ex USING (part), m)"""


def _modularity(name: str, tau: float, resolution: float = 1.0):
    sql_tau = None if tau == float("inf") else tau

    @query(name, "SELECT round(sum(q), 6) AS q FROM contrib", "supply", CARDS + _modularity_sql(sql_tau, resolution))
    def _(s, d):
        return modularity.modularity(view(s, d, "supply"), nations(s, d), tau, resolution).select(r6("q").alias("q"))


for _name, _tau in modularity.TAU.items():
    _modularity(f"modularity_{_name}", _tau)
_modularity("h_modularity_tau_resolution", 3.0, 0.7)


@query("cluster_contribution", "SELECT part, round(observed, 6) AS observed, round(expected, 6) AS expected, round(q, 6) AS q FROM contrib", "supply", CARDS + _modularity_sql(1.0))
def _(s, d):
    return modularity.contributions(view(s, d, "supply"), nations(s, d)).select("part", *[r6(c).alias(c) for c in ("observed", "expected", "q")])


@query("part_scores", "SELECT part, n_nodes, round(q, 6) AS q FROM contrib JOIN (SELECT CAST(s_nationkey AS BIGINT) AS part, count(*) AS n_nodes FROM supplier GROUP BY ALL) USING (part)", "supply", CARDS + _modularity_sql(1.0))
def _(s, d):
    return modularity.part_scores(view(s, d, "supply"), nations(s, d)).select("part", "n_nodes", r6("q").alias("q"))


TWO = """, w2 AS (SELECT a.node AS u, b.node AS v, sum(1.0 / (a.card - 1)) AS w FROM ic a JOIN ic b ON a.edge = b.edge AND a.node < b.node GROUP BY ALL),
lab AS (SELECT CAST(s_suppkey AS BIGINT) AS node, s_nationkey AS part FROM supplier),
tot AS (SELECT sum(w) AS m FROM w2),
vol2 AS (SELECT part, sum(w) AS vol FROM (SELECT part, w FROM w2 JOIN lab ON u = node UNION ALL SELECT part, w FROM w2 JOIN lab ON v = node) GROUP BY part),
flat AS (SELECT coalesce((SELECT sum(w) FROM w2 JOIN lab a ON u = a.node JOIN lab b ON v = b.node WHERE a.part = b.part), 0) / m - (SELECT sum(pow(vol / (2 * m), 2)) FROM vol2, tot) AS q FROM tot)"""


@query("two_section_modularity", "SELECT round(q, 6) AS q FROM flat", "supply", CARDS + TWO)
def _(s, d):
    return modularity.graph_modularity(incidence.two_section(view(s, d, "supply")), nations(s, d)).select(r6("q").alias("q"))


@query("combined_modularity", "SELECT round(0.4 * (SELECT q FROM flat) + 0.6 * (SELECT sum(q) FROM contrib), 6) AS q", "supply", CARDS + TWO + _modularity_sql(1.0))
def _(s, d):
    return modularity.combined_modularity(view(s, d, "supply"), nations(s, d), 0.6).select(r6("q").alias("q"))


# --- clustering ---------------------------------------------------------------------------------------------------


@query("removal_order_forman", "SELECT row_number() OVER (ORDER BY coalesce(f, 0), edge) AS step, edge FROM cards LEFT JOIN fn ON n = 'e' || edge WHERE card > 1", "supply", FORMAN)
def _(s, d):
    return clustering.removal_order(poset.forman_hyperedges(view(s, d, "supply")), "curvature")


@query("removal_order_random", "SELECT row_number() OVER (ORDER BY score, edge) AS step, edge FROM (SELECT DISTINCT edge, md5(edge || '/1') AS score FROM inc)", "session")
def _(s, d):
    return clustering.removal_order(transport.random_scores(view(s, d, "session")))


@query("cluster_random")
def _(s, d):
    return clustering.cluster_static(cut(view(s, d, "session")), cut(transport.random_scores(view(s, d, "session"))))[0]


@query("cluster_forman")
def _(s, d):
    inc = cut(view(s, d, "session"))
    return clustering.cluster_static(inc, cut(poset.forman_hyperedges(inc).withColumnRenamed("curvature", "score")))[0]


@query("targeted_removals")
def _(s, d):
    inc = cut(view(s, d, "session"))
    order = clustering.targeted_order(transport.random_scores(inc), inc, [0.0, 0.0, *[0.02] * 40])
    return s.createDataFrame(list(enumerate(order, 1)), "step long, edge long")


def _nation_blocks(s, d):
    inc, parts = view(s, d, "supply"), nations(s, d)
    sizes = {r["part"]: r["n_nodes"] for r in clustering.component_sizes(parts).collect()}
    score = clustering.BlockScores(inc, parts)
    return sizes, score, clustering.greedy_attach(sizes, score, min(6, len(sizes)))


@query("greedy_attach")
def _(s, d):
    blocks = _nation_blocks(s, d)[2]
    return s.createDataFrame([(int(p), k) for k, b in enumerate(blocks) for p in sorted(b)], "part long, cluster int")


@query("optimal_attach")
def _(s, d):
    _, score, blocks = _nation_blocks(s, d)
    merged, q = clustering.optimal_attach(blocks, score, min(3, len(blocks)))
    return s.createDataFrame([(int(p), k, float(q)) for k, b in enumerate(merged) for p in sorted(b)], "part long, cluster int, q double")


@query("h_louvain")
def _(s, d):
    return louvain.h_louvain(view(s, d, "trade"))


# --- generators ---------------------------------------------------------------------------------------------------


@query("random_hypergraph")
def _(s, d):
    return generators.random_hypergraph(s, 1000, {2: 1025, 3: 1003})


@query("hsbm")
def _(s, d):
    return generators.uniform_hsbm(s, 300, 3, 3, 0.0012, 0.00005)


@query("block_hypergraph")
def _(s, d):
    return generators.block_hypergraph(s, 200, 4, 240)


@query("small_world_hypergraph")
def _(s, d):
    return generators.small_world(s, 500, 3, 0.1)


# --- statistics ---------------------------------------------------------------------------------------------------

LAB = "lab AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b FROM customer)"


def _labels(s, d) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_mktsegment").alias("a"), (F.col("c_nationkey") % 5).alias("b"))


@query("contingency", "SELECT a, CAST(b AS BIGINT) AS b, count(*) AS n FROM lab GROUP BY a, b", None, LAB)
def _(s, d):
    return stats.contingency(_labels(s, d), "a", "b").select("a", F.col("b").cast("long").alias("b"), "n")


@query("contingency_matrix", "SELECT a, c_0, c_1, c_2, c_3, c_4, c_0 + c_1 + c_2 + c_3 + c_4 AS total FROM (SELECT coalesce(a, 'total') AS a, count(*) FILTER (b = 0) AS c_0, count(*) FILTER (b = 1) AS c_1, count(*) FILTER (b = 2) AS c_2, count(*) FILTER (b = 3) AS c_3, count(*) FILTER (b = 4) AS c_4 FROM lab GROUP BY GROUPING SETS ((a), ()))", None, LAB)
def _(s, d):
    out = stats.crosstab(_labels(s, d), "a", "b", [0, 1, 2, 3, 4])
    return out.select("a", *[F.col(c).cast("long").alias(c) for c in out.columns[1:]])


AGREE = LAB + """, c AS (SELECT a, b, count(*) AS n FROM lab GROUP BY a, b), ra AS (SELECT a, sum(n) AS n, max(n) AS t FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS n, max(n) AS t FROM c GROUP BY b),
s AS (SELECT CAST((SELECT sum(n) FROM c) AS DOUBLE) AS n, (SELECT sum(n * ln(n)) FROM c) AS xx, (SELECT sum(n * ln(n)) FROM ra) AS xa, (SELECT sum(n * ln(n)) FROM rb) AS xb,
  (SELECT sum(n * (n - 1) / 2.0) FROM c) AS pp, (SELECT sum(n * (n - 1) / 2.0) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2.0) FROM rb) AS pb, (SELECT sum(t) FROM ra) AS ta, (SELECT sum(t) FROM rb) AS tb),
h AS (SELECT *, ln(n) - xa / n AS ha, ln(n) - xb / n AS hb, ln(n) - xa / n - xb / n + xx / n AS i FROM s)"""


@query("nmi_ari", "SELECT round(i / ((ha + hb) / 2), 6) AS nmi, round((pp - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari FROM h", None, AGREE)
def _(s, d):
    return stats.partition_agreement(_labels(s, d), "a", "b").select(r6("nmi").alias("nmi"), r6("ari").alias("ari"))


@query("purity_vmeasure", "SELECT round(ta / n, 6) AS purity, round(tb / n, 6) AS inverse_purity, round(i / hb, 6) AS homogeneity, round(i / ha, 6) AS completeness, round(2 * (i / hb) * (i / ha) / (i / hb + i / ha), 6) AS v_measure FROM h", None, AGREE)
def _(s, d):
    names = ("purity", "inverse_purity", "homogeneity", "completeness", "v_measure")
    return stats.partition_agreement(_labels(s, d), "a", "b").select(*[r6(c).alias(c) for c in names])


ORD = "o AS (SELECT o_orderkey AS key, CAST(o_totalprice AS DOUBLE) AS a, CAST(n AS DOUBLE) AS b, CAST(n AS INTEGER) AS card, o_orderpriority AS grp FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"


def _orders(s, d) -> DataFrame:
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(s, d, "orders").join(n, "o_orderkey").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("double").alias("a"), F.col("n").cast("double").alias("b"), F.col("n").cast("int").alias("card"), F.col("o_orderpriority").alias("grp"))


@query("pearson_pooled", "SELECT count(*) AS n, round(corr(a, b), 6) AS pearson FROM o", None, ORD)
def _(s, d):
    return stats.correlation(_orders(s, d), "a", "b").select("n", r6("pearson").alias("pearson"))


RANKED = ORD + ", rk AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM o)"


@query("spearman_pooled", "SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM rk", None, RANKED)
def _(s, d):
    return stats.correlation(_orders(s, d), "a", "b").select("n", r6("spearman").alias("spearman"))


STRATA = ORD + ", st AS (SELECT grp, count(*) AS n, corr(a, b) AS pearson, corr(ra, rb) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY grp ORDER BY a) + (count(*) OVER (PARTITION BY grp, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY grp ORDER BY b) + (count(*) OVER (PARTITION BY grp, b) - 1) / 2.0 AS rb FROM o) GROUP BY grp)"


@query("corr_stratified", "SELECT grp, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM st", None, STRATA)
def _(s, d):
    return stats.correlation(_orders(s, d), "a", "b", ["grp"]).select("grp", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@query("corr_weighted", "SELECT round(sum(pearson * n) / sum(n), 6) AS pearson FROM st", None, STRATA)
def _(s, d):
    return stats.weighted_mean(stats.correlation(_orders(s, d), "a", "b", ["grp"]), "pearson").select(r6("pearson").alias("pearson"))


@query("corr_matrix", "SELECT 'a' AS a, 'b' AS b, count(*) AS n, round(corr(a, b), 6) AS pearson FROM o UNION ALL SELECT 'a', 'card', count(*), round(corr(a, card), 6) FROM o UNION ALL SELECT 'b', 'card', count(*), round(corr(b, card), 6) FROM o", None, ORD)
def _(s, d):
    return stats.correlation_matrix(_orders(s, d), ["a", "b", "card"]).select("a", "b", "n", r6("pearson").alias("pearson"))


@query("corr_summary", "SELECT 'pooled' AS scope, count(*) AS n, round(corr(a, b), 6) AS pearson FROM o UNION ALL SELECT 'card ' || grp, n, round(pearson, 6) FROM st UNION ALL SELECT 'weighted', CAST(sum(n) AS BIGINT), round(sum(pearson * n) / sum(n), 6) FROM st", None, STRATA)
def _(s, d):
    return stats.correlation_summary(_orders(s, d), "a", "b", "grp").select("scope", "n", r6("pearson").alias("pearson"))


@query("corr_vs_cardinality", "SELECT count(*) AS n, round(corr(f, card), 6) AS pearson FROM (SELECT coalesce(f, 0) AS f, card FROM cards LEFT JOIN fn ON n = 'e' || edge WHERE card > 1)", "supply", FORMAN)
def _(s, d):
    return stats.correlation(cut(poset.forman_sums(view(s, d, "supply"))[0]), "curvature", "card", ranks=False).select("n", r6("pearson").alias("pearson"))


MWU = """, g AS (SELECT {by} a AS v, grp IN ('1-URGENT', '2-HIGH') AS g FROM o), r AS (SELECT *, rank() OVER ({part} ORDER BY v) + (count(*) OVER (PARTITION BY {by} v) - 1) / 2.0 AS rk FROM g),
u AS (SELECT {by} count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(rk) FILTER (g) AS s1 FROM r {group})"""


@query("mannwhitney", "SELECT n1, n2, round(s1 - n1 * (n1 + 1) / 2.0, 6) AS u, round(2 * (s1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 6) AS r FROM u", None, ORD + MWU.format(by="", part="", group=""))
def _(s, d):
    o = _orders(s, d).withColumn("g", F.col("grp").isin("1-URGENT", "2-HIGH"))
    return stats.mann_whitney(o, "a", "g").select("n1", "n2", r6("u").alias("u"), r6("r").alias("r"))


@query("mannwhitney_by_card", "SELECT card, n1, n2, CASE WHEN n1 >= 3 AND n2 >= 3 THEN round(s1 - n1 * (n1 + 1) / 2.0, 6) END AS u, CASE WHEN n1 >= 3 AND n2 >= 3 THEN round(2 * (s1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 6) END AS r FROM u", None, ORD + MWU.format(by="card,", part="PARTITION BY card", group="GROUP BY card"))
def _(s, d):
    o = _orders(s, d).withColumn("g", F.col("grp").isin("1-URGENT", "2-HIGH"))
    return stats.mann_whitney(o, "a", "g", ["card"]).select("card", "n1", "n2", r6("u").alias("u"), r6("r").alias("r"))


@query("mannwhitney_p")
def _(s, d):
    o = _orders(s, d).withColumn("g", F.col("grp").isin("1-URGENT", "2-HIGH"))
    return stats.holm(stats.mann_whitney(o, "a", "g", ["card"]).withColumnRenamed("card", "key"))


@query("holm_adjust", "SELECT key, round(p, 6) AS p, round(max(least(1.0, (m - rk + 1) * p)) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM (SELECT key, p, row_number() OVER (ORDER BY p, key) AS rk, count(*) OVER () AS m FROM ps)", None, "ps AS (SELECT c_nationkey AS key, count(*) FILTER (c_mktsegment = 'BUILDING') / (10.0 * count(*)) AS p FROM customer GROUP BY c_nationkey)")
def _(s, d):
    ps = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg((F.sum((F.col("c_mktsegment") == "BUILDING").cast("int")) / (10.0 * F.count("*"))).alias("p"))
    return stats.holm(ps).select("key", r6("p").alias("p"), r6("p_holm").alias("p_holm"))


WB = CARDS + """, lab AS (SELECT CAST(p_partkey AS BIGINT) AS node, p_brand AS label FROM part), lc AS (SELECT edge, label, count(*) AS c FROM inc JOIN lab USING (node) GROUP BY ALL),
t AS (SELECT cards.edge, card, coalesce(sum(c), 0) AS n, coalesce(max(c), 0) AS top, count(label) AS k FROM cards LEFT JOIN lc ON cards.edge = lc.edge GROUP BY cards.edge, card),
tt AS (SELECT t.*, (SELECT count(*) FROM lc WHERE lc.edge = t.edge AND lc.c = t.top) AS ties FROM t)"""
RULES = {
    "strict": "top = card", "majority": "2 * top > card", "linear": "CASE WHEN n = 0 THEN false WHEN ties > 1 THEN NULL ELSE true END", "unassigned_strict": "n > 0 AND top = n",
    "unassigned_majority": "n > 0 AND 2 * top > n", "impure": "k = 1",
}


def _within(rule: str, sql: str):
    @query(f"within_between_{rule}", f"SELECT edge, {sql} AS within FROM tt", "basket", WB)
    def _(s, d):
        return stats.within(stats.label_counts(view(s, d, "basket"), brands(s, d)), rule)


for _rule, _sql in RULES.items():
    _within(_rule, _sql)


@query("unlabelled_nodes", "SELECT DISTINCT node FROM inc WHERE node NOT IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#11')", "basket")
def _(s, d):
    known = brands(s, d).filter("label <> 'Brand#11'")
    return view(s, d, "basket").select("node").distinct().join(known, "node", "left_anti")


@query("removal_precision_recall", ", b AS (SELECT edge, count(DISTINCT CAST(s_nationkey AS BIGINT)) > 1 AS bt FROM inc JOIN supplier ON node = s_suppkey GROUP BY edge), o AS (SELECT edge, bt, row_number() OVER (ORDER BY edge) AS step FROM b), c AS (SELECT step, edge, CAST(sum(CAST(bt AS BIGINT)) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS removed_between FROM o) SELECT step, edge, removed_between, round(removed_between / step, 6) AS precision, round(removed_between / (SELECT sum(CAST(bt AS BIGINT)) FROM o), 6) AS recall FROM c", "supply", "one AS (SELECT 1)")
def _(s, d):
    inc = view(s, d, "supply")
    labels = nations(s, d).withColumnRenamed("part", "label")
    between = stats.within(stats.label_counts(inc, labels), "strict").select("edge", (~F.col("within")).alias("is_between"))
    order = numbered(inc.select("edge").distinct(), [F.col("edge")], "step")
    return stats.removal_curve(order, between).select("step", "edge", "removed_between", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("curvature_histogram", "SELECT CAST(floor(coalesce(f, 0) / 10.0) * 10 AS BIGINT) AS bin, count(*) AS n FROM cards LEFT JOIN fn ON n = 'e' || edge WHERE card > 1 GROUP BY ALL", "supply", FORMAN.replace("fn AS (SELECT n,", "fn AS (SELECT n,"))
def _(s, d):
    return stats.integer_histogram(poset.forman_hyperedges(view(s, d, "supply")), "curvature", 10)


@query("value_histogram", "SELECT CAST(least(19, floor((a - lo) / (hi - lo) * 20)) AS INTEGER) AS bin, count(*) AS n FROM o, (SELECT min(a) AS lo, max(a) AS hi FROM o) GROUP BY ALL", None, ORD)
def _(s, d):
    return stats.histogram(_orders(s, d), "a", 20).select("bin", "n")


@query("grouped_summary", "SELECT grp, count(*) AS n, round(avg(a), 4) AS mean, round(median(a), 4) AS median, round(stddev_samp(a), 4) AS std FROM o GROUP BY grp", None, ORD)
def _(s, d):
    return stats.grouped_summary(_orders(s, d), "a", ["grp"]).select("grp", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")])


@query("value_summary", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_nan, round(min(a), 4) AS least, round(median(a), 4) AS median, round(avg(a), 4) AS mean, round(max(a), 4) AS greatest, round(stddev_samp(a), 4) AS std FROM o", None, ORD)
def _(s, d):
    out = stats.summary(_orders(s, d), "a")
    return out.select("n", "n_nan", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


@query("join_curvatures", "SELECT k.key, f.f AS a, k.card AS b FROM (SELECT key, max(edge) AS edge, CAST(any_value(card) AS BIGINT) AS card FROM keys WHERE card > 1 GROUP BY key) k JOIN (SELECT n, f FROM fn) f ON f.n = 'e' || k.edge", "supply", KEYS + ", " + FORMAN)
def _(s, d):
    inc = view(s, d, "supply")
    e = incidence.hyperedges(inc).groupBy("key").agg(F.max("edge").alias("edge"), F.max("card").cast("long").alias("card")).filter("card > 1")
    e = cut(e)
    a = e.join(poset.forman_hyperedges(inc), "edge").select("key", F.col("curvature").alias("value"))
    return stats.joined_curvatures(cut(a), e.select("key", F.col("card").alias("value")))


@query("aligned_curvatures", "SELECT key, a, b FROM o", None, "o AS (SELECT o_orderkey AS key, o_totalprice AS a, n AS b FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)")
def _(s, d):
    a = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    b = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("value"))
    return stats.aligned({"a": a, "b": b})


@query("dense_labels", "SELECT CAST(k AS BIGINT) AS node, coalesce(CAST(s_nationkey AS VARCHAR), '') AS label FROM range(1, (SELECT max(s_suppkey) + 6 FROM supplier)) t(k) LEFT JOIN supplier ON s_suppkey = k")
def _(s, d):
    parts = nations(s, d)
    n = parts.agg(F.max("node")).first()[0] + 5
    return stats.dense_labels(parts.select("node", F.col("part").alias("label")), n)


@query("letter_labels", "SELECT n_nationkey AS k, chr(CAST(65 + n_nationkey AS INTEGER)) AS letter, chr(CAST(65 + (n_nationkey + 26) // 26 - 1 AS INTEGER)) || chr(CAST(65 + n_nationkey % 26 AS INTEGER)) AS later FROM nation")
def _(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("k"), stats.letter_label(F.col("n_nationkey")).alias("letter"), stats.letter_label(F.col("n_nationkey") + 26).alias("later"))


from hyperweft.plans import more_queries  # noqa: E402, F401  registers its queries

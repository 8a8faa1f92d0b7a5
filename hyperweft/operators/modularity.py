"""Hypergraph modularity of a partition, with the Chung-Lu degree tax, and its h-Louvain generalisation.

A hyperedge of d nodes, c of them in a cluster, counts w(d, c) = (c/d)^tau for it if c > d/2. tau = 0 is 'majority', 1
'linear', 2 'quadratic', and infinity 'strict' (c = d alone).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperweft.operators.incidence import card_histogram, degrees, two_section, with_card

TAU = {"strict": math.inf, "majority": 0.0, "linear": 1.0, "quadratic": 2.0}


def weight(d: Column, c: Column, tau: float) -> Column:
    """w(d, c)."""
    if math.isinf(tau):
        return F.when(c == d, 1.0).otherwise(0.0)
    return F.when(c > d / 2, F.pow(c / d, F.lit(float(tau)))).otherwise(0.0)


def binomial(n: Column, k: Column) -> Column:
    """n over k as a product of ratios, which stays finite where factorials don't."""
    return F.when(k == 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), k), F.lit(1.0), lambda acc, i: acc * (n - k + i) / i))


def expected_share(parts: DataFrame, sizes: DataFrame, tau: float) -> DataFrame:
    """(part, card, share): the probability-weighted count of a random hyperedge of card nodes, for parts(part, p) and sizes(card)."""
    grid = sizes.select("card", F.explode(F.sequence(F.floor(F.col("card") / 2).cast("int") + 1, F.col("card"))).alias("c"))
    terms = grid.select("card", "c", (binomial(F.col("card"), F.col("c")) * weight(F.col("card"), F.col("c"), tau)).alias("factor")).filter("factor > 0")
    # as many rows as pairs of sizes; parts keep their partitioning
    chance = F.col("factor") * F.pow("p", F.col("c")) * F.pow(1 - F.col("p"), F.col("card") - F.col("c"))
    return parts.join(F.broadcast(terms)).groupBy("part", "card").agg(F.sum(chance).alias("share"))


def contributions(inc: DataFrame, assignment: DataFrame, tau: float = 1.0, resolution: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """(part, observed, expected, q) for each part of assignment(node, part); q = observed - resolution * expected.

    Hyperedges of fewer than two nodes are left out. weights(edge, weight): hyperedges count by their weight, and degrees and
    the histogram of sizes do so too. Nodes without a part are in none.
    """
    e = with_card(inc, 2)
    e = e.join(weights.select("edge", "weight"), "edge") if weights is not None else e.withColumn("weight", F.lit(1.0))
    whole = e.select("edge", "card", "weight").distinct()
    total = whole.agg(F.sum("weight").alias("m"))
    hist = whole.groupBy("card").agg(F.sum("weight").alias("n"))
    volume = e.agg(F.sum("weight").alias("all"))
    member = e.join(assignment.select("node", "part"), "node")
    vol = member.groupBy("part").agg(F.sum("weight").alias("vol"))
    inside = member.groupBy("edge", "card", "weight", "part").agg(F.count("*").alias("c"))
    observed = inside.groupBy("part").agg(F.sum(F.col("weight") * weight(F.col("card"), F.col("c"), tau)).alias("observed"))
    # total, volume and the histogram of sizes have one row, one row, and one for each size
    parts = vol.join(F.broadcast(volume)).select("part", (F.col("vol") / F.col("all")).alias("p"))
    share = expected_share(parts, hist.select("card"), tau)
    expected = share.join(F.broadcast(hist), "card").groupBy("part").agg(F.sum(F.col("n") * F.col("share")).alias("expected"))
    out = observed.join(expected, "part").join(F.broadcast(total))
    return out.select("part", (F.col("observed") / F.col("m")).alias("observed"), (F.col("expected") / F.col("m")).alias("expected")).withColumn("q", F.col("observed") - resolution * F.col("expected"))


def modularity(inc: DataFrame, assignment: DataFrame, tau: float = 1.0, resolution: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """One row: q."""
    return contributions(inc, assignment, tau, resolution, weights).agg(F.sum("q").alias("q"))


def part_scores(inc: DataFrame, assignment: DataFrame, tau: float = 1.0) -> DataFrame:
    """(part, n_nodes, q), for the parts of a component split."""
    sizes = assignment.groupBy("part").agg(F.count("*").alias("n_nodes"))
    return sizes.join(contributions(inc, assignment, tau).select("part", "q"), "part", "left").select("part", "n_nodes", F.coalesce("q", F.lit(0.0)).alias("q"))


def graph_modularity(edges: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: q, the Newman modularity of weighted undirected edges (u, v, w)."""
    a = assignment.select(F.col("node").alias("u"), F.col("part").alias("pu"))
    b = assignment.select(F.col("node").alias("v"), F.col("part").alias("pv"))
    e = edges.join(a, "u").join(b, "v")
    ends = e.select(F.col("pu").alias("part"), "w").unionByName(e.select(F.col("pv").alias("part"), "w"))
    vol = ends.groupBy("part").agg(F.sum("w").alias("vol"))
    total = edges.agg(F.sum("w").alias("m"))
    tax = vol.join(F.broadcast(total)).agg(F.sum(F.pow(F.col("vol") / (2 * F.col("m")), F.lit(2.0))).alias("tax"))
    inside = e.agg(F.sum(F.when(F.col("pu") == F.col("pv"), F.col("w")).otherwise(0.0)).alias("inside"))
    return inside.join(F.broadcast(total)).join(F.broadcast(tax)).select((F.col("inside") / F.col("m") - resolution * F.col("tax")).alias("q"))


def combined_modularity(inc: DataFrame, assignment: DataFrame, alpha: float, tau: float = 1.0, resolution: float = 1.0) -> DataFrame:
    """One row: q = (1 - alpha) * modularity of the two-section graph + alpha * hypergraph modularity."""
    flat = graph_modularity(two_section(inc), assignment, resolution).withColumnRenamed("q", "q2")
    return modularity(inc, assignment, tau, resolution).join(F.broadcast(flat)).select(((1 - alpha) * F.col("q2") + alpha * F.col("q")).alias("q"))


def collapsed(inc: DataFrame, assignment: DataFrame) -> DataFrame:
    """(part, edge, mult): supernodes with their multiplicity in each hyperedge."""
    return inc.join(assignment, "node").groupBy("part", "edge").agg(F.count("*").alias("mult"))


def degree_tables(inc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Degrees and the histogram of sizes of hyperedges with at least two nodes."""
    e = with_card(inc, 2).select("edge", "node")
    return degrees(e), card_histogram(e)

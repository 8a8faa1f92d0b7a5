"""Random hypergraphs. Equal in distribution to the usual generators and reproducible by seed; every row is made where it is needed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweft.operators.incidence import hyperedges
from hyperweft.plans.storage import numbered


def _draws(spark: SparkSession, n: int, card: int, pick, seed: int, tries: int = 4) -> DataFrame:
    """(row, nodes): n sets of card nodes; each row draws `tries` * card nodes by pick(u) and keeps its first distinct ones."""
    rows = spark.range(n).select(F.col("id").alias("row"))
    u = lambda i: F.pmod(F.xxhash64("row", i, F.lit(seed), F.lit(card)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(tries * card + 8)), lambda i: pick(u(i))))
    return rows.select("row", F.array_sort(F.slice(drawn, 1, card)).alias("nodes")).filter(F.size("nodes") == card)


def _as_incidence(sets: DataFrame) -> DataFrame:
    distinct = sets.select(F.array_join("nodes", ",").alias("key"), "nodes").dropDuplicates(["key"])
    ids = numbered(distinct, [F.col("key")], "edge")
    return ids.select((F.col("edge") - 1).alias("edge"), F.explode("nodes").alias("node"))


def random_hypergraph(spark: SparkSession, nodes: int, counts: dict[int, int], seed: int = 1) -> DataFrame:
    """(edge, node): about counts[card] distinct random hyperedges of each cardinality over nodes 1 to n."""
    sets = None
    for card, m in sorted(counts.items()):
        possible = math.comb(nodes, card)
        # as many draws as leave about m distinct ones
        draws = m if m >= possible else round(-possible * math.log1p(-m / possible)) if possible < 1e12 else m
        part = _draws(spark, min(draws, 50 * m), card, lambda u: (F.floor(u * nodes) + 1).cast("long"), seed).select("nodes")
        sets = part if sets is None else sets.unionByName(part)
    return _as_incidence(sets)


def block_hypergraph(spark: SparkSession, nodes: int, blocks: int, edges: int, inside: float = 0.85, smallest: int = 3, largest: int = 8, seed: int = 1) -> DataFrame:
    """(edge, node): random hyperedges of smallest to largest nodes, a share `inside` of them within one block; node n is in block n % blocks."""
    sets = None
    for card in range(smallest, largest + 1):
        m = edges // (largest - smallest + 1)
        per = nodes // blocks
        home = F.pmod(F.xxhash64("row", F.lit(seed), F.lit(-card)), F.lit(blocks))
        local = F.pmod(F.xxhash64("row", F.lit(seed), F.lit("inside"), F.lit(card)), F.lit(1 << 20)) / F.lit(float(1 << 20)) < inside
        part = _draws(spark, m, card, lambda u, home=home, local=local, per=per: F.when(local, F.floor(u * per) * blocks + home).otherwise(F.floor(u * nodes)).cast("long"), seed).select("nodes")
        sets = part if sets is None else sets.unionByName(part)
    return _as_incidence(sets)


def uniform_hsbm(spark: SparkSession, nodes: int, blocks: int, card: int, p_in: float, p_out: float, seed: int = 1, rounds: int = 8, tolerance: float = 0.02) -> DataFrame:
    """(edge, node) of a uniform stochastic block model: sets within one block appear with p_in, others with p_out.

    The numbers of draws are corrected for repeats until the numbers of distinct sets are within tolerance of their expectation. Nodes that are left
    isolated join one random set of their own block. Node n is in block n % blocks.
    """
    per = nodes // blocks
    within = blocks * math.comb(per, card)
    wanted = {"in": round(p_in * within), "out": round(p_out * (math.comb(nodes, card) - within))}
    home = F.pmod(F.xxhash64("row", F.lit(seed), F.lit("home")), F.lit(blocks))
    pick = {"in": lambda u: (F.floor(u * per) * blocks + home).cast("long"), "out": lambda u: F.floor(u * nodes).cast("long")}
    sets = None
    for kind, m in wanted.items():
        draws = m
        for k in range(rounds):
            part = _draws(spark, draws, card, pick[kind], seed + k * 1000 + (kind == "out")).select("nodes").distinct()
            if kind == "out":
                part = part.filter(F.size(F.array_distinct(F.transform("nodes", lambda x: x % blocks))) > 1)
            made = part.count()
            if abs(made - m) <= tolerance * max(m, 1) or not m:
                break
            draws = max(1, round(draws * m / max(made, 1)))
        sets = part if sets is None else sets.unionByName(part)
    used = sets.select(F.explode("nodes").alias("node")).distinct()
    lonely = spark.range(nodes).select(F.col("id").alias("node")).join(used, "node", "left_anti")
    mates = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(4 * card + 8)), lambda i: (F.pmod(F.xxhash64("node", i, F.lit(seed)), F.lit(per)) * blocks + F.col("node") % blocks).cast("long")))
    joined = lonely.select(F.array_sort(F.slice(F.array_distinct(F.concat(F.array("node"), mates)), 1, card)).alias("nodes")).filter(F.size("nodes") == card)
    return _as_incidence(sets.unionByName(joined))


def small_world(spark: SparkSession, nodes: int, card: int, rewire: float, seed: int = 1) -> DataFrame:
    """(edge, node): a ring of hyperedges of `card` consecutive nodes, each node of which is moved at random with probability rewire."""
    rows = spark.range(nodes).select(F.col("id").alias("row"))
    u = lambda i, salt: F.pmod(F.xxhash64("row", i, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    member = F.transform(F.sequence(F.lit(0), F.lit(card - 1)), lambda i: F.when((i > 0) & (u(i, 1) < rewire), F.floor(u(i, 2) * nodes)).otherwise((F.col("row") + i) % nodes).cast("long"))
    return _as_incidence(rows.select(F.array_sort(F.array_distinct(member)).alias("nodes")).filter(F.size("nodes") > 1))


def within_between(inc: DataFrame, blocks: int) -> DataFrame:
    """One row: n_within, n_between hyperedges, for blocks n % blocks."""
    e = hyperedges(inc).select((F.size(F.array_distinct(F.transform("nodes", lambda x: x % blocks))) == 1).alias("w"))
    return e.agg(F.sum(F.col("w").cast("long")).alias("n_within"), F.sum((~F.col("w")).cast("long")).alias("n_between"))

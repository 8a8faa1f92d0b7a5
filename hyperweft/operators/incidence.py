"""Hypergraphs as incidences (edge, node) and as hyperedges (edge, nodes, card, key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incidence_of(df: DataFrame, edge, node) -> DataFrame:
    """Distinct (edge, node) pairs of any table: one hyperedge for each value of edge."""
    edge, node = (F.col(c) if isinstance(c, str) else c for c in (edge, node))
    return df.select(edge.cast("long").alias("edge"), node.cast("long").alias("node")).filter("edge is not null and node is not null").distinct()


def key_of(nodes) -> F.Column:
    return F.array_join(F.array_sort(nodes).cast("array<string>"), ",")


def hyperedges(inc: DataFrame) -> DataFrame:
    """(edge, nodes, card, key): nodes in order, key their canonical text."""
    grouped = inc.groupBy("edge").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return grouped.select("edge", "nodes", F.size("nodes").alias("card"), key_of(F.col("nodes")).alias("key"))


def incidences(edges: DataFrame) -> DataFrame:
    return edges.select("edge", F.explode("nodes").alias("node"))


def with_card(inc: DataFrame, least: int = 1) -> DataFrame:
    """(edge, node, card) of hyperedges with at least `least` nodes."""
    cards = inc.groupBy("edge").agg(F.count("*").cast("int").alias("card"))
    return inc.join(cards.filter(F.col("card") >= least), "edge")


def node_index(inc: DataFrame) -> DataFrame:
    """(node, edges): the inverse incidence."""
    return inc.groupBy("node").agg(F.array_sort(F.collect_set("edge")).alias("edges"))


def degrees(inc: DataFrame) -> DataFrame:
    return inc.groupBy("node").agg(F.count("*").alias("degree"))


def totals(inc: DataFrame) -> DataFrame:
    """One row: n_edges, n_nodes, volume."""
    return inc.agg(F.countDistinct("edge").alias("n_edges"), F.countDistinct("node").alias("n_nodes"), F.count("*").alias("volume"))


def card_histogram(inc: DataFrame, least: int = 1) -> DataFrame:
    cards = inc.groupBy("edge").agg(F.count("*").cast("int").alias("card")).filter(F.col("card") >= least)
    return cards.groupBy("card").agg(F.count("*").alias("n_edges"))


def cardinality_distribution(inc: DataFrame, max_card: int) -> DataFrame:
    """(card, share) for card 0 to max_card; larger hyperedges count in the total alone."""
    hist = card_histogram(inc)
    total = hist.agg(F.sum("n_edges").alias("total"))  # one row
    cards = inc.sparkSession.range(0, max_card + 1).select(F.col("id").cast("int").alias("card"))
    return cards.join(hist, "card", "left").join(F.broadcast(total)).select("card", (F.coalesce("n_edges", F.lit(0)) / F.col("total")).alias("share"))


def lookup(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, edge): the last hyperedge with exactly the nodes that key lists in any order; null if there is none."""
    canonical = keys.select("key", F.array_join(F.array_sort(F.array_distinct(F.transform(F.split("key", r"[,\s]+"), lambda x: x.cast("long")))).cast("array<string>"), ",").alias("canonical"))
    last = edges.groupBy(F.col("key").alias("canonical")).agg(F.max("edge").alias("edge"))
    return canonical.join(last, "canonical", "left").select("key", "edge")


def deduplicated(edges: DataFrame) -> DataFrame:
    """Of equal hyperedges the first one."""
    firsts = edges.groupBy("key").agg(F.min("edge").alias("edge"))
    return edges.join(firsts.select("edge"), "edge", "left_semi")


def duplicate_stats(edges: DataFrame) -> DataFrame:
    """One row: n_edges, n_distinct, n_duplicates."""
    return edges.agg(F.count("*").alias("n_edges"), F.countDistinct("key").alias("n_distinct")).withColumn("n_duplicates", F.col("n_edges") - F.col("n_distinct"))


def node_pairs(inc: DataFrame) -> DataFrame:
    """(edge, u, v), u < v: pairs of nodes of one hyperedge, from its own array and without a join."""
    e = hyperedges(inc).filter("card > 1").select("edge", "card", "nodes", F.posexplode("nodes").alias("i", "u"))
    return e.select("edge", "card", "u", F.explode(F.expr("slice(nodes, i + 2, greatest(card - i - 1, 0))")).alias("v"))


def cooccurrence(inc: DataFrame) -> DataFrame:
    """(u, v, w), u < v: the number of hyperedges that hold both; the clique expansion has an edge for each row."""
    return node_pairs(inc).groupBy("u", "v").agg(F.count("*").alias("w"))


def two_section(inc: DataFrame) -> DataFrame:
    """(u, v, w), u < v: each hyperedge adds 1 / (card - 1)."""
    return node_pairs(inc).groupBy("u", "v").agg(F.sum(1 / (F.col("card") - 1)).alias("w"))


def shared_pair_edges(inc: DataFrame) -> DataFrame:
    """One row: the number of hyperedges that share at least two nodes with another one."""
    pairs = node_pairs(inc).select("edge", "u", "v")
    common = pairs.groupBy("u", "v").agg(F.count("*").alias("n")).filter("n > 1").select("u", "v")
    return pairs.join(common, ["u", "v"], "left_semi").agg(F.countDistinct("edge").alias("n_edges"))


def without_edges(inc: DataFrame, removed: DataFrame) -> DataFrame:
    """The hypergraph without the hyperedges in removed(edge)."""
    return inc.join(removed.select("edge").distinct(), "edge", "left_anti")


def generated_nodes(inc: DataFrame) -> DataFrame:
    """Nodes 1 to the largest one."""
    return inc.agg(F.max("node").alias("m")).select(F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("node"))

"""Writers of line-oriented results, and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, value, order: list | None = None) -> None:
    """One text line a row; with an order, one file in that order (for results that have to be one file)."""
    out = df
    if order:
        out = out.orderBy(*order).coalesce(1)
    out.select(value.alias("value")).write.mode("overwrite").text(path)


def write_curvature(curved: DataFrame, path: str, key: str = "key", value: str = "curvature") -> None:
    """'key : value' lines by key."""
    write_lines(curved, path, F.concat_ws(" : ", F.col(key).cast("string"), F.col(value).cast("string")), [F.col(key)])


def write_removals(removed: DataFrame, edges: DataFrame, path: str) -> None:
    """The nodes of removed(step, edge), comma-separated, in order."""
    write_lines(removed.join(edges.select("edge", "key"), "edge"), path, F.col("key"), [F.col("step")])


def write_clusters(clusters: DataFrame, path: str) -> None:
    """'node truth pred' lines by node."""
    write_lines(clusters, path, F.concat_ws(" ", "node", "truth", "pred"), [F.col("node")])


def write_dual(duals: DataFrame, edges: DataFrame, path: str) -> None:
    """Dual edges as '[a, b]:[b, c]' lines in one folder for each k = card - 1."""
    text = edges.select("edge", F.concat(F.lit("["), F.array_join(F.col("nodes").cast("array<string>"), ", "), F.lit("]")).alias("t"))
    j = duals.join(text.withColumnsRenamed({"edge": "e1", "t": "t1"}), "e1").join(text.withColumnsRenamed({"edge": "e2", "t": "t2"}), "e2")
    j.select((F.col("card") - 1).alias("k"), F.concat_ws(":", "t1", "t2").alias("value")).write.mode("overwrite").partitionBy("k").text(path)


def write_dual_nodes(edges: DataFrame, path: str) -> None:
    """Distinct hyperedges as '[a, b]' lines in one folder for each k = card - 1."""
    e = edges.dropDuplicates(["key"])
    e.select((F.col("card") - 1).alias("k"), F.concat(F.lit("["), F.array_join(F.col("nodes").cast("array<string>"), ", "), F.lit("]")).alias("value")).write.mode("overwrite").partitionBy("k").text(path)


def write_keys(keyed: DataFrame, path: str) -> None:
    """'name : a,b,c' lines of keyed(name, key), the bijection between members of the poset and hyperedges."""
    write_lines(keyed, path, F.concat_ws(" : ", "name", "key"), [F.col("name")])


def write_poset(nodes: DataFrame, cover: DataFrame, tri: DataFrame, folder: str, name: str) -> None:
    """A poset as the files nodes, cardinality, edges and triangles: nodes(id, card), all edges (u, v) of cover and of tri's two steps, and tri(i, j, k)."""
    write_lines(nodes, f"{folder}/nodes/{name}.txt", F.col("id").cast("string"), [F.col("id")])
    write_lines(nodes, f"{folder}/cardinality/{name}.txt", F.col("card").cast("string"), [F.col("id")])
    edges = cover.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(tri.select(F.col("i").alias("u"), F.col("k").alias("v"))).distinct()
    write_lines(edges, f"{folder}/edges/{name}.txt", F.concat_ws("\t", "u", "v"))
    write_lines(tri, f"{folder}/triangles/{name}.txt", F.concat_ws("\t", "i", "j", "k"))


def write_hypergraph(hyperedges: DataFrame, path: str) -> None:
    """Tab-separated hyperedges in the order of their ids, as other programs read them."""
    write_lines(hyperedges, path, F.array_join(F.col("nodes").cast("array<string>"), "\t"), [F.col("edge")])


def load_config(path: str) -> dict:
    """A YAML file on the driver, with defaults for all that clustering asks for."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    model = {"number_of_target_cluster": 2, "max_iterations": 5000, "target_distribution": [], "ot_computation": "IBP"} | (found.get("model") or {})
    return found | {"model": model}

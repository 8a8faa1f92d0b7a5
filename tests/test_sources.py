"""Readers, writers and configuration."""

import math

import pytest
from pyspark.sql import functions as F

from hyperweft.operators import dual, incidence
from hyperweft.sources import sinks, text


@pytest.fixture
def write(tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
        return str(path)

    return put


def test_hyperedges(spark, write):
    df = text.read_hyperedges(spark, write("h.txt", "3 1,2 2\n\n4\tx\n7, 5\n"))
    assert {(r["edge"], tuple(r["nodes"]), r["card"], r["key"]) for r in df.collect()} == {(0, (1, 2, 3), 3, "1,2,3"), (3, (5, 7), 2, "5,7")}


def test_labelled_hyperedges(spark, write):
    df = text.read_labelled_hyperedges(spark, write("h.txt", "# note\nb;a a\n10,9\n"))
    assert [(r["edge"], r["labels"]) for r in df.orderBy("edge").collect()] == [(1, ["b", "a"]), (2, ["10", "9"])]
    assert {r["label"]: r["node"] for r in text.label_index(df).collect()} == {"9": 1, "10": 2, "a": 3, "b": 4}


def test_labels_nodes_and_removals(spark, write):
    assert {(r["node"], r["label"]) for r in text.read_labels(spark, write("a.txt", "x\ny\n")).collect()} == {(1, "x"), (2, "y")}
    assert {(r["node"], r["label"]) for r in text.read_labels(spark, write("b.txt", "5 x\n9,y\n")).collect()} == {(5, "x"), (9, "y")}
    assert {r["node"] for r in text.read_nodes(spark, write("n.txt", "1\n4\n\n")).collect()} == {1, 4}
    removals = text.read_removals(spark, write("r.txt", "2,1\n1: 3, 4\nNone\n"))
    assert {(r["step"], tuple(r["nodes"])) for r in removals.collect()} == {(1, (1, 2)), (2, (3, 4))}
    assert text.read_clusters(spark, write("c.txt", "1 a b\n2 a c\n")).count() == 2


def test_curvature(spark, write, tmp_path):
    df = text.read_curvature(spark, write("c.txt", "2,1 : 0.5\ne:3 : -1\n7 : bad\n"))
    rows = {r["key"]: r for r in df.collect()}
    assert rows["1,2"]["value"] == 0.5 and rows["1,2"]["card"] == 2 and rows["e:3"]["nodes"] is None and math.isnan(rows["7"]["value"])
    sinks.write_curvature(df.select("key", F.col("value").alias("curvature")).filter("key <> '7'"), str(tmp_path / "out"))
    assert {(r["key"], r["value"]) for r in text.read_curvature(spark, str(tmp_path / "out/part*")).collect()} == {("1,2", 0.5), ("e:3", -1.0)}


def test_poset(spark, write, tmp_path):
    for part, content in {"nodes": "1\n2\n3\n", "cardinality": "1\n2\n3\n", "edges": "1\t2\n2\t3\n1\t3\n", "triangles": "1\t2\t3\n"}.items():
        write(f"p/{part}/x.txt", content)
    nodes, edges, tri = text.read_poset(spark, str(tmp_path / "p"), "x")
    assert {tuple(r) for r in nodes.collect()} == {(1, 1), (2, 2), (3, 3)} and {r["tri"] for r in edges.collect()} == {1} and tri.count() == 1


def test_dual_files(spark, tmp_path, write):
    inc = spark.createDataFrame([(k, n) for k, e in enumerate([[1, 2], [2, 3], [5, 6, 7], [6, 7, 8]]) for n in e], "edge long, node long")
    sinks.write_dual(dual.dual_edges(inc), incidence.hyperedges(inc), str(tmp_path / "d"))
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "d/k=1")).collect()}
    assert lines == {"[1, 2]:[2, 3]"}
    nodes, edges = text.read_dual(spark, write("nodes_k1.txt", "[1, 2]\n[2, 3]\n"), write("edges_k1.txt", "[1, 2]:[2, 3]\n"))
    assert {(r["k"], r["card"]) for r in nodes.collect()} == {(1, 2)} and edges.first()["n2"] == [2, 3]
    assert text.cardinalities(spark, str(tmp_path / "nodes_k*.txt")).first()["k"] == 1


def test_writers(spark, tmp_path):
    edges = incidence.hyperedges(spark.createDataFrame([(0, 2), (0, 1), (1, 3)], "edge long, node long"))
    sinks.write_removals(spark.createDataFrame([(2, 0), (1, 1)], "step long, edge long"), edges, str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["3", "1,2"]
    sinks.write_hypergraph(edges, str(tmp_path / "h"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "h")).collect()] == ["1\t2", "3"]
    sinks.write_clusters(spark.createDataFrame([(1, "a", "b")], "node long, truth string, pred string"), str(tmp_path / "c"))
    assert text.read_clusters(spark, str(tmp_path / "c/part*")).first()["pred"] == "b"


def test_config_and_names(write):
    found = sinks.load_config(write("c.yaml", "data:\n  name: x\nmodel:\n  max_iterations: 7\n"))
    assert found["model"] == {"number_of_target_cluster": 2, "max_iterations": 7, "target_distribution": [], "ot_computation": "IBP"}
    assert text.resolve("A", ["b/a.txt", "c/A.txt"]) == "c/A.txt" and text.resolve("B.csv", ["x/b.txt"]) == "x/b.txt"
    with pytest.raises(FileNotFoundError):
        text.resolve("z", [])


def test_command_lines(spark, tmp_path):
    """Both commands on a small hypergraph whose curvatures are known."""
    from hyperweft.__main__ import main

    star = ["1 2 3 4", "1 5", "1 6", "2 7", "2 8", "3 9", "3 10", "4 11", "4 12"]
    (tmp_path / "edges.txt").write_text("\n".join(star) + "\n")
    (tmp_path / "labels.txt").write_text("\n".join("a" if k < 7 else "b" for k in range(1, 13)) + "\n")
    for name in ("Forman", "OR_MMOT"):
        out = tmp_path / name
        (tmp_path / "c.yaml").write_text(f"data: {{hyperedges: {tmp_path}/edges.txt, labels: {tmp_path}/labels.txt, output: {out}}}\nmodel: {{measure: {name}, number_of_target_cluster: 2, max_iterations: 3}}\n")
        main(["measure", str(tmp_path / "c.yaml")], spark)
        curved = {r["key"]: r["value"] for r in text.read_curvature(spark, str(out / "hyperedge.txt")).collect()}
        assert len(curved) == 9 and math.isclose(curved["1,2,3,4"], {"Forman": -12, "OR_MMOT": 0.6631082935304122}[name], rel_tol=1e-9)
        assert text.read_curvature(spark, str(out / "node.txt")).count() == 12
        main(["cluster", str(tmp_path / "c.yaml")], spark)
        clusters = text.read_clusters(spark, str(out / "clusters.txt")).collect()
        assert {r["node"] for r in clusters} == set(range(1, 13)) and {r["truth"] for r in clusters} == {"a", "b"}
        # one hyperedge goes before the rule is looked at
        assert 1 <= text.read_removals(spark, str(out / "removals.txt")).count() <= 3
        assert "modularity" in {r["key"] for r in text.read_curvature(spark, str(out / "scores.txt")).collect()}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "c.yaml").write_text(f"data: {{hyperedges: {tmp_path}/none.txt, output: {tmp_path}}}\n")
        main(["measure", str(tmp_path / "c.yaml")], spark)

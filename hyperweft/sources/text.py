"""Line-oriented files: hyperedges, nodes, labels, curvatures, posets, dual networks and removal logs."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = r"[,\s]+"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines of each file, numbered from 0 with blank ones; the last line break ends a line."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    return raw.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def _numbers(tokens) -> F.Column:
    return F.transform(tokens, lambda x: F.expr("try_cast(null as bigint)") if x is None else x.try_cast("bigint"))


def read_hyperedges(spark: SparkSession, path: str) -> DataFrame:
    """(edge, nodes, card, key): one hyperedge a line, named by its line number. Blank lines, and lines with anything but whole numbers, are skipped."""
    t = lines(spark, path).select(F.col("line").cast("long").alias("edge"), F.filter(F.split("value", SPLIT), lambda x: x != "").alias("tokens"))
    t = t.filter(F.size("tokens") > 0).withColumn("nodes", _numbers(F.col("tokens"))).filter(~F.exists("nodes", lambda x: x.isNull()))
    t = t.withColumn("nodes", F.array_sort(F.array_distinct("nodes")))
    return t.select("edge", "nodes", F.size("nodes").alias("card"), F.array_join(F.col("nodes").cast("array<string>"), ",").alias("key"))


def read_labelled_hyperedges(spark: SparkSession, path: str, separators: str = r"[,;\s]+") -> DataFrame:
    """(edge, labels): hyperedges over any labels, in their order and without repeats; lines that start with # are comments."""
    t = lines(spark, path).filter(~F.col("value").startswith("#"))
    t = t.select(F.col("line").cast("long").alias("edge"), F.array_distinct(F.filter(F.split("value", separators), lambda x: x != "")).alias("labels"))
    return t.filter(F.size("labels") > 0)


def label_index(hyperedges: DataFrame) -> DataFrame:
    """(label, node): labels numbered from 1, numbers by value before words by letters."""
    from hyperweft.plans.storage import numbered

    every = hyperedges.select(F.explode("labels").alias("label")).distinct()
    order = [F.col("label").try_cast("bigint").isNull(), F.col("label").try_cast("bigint"), F.col("label")]
    return numbered(every, order, "node").select("label", "node")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.trim("value").try_cast("bigint").alias("node")).filter("node is not null")


def read_labels(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """(node, label): one label a line (the node is the line's number from base), or two columns, node and label."""
    parts = F.filter(F.split("value", SPLIT), lambda x: x != "")
    t = lines(spark, path).withColumn("p", parts).filter(F.size("p") > 0)
    return t.select(F.when(F.size("p") == 1, F.col("line") + base).otherwise(F.get("p", F.lit(0)).try_cast("bigint")).cast("long").alias("node"), F.element_at("p", -1).alias("label"))


def read_removals(spark: SparkSession, path: str) -> DataFrame:
    """(step, nodes): a removal log; a leading 'index:' is dropped, and lines without numbers (None) are skipped."""
    t = lines(spark, path).withColumn("value", F.regexp_replace("value", r"^\s*\d+\s*[:\t]\s*", ""))
    t = t.withColumn("nodes", F.array_sort(_numbers(F.regexp_extract_all("value", F.lit(r"(\d+)"), 1)))).filter(F.size("nodes") > 0)
    return t.select((F.col("line") + 1).cast("long").alias("step"), "nodes")


def read_curvature(spark: SparkSession, path: str) -> DataFrame:
    """(pos, key, nodes, card, value): 'key : value' lines, split at the last colon; node sets get sorted nodes, other keys null; a bad value is NaN."""
    t = lines(spark, path).filter(F.trim("value") != "")
    t = t.select("line", F.trim(F.regexp_extract("value", r"^(.*):([^:]*)$", 1)).alias("raw"), F.trim(F.regexp_extract("value", r"^(.*):([^:]*)$", 2)).alias("v"))
    is_set = F.col("raw").rlike(r"^\d+(,\s*\d+)*$")
    nodes = F.when(is_set, F.array_sort(_numbers(F.split("raw", r",\s*"))))
    key = F.when(is_set, F.array_join(F.array_sort(_numbers(F.split("raw", r",\s*"))).cast("array<string>"), ",")).otherwise(F.col("raw"))
    return t.select(F.col("line").cast("long").alias("pos"), key.alias("key"), nodes.alias("nodes"), F.when(is_set, F.size(nodes)).alias("card"), F.coalesce(F.col("v").try_cast("double"), F.lit(float("nan"))).alias("value"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(node, truth, pred): a clustering result."""
    p = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).filter(F.trim("value") != "").select(p[0].cast("bigint").alias("node"), p[1].alias("truth"), p[2].alias("pred"))


def read_poset(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, card), (u, v, tri) and (i, j, k) of a saved poset; tri counts the triangles on each edge."""
    ids, cards = (lines(spark, f"{folder}/{part}/{name}.txt").select("line", F.trim("value").try_cast("bigint").alias("x")) for part in ("nodes", "cardinality"))
    nodes = ids.join(cards.select("line", F.col("x").alias("card")), "line").select(F.col("x").alias("id"), F.col("card").cast("int").alias("card"))
    pair = F.split(F.trim("value"), r"\s+")
    tri = lines(spark, f"{folder}/triangles/{name}.txt").filter("trim(value) <> ''").select(*[pair[k].cast("bigint").alias(c) for k, c in enumerate("ijk")])
    edges = lines(spark, f"{folder}/edges/{name}.txt").filter("trim(value) <> ''").select(pair[0].cast("bigint").alias("u"), pair[1].cast("bigint").alias("v")).distinct()
    sides = tri.select(F.col("i").alias("u"), F.col("j").alias("v")).unionByName(tri.select(F.col("j").alias("u"), F.col("k").alias("v"))).unionByName(tri.select(F.col("i").alias("u"), F.col("k").alias("v")))
    counts = sides.groupBy("u", "v").agg(F.count("*").alias("tri"))
    return nodes, edges.join(counts, ["u", "v"], "left").select("u", "v", F.coalesce("tri", F.lit(0)).alias("tri")), tri


def _bracketed(value) -> F.Column:
    return F.from_json(F.regexp_replace(F.regexp_replace(value, "[{(]", "["), "[})]", "]"), "array<bigint>")


def read_dual(spark: SparkSession, nodes_path: str, edges_path: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(k, nodes, card) and (k, n1, n2) of saved dual networks: '[a, b]' and '[a, b]:[b, c]' lines; k is read off the file's name, card off the sets."""
    k = F.regexp_extract("file", r"[_/]k=?(\d+)", 1).cast("int").alias("k")
    nodes = lines(spark, nodes_path).filter("trim(value) <> ''").select(k, F.array_sort(_bracketed(F.col("value"))).alias("nodes"))
    nodes = nodes.select("k", "nodes", F.size("nodes").alias("card"))
    if edges_path is None:
        return nodes, None
    ends = F.split("value", ":")
    edges = lines(spark, edges_path).filter("trim(value) <> ''").select(k, F.array_sort(_bracketed(ends[0])).alias("n1"), F.array_sort(_bracketed(ends[1])).alias("n2"))
    return nodes, edges


def cardinalities(spark: SparkSession, path: str) -> DataFrame:
    """(k, n_rows) of the dual files under a path."""
    return lines(spark, path).filter("trim(value) <> ''").groupBy(F.regexp_extract("file", r"[_/]k=?(\d+)", 1).cast("int").alias("k")).agg(F.count("*").alias("n_rows"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(name, key) of a key file."""
    p = F.split("value", " : ")
    return lines(spark, path).filter("trim(value) <> ''").select(p[0].alias("name"), p[1].alias("key"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of paths that don't exist or are empty."""
    return [p for p in paths if not exists(spark, p) or spark.read.text(p).isEmpty()]


def ensured(spark: SparkSession, path: str, build) -> str:
    """The path, which build(path) makes if it is missing."""
    if missing(spark, [path]):
        build(path)
    return path


def resolve(name: str, paths: list[str]) -> str:
    """The path whose file name is `name`: exact, without its extension, or in other letter case, tried in this order."""
    for same in (lambda p: PurePath(p).name == name, lambda p: PurePath(p).stem == name, lambda p: PurePath(p).stem.lower() == PurePath(name).stem.lower()):
        found = [p for p in paths if same(p)]
        if found:
            return found[0]
    raise FileNotFoundError(f"{name}: none of {paths}")

"""Command lines: `python -m hyperweft cluster CONFIG` and `python -m hyperweft measure CONFIG`.

CONFIG is a YAML file:

    data:   hyperedges, output, and for clustering optionally labels
    model:  measure, number_of_target_cluster, max_iterations, target_distribution, ot_computation

cluster writes clusters.txt (node, truth, predicted), removals.txt and scores.txt below output; measure writes hyperedge.txt and node.txt.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hyperweft.functions import stats
from hyperweft.operators.incidence import hyperedges, incidences
from hyperweft.operators.transport import TransportParams
from hyperweft.plans import clustering, measures
from hyperweft.plans.storage import cut, discard
from hyperweft.sources import sinks, text


def measure_of(model: dict) -> measures.CurvatureMeasure:
    name = model.get("measure", "Forman")
    options = {"params": TransportParams(solver=model["ot_computation"].lower())} if name == "OR_MMOT" else {}
    return measures.measure(name, **options)


def read(spark: SparkSession, data: dict):
    absent = text.missing(spark, [data["hyperedges"]])
    if absent:
        raise FileNotFoundError(f"missing or empty: {absent}")
    return cut(incidences(text.read_hyperedges(spark, data["hyperedges"])))


def run_cluster(spark: SparkSession, config: dict) -> None:
    data, model = config["data"], config["model"]
    inc, chosen = read(spark, data), measure_of(config["model"])
    params = clustering.ClusterParams(model["number_of_target_cluster"], model["max_iterations"], target_distribution=model["target_distribution"] or [])
    if isinstance(chosen, measures.Static) and chosen.name != "Forman_dynamic":
        scores = cut(chosen.edge_scores(inc).select("edge", F.col("curvature").alias("score")))
        clusters, removed, q = clustering.cluster_static(inc, scores, params)
    else:
        clusters, gone, q = clustering.cluster_dynamic(inc, chosen.edge_scores, chosen.refreshed, params)
        removed = spark.createDataFrame(list(enumerate(gone, 1)), "step long, edge long")
    labels = text.read_labels(spark, data["labels"]) if data.get("labels") else None
    truth = clusters.join(labels.withColumnRenamed("label", "truth"), "node", "left") if labels is not None else clusters.withColumn("truth", F.lit(None).cast("string"))
    rows = cut(truth.select("node", F.coalesce("truth", F.lit("-")).alias("truth"), F.col("cluster").cast("string").alias("pred")))
    sinks.write_clusters(rows, f"{data['output']}/clusters.txt")
    sinks.write_removals(removed, hyperedges(inc), f"{data['output']}/removals.txt")
    scores = spark.createDataFrame([("modularity", float(q))], "key string, curvature double")
    if labels is not None:
        found = stats.partition_agreement(rows, "pred", "truth").first().asDict()
        scores = scores.unionByName(spark.createDataFrame([(k, float(v)) for k, v in found.items()], scores.schema))
    sinks.write_curvature(scores, f"{data['output']}/scores.txt")


def run_measure(spark: SparkSession, config: dict) -> None:
    data = config["data"]
    inc, chosen = read(spark, data), measure_of(config["model"])
    curved = cut(chosen.edge_scores(inc))
    sinks.write_curvature(curved.join(hyperedges(inc), "edge"), f"{data['output']}/hyperedge.txt")
    sinks.write_curvature(chosen.vertex_scores(inc), f"{data['output']}/node.txt", "node")


COMMANDS = {"cluster": run_cluster, "measure": run_measure}


def main(arguments: list[str], spark: SparkSession | None = None) -> None:
    if len(arguments) != 2 or arguments[0] not in COMMANDS:
        raise SystemExit(__doc__)
    spark = spark or SparkSession.builder.appName("hyperweft").getOrCreate()
    COMMANDS[arguments[0]](spark, sinks.load_config(arguments[1]))
    discard(spark)


if __name__ == "__main__":
    main(sys.argv[1:])

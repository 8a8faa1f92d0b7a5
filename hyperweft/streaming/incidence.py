"""Incidence statistics of a stream of (edge, node) rows, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_degrees(stream: DataFrame) -> DataFrame:
    """(node, degree): a running count of distinct incidences; state is one row for each incidence and each node."""
    return stream.select("edge", "node").dropDuplicates(["edge", "node"]).groupBy("node").agg(F.count("*").alias("degree"))


def stream_cardinalities(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, edge, card): nodes that a hyperedge gained in each window; rows later than `late` are left out, so state stays bounded."""
    kept = stream.withWatermark(time, late).dropDuplicates(["edge", "node", time])
    return kept.groupBy(F.window(time, window), "edge").agg(F.count("*").alias("card"))

"""Curvature measures by name, and how to add one."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.operators import dual, poset, transport


class CurvatureMeasure(Protocol):
    """What clustering and evaluation ask of a measure."""

    name: str

    def edge_scores(self, inc: DataFrame) -> DataFrame:
        """(edge, curvature) of all hyperedges."""

    def vertex_scores(self, inc: DataFrame) -> DataFrame:
        """(node, curvature) of all vertices."""

    def refreshed(self, inc: DataFrame, curved: DataFrame, removed: DataFrame) -> DataFrame:
        """(edge, curvature) once removed(edge) are gone."""


class Static:
    """Measures whose scores stay as hyperedges go."""

    def refreshed(self, inc: DataFrame, curved: DataFrame, removed: DataFrame) -> DataFrame:
        return curved.join(removed.select("edge"), "edge", "left_anti")


class Forman(Static):
    name = "Forman"

    def edge_scores(self, inc: DataFrame) -> DataFrame:
        return poset.forman_hyperedges(inc)

    def vertex_scores(self, inc: DataFrame) -> DataFrame:
        return poset.forman_vertices(inc)


class FormanDynamic(Forman):
    """Forman curvature that is computed anew after each removal; the static order is the default of clustering."""

    name = "Forman_dynamic"

    def refreshed(self, inc: DataFrame, curved: DataFrame, removed: DataFrame) -> DataFrame:
        return self.edge_scores(inc.join(removed.select("edge"), "edge", "left_anti"))


class OllivierDual(Static):
    name = "OR_Dual"

    def __init__(self, alpha: float = 0.05):
        self.alpha = alpha

    def edge_scores(self, inc: DataFrame) -> DataFrame:
        return dual.by_hyperedge(transport.dual_curvature(dual.dual_edges(inc), self.alpha), inc.select("edge").distinct())

    def vertex_scores(self, inc: DataFrame) -> DataFrame:
        return dual.by_vertex(inc, self.edge_scores(inc))


class OllivierMMOT:
    name = "OR_MMOT"

    def __init__(self, params: transport.TransportParams = transport.TransportParams()):
        self.params = params

    def edge_scores(self, inc: DataFrame) -> DataFrame:
        return transport.mmot_curvature(inc, self.params).select("edge", "curvature")

    def vertex_scores(self, inc: DataFrame) -> DataFrame:
        return transport.mmot_vertex(inc, self.edge_scores(inc))

    def refreshed(self, inc: DataFrame, curved: DataFrame, removed: DataFrame) -> DataFrame:
        return transport.refreshed(inc, curved, removed, self.params)


class Pairwise(Static):
    """ORCHID-style curvature: dispersion star, clique or weighted_clique; aggregation mean or max."""

    name = "ORCHID"

    def __init__(self, dispersion: str = "star", aggregation: str = "mean", alpha: float = 0.01):
        self.options = (dispersion, aggregation, alpha)

    def edge_scores(self, inc: DataFrame) -> DataFrame:
        return transport.pair_curvature(inc, *self.options)

    def vertex_scores(self, inc: DataFrame) -> DataFrame:
        return transport.mmot_vertex(inc, self.edge_scores(inc))


class Random(Static):
    name = "random"

    def __init__(self, seed: int = 1):
        self.seed = seed

    def edge_scores(self, inc: DataFrame) -> DataFrame:
        return transport.random_scores(inc, self.seed).select("edge", (F.conv(F.substring("score", 1, 8), 16, 10).cast("double") / 2.0**32).alias("curvature"))

    def vertex_scores(self, inc: DataFrame) -> DataFrame:
        return transport.mmot_vertex(inc, self.edge_scores(inc))


MEASURES: dict[str, type] = {m.name: m for m in (Forman, FormanDynamic, OllivierDual, OllivierMMOT, Pairwise, Random)}


def measure(name: str, **options) -> CurvatureMeasure:
    """A measure by name; register others in MEASURES."""
    if name not in MEASURES:
        raise KeyError(f"no measure {name!r}: {sorted(MEASURES)}")
    return MEASURES[name](**options)

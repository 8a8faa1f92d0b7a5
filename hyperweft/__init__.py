"""Hypergraph curvature and clustering analytics on Spark."""

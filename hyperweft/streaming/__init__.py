"""Incremental versions of incidence statistics."""

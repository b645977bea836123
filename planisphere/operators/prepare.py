"""Reduction of long vectors before neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame

from planisphere.functions.vectors import vector_dim


def preprocess_pca(df: DataFrame, dims: int = 50) -> DataFrame:
    """Vectors of more than ``dims`` entries replaced by their ``dims`` leading principal coordinates."""
    from planisphere.methods.linear import fit_pca, project

    if vector_dim(df.limit(1)) <= dims:
        return df
    return project(df, fit_pca(df, dims))

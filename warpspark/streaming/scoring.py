"""Models over streams. An extension: the same projections as in batch, so they run on unbounded input."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators.forest import Forest


def assign_stream(stream: DataFrame, centroids: np.ndarray, radius: int | None = None) -> DataFrame:
    """stream with cluster and dist, stateless."""

    @F.pandas_udf("cluster int, dist double")
    def near(series: pd.Series) -> pd.DataFrame:
        if not len(series):
            return pd.DataFrame({"cluster": pd.Series([], dtype="int32"), "dist": pd.Series([], dtype="float64")})
        label, dist = kernels.nearest(np.stack(series.to_list()), centroids, radius)
        return pd.DataFrame({"cluster": label.astype(np.int32), "dist": dist})

    return stream.withColumn("nearest", near("series")).select(*stream.columns, "nearest.cluster", "nearest.dist")


def predict_stream(stream: DataFrame, forest: Forest) -> DataFrame:
    """stream with distribution."""
    trees = list(forest.trees().values())

    @F.pandas_udf("array<double>")
    def run(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        x = np.stack(features.to_list())
        return pd.Series(list(sum(t.distribution[t.leaves(x)] for t in trees) / len(trees)))

    return stream.withColumn("distribution", run("features"))

"""Cluster labels joined with static attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors


def joined(labels: DataFrame, attributes: DataFrame) -> DataFrame:
    """Rows of labels with their attributes; Spark sends the attributes around if it finds them small."""
    return labels.join(attributes, "id", "inner")


def missing(labels: DataFrame, attributes: DataFrame) -> DataFrame:
    return labels.join(attributes, "id", "left_anti")


def extra(labels: DataFrame, attributes: DataFrame) -> DataFrame:
    return attributes.join(labels, "id", "left_anti")


def align(labels: DataFrame, attributes: DataFrame, order: str = "id") -> tuple[DataFrame, int]:
    """The joined rows, and how many attribute rows no label asks for. A label without attributes is an error
    (the first in order is named)."""
    lost = missing(labels, attributes).orderBy(order).head(1)
    if lost:
        raise errors.MissingAttributes(id=lost[0]["id"])
    return joined(labels, attributes), extra(labels, attributes).agg(F.count("*")).first()[0]

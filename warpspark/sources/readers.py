"""CSV readers: an id and numbers in each row, read as text and judged strictly."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors

#: Fixed value: decimal numbers as the format allows them (casts accept more, such as blanks and type letters).
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass
class Table:
    """rows: (row, id, <names or series>) with row rising in the order of the file."""

    rows: DataFrame
    names: list[str]


def _number(raw: Column) -> Column:
    value = F.when(raw.rlike(NUMBER), raw.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def _position(rows: DataFrame, row: int) -> int:
    return rows.filter(F.col("row") < row).count()


def _read(spark: SparkSession, path: str, attributes: bool) -> tuple[DataFrame, list[str]]:
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise errors.SourceNotFound(path=path) from None
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise errors.EmptyDataset(path=path) from None
        raise
    if len(header) < 2:
        raise (errors.NoFeatureColumns if attributes else errors.EmptyDataset)(path=path)
    names = header[1:]
    cells = [f"c{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "_bad"]])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").csv(path)
    raw = raw.withColumn("row", F.monotonically_increasing_id()).persist()
    if not raw.head(1):
        raise errors.EmptyDataset(path=path)
    bad = raw.filter("_bad is not null").orderBy("row").head(1)
    if bad:
        got = len(next(csv.reader([bad[0]["_bad"]])))
        raise errors.InconsistentRowLength(row=_position(raw, bad[0]["row"]), id=bad[0]["c0"], expected=len(header), got=got)
    if raw.filter("c0 is null or c0 = ''").head(1):
        raise errors.EmptyId(path=path)
    first = raw.groupBy("c0").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1")
    later = raw.select("c0", "row").join(first, "c0").filter("row > first")
    twice = later.groupBy("c0", "first").agg(F.min("row").alias("second")).orderBy("second").head(1)
    if twice:
        raise errors.DuplicateId(id=twice[0]["c0"], first=_position(raw, twice[0]["first"]), second=_position(raw, twice[0]["second"]))
    values = F.array(*[F.struct(F.lit(i).alias("col"), F.coalesce(F.col(c), F.lit("")).alias("raw"), _number(F.col(c)).alias("value")) for i, c in enumerate(cells[1:])])
    wrong = raw.select("row", F.explode(F.filter(values, lambda v: v["value"].isNull())).alias("v")).orderBy("row", "v.col").head(1)
    if wrong:
        raise errors.NonFiniteCell(row=_position(raw, wrong[0]["row"]), column=wrong[0]["v"]["col"], raw=wrong[0]["v"]["raw"])
    return raw.select("row", F.col("c0").alias("id"), *[_number(F.col(c)).alias(c) for c in cells[1:]]), names


def read_series(spark: SparkSession, path: str) -> Table:
    """(row, id, series). The header's names of the times are not used."""
    rows, names = _read(spark, path, False)
    return Table(rows.select("row", "id", F.array(*[f"c{i + 1}" for i in range(len(names))]).alias("series")), names)


def read_attributes(spark: SparkSession, path: str) -> Table:
    """(row, id, features), with the features' names from the header."""
    rows, names = _read(spark, path, True)
    return Table(rows.select("row", "id", F.array(*[f"c{i + 1}" for i in range(len(names))]).alias("features")), names)


def bad_cells(cells: DataFrame) -> DataFrame:
    """(id, col, raw) of text cells (id, col, raw) that are no finite numbers."""
    return cells.filter(_number(F.col("raw")).isNull())


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")

"""Warping distances as column functions (Arrow batches through the numpy kernels) and in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels, series

STEPS = "array<struct<a: int, b: int>>"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, where each row begins)."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).astype(float, copy=False), offsets


def groups(a: pa.Array, b: pa.Array):
    """(rows, matrix of a, matrix of b) of rows of equal lengths; rows with a null are in none."""
    (va, oa), (vb, ob) = _flat(a), _flat(b)
    there = ~(a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False))
    shapes = np.stack([np.diff(oa), np.diff(ob)], 1)
    for n, m in np.unique(shapes[there], axis=0).tolist():
        at = np.flatnonzero(there & (shapes == (n, m)).all(axis=1))
        yield at, va[oa[at][:, None] + np.arange(n)], vb[ob[at][:, None] + np.arange(m)]


def _require_band(x: np.ndarray, y: np.ndarray, radius: int | None) -> None:
    if radius is not None and abs(x.shape[1] - y.shape[1]) > radius:
        raise ValueError("the band is narrower than the difference of the lengths")


def _doubles(found: np.ndarray, a: pa.Array, b: pa.Array) -> pa.Array:
    missing = a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)
    return pa.array(found, pa.float64(), mask=missing)


def dtw(a: Column, b: Column, radius: int | None = None) -> Column:
    """Null if a series is."""

    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.full(len(a), np.nan)
        for at, x, y in groups(a, b):
            _require_band(x, y, radius)
            out[at] = kernels.dtw(x, y, radius)
        return _doubles(out, a, b)

    return run(a, b)


def dtw_cutoff(a: Column, b: Column, cutoff: Column, radius: int | None = None) -> Column:
    """The distance, or infinity if it is above the cutoff."""

    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        out, limit = np.full(len(a), np.nan), c.to_numpy(zero_copy_only=False).astype(float)
        for at, x, y in groups(a, b):
            _require_band(x, y, radius)
            out[at] = kernels.dtw(x, y, radius, limit[at])
        return _doubles(out, a, b)

    return run(a, b, cutoff.cast("double"))


def dtw_cascade(a: Column, b: Column, cutoff: Column, radius: int | None = None) -> Column:
    """struct<distance, settled>: infinity if a bound already reaches the cutoff, else as dtw_cutoff, and what settled
    the pair (kernels.SETTLED). Spark runs Python functions on all rows below a CASE, so the bounds are tried inside."""

    @F.arrow_udf("struct<distance: double, settled: string>")
    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        out, by, limit = np.full(len(a), np.nan), np.zeros(len(a), np.int8), c.to_numpy(zero_copy_only=False).astype(float)
        for at, x, y in groups(a, b):
            _require_band(x, y, radius)
            out[at], by[at] = kernels.cascade(x, y, radius, limit[at])
        return pa.StructArray.from_arrays([_doubles(out, a, b), pa.array(kernels.SETTLED).take(pa.array(by))], ["distance", "settled"])

    return run(a, b, cutoff.cast("double"))


def dtw_pruned(a: Column, b: Column, cutoff: Column, radius: int | None = None) -> Column:
    """Infinity if a bound already reaches the cutoff, else as dtw_cutoff."""
    return dtw_cascade(a, b, cutoff, radius)["distance"]


def _paths(a: pa.Array, b: pa.Array, radius_of) -> pa.Array:
    """An array of steps for each row; null if a series is. radius_of: rows -> (rows, radius) parts."""
    count, steps = np.zeros(len(a), np.int64), []
    for at, x, y in groups(a, b):
        for part, radius in radius_of(at):
            where = np.searchsorted(at, part)
            _require_band(x, y, radius)
            size = kernels.path_batch(x.shape[1], y.shape[1], radius)
            for low in range(0, len(part), size):
                some = where[low : low + size]
                _, row, i, j = kernels.paths(x[some], y[some], radius)
                count[at[some]] = np.bincount(row, minlength=len(some))
                steps.append((at[some][row], i, j))
    row, i, j = (np.concatenate(v) for v in zip(*steps)) if steps else (np.empty(0, np.int64),) * 3
    order = np.argsort(row, kind="stable")
    values = pa.StructArray.from_arrays([pa.array(i[order], pa.int32()), pa.array(j[order], pa.int32())], ["a", "b"])
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    missing = np.append(a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=missing if missing.any() else None), values)


def dtw_path(a: Column, b: Column, radius: int | None = None) -> Column:
    @F.arrow_udf(STEPS)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _paths(a, b, lambda at: [(at, radius)])

    return run(a, b)


def dtw_native(a: Column, b: Column, radius: int | None = None) -> Column:
    """The distance as nested folds; slower than dtw(), with no Python on the executors."""
    inf = float("inf")
    m = F.size(b)
    start = F.concat(F.array(F.lit(0.0)), F.array_repeat(F.lit(inf), m))

    def one_row(state: Column, i: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            d = F.get(a, i) - F.get(b, j)
            best = F.least(F.get(state, j), F.get(state, j + 1), F.element_at(row, -1))
            inside = F.lit(True) if radius is None else F.abs(i - j) <= radius
            return F.concat(row, F.array(F.when(inside, best + d * d).otherwise(inf)))

        return F.aggregate(F.sequence(F.lit(0), m - 1), F.array(F.lit(inf)), cell)

    return F.sqrt(F.element_at(F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, one_row), -1))


def register(spark: SparkSession) -> None:
    """dtw, dtw_path, z_normalize and derivative for SQL strings; radius is the third argument, 0 for none."""

    def by_radius(r: pa.Array):
        radii = r.to_numpy(zero_copy_only=False)
        return lambda at: [(at[radii[at] == k], int(k) or None) for k in np.unique(radii[at])]

    @F.arrow_udf(T.DoubleType())
    def distance(a: pa.Array, b: pa.Array, r: pa.Array) -> pa.Array:
        out, parts = np.full(len(a), np.nan), by_radius(r)
        for at, x, y in groups(a, b):
            for part, radius in parts(at):
                where = np.searchsorted(at, part)
                _require_band(x, y, radius)
                out[part] = kernels.dtw(x[where], y[where], radius)
        return _doubles(out, a, b)

    @F.arrow_udf(STEPS)
    def path(a: pa.Array, b: pa.Array, r: pa.Array) -> pa.Array:
        return _paths(a, b, by_radius(r))

    spark.udf.register("dtw", distance)
    spark.udf.register("dtw_path", path)
    # A value that is used twice is bound by a lambda over an array of one.
    mean = "aggregate(s, 0D, (a, x) -> a + x) / size(s)"
    moments = f"transform(array({mean}), m -> struct(m, sqrt(aggregate(s, 0D, (a, x) -> a + (x - m) * (x - m)) / size(s)) AS d))[0]"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION z_normalize(s ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(array({moments}), v -> transform(s, x -> (x - v.m) / v.d))[0]")
    slope = "((get(s, i) - get(s, i - 1)) + (get(s, i + 1) - get(s, i - 1)) / 2) / 2"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION derivative(s ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(sequence(1, size(s) - 2), i -> {slope})")

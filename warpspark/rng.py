"""Uniform numbers that depend on their key alone: the same on any partitioning, in Spark, numpy and SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(1 << 32)


def uniform(seed: int | Column, *keys: Column | str | int) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5 over seed and keys."""
    parts = [(k if isinstance(k, Column) else F.lit(str(k))).cast("string") for k in (seed, *keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / _SCALE


def uniform_value(seed: int, *keys) -> float:
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16) / _SCALE


def derived_seed(seed: int, *keys) -> int:
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:15], 16)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same as DuckDB SQL; keys are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0)"

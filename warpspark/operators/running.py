"""Running sums, ranks and order statistics over any number of rows, also within one key that holds most of them.

Rows are range-partitioned and sorted by key and order, and each partition is scanned by itself: its sums begin anew
with every key. Only a partition's first key can have begun before, so what it carries in follows from one row for
each partition (its first and last key, and the last key's sums), added up in order on the driver. No window, no task
with all rows of a key; the scanned table is written, so partitions stay what they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

_PART, _SEQ = "__partition", "__place"


def _scan(batches: Iterator[pa.RecordBatch], by: list[str], values: list[str], previous: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums of the values so far and the previous row's columns, by runs of equal keys, in the rows' order."""
    part, seen = TaskContext.get().partitionId(), 0
    key, sums, before = None, [0] * len(values), [None] * len(previous)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(c) for c in by]
        new = np.zeros(n, bool)
        for column in keys:
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        new[0] = tuple(column[0].as_py() for column in keys) != key
        key = tuple(column[-1].as_py() for column in keys)
        begin = np.flatnonzero(new)
        head = int(begin[0]) if len(begin) else n  # rows that go on with the last batch's key
        out = []
        for k, c in enumerate(values):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            run = np.cumsum(x)
            base = np.zeros(n, run.dtype)  # what the sums were when the key began
            base[begin] = run[begin] - x[begin]
            run = run - base[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
            run[:head] += run.dtype.type(sums[k])
            sums[k] = run[-1].item()
            out.append(pa.array(run))
        for k, c in enumerate(previous):
            column = batch.column(c)
            shifted = pa.concat_arrays([pa.array([before[k]], column.type), column.slice(0, n - 1)])
            out.append(pa.compute.if_else(pa.array(new), pa.scalar(None, column.type), shifted))
            before[k] = column[-1].as_py()
        place = pa.array(np.arange(seen, seen + n))
        seen += n
        names = [*batch.schema.names, *(f"run_{c}" for c in values), *(f"before_{c}" for c in previous), _PART, _SEQ]
        yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(n, part, np.int32)), place], names)


def running_sums(df: DataFrame, by: list[str], order: list[str], values: list[str], previous: tuple[str, ...] = ()) -> DataFrame:
    """df with run_<value> for each value (a long or double column without nulls): its sum over the rows of the same
    `by` columns up to this one, in the order of the `order` columns, which should settle every tie. previous: columns
    of which before_<column> is the row's before (null for a key's first)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    made = {f"run_{c}": kinds[c] for c in values} | {f"before_{c}": kinds[c] for c in previous}
    fields = [*df.schema.fields, *(T.StructField(c, kind) for c, kind in made.items()), T.StructField(_PART, T.IntegerType()), T.StructField(_SEQ, T.LongType())]
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = written(ranged.mapInArrow(lambda batches: _scan(batches, by, values, list(previous)), T.StructType(fields)), "scanned")
    last = F.max_by(F.struct(*dict.fromkeys([*by, *previous, *(f"run_{c}" for c in values)])), _SEQ)
    ends = rows.groupBy(_PART).agg(F.min_by(F.struct(F.lit(0).alias("_"), *by), _SEQ).alias("first"), last.alias("last")).orderBy(_PART).collect()  # a row for each partition
    carried, sums, key, before = [], [0] * len(values), None, ()
    for r in ends:
        first = tuple(r["first"][c] for c in by)
        if first == key:
            carried.append((r[_PART], *first, *sums, *before))
        else:
            sums = [0] * len(values)
        key = tuple(r["last"][c] for c in by)
        sums = [r["last"][f"run_{c}"] + (s if key == first else 0) for c, s in zip(values, sums)]
        before = tuple(r["last"][c] for c in previous)
    if not carried:
        return rows.drop(_PART, _SEQ)
    known = [T.StructField(_PART, T.IntegerType())]
    known += [T.StructField(f"__{k}_{c}", kinds[c]) for k, some in (("of", by), ("sum", values), ("before", previous)) for c in some]
    starts = F.broadcast(df.sparkSession.createDataFrame(carried, T.StructType(known)).withColumn("__there", F.lit(True)))  # a row for each partition at most
    here = F.coalesce(F.col("__there"), F.lit(False))
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    full = {f"run_{c}": F.col(f"run_{c}") + F.when(here, F.col(f"__sum_{c}")).otherwise(F.lit(0).cast(kinds[c])) for c in values}
    full |= {f"before_{c}": F.when(here & (F.col(_SEQ) == 0), F.col(f"__before_{c}")).otherwise(F.col(f"before_{c}")) for c in previous}
    return rows.join(starts, _PART, "left").withColumns(full).select(*df.columns, *made)


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with each row's number, from 1 on, among those of the same `by` columns."""
    return running_sums(df.withColumn("__one", F.lit(1).cast("long")), by, order, ["__one"]).withColumnRenamed("run___one", name).drop("__one")


def order_statistics(df: DataFrame, ranks: Column, by: str = "feature", value: str = "value") -> DataFrame:
    """(by, rank, value): the values of the given ranks (from 0 on) of each key's rows in rising order. df: (by, value);
    ranks: an array of longs made of the key's number of rows, the column `n`. Equal values are counted before the
    exchange; of those, a row each is scanned."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("count"))
    runs = running_sums(counts, [by], [value], ["count"])
    totals = runs.groupBy(by).agg(F.max("run_count").alias("n"))
    wanted = totals.select(by, F.explode(F.array_distinct(ranks)).alias("rank"))
    upto = F.col("run_count")
    at = wanted.groupBy(by).agg(F.sort_array(F.collect_list("rank")).alias("ranks"))  # as many as were asked for
    found = runs.join(F.broadcast(at), by).select(by, value, F.explode(F.filter("ranks", lambda r: (r < upto) & (r >= upto - F.col("count")))).alias("rank"))
    return found.select(by, "rank", value)


def quantiles(df: DataFrame, parts: int, by: str = "feature", value: str = "value") -> DataFrame:
    """(by, low, high, edges): the least and greatest value of each key and its parts - 1 inner quantiles by linear
    interpolation, in order. Exact; a key's state is its 2 * parts order statistics."""
    last = F.col("n") - 1
    place = lambda k: last * F.lit(k) / F.lit(parts)
    floors = [F.floor(place(k)) for k in range(parts + 1)]
    ranks = F.array(*floors, *[F.least(f + 1, last) for f in floors])
    found = order_statistics(df.select(by, value), ranks, by, value)
    n = df.groupBy(by).agg(F.count(value).alias("n"))
    maps = found.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("at")).join(n, by)

    def edge(k: int) -> Column:
        f = F.floor(place(k))
        a, b, t = F.element_at("at", f), F.element_at("at", F.least(f + 1, last)), place(k) - f
        return F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)

    return maps.select(by, F.element_at("at", F.lit(0).cast("long")).alias("low"), F.element_at("at", last).alias("high"), F.array(*[edge(k) for k in range(1, parts)]).alias("edges"))


def inner_edges(df: DataFrame, parts: int, by: str = "feature", value: str = "value") -> DataFrame:
    """(by, edges): each key's inner quantiles without repeats, strictly within its range; none for a constant."""
    inside = lambda e: (e > F.col("low")) & (e < F.col("high"))
    return quantiles(df, parts, by, value).select(by, F.filter(F.array_distinct("edges"), inside).alias("edges"))

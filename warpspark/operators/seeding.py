"""Choice of first centroids. All draws are uniform numbers keyed by (seed, round, id), so the ways for a matrix
and for a DataFrame choose the same rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..rng import uniform, uniform_value
from ..scratch import written
from .barycenter import keyed_numbers
from .pairwise import against, assign, matrix
from .running import running_sums


def first_choice(df: DataFrame, seed: int) -> int:
    return df.select("id").orderBy(uniform(seed, "first", F.col("id")), "id").first()["id"]


def least_squares(df: DataFrame, chosen: np.ndarray, radius: int | None) -> DataFrame:
    """(id, d2): squared distance to the nearest of the chosen series."""
    return assign(df, chosen, radius).select("id", F.pow("dist", F.lit(2)).alias("d2"))


def exponential_race(weights: DataFrame, seed: int, round_: int) -> DataFrame:
    """(id): one row, drawn with chances as the weights `d2`: the least of -ln(1 - u) / weight. Needs no running
    sum, so it is one partial aggregate."""
    time = -F.ln(1 - uniform(seed, "race", round_, F.col("id"))) / F.col("d2")
    return weights.filter("d2 > 0").agg(F.min_by("id", F.struct(time, F.col("id"))).alias("id"))


def weighted_draw(weights: DataFrame, threshold: float) -> DataFrame:
    """(id): the first id at which the running sum of weights, by id, is above the threshold (a share of the
    total). weights: (id, w), none below 0. exponential_race() draws with one aggregate and is what seeding uses."""
    runs = running_sums(weights.select("id", "w"), [], ["id"], ["w"])
    total = runs.agg(F.max("run_w")).first()[0]
    return runs.filter(F.col("run_w") > F.lit(threshold) * F.lit(total)).agg(F.min("id").alias("id"))


def plus_plus(df: DataFrame, k: int, radius: int | None, seed: int) -> np.ndarray:
    """k series by D-squared weights."""
    return plus_plus_ids(df, k, radius, seed)[1]


def plus_plus_ids(df: DataFrame, k: int, radius: int | None, seed: int) -> tuple[list[int], np.ndarray]:
    """Ids and series of k rows by D-squared weights, one job for each. With nothing but copies left, the least
    unchosen id."""

    def values(i):
        return np.array(df.filter(F.col("id") == i).first()["series"])

    ids = [first_choice(df, seed)]
    chosen = [values(ids[0])]
    for r in range(1, k):
        row = exponential_race(least_squares(df, np.stack(chosen), radius), seed, r).first()
        ids.append(row["id"] if row["id"] is not None else df.filter(~F.col("id").isin(ids)).agg(F.min("id")).first()[0])
        chosen.append(values(ids[-1]))
    return ids, np.stack(chosen)


def plus_plus_runs(df: DataFrame, k: int, radius: int | None, seeds: list[int]) -> list[np.ndarray]:
    """plus_plus() for several seeds at once, a pass for each of the k draws: a task finds its own first row in each seed's
    race, and of these few the first is drawn."""
    chosen: list[list[np.ndarray]] = [[] for _ in seeds]
    ids: list[list[int]] = [[] for _ in seeds]
    for r in range(k):

        def run(batches: Iterator[pa.RecordBatch], r=r, at=[np.stack(c) if c else None for c in chosen]) -> Iterator[pa.RecordBatch]:
            first: dict[int, tuple] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, x = batch.column("id").to_numpy(), matrix(batch.column("series"))
                for n, seed in enumerate(seeds):
                    if r:
                        d = kernels.nearest(x, at[n], radius)[1]
                        open_ = np.flatnonzero(d > 0)
                        time = -np.log(1 - keyed_numbers(own[open_], seed, "race", r)) / d[open_] ** 2
                    else:
                        open_, time = np.arange(len(own)), keyed_numbers(own, seed, "first")
                    if len(open_):
                        i = np.lexsort((own[open_], time))[0]
                        found = float(time[i]), int(own[open_[i]]), x[open_[i]].tolist()
                        first[n] = min(first.get(n, found), found)
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int32()), *map(pa.array, zip(*first.values()))], ["nth", "time", "id", "series"])

        rows = df.select(F.col("id").cast("long").alias("id"), "series").mapInArrow(run, "nth int, time double, id long, series array<double>").collect()  # one for each seed and task
        for n in range(len(seeds)):
            found = min(((row["time"], row["id"], row["series"]) for row in rows if row["nth"] == n), default=None)
            if found is None:  # nothing but copies is left
                row = df.filter(~F.col("id").isin(ids[n])).orderBy("id").first()
                found = 0.0, row["id"], row["series"]
            ids[n].append(found[1])
            chosen[n].append(np.array(found[2]))
    return [np.stack(c) for c in chosen]


def plus_plus_cached(df: DataFrame, distances: DataFrame | None, k: int, seeds: list[int], radius: int | None = None) -> list[list[int]]:
    """plus_plus_ids() for several seeds at once from cached distances: a round is one job for all seeds, the least distance
    to the chosen ids by a join with those (few) ids. As each draw has its own number, the first ids are those of a smaller
    k. distances: (i, j, dist) of all pairs, if they are there already; without them a round makes those from its new ids
    to all rows, each id once whatever the number of seeds, so the cache has as many rows as the table for each id drawn."""
    spark = df.sparkSession
    chosen = [[first_choice(df, seed)] for seed in seeds]
    number = spark.createDataFrame(list(enumerate(map(str, seeds))), "nth int, seed string")
    cached: dict[int, DataFrame] = {}
    for r in range(1, k):
        ends = F.broadcast(spark.createDataFrame([(n, i) for n, ids in enumerate(chosen) for i in ids], "nth int, end long"))
        if distances is None:
            for some in _chunks(sorted({ids[-1] for ids in chosen} - set(cached)), 64):
                made = written(distances_from(df, some, radius), "cached")
                cached |= dict.fromkeys(some, made)
            every = reduce(DataFrame.unionByName, {id(part): part for part in cached.values()}.values())
            near = every.join(ends, "end").select("nth", "id", "dist")
        else:
            near = distances.join(ends, F.col("i") == F.col("end")).select("nth", F.col("j").alias("id"), "dist")
            near = near.unionByName(distances.join(ends, F.col("j") == F.col("end")).select("nth", F.col("i").alias("id"), "dist"))
        weights = near.groupBy("nth", "id").agg(F.pow(F.min("dist"), 2).alias("d2"))
        taken = ends.select("nth", F.col("end").alias("id"))
        weights = weights.join(taken, ["nth", "id"], "left_anti").filter("d2 > 0").join(F.broadcast(number), "nth")
        time = -F.ln(1 - uniform(F.col("seed"), "race", r, F.col("id"))) / F.col("d2")
        drawn = {row["nth"]: row["id"] for row in weights.groupBy("nth").agg(F.min_by("id", F.struct(time, F.col("id"))).alias("id")).collect()}
        for n, ids in enumerate(chosen):
            ids.append(drawn[n] if n in drawn else df.filter(~F.col("id").isin(ids)).agg(F.min("id")).first()[0])
    return chosen


def _chunks(some: list, size: int) -> list[list]:
    return [some[at : at + size] for at in range(0, len(some), size)]


def distances_from(df: DataFrame, ids: list[int], radius: int | None = None) -> DataFrame:
    """(end, id, dist) from each of a few rows, by their ids, to every row."""
    x = {r["id"]: np.array(r["series"]) for r in df.filter(F.col("id").isin(ids)).select("id", "series").collect()}
    end = F.element_at(F.array(*[F.lit(i).cast("long") for i in ids]), F.col("cluster") + 1)
    return against(df, np.stack([x[i] for i in ids]), radius).select(end.alias("end"), "id", "dist")


def bernoulli_round(weights: DataFrame, oversample: float, seed: int, round_: int) -> DataFrame:
    """(id): each row by itself with chance min(1, oversample * d2 / sum of d2)."""
    total = weights.agg(F.sum("d2").alias("cost"))  # one row
    joined = weights.crossJoin(F.broadcast(total))
    return joined.filter(uniform(seed, "bernoulli", round_, F.col("id")) < F.least(F.lit(1.0), oversample * F.col("d2") / F.col("cost"))).select("id")


def parallel(df: DataFrame, k: int, radius: int | None, seed: int, oversample: float = 2.0) -> np.ndarray:
    """K-Means||: about log2(k) rounds, each keeping rows by their share of the cost; candidates (some ℓ a
    round, so few) are then weighted by the rows nearest to them and reduced to k by weighted draws."""
    ids = {first_choice(df, seed)}
    series = lambda some: {r["id"]: np.array(r["series"]) for r in df.filter(F.col("id").isin(list(some))).collect()}
    found = series(ids)
    for r in range(max(1, math.ceil(math.log2(k)))):
        weights = least_squares(df, np.stack(list(found.values())), radius).persist()
        new = {row["id"] for row in bernoulli_round(weights, oversample, seed, r).collect()} - set(found)
        weights.unpersist()
        if new:
            found |= series(new)
    if len(found) < k:
        rest = [row["id"] for row in df.filter(~F.col("id").isin(list(found))).select("id").orderBy("id").limit(k - len(found)).collect()]
        found |= series(rest)
    ids, x = sorted(found), np.stack([found[i] for i in sorted(found)])
    if len(ids) == k:
        return x
    weight = np.zeros(len(ids))
    for row in assign(df, x, radius).groupBy("cluster").count().collect():
        weight[row["cluster"]] = row["count"]
    return x[reduce_weighted(x, weight, k, radius, seed)]


def reduce_weighted(x: np.ndarray, weight: np.ndarray, k: int, radius: int | None, seed: int) -> list[int]:
    def draw(w, *key):
        run = np.cumsum(w)
        return int(np.searchsorted(run, uniform_value(seed, *key) * run[-1], "right")) if run[-1] > 0 else -1

    chosen = [draw(weight, "reduce", 0)]
    best = np.full(len(x), np.inf)
    while len(chosen) < k:
        best = np.minimum(best, kernels.dtw(x, np.broadcast_to(x[chosen[-1]], x.shape), radius))
        w = weight * best**2
        w[chosen] = 0
        pick = draw(w, "reduce", len(chosen))
        chosen.append(pick if pick >= 0 else next(i for i in range(len(x)) if i not in chosen))
    return chosen


def plus_plus_local(x: np.ndarray, k: int, radius: int | None, seed: int, ids: np.ndarray | None = None) -> list[int]:
    """plus_plus() of a matrix of series in the order of ids: the same draws, so the same rows."""
    ids = np.arange(len(x)) if ids is None else ids
    chosen = [int(np.lexsort((ids, keyed_numbers(ids, seed, "first")))[0])]
    best = np.full(len(x), np.inf)
    for r in range(1, k):
        last = chosen[-1]
        best = np.minimum(best, kernels.dtw(x, np.broadcast_to(x[last], x.shape), radius))
        open_ = np.flatnonzero(best > 0)
        if len(open_):
            time = -np.log(1 - keyed_numbers(ids[open_], seed, "race", r)) / best[open_] ** 2
            chosen.append(int(open_[np.lexsort((ids[open_], time))[0]]))
        else:
            chosen.append(next(i for i in range(len(x)) if i not in chosen))
    return chosen


def parallel_local(x: np.ndarray, k: int, radius: int | None, seed: int, oversample: float = 2.0, ids: np.ndarray | None = None) -> list[int]:
    """parallel() of a matrix of series in the order of ids: the same draws, so the same rows."""
    ids = np.arange(len(x)) if ids is None else ids
    near = lambda c: kernels.dtw(x, np.broadcast_to(x[c], x.shape), radius)
    found = {int(np.lexsort((ids, keyed_numbers(ids, seed, "first")))[0])}
    best = near(next(iter(found)))
    for r in range(max(1, math.ceil(math.log2(k)))):
        cost = (best**2).sum()
        if cost == 0:
            break
        new = set(np.flatnonzero(keyed_numbers(ids, seed, "bernoulli", r) < np.minimum(1, oversample * best**2 / cost)).tolist()) - found
        for i in new:
            best = np.minimum(best, near(i))
        found |= new
    for i in range(len(x)):
        if len(found) >= k:
            break
        found.add(i)
    rows = sorted(found)
    if len(rows) == k:
        return rows
    d = np.stack([near(i) for i in rows])
    weight = np.bincount(d.argmin(axis=0), minlength=len(rows)).astype(float)
    return [rows[i] for i in reduce_weighted(x[rows], weight, k, radius, seed)]

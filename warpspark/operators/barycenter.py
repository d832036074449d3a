"""Averages of series under warping, by partial sums over all tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions import kernels
from ..rng import uniform, uniform_value
from ..scratch import written
from .pairwise import integers, matrix, medoid

PART_MEMBERS = 50_000  # members that one subgradient pass takes one after the other
GROUP_VALUES = 4_000_000  # numbers of a group that a task averages whole: 32 MB


def element_mean(df: DataFrame, group: str) -> DataFrame:
    """(group, pos, value): the mean at each place; native."""
    return df.select(F.col(group).alias("group"), F.posexplode("series").alias("pos", "v")).groupBy("group", "pos").agg(F.avg("v").alias("value"))


AVERAGE_SCHEMA = "group long, centroid array<double>, converged boolean, iterations long, change double, mode string"


def averages(df: DataFrame, group: str, radius: int | None = None, method: str = "dba", init: str = "mean", max_iter: int = 10, tol: float = 1e-5, fraction: float = 1.0, seed: int = 42, max_epochs: int = 20) -> DataFrame:
    """(group, centroid, converged, iterations, change, mode) of each group. A group of at most GROUP_VALUES numbers (all
    groups are counted first) is one task from the first step to the last; a larger one, which may hold any share of the
    rows, takes its steps over partial sums, one job each. Medoids to start from are found by tiles of pairs. Draws are keyed by id, so both ways give the same but for the
    rounding of sums. Larger groups are to be few, as their centroids go over the driver."""
    if method not in ("dba", "ssg") or init not in ("mean", "medoid"):
        raise errors.InvalidConfig(method=method, init=init)
    rows = df.select(F.col("id").cast("long").alias("id"), F.col(group).cast("long").alias("group"), "series")
    sizes = rows.groupBy("group").agg((F.sum(F.size("series")) <= GROUP_VALUES).alias("small")).persist()
    options = (radius, method, init, max_iter, tol, fraction, seed, max_epochs)
    found = None
    large = [r["group"] for r in sizes.filter("not small").orderBy("group").collect()]  # groups of over GROUP_VALUES numbers
    if large:
        found = _large_averages(rows.filter(F.col("group").isin(large)), large, *options)
        rows = rows.filter(~F.col("group").isin(large))
    small = _small_averages(rows, *options)
    sizes.unpersist()
    return small if found is None else small.unionByName(found)


def _mode(method: str, fraction: float) -> str:
    return "ssg" if method == "ssg" else "full" if fraction >= 1 else "stochastic"


def _small_averages(rows: DataFrame, radius: int | None, method: str, init: str, max_iter: int, tol: float, fraction: float, seed: int, max_epochs: int) -> DataFrame:
    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        start = np.flatnonzero(table.column("first").to_numpy(zero_copy_only=False)) if "first" in table.column_names else None
        ids, x = table.column("id").to_numpy(), matrix(table.column("series").combine_chunks())
        if method == "ssg":
            order = lambda epoch: np.lexsort((ids, keyed_numbers(ids, seed, "ssg", epoch)))
            centroid, converged, done, _ = kernels.ssg(x, radius, max_epochs, tol=tol, order=order)
            change = 0.0
        else:
            centroid, converged, done, change, _ = kernels.dba(x, radius, init, max_iter, tol, fraction, sample=lambda step: sample_places(ids, fraction, seed, step), start=x[start[0]] if start is not None else None)
        found = [table.column("group")[0].as_py(), centroid.tolist(), bool(converged), int(done), float(change), _mode(method, fraction)]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(found, (pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.int64(), pa.float64(), pa.string()))], ["group", "centroid", "converged", "iterations", "change", "mode"])

    if method == "dba" and init == "medoid":  # all pairs of a group are many tasks' work, its average is one's
        first = written(medoid(rows, "group", radius).select("group", "medoid"), "medoids")
        rows = rows.join(first, "group").select("id", "group", "series", (F.col("id") == F.col("medoid")).alias("first"))
    return rows.groupBy("group").applyInArrow(one, AVERAGE_SCHEMA)


def _large_averages(rows: DataFrame, names: list[int], radius: int | None, method: str, init: str, max_iter: int, tol: float, fraction: float, seed: int, max_epochs: int) -> DataFrame:
    spark = rows.sparkSession
    number = spark.createDataFrame(list(enumerate(names)), "cluster int, group long")
    members = rows.join(F.broadcast(number), "group").select("id", "cluster", "series").persist()
    start = means(members, len(names)) if init == "mean" or method == "ssg" else series_of(members, medoids(members, radius), len(names))
    steps = Steps(len(names))
    if method == "ssg":
        centroids = ssg_distributed(members, start, radius, max_epochs, tol=tol, seed=seed, record=steps)
        steps.change[:] = 0.0
    else:
        centroids = dba_distributed(members, start, radius, max_iter, tol, fraction, seed, record=steps)
    members.unpersist()
    found = [(int(g), centroids[c].tolist(), bool(steps.converged[c]), int(steps.done[c]), float(steps.change[c]), _mode(method, fraction)) for c, g in enumerate(names)]
    return spark.createDataFrame(found, AVERAGE_SCHEMA)


class Steps:
    """What became of each cluster: steps taken, whether it settled, the last change."""

    def __init__(self, k: int):
        self.done, self.converged, self.change = np.zeros(k, np.int64), np.zeros(k, bool), np.full(k, np.inf)


def means(members: DataFrame, k: int) -> np.ndarray:
    """The element means of clusters 0 .. k - 1, one row of numbers for each."""
    rows = element_mean(members, "cluster").collect()
    out = np.zeros((k, 1 + max((r["pos"] for r in rows), default=0)))
    for r in rows:
        out[r["group"], r["pos"]] = r["value"]
    return out


def series_of(members: DataFrame, ids: DataFrame, k: int) -> np.ndarray:
    """The series of one member (medoid) of each of k clusters."""
    rows = members.join(F.broadcast(ids.withColumnRenamed("medoid", "id")), "id").select("cluster", "series").collect()
    out = np.zeros((k, len(rows[0]["series"]) if rows else 0))
    for r in rows:
        out[r["cluster"]] = r["series"]
    return out


def align_partials(df: DataFrame, centroids: np.ndarray, radius: int | None = None) -> DataFrame:
    """(cluster, pos, total, n): one averaging step of all clusters. df: (cluster, series). Each task sums its
    own rows first, so what is shuffled is k rows of centroids for each task, whatever the size of a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = counts = None
        for batch in batches:
            if batch.num_rows:
                s, n = kernels.align_sums_by(matrix(batch.column("series")), batch.column("cluster").to_numpy().astype(np.int64), centroids, radius)
                sums, counts = (s, n) if sums is None else (sums + s, counts + n)
        if sums is not None:
            c, pos = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(pos, pa.int32()), pa.array(sums[c, pos]), pa.array(counts[c, pos])], ["cluster", "pos", "total", "n"])

    part = df.select("cluster", "series").mapInArrow(run, "cluster int, pos int, total double, n double")
    return part.groupBy("cluster", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _summed(parts: DataFrame, slots: int, length: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts), each (slots, length), of what so many tasks summed: (slot, pos, total, n). The driver adds up at most
    GROUP_VALUES rows, which spares a shuffle for each pass; more are added up by a shuffle."""
    if tasks * slots * length > GROUP_VALUES:
        parts = parts.groupBy("slot", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    rows = parts.toArrow()
    at = rows.column("slot").to_numpy() * length + rows.column("pos").to_numpy()
    return tuple(np.bincount(at, weights=rows.column(c).to_numpy(), minlength=slots * length).reshape(slots, length) for c in ("total", "n"))


def _slots(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    slot, pos = np.nonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(pos, pa.int32()), pa.array(sums[slot, pos]), pa.array(counts[slot, pos])], ["slot", "pos", "total", "n"])


_SLOTS = "slot int, pos int, total double, n double"


def run_sums(labelled: DataFrame, runs: int, k: int, length: int, tasks: int, counters: tuple[str, ...] = ()) -> tuple[np.ndarray, ...]:
    """(sums of series, members, squared distances, *counters) of the clusters of several runs: (runs, k, length), then
    (runs, k) each. labelled: (series, clusters, dists, *counters), arrays with a place for each run; tasks: its partitions."""
    extra = 1 + len(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((runs * k, length + extra)), np.zeros((runs * k, length + extra))
        for batch in batches:
            if batch.num_rows:
                label = integers(batch.column("clusters"))
                more = [matrix(batch.column("dists")) ** 2, *(matrix(batch.column(c)) for c in counters)]
                x = matrix(batch.column("series"))
                for r in range(runs):
                    order = np.argsort(label[:, r], kind="stable")
                    own = label[order, r]
                    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    values = np.concatenate([x, *(m[:, r : r + 1] for m in more)], 1)[order]
                    sums[r * k + own[starts]] += np.add.reduceat(values, starts, axis=0)
                    counts[r * k : r * k + k] += np.bincount(own, minlength=k)[:, None]
        yield _slots(sums, counts)

    sums, counts = _summed(labelled.select("series", "clusters", "dists", *counters).mapInArrow(run, _SLOTS), runs * k, length + extra, tasks)
    return sums[:, :length].reshape(runs, k, length), counts[:, 0].reshape(runs, k), *(sums[:, length + i].reshape(runs, k) for i in range(extra))


def dba_runs(labelled: DataFrame, centroids: np.ndarray, open_: np.ndarray, tasks: int, radius: int | None, max_iter: int = 10, tol: float = 1e-5) -> np.ndarray:
    """dba_distributed() of several runs at once: a step of all of them is one pass over labelled (series, clusters), whose
    arrays have a place for each run. centroids: (runs, k, length); runs that are not open_ stay."""
    runs, k, length = centroids.shape
    flat, going = centroids.reshape(-1, length).copy(), np.repeat(open_, k)
    chunk = max(1, GROUP_VALUES // length)
    for _ in range(max_iter):
        if not going.any():
            break

        def run(batches: Iterator[pa.RecordBatch], at=flat, going=going) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(at.shape), np.zeros(at.shape)
            for batch in batches:
                if batch.num_rows:
                    x, slot = matrix(batch.column("series")), integers(batch.column("clusters")) + k * np.arange(runs)
                    rows, places = np.nonzero(going[slot])
                    slot = slot[rows, places]
                    for s in range(0, len(rows), chunk):
                        found = kernels.align_sums_by(x[rows[s : s + chunk]], slot[s : s + chunk], at, radius)
                        sums, counts = sums + found[0], counts + found[1]
            yield _slots(sums, counts)

        sums, counts = _summed(labelled.select("series", "clusters").mapInArrow(run, _SLOTS), len(flat), length, tasks)
        new = np.where(counts > 0, sums / np.maximum(counts, 1), flat)
        going, flat = going & (np.abs(new - flat).max(axis=1) >= tol), new
    return flat.reshape(runs, k, length)


def members_sample(labelled: DataFrame, fraction: float, seed: int, round_no: int) -> DataFrame:
    """(id, cluster, series) of ceil(fraction n) members of each cluster, drawn anew for each round: those of the
    least keyed numbers. Cells of these numbers are counted, and finer ones where the sample ends, until what is
    left there is little."""
    keyed = labelled.select("id", "cluster", "series", F.floor(uniform(seed, "members", round_no, F.col("id")) * float(1 << 32)).alias("u"))
    sizes = {r["cluster"]: r["count"] for r in labelled.groupBy("cluster").count().collect()}
    need = {c: max(1, int(np.ceil(n * fraction))) for c, n in sizes.items()}
    prefix = dict.fromkeys(sizes, 0)  # the cell where a cluster's sample ends
    within = lambda shift: _any([(F.col("cluster") == c) & (F.shiftright("u", shift) == p) for c, p in prefix.items()])
    for shift in (20, 8):
        rows = keyed if shift == 20 else keyed.filter(within(20))
        counts = sorted(tuple(r) for r in rows.groupBy("cluster", F.shiftright("u", shift).alias("cell")).count().collect())  # 4,096 of a cluster
        done = set()
        for c, cell, n in counts:
            if c in done:
                continue
            prefix[c] = cell
            if need[c] <= n:
                done.add(c)
            else:
                need[c] -= n
    last: dict[int, list] = {}
    for r in keyed.filter(within(8)).select("cluster", "u", "id").collect():  # a 2^24th of the members
        last.setdefault(r["cluster"], []).append((r["u"], r["id"]))
    ends = {c: sorted(rows)[need[c] - 1] for c, rows in last.items()}
    taken = _any([(F.col("cluster") == c) & ((F.col("u") < u) | ((F.col("u") == u) & (F.col("id") <= i))) for c, (u, i) in ends.items()])
    return keyed.filter(taken).select("id", "cluster", "series")


def keyed_numbers(ids: np.ndarray, seed: int, *key) -> np.ndarray:
    """uniform() of each id."""
    return np.array([uniform_value(seed, *key, i) for i in ids.tolist()])


def sample_places(ids: np.ndarray, fraction: float, seed: int, round_no: int) -> np.ndarray:
    """members_sample() of one cluster's members: their places."""
    u = np.floor(np.array([uniform_value(seed, "members", round_no, i) for i in ids.tolist()]) * float(1 << 32))
    return np.sort(np.lexsort((ids, u))[: max(1, int(np.ceil(len(ids) * fraction)))])


def _any(conditions: list) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def dba_distributed(labelled: DataFrame, centroids: np.ndarray, radius: int | None, max_iter: int = 10, tol: float = 1e-5, fraction: float = 1.0, seed: int = 42, record: Steps | None = None) -> np.ndarray:
    """Averaging steps over a (cached) DataFrame until no centroid moves; only centroids come to the driver. As in
    kernels.dba each cluster stops by itself. Below a fraction of 1 each step is over a sample of the members."""
    centroids = centroids.copy()
    going = set(range(len(centroids)))
    for round_no in range(max_iter):
        new = centroids.copy()
        part = labelled.filter(F.col("cluster").isin(list(going)))
        if fraction < 1:
            part = members_sample(part, fraction, seed, round_no)
        for r in align_partials(part, centroids, radius).collect():  # k centroids
            new[r["cluster"], r["pos"]] = r["total"] / r["n"]
        change = np.abs(new - centroids).max(axis=1)
        centroids = new
        if record:
            some = sorted(going)
            record.done[some], record.change[some], record.converged[some] = round_no + 1, change[some], change[some] < tol
        going = {c for c in going if change[c] >= tol}
        if not going:
            break
    return centroids


def ssg_distributed(labelled: DataFrame, centroids: np.ndarray, radius: int | None, max_epochs: int = 20, rate: float = 0.1, decay: float = 0.01, tol: float = 1e-5, seed: int = 42, record: Steps | None = None) -> np.ndarray:
    """kernels.ssg of each cluster from the given means. The method takes members one after the other. A cluster of at most
    PART_MEMBERS is one stream, in an order drawn anew for each epoch. A larger one is cut into as many parts as it has
    PART_MEMBERS, by a hash of the id: in an epoch each part goes from the same centroid over its own members, and the mean
    of what the parts arrive at, weighted by their members, is the next centroid; the step size falls by the steps of the
    longest part. Tasks hold a batch of a part at a time; the rule depends on the number of members, not on partitions."""
    centroids = centroids.copy()
    sizes = {r["cluster"]: r["count"] for r in labelled.groupBy("cluster").count().collect()}  # clusters
    parts = [max(1, -(-sizes.get(c, 0) // PART_MEMBERS)) for c in range(len(centroids))]
    part = F.pmod(F.xxhash64("id"), F.element_at(F.array(*map(F.lit, parts)), F.col("cluster") + 1).cast("long")).cast("int")
    steps = dict.fromkeys(range(len(centroids)), 0)
    going = set(steps)
    for epoch in range(1, max_epochs + 1):
        at, before = centroids, dict(steps)

        def run(batches: Iterator[pa.RecordBatch], at=at, before=before) -> Iterator[pa.RecordBatch]:
            state: dict[tuple[int, int], list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                label, own, x = batch.column("cluster").to_numpy(), batch.column("part").to_numpy(), matrix(batch.column("series"))
                for c, q in np.unique(np.stack([label, own], 1), axis=0).tolist():
                    here = state.setdefault((c, q), [at[c].copy(), before[c], 0.0])
                    here[1], largest = kernels.ssg_pass(x[(label == c) & (own == q)], here[0], radius, here[1], rate, decay)
                    here[2] = max(here[2], largest)
            for (c, _), (centroid, n, largest) in state.items():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([centroid.tolist()], pa.list_(pa.float64())), pa.array([n - before[c]], pa.int64()), pa.array([float(largest)])], ["cluster", "centroid", "n", "largest"])

        order = labelled.filter(F.col("cluster").isin(list(going))).withColumn("part", part).withColumn("u", uniform(seed, "ssg", epoch, F.col("id")))
        dealt = order.repartition(max(1, sum(parts[c] for c in going)), "cluster", "part").sortWithinPartitions("cluster", "part", "u", "id").select("cluster", "part", "series")
        found = dealt.mapInArrow(run, "cluster int, centroid array<double>, n long, largest double").select("cluster", "n", "largest", F.posexplode("centroid").alias("pos", "v"))
        weighted = found.groupBy("cluster", "pos").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"), F.max("n").alias("n"), F.max("largest").alias("largest"))
        centroids = centroids.copy()
        for r in weighted.collect():  # k centroids
            c = r["cluster"]
            centroids[c, r["pos"]] = r["v"]
            steps[c] = before[c] + r["n"]
            if record:
                record.done[c], record.converged[c] = epoch, r["largest"] < tol
            if r["largest"] < tol:
                going.discard(c)
        if not going:
            break
    return centroids


def medoids(members: DataFrame, radius: int | None = None) -> DataFrame:
    """(medoid) of each cluster."""
    return medoid(members, "cluster", radius).select("medoid")

"""K-means under warping.

Two ways with one meaning. A table of at most TASK_VALUES numbers (its size is counted first) is sent to the
executors, and each restart runs there as one task (for a sweep over k LOCAL_VALUES counts). A larger one
stays where it is: all restarts take their steps together, each iteration is one pass that assigns and a few that average by
the method of the configuration, and just centroids and sums come to the driver. All draws (seeds, samples of members, their
orders) are keyed by id, so both ways give the same result but for the rounding of sums. Options that are dear stay what they
are and take their passes for each restart: medoids compare all pairs of a cluster, and the subgradient method takes a
cluster's members one by one, in one task for each cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions import kernels
from ..rng import derived_seed
from ..scratch import written
from . import barycenter, pairwise, seeding
from .barycenter import dba_distributed, medoids, ssg_distributed

LOCAL_VALUES = 8_000_000  # 64 MB
TASK_VALUES = LOCAL_VALUES  # of a table that a restart of fit() goes over in one task; at five millions that took less than shared passes


@dataclass(frozen=True)
class KMeansConfig:
    k: int
    n_init: int = 10
    max_iter: int = 75
    tol: float = 1e-4
    radius: int | None = 2
    seed: int = 42
    init: str = "kpp"
    oversample: float = 2.0
    elkan: bool = False
    centroid_method: str = "dba"
    dba_init: str = "mean"
    dba_fraction: float = 1.0
    dba_max_iter: int = 10
    dba_tol: float = 1e-5

    def __post_init__(self):
        if self.k < 1:
            raise errors.InvalidK(k=self.k)
        if self.n_init < 1 or self.max_iter < 1 or self.init not in ("kpp", "parallel") or self.centroid_method not in ("dba", "ssg") or self.dba_init not in ("mean", "medoid") or not 0 < self.dba_fraction <= 1:
            raise errors.InvalidConfig(config=self)


@dataclass
class KMeansResult:
    """assignments: (id, cluster, dist). On a stop at max_iter the centroids are one step newer than they."""

    assignments: DataFrame
    centroids: np.ndarray
    inertia: float
    converged: bool
    iterations: int
    n_init: int
    config: KMeansConfig
    skipped: int = 0  # distances that bounds kept between steps made needless (elkan)
    warped: int = 0  # distances that were made all the same (elkan)
    restarts: list[float] = field(default_factory=list)

    def sizes(self) -> DataFrame:
        return cluster_sizes(self.assignments, self.config.k)

    def members(self, cluster: int) -> DataFrame:
        return self.assignments.filter(F.col("cluster") == cluster).select("id")


def inertia(assignments: DataFrame) -> DataFrame:
    return assignments.agg(F.sum(F.col("dist") * F.col("dist")).alias("inertia"))


def cluster_sizes(assignments: DataFrame, k: int) -> DataFrame:
    """(cluster, n), empty ones too."""
    counts = assignments.groupBy("cluster").agg(F.count("*").alias("n"))
    every = assignments.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return every.join(counts, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def rescue(label: np.ndarray, x: np.ndarray, centroids: np.ndarray, k: int, radius: int | None, iteration: int) -> list[np.ndarray]:
    """Members of each cluster for its average. An empty one takes, of the largest (of ties the last), the member
    farthest from that centroid (of ties the last); labels stay."""
    members = [np.flatnonzero(label == c) for c in range(k)]
    for c in range(k):
        if len(members[c]):
            continue
        sizes = [len(m) for m in members]
        donor = max(range(k), key=lambda i: (sizes[i], i))
        if sizes[donor] <= 1:
            raise errors.EmptyCluster(label=c, iteration=iteration)
        d = kernels.dtw(x[members[donor]], np.broadcast_to(centroids[donor], (sizes[donor], x.shape[1])), radius)
        far = len(d) - 1 - int(np.argmax(d[::-1]))
        members[c] = members[donor][far : far + 1]
        members[donor] = np.delete(members[donor], far)
    return members


def fit_matrix(x: np.ndarray, cfg: KMeansConfig, seed: int, ids: np.ndarray | None = None, start: list[int] | None = None) -> tuple:
    """(label, dist, centroids, inertia, converged, iterations, skipped, warped) of one restart. start: places of the first
    centroids, drawn by the seed if not given."""
    ids = np.arange(len(x)) if ids is None else ids
    if start is not None:
        start = start[: cfg.k]
    elif cfg.init == "parallel":
        start = seeding.parallel_local(x, cfg.k, cfg.radius, seed, cfg.oversample, ids)
    else:
        start = seeding.plus_plus_local(x, cfg.k, cfg.radius, seed, ids)
    centroids, before, converged, skipped, warped, step = x[start].copy(), np.inf, False, 0, 0, 0
    label, lower, moves = np.zeros(len(x), np.int64), np.zeros((len(x), cfg.k)), np.zeros(cfg.k)
    for step in range(1, cfg.max_iter + 1):
        if cfg.elkan:
            label, dist, lower, made, spared = kernels.nearest_bounded(x, centroids, cfg.radius, label, np.maximum(lower - moves, 0.0))
            skipped, warped = skipped + int(spared.sum()), warped + int(made.sum())
        else:
            label, dist = kernels.nearest(x, centroids, cfg.radius)
        total = float((dist * dist).sum())
        if step > 1 and abs(before - total) < cfg.tol:
            converged = True
            break
        before, used = total, centroids
        members = rescue(label, x, centroids, cfg.k, cfg.radius, step)
        if cfg.centroid_method == "ssg":
            order = lambda m: lambda epoch: np.lexsort((ids[m], barycenter.keyed_numbers(ids[m], seed, "ssg", epoch)))
            centroids = np.stack([kernels.ssg(x[m], cfg.radius, order=order(m))[0] for m in members])
        else:
            some = lambda m: lambda step: barycenter.sample_places(ids[m], cfg.dba_fraction, seed, step)
            centroids = kernels.dba_groups(x, members, cfg.radius, cfg.dba_init, cfg.dba_max_iter, cfg.dba_tol, cfg.dba_fraction, list(map(some, members)))[0]
        moves = kernels.bound_moves(used, centroids, cfg.radius)
    return label, dist, centroids, total, converged, step, skipped, warped


def _validated(df: DataFrame, k: int) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.min(F.size("series")).alias("low"), F.max(F.size("series")).alias("high")).first()
    if row["n"] < k:
        raise errors.TooFewSeries(n=row["n"], k=k)
    if row["low"] != row["high"]:
        raise errors.UnequalLengths(shortest=row["low"], longest=row["high"])
    return row["n"], row["low"]


def gather(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and series in the order of ids; the caller has checked the size."""
    pdf = df.select("id", "series").toPandas().sort_values("id", kind="stable")
    return pdf["id"].to_numpy(), np.stack(pdf["series"].to_list())


def fit(df: DataFrame, cfg: KMeansConfig) -> KMeansResult:
    """df: (id long, series array<double>), ids unique. Of all restarts the one of least inertia, of ties the first."""
    df = df.select("id", "series").persist()  # may be dear to make
    try:
        n, length = _validated(df, cfg.k)
        if n * length <= min(LOCAL_VALUES, TASK_VALUES):
            return _fit_local(df, cfg)
        dealt = _dealt(df, n * length)
    finally:
        df.unpersist()
    return _fit_distributed(dealt, cfg)


def _fit_local(df: DataFrame, cfg: KMeansConfig) -> KMeansResult:
    spark = df.sparkSession
    ids, x = gather(df)
    sent = spark.sparkContext.broadcast((x, ids))  # LOCAL_VALUES numbers at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for restart in batch["id"]:
                label, dist, centroids, total, converged, steps, skipped, warped = fit_matrix(sent.value[0], cfg, derived_seed(cfg.seed, "restart", restart), sent.value[1])
                yield pd.DataFrame({"restart": [restart], "label": [label.tolist()], "dist": [dist.tolist()], "centroids": [centroids.ravel().tolist()], "inertia": [total], "converged": [converged], "iterations": [steps], "skipped": [skipped], "warped": [warped]})

    schema = "restart long, label array<int>, dist array<double>, centroids array<double>, inertia double, converged boolean, iterations long, skipped long, warped long"
    runs = spark.range(0, cfg.n_init, numPartitions=cfg.n_init).mapInPandas(run, schema).collect()
    best = min(runs, key=lambda r: (r["inertia"], r["restart"]))
    rows = pd.DataFrame({"id": ids, "cluster": np.array(best["label"], np.int32), "dist": np.array(best["dist"])})
    assignments = spark.createDataFrame(rows, "id long, cluster int, dist double")
    by_restart = [r["inertia"] for r in sorted(runs, key=lambda r: r["restart"])]
    return KMeansResult(assignments, np.array(best["centroids"]).reshape(cfg.k, -1), best["inertia"], best["converged"], best["iterations"], cfg.n_init, cfg, best["skipped"], best["warped"], by_restart)


def _rescued(labelled: DataFrame, stats: list, k: int, step: int) -> DataFrame:
    """rescue() on a DataFrame: labels of the members of each cluster for its average; those of `labelled` stay."""
    sizes = {r["cluster"]: r["n"] for r in stats}
    moved: dict[int, int] = {}
    for c in [c for c in range(k) if c not in sizes]:
        donor = max(sizes, key=lambda i: (sizes[i], i))
        if sizes[donor] <= 1:
            raise errors.EmptyCluster(label=c, iteration=step)
        far = labelled.filter((F.col("cluster") == donor) & ~F.col("id").isin(list(moved))).orderBy(F.desc("dist"), F.desc("id")).first()
        moved[far["id"]] = c
        sizes[donor] -= 1
        sizes[c] = 1
    label = F.col("cluster")
    for i, c in moved.items():  # fewer than k
        label = F.when(F.col("id") == i, c).otherwise(label)
    return labelled.select("id", label.cast("int").alias("cluster"), "series")


def _averaged(members: DataFrame, cfg: KMeansConfig, seed: int) -> np.ndarray:
    """The average of each cluster's members (id, cluster, series), by the method that cfg names."""
    if cfg.centroid_method == "dba" and cfg.dba_init == "medoid":
        centroids = barycenter.series_of(members, medoids(members, cfg.radius), cfg.k)
    else:
        centroids = barycenter.means(members, cfg.k)
    if cfg.centroid_method == "ssg":
        return ssg_distributed(members, centroids, cfg.radius, seed=seed)
    return dba_distributed(members, centroids, cfg.radius, cfg.dba_max_iter, cfg.dba_tol, cfg.dba_fraction, seed)


def _dealt(df: DataFrame, values: int) -> DataFrame:
    """(id, series) of a table of so many numbers, written once, in parts for all cores: what each pass reads."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(F.col("id").cast("long").alias("id"), "series")
    return written(rows.repartition(max(2 * cores, -(-values // pairwise.VALUES))), "series")


@dataclass
class _Run:
    """A restart of _fit_distributed()."""

    seed: int
    centroids: np.ndarray
    used: np.ndarray | None = None  # those of the last assignment
    moves: np.ndarray | None = None
    total: float = np.inf
    converged: bool = False
    step: int = 0
    skipped: int = 0
    warped: int = 0


def _fit_distributed(df: DataFrame, cfg: KMeansConfig, starts: list[np.ndarray] | None = None) -> KMeansResult:
    """The same steps as fit_matrix, with the same draws, as those are keyed by id. All restarts take their steps together: a
    pass over the table serves each of them. df: by _dealt(). starts: first centroids of each restart, as many as cfg.k or
    more."""
    df = df.persist()
    tasks = df.rdd.getNumPartitions()
    seeds = [derived_seed(cfg.seed, "restart", r) for r in range(cfg.n_init)]
    if starts is None:
        starts = [seeding.parallel(df, cfg.k, cfg.radius, seed, cfg.oversample) for seed in seeds] if cfg.init == "parallel" else seeding.plus_plus_runs(df, cfg.k, cfg.radius, seeds)
    runs = [_Run(seed, start[: cfg.k], moves=np.zeros(cfg.k)) for seed, start in zip(seeds, starts)]
    going, places = runs, list(range(len(runs)))
    state = pairwise.start_bounds_runs(df, cfg.k, len(runs))
    labelled = None
    for step in range(1, cfg.max_iter + 1):
        at = np.stack([run.centroids for run in going])
        last = labelled
        if cfg.elkan:  # the bounds of a step rest on those before, so each step is written
            bounded = pairwise.assign_bounded_runs(state, places, at, np.stack([run.moves for run in going]), cfg.radius)
            labelled = state = written(bounded, "bounds").persist()
        else:
            labelled = pairwise.assign_runs(df, at, cfg.radius).persist()
        sums, n, squares, *counts = barycenter.run_sums(labelled, *at.shape, tasks, ("warped", "spared") if cfg.elkan else ())
        if last is not None:
            last.unpersist()
        for i, run in enumerate(going):
            before, run.total, run.step, run.used = run.total, float(squares[i].sum()), step, run.centroids
            run.converged = step > 1 and abs(before - run.total) < cfg.tol
            if cfg.elkan:
                run.warped, run.skipped = run.warped + int(counts[0][i].sum()), run.skipped + int(counts[1][i].sum())
        places = [i for i, run in enumerate(going) if not run.converged]
        if not places:
            break
        found = _averaged_runs(labelled, going, places, sums, n, tasks, cfg, step)
        going = [going[i] for i in places]
        for run, centroids in zip(going, found):
            run.moves = kernels.bound_moves(run.used, centroids, cfg.radius)
            run.centroids = centroids
    labelled.unpersist()
    df.unpersist()
    best = min(runs, key=lambda run: run.total)  # of ties the first
    return KMeansResult(pairwise.assign(df, best.used, cfg.radius), best.centroids, best.total, best.converged, best.step, cfg.n_init, cfg, best.skipped, best.warped, [run.total for run in runs])


def _averaged_runs(labelled: DataFrame, runs: list[_Run], places: list[int], sums: np.ndarray, n: np.ndarray, tasks: int, cfg: KMeansConfig, step: int) -> list[np.ndarray]:
    """New centroids of the runs at some places. Full averages from the means take common passes; a run that has an empty
    cluster, or another method, takes its own."""
    common = np.zeros(len(runs), bool)
    if cfg.centroid_method == "dba" and cfg.dba_init == "mean" and cfg.dba_fraction >= 1:
        common[[i for i in places if (n[i] > 0).all()]] = True
    found = barycenter.dba_runs(labelled, sums / np.maximum(n, 1)[:, :, None], common, tasks, cfg.radius, cfg.dba_max_iter, cfg.dba_tol)
    for i in np.setdiff1d(places, np.flatnonzero(common)):
        own = labelled.select("id", "series", F.get("clusters", F.lit(int(i))).alias("cluster"), F.get("dists", F.lit(int(i))).alias("dist"))
        stats = [{"cluster": c, "n": int(n[i, c])} for c in np.flatnonzero(n[i]).tolist()]
        found[i] = _averaged(_rescued(own, stats, cfg.k, step), cfg, runs[i].seed)
    return [found[i] for i in places]


def moved_bounds(lower: Column, upper: Column, own: Column, moves: Column) -> Column:
    """Struct (lower, upper) of bounds after the centroids moved by `moves`: each lower bound falls by its centroid's
    move, to 0 at least, and the upper one rises by that of the row's own centroid."""
    low = F.zip_with(lower, moves, lambda x, m: F.greatest(F.lit(0.0), x - m))
    return F.struct(low.alias("lower"), (upper + F.get(moves, own)).alias("upper"))


def best_k(results: list[tuple[int, float]]) -> int | None:
    """The k of the largest second difference; of ties the last; with two or fewer, the first."""
    results = sorted(results)
    if len(results) <= 2:
        return results[0][0] if results else None
    bend = [(a[1] - 2 * b[1] + c[1], b[0]) for a, b, c in zip(results, results[1:], results[2:])]
    return max(bend)[1]


def best_k_table(inertias: DataFrame) -> DataFrame:
    """(best_k) of a table (k, inertia): one row, native. The table has one row for each k."""
    from pyspark.sql import Window

    w = Window.orderBy("k")
    bend = inertias.select("k", (F.lag("inertia").over(w) - 2 * F.col("inertia") + F.lead("inertia").over(w)).alias("bend"))
    return bend.agg(F.coalesce(F.max_by("k", F.when(F.col("bend").isNotNull(), F.struct("bend", "k"))), F.min("k")).alias("best_k"))


def optimize(df: DataFrame, min_k: int, max_k: int, cfg: KMeansConfig, distances: DataFrame | None = None) -> tuple[list[tuple[int, float]], int | None]:
    """Inertia of each k, and the elbow. First centroids are drawn once for each restart: the first k of those for max_k
    are those for k. A table of at most LOCAL_VALUES numbers takes two jobs, one for these draws and one in which every
    (k, restart) is a task; on a larger one the fits follow one another, each spread over the cluster. distances:
    (i, j, dist) of all pairs, for the draws."""
    if not 1 <= min_k <= max_k:
        raise errors.InvalidKRange(min_k=min_k, max_k=max_k)
    n, length = _validated(df, max_k)
    seeds = [derived_seed(cfg.seed, "restart", r) for r in range(cfg.n_init)]
    chosen = seeding.plus_plus_cached(df, distances, max_k, seeds) if distances is not None and cfg.init == "kpp" else None
    if n * length <= LOCAL_VALUES:
        results = _sweep_local(df, range(min_k, max_k + 1), cfg, seeds, chosen)
        return results, best_k(results)
    df = _dealt(df, n * length).persist()
    starts = None
    if cfg.init == "kpp":
        if chosen is None:
            starts = seeding.plus_plus_runs(df, max_k, cfg.radius, seeds)
        else:
            by = {r["id"]: np.array(r["series"]) for r in df.filter(F.col("id").isin(sorted({i for ids in chosen for i in ids}))).collect()}  # max_k for each restart
            starts = [np.stack([by[i] for i in ids]) for ids in chosen]
    results = [(k, _fit_distributed(df, replace(cfg, k=k), starts).inertia) for k in range(min_k, max_k + 1)]
    df.unpersist()
    return results, best_k(results)


def _sweep_local(df: DataFrame, ks: range, cfg: KMeansConfig, seeds: list[int], chosen: list[list[int]] | None) -> list[tuple[int, float]]:
    """(k, least inertia): the draws of all restarts are one job, the fits of all k and restarts another."""
    spark = df.sparkSession
    ids, x = gather(df)
    sent = spark.sparkContext.broadcast((x, ids))  # LOCAL_VALUES numbers at most
    starts: dict[int, list[int]] = {}
    if chosen is not None:
        starts = {r: np.searchsorted(ids, some).tolist() for r, some in enumerate(chosen)}
    elif cfg.init == "kpp":

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch["id"]:
                    yield pd.DataFrame({"restart": [r], "places": [seeding.plus_plus_local(sent.value[0], max(ks), cfg.radius, seeds[r], sent.value[1])]})

        starts = {r["restart"]: r["places"] for r in spark.range(0, len(seeds), numPartitions=len(seeds)).mapInPandas(draw, "restart long, places array<long>").collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"]:
                k, r = ks[number // len(seeds)], number % len(seeds)
                found = fit_matrix(sent.value[0], replace(cfg, k=k), seeds[r], sent.value[1], starts.get(r))
                yield pd.DataFrame({"k": [k], "inertia": [found[3]]})

    fits = spark.range(0, len(ks) * len(seeds), numPartitions=len(ks) * len(seeds)).mapInPandas(run, "k int, inertia double")
    return sorted((r["k"], r["inertia"]) for r in fits.groupBy("k").agg(F.min("inertia").alias("inertia")).collect())

"""Mini-batch K-means: a sampled batch for each step, exact assignment at the end."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions import kernels
from ..rng import derived_seed, uniform
from . import barycenter, seeding
from .kmeans import LOCAL_VALUES, KMeansConfig, KMeansResult, _validated, gather, inertia
from .pairwise import assign


@dataclass(frozen=True)
class MiniBatchConfig:
    k: int
    batch_size: int = 256
    max_iter: int = 200
    n_init: int = 3
    tol: float = 1e-4
    radius: int | None = 2
    seed: int = 42

    def __post_init__(self):
        if self.k < 1:
            raise errors.InvalidK(k=self.k)
        if min(self.batch_size, self.max_iter, self.n_init) < 1:
            raise errors.InvalidConfig(config=self)


def sample(df: DataFrame, n: int, seed: int, round_: int) -> DataFrame:
    """n rows without replacement (all, if there are fewer): the least keyed numbers."""
    return df.orderBy(uniform(seed, "batch", round_, F.col("id")), "id").limit(n)


def update(centroids: np.ndarray, counts: np.ndarray, x: np.ndarray, radius: int | None) -> float:
    """Moves centroids (in place) towards the batch, place by place, by 1 / rows seen; the largest move."""
    label, _ = kernels.nearest(x, centroids, radius)
    before = centroids.copy()
    for row, c in zip(x, label):
        counts[c] += 1
        centroids[c] += (row - centroids[c]) / counts[c]
    return float(np.sqrt(((centroids - before) ** 2).sum(axis=1)).max())


def fit(df: DataFrame, cfg: MiniBatchConfig) -> KMeansResult:
    """Steps see batch_size rows each. A table of bounded size is gathered once; else each step draws its batch
    in a job. Draws are keyed by id, so both ways see the same batches. The last assignment is distributed."""
    n, length = _validated(df, cfg.k)
    local = gather(df) if n * length <= LOCAL_VALUES else None
    df = df if local is not None else df.persist()  # stays for the result's assignment
    best = None
    for restart in range(cfg.n_init):
        seed = derived_seed(cfg.seed, "mini", restart)
        if local is not None:
            centroids = local[1][seeding.plus_plus_local(local[1], cfg.k, cfg.radius, seed, ids=local[0])].copy()
        else:
            centroids = seeding.plus_plus(df, cfg.k, cfg.radius, seed)
        counts, step, converged = np.zeros(cfg.k), 0, False
        for step in range(1, cfg.max_iter + 1):
            if local is not None:
                x = local[1][np.lexsort((local[0], barycenter.keyed_numbers(local[0], seed, "batch", step)))[: cfg.batch_size]]
            else:
                x = np.array([r["series"] for r in sample(df, cfg.batch_size, seed, step).collect()])
            if update(centroids, counts, x, cfg.radius) < cfg.tol:
                converged = True
                break
        found = assign(df, centroids, cfg.radius)
        total = inertia(found).first()["inertia"]
        if best is None or total < best.inertia:
            best = KMeansResult(found, centroids, total, converged, step, cfg.n_init, KMeansConfig(cfg.k, cfg.n_init, radius=cfg.radius, seed=cfg.seed))
    return best

"""The four commands: optimize, cluster, evaluate, predict. Each returns the summary that the CLI prints."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import series as S
from ..operators import evaluation, forest, kmeans, silhouette
from ..operators.align import align
from ..operators.trees import TreeConfig
from ..sources.readers import read_attributes, read_series
from ..sources.writers import ResultWriter

log = logging.getLogger("warpspark")


@dataclass(frozen=True)
class Preparation:
    normalize: bool = False
    derivative: bool = False


def load(spark: SparkSession, path: str, prepare: Preparation) -> tuple[DataFrame, DataFrame]:
    """((id, series), (id, name)): ids are numbered in the order of the file, which settles ties."""
    table = read_series(spark, path).rows
    numbered = table.withColumn("n", F.row_number().over(W.orderBy("row")).cast("long") - 1).persist()  # a file of one machine's size
    df = S.preprocess(numbered.select(F.col("n").alias("id"), "series"), prepare.normalize, prepare.derivative)
    return df.persist(), numbered.select(F.col("n").alias("id"), F.col("id").alias("name"))


def optimize(spark: SparkSession, data: str, experiment: str, out: str, min_k: int, max_k: int, cfg: kmeans.KMeansConfig, prepare: Preparation = Preparation(), with_silhouette: bool = False) -> dict:
    writer = ResultWriter(out, experiment)
    df, _ = load(spark, data, prepare)
    results, best = kmeans.optimize(df, min_k, max_k, cfg)
    score = None
    if with_silhouette and best and best > 1:
        found = kmeans.fit(df, replace(cfg, k=best))
        _, score = silhouette.silhouette(df, found.assignments.select("id", "cluster"), cfg.radius)
        log.info("silhouette of k = %s: %.6f", best, score)
    path = writer.write_optimize(df.count(), best, results, score)
    return {"command": "optimize", "experiment": experiment, "best_k": best, "results": [{"k": k, "inertia": v} for k, v in results], "artifact": path}


def cluster(spark: SparkSession, data: str, experiment: str, out: str, cfg: kmeans.KMeansConfig, prepare: Preparation = Preparation()) -> dict:
    writer = ResultWriter(out, experiment)
    df, names = load(spark, data, prepare)
    found = kmeans.fit(df, cfg)
    path = writer.write_cluster(found, names)
    return {"command": "cluster", "experiment": experiment, "k": cfg.k, "inertia": found.inertia, "converged": found.converged, "iterations": found.iterations, "artifact": path}


def evaluate(spark: SparkSession, data: str, attributes: str, experiment: str, out: str, cfg: kmeans.KMeansConfig, n_trees: int = 100, cv_folds: int = 5, max_depth: int | None = None, split: str = "exact", prepare: Preparation = Preparation()) -> dict:
    writer = ResultWriter(out, experiment)
    df, names = load(spark, data, prepare)
    found = kmeans.fit(df, cfg)
    table = read_attributes(spark, attributes)
    labels = found.assignments.join(names, "id").select(F.col("name").alias("id"), F.col("id").alias("n"), F.col("cluster").alias("label"))
    rows, dropped = align(labels, table.rows.select("id", "features"), "n")
    if dropped:
        log.warning("%s rows of attributes have no cluster", dropped)
    rows = rows.select(F.col("n").alias("id"), "features", "label").persist()
    model_cfg = forest.ForestConfig(n_trees, TreeConfig(split=split, max_depth=max_depth), seed=cfg.seed, oob=True)
    cv = evaluation.cross_validate(rows, model_cfg, cv_folds, table.names)
    model = forest.train(rows, model_cfg, table.names)
    oob, _ = forest.oob_score(model, rows)
    forest.save(model, writer.model_path)
    path = writer.write_evaluation(cv, oob, forest.importances(model.nodes, table.names))
    clusters = writer.write_cluster(found, names)
    return {"command": "evaluate", "experiment": experiment, "cv_accuracy_mean": cv["mean"], "cv_accuracy_std": cv["std"], "oob_accuracy": oob, "model": writer.model_path, "artifact": path, "cluster_artifact": clusters}


def predict(spark: SparkSession, model: str, attributes: str, experiment: str, out: str, top_k: int = 3) -> dict:
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    writer = ResultWriter(out, experiment)
    found = forest.load(spark, model)
    table = read_attributes(spark, attributes)
    if table.names != found.feature_names:
        log.warning("features are named %s, the model's %s", table.names, found.feature_names)
    rows = forest.predict_proba(found, table.rows.orderBy("row"))
    path = writer.write_predictions(rows.select(F.col("id").alias("name"), "distribution"), top_k)
    return {"command": "predict", "experiment": experiment, "n_basins": table.rows.count(), "artifact": path}

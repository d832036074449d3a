"""Confusion, metrics and cross-validation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..rng import uniform
from . import forest as RF
from .running import ranked


def confusion(df: DataFrame, n_classes: int) -> DataFrame:
    """(true_class, pred_class, n), dense. df: (label, predicted)."""
    spark = df.sparkSession
    every = spark.range(n_classes).select(F.col("id").cast("int").alias("true_class"), F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("pred_class"))
    counts = df.groupBy(F.col("label").cast("int").alias("true_class"), F.col("predicted").cast("int").alias("pred_class")).agg(F.count("*").alias("n"))
    return every.join(counts, ["true_class", "pred_class"], "left").na.fill(0, ["n"])


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg((F.col("label") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"))


def fold_stats(folds: DataFrame) -> DataFrame:
    """(mean, std) of the folds' accuracies, std of the population. folds: (fold, accuracy)."""
    return folds.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


def fold_accuracies(df: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, accuracy). df: (fold, label, predicted)."""
    return df.groupBy(F.col(fold).alias("fold")).agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) of a dense confusion table; 0 where there is nothing to divide by."""
    hit = F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)
    rows = matrix.groupBy(F.col("true_class").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    cols = matrix.groupBy(F.col("pred_class").alias("class")).agg(F.sum("n").alias("said"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    both = rows.join(cols, "class").select("class", "support", safe(F.col("tp"), F.col("said")).alias("precision"), safe(F.col("tp"), F.col("support")).alias("recall"))
    f1 = safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return both.select("class", "precision", "recall", f1.alias("f1"), "support")


def stratified_folds(df: DataFrame, n_folds: int, seed: int, label: str = "label") -> DataFrame:
    """df with fold: rows of each class in keyed order, dealt round robin. A class may hold nearly all rows."""
    nth = ranked(df.withColumn("__u", uniform(seed, "fold", F.col("id"))), [label], ["__u", "id"], "__nth")
    return nth.select(*df.columns, ((F.col("__nth") - 1) % n_folds).cast("int").alias("fold"))


def cross_validate(df: DataFrame, cfg: RF.ForestConfig, n_folds: int = 5, feature_names: list[str] | None = None) -> dict:
    """Accuracy of each fold, their mean and population deviation, one confusion table over all folds, and the
    importances of all trees."""
    if n_folds < 2:
        raise errors.InvalidFoldCount(n_folds=n_folds)
    few = df.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") < n_folds).orderBy("label").head(1)
    if few:
        raise errors.TooFewSamplesForFolds(label=few[0]["label"], count=few[0]["n"], n_folds=n_folds)
    folds = stratified_folds(df, n_folds, cfg.seed).persist()
    n_classes = folds.agg(F.max("label")).first()[0] + 1
    found, nodes = None, None
    for k in range(n_folds):
        model = RF.train(folds.filter(F.col("fold") != k), replace(cfg, seed=cfg.seed + k, oob=False), feature_names)
        part = RF.predict(model, folds.filter(F.col("fold") == k)).select("fold", "label", "predicted")
        found = part if found is None else found.unionByName(part)
        shifted = model.nodes.withColumn("tree_id", F.col("tree_id") + k * cfg.n_trees)
        nodes = shifted if nodes is None else nodes.unionByName(shifted)
    found = found.persist()
    each = fold_accuracies(found)
    by_fold = [r["accuracy"] for r in each.orderBy("fold").collect()]
    mean, std = fold_stats(each).first()
    matrix = confusion(found, n_classes)
    folds.unpersist()
    return {"fold_accuracies": by_fold, "mean": mean, "std": std, "confusion": matrix, "metrics": class_metrics(matrix), "importances": RF.importances(nodes, model.feature_names), "n_classes": n_classes}

"""Command line: python -m warpspark.cli {optimize,cluster,evaluate,predict} ..."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark import SparkConf
from pyspark.sql import SparkSession

from .operators.kmeans import KMeansConfig
from .operators.trees import SPLITS
from .plans import commands


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="warpspark")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--threads", type=int, default=0, help="local cores; 0: all")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, tuning: bool) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--experiment", required=True)
        c.add_argument("--output-dir", required=True)
        if tuning:
            c.add_argument("--data", required=True)
            c.add_argument("--n-init", type=int, default=10)
            c.add_argument("--max-iter", type=int, default=75)
            c.add_argument("--warping-window", type=int, default=2, help="0: no band")
            c.add_argument("--tol", type=float, default=1e-4)
            c.add_argument("--normalize", action="store_true")
            c.add_argument("--derivative", action="store_true")
            c.add_argument("--dba-init", choices=("mean", "medoid"), default="mean")
            c.add_argument("--dba-sample-fraction", type=float, default=1.0)
            c.add_argument("--centroid-method", choices=("dba", "ssg"), default="dba")
            c.add_argument("--elkan", action="store_true")
            c.add_argument("--init-strategy", choices=("kpp", "parallel"), default="kpp")
        return c

    c = command("optimize", True)
    c.add_argument("--min-k", type=int, required=True)
    c.add_argument("--max-k", type=int, required=True)
    c.add_argument("--silhouette", action="store_true")
    command("cluster", True).add_argument("--k", type=int, required=True)
    c = command("evaluate", True)
    c.add_argument("--k", type=int, required=True)
    c.add_argument("--attributes", required=True)
    c.add_argument("--cv-folds", type=int, default=5)
    c.add_argument("--n-trees", type=int, default=100)
    c.add_argument("--max-depth", type=int, default=None)
    c.add_argument("--split-method", choices=SPLITS, default="exact")
    c = command("predict", False)
    c.add_argument("--model", required=True)
    c.add_argument("--attributes", required=True)
    c.add_argument("--top-k", type=int, default=3)
    return p


def run(spark: SparkSession, argv: list[str]) -> dict:
    a = parser().parse_args(argv)
    if a.command == "predict":
        return commands.predict(spark, a.model, a.attributes, a.experiment, a.output_dir, a.top_k)
    cfg = KMeansConfig(
        k=getattr(a, "k", 1), n_init=a.n_init, max_iter=a.max_iter, tol=a.tol, radius=a.warping_window or None, seed=a.seed, init=a.init_strategy,
        elkan=a.elkan, centroid_method=a.centroid_method, dba_init=a.dba_init, dba_fraction=a.dba_sample_fraction,
    )
    prepare = commands.Preparation(a.normalize, a.derivative)
    if a.command == "optimize":
        return commands.optimize(spark, a.data, a.experiment, a.output_dir, a.min_k, a.max_k, cfg, prepare, a.silhouette)
    if a.command == "cluster":
        return commands.cluster(spark, a.data, a.experiment, a.output_dir, cfg, prepare)
    return commands.evaluate(spark, a.data, a.attributes, a.experiment, a.output_dir, cfg, a.n_trees, a.cv_folds, a.max_depth, a.split_method, prepare)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.ERROR if a.quiet else logging.INFO)
    builder = SparkSession.builder.config("spark.ui.enabled", "false")
    if not SparkConf().contains("spark.master"):  # spark-submit names the master of a cluster
        builder = builder.master(f"local[{a.threads or '*'}]")
    spark = builder.getOrCreate()
    import sys

    print(json.dumps(run(spark, sys.argv[1:] if argv is None else argv)))


if __name__ == "__main__":
    main()

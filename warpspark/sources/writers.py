"""JSON artifacts, one file for each result: {experiment}_{kind}.json."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions import series as S


class ResultWriter:
    def __init__(self, directory: str, experiment: str):
        if not re.fullmatch(r"[a-zA-Z0-9_-]+", experiment):
            raise errors.InvalidExperimentName(name=experiment)
        os.makedirs(directory, exist_ok=True)
        self.directory, self.experiment = directory, experiment

    def _write(self, kind: str, value: dict) -> str:
        path = os.path.join(self.directory, f"{self.experiment}_{kind}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"experiment": self.experiment, **value}, f, indent=2)
        return path

    def _stream(self, kind: str, value: dict, name: str, entries: Iterator[str], brackets: str) -> str:
        """Like _write(), with one more entry whose items come one by one, so that no list of all rows is held."""
        path = os.path.join(self.directory, f"{self.experiment}_{kind}.json")
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps({"experiment": self.experiment, **value}, indent=2)[:-2] + f',\n  "{name}": {brackets[0]}')
            for i, entry in enumerate(entries):
                f.write(("," if i else "") + "\n    " + entry)
            f.write(f"\n  {brackets[1]}\n}}")
        return path

    @property
    def model_path(self) -> str:
        return os.path.join(self.directory, f"{self.experiment}_model")

    def write_cluster(self, result, names: DataFrame) -> str:
        """names: (id, name). Assignments are in the order of names, one partition at a time on the driver; results for
        other programs of a cluster are written with `result.assignments.write`."""
        rows = result.assignments.join(names, "id").select("name", "cluster").orderBy("name").toLocalIterator()
        sizes = [r["n"] for r in result.sizes().orderBy("cluster").collect()]
        value = {
            "k": result.config.k, "inertia": result.inertia, "converged": result.converged, "iterations": result.iterations, "n_init_used": result.n_init,
            "centroids": result.centroids.tolist(), "cluster_sizes": sizes,
        }
        return self._stream("cluster", value, "assignments", (f"{json.dumps(r['name'])}: {r['cluster']}" for r in rows), "{}")

    def write_optimize(self, n: int, best: int | None, results: list[tuple[int, float]], silhouette: float | None = None) -> str:
        value = {"n_basins": n, "best_k": best, "results": [{"k": k, "inertia": v} for k, v in results]}
        return self._write("optimize", value | ({"silhouette": silhouette} if silhouette is not None else {}))

    def write_evaluation(self, cv: dict, oob: float | None, importances: DataFrame) -> str:
        cells = {(r["true_class"], r["pred_class"]): r["n"] for r in cv["confusion"].collect()}
        k = range(cv["n_classes"])
        return self._write("evaluate", {
            "cv_accuracy_mean": cv["mean"], "cv_accuracy_std": cv["std"], "fold_accuracies": cv["fold_accuracies"], "oob_accuracy": oob,
            "feature_importances": [r.asDict() for r in importances.orderBy("rank").collect()],
            "confusion_matrix": [[cells[i, j] for j in k] for i in k], "n_classes": cv["n_classes"],
            "class_metrics": [r.asDict() for r in cv["metrics"].orderBy("class").collect()],
        })

    def write_predictions(self, predictions: DataFrame, top: int) -> str:
        """predictions: (name, distribution)."""
        rows = ranked(predictions, top)
        return self._stream("predict", {"n_basins": predictions.count()}, "predictions", (json.dumps(r.asDict(True)) for r in rows.toLocalIterator()), "[]")


def ranked(predictions: DataFrame, top: int) -> DataFrame:
    """(basin_id, predicted_class, top_k); the class is the first of the ranking."""
    best = S.top_k(F.col("distribution"), top)
    return predictions.select(F.col("name").alias("basin_id"), best[0]["class"].alias("predicted_class"), best.alias("top_k"))

"""Running sums over ranges, against plain sums; one key holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpspark.operators import evaluation, forest, running, seeding


@pytest.fixture
def many(spark):
    """Runs the test with more ranges than there are keys."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums(many):
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 18 + ["b", None]), i, rng.randrange(-5, 1 << 60 if i == 7 else 9), float(i % 3)) for i in range(600)]
    df = many.createDataFrame(rows, "k string, i long, v long, w double").repartition(5)
    found = running.running_sums(df, ["k"], ["i"], ["v", "w"], ("v", "w"))
    assert found.columns == ["k", "i", "v", "w", "run_v", "run_w", "before_v", "before_w"]
    sums, before, want = {}, {}, []
    for k, i, v, w in rows:
        a, b = sums.get(k, (0, 0.0))
        sums[k] = a + v, b + w
        want.append((k, i, v, w, *sums[k], *before.get(k, (None, None))))
        before[k] = v, w
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[1]) == want
    whole = running.running_sums(df, [], ["i"], ["v"]).orderBy("i").select("run_v").collect()
    assert [r[0] for r in whole] == np.cumsum([r[2] for r in rows], dtype=object).tolist()
    assert running.running_sums(df.limit(0), ["k"], ["i"], ["v"]).count() == 0


def test_ranks_in_a_class_that_holds_nearly_all(many):
    df = many.range(500).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), F.array(F.lit(1.0)).alias("features"))
    folds = evaluation.stratified_folds(df, 4, 3).collect()
    assert len(folds) == 500 and sorted(folds[0].asDict()) == ["features", "fold", "id", "label"]
    for label, n in ((0, 450), (1, 50)):
        sizes = np.bincount([r["fold"] for r in folds if r["label"] == label])
        assert sizes.sum() == n and sizes.max() - sizes.min() <= 1
    nth = running.ranked(df, ["label"], ["id"]).filter("label = 0").orderBy("id").select("rank").collect()
    assert [r[0] for r in nth] == list(range(1, 451))


def test_quantiles_are_exact(many):
    rng = np.random.default_rng(2)
    columns = {0: rng.normal(size=301), 1: rng.integers(0, 3, 40).astype(float), 2: np.full(9, 4.0), 3: np.array([2.5]), 4: np.concatenate([np.full(200, 1.0), rng.uniform(size=50)])}
    rows = [(f, float(v)) for f, x in columns.items() for v in x]
    df = many.createDataFrame(rows, "feature int, value double").repartition(4)
    found = {r["feature"]: r for r in running.quantiles(df, 16).collect()}
    edges = {r["feature"]: r["edges"] for r in running.inner_edges(df, 16).collect()}
    for f, x in columns.items():
        assert (found[f]["low"], found[f]["high"]) == (x.min(), x.max())
        assert np.allclose(found[f]["edges"], np.quantile(x, np.arange(1, 16) / 16), atol=1e-12)
        assert edges[f] == forest.feature_edges(x, 16).tolist()


def test_weighted_draw_and_exact_splits(many):
    w = many.range(1, 200).select("id", (F.col("id") % 7).cast("double").alias("w"))
    run = np.cumsum([i % 7 for i in range(1, 200)])
    for share in (0.0, 0.37, 0.999):
        assert seeding.weighted_draw(w, share).first()[0] == 1 + int(np.argmax(run > share * run[-1]))
    rows = [(float(i % 40), float(-(i % 3)), i % 40 >= 25) for i in range(400)]
    df = many.createDataFrame(rows, "x double, y double, label boolean")
    best = {r["feature"]: (r["threshold"], r["decrease"]) for r in forest.exact_splits(df, ["x", "y"], "label").collect()}
    assert best["x"] == (24.5, pytest.approx(400 * (1 - (250 / 400) ** 2 - (150 / 400) ** 2)))

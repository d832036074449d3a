from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpspark import errors
from warpspark.operators import evaluation, forest, levels
from warpspark.operators.trees import Tree, TreeConfig, feature_edges, grow, resolve_max_features


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(300):
        x = rng.uniform(0, 0.5, 10)
        x[:3] += 3 * (i % 3)
        rows.append((i, x.tolist(), i % 3))
    return spark.createDataFrame(rows, "id long, features array<double>, label int").persist()


@pytest.fixture(scope="module")
def model(table):
    return forest.train(table, forest.ForestConfig(n_trees=20))


@pytest.mark.parametrize("split", ["exact", "extra-trees", "histogram"])
def test_learns_three_classes(table, split):
    m = forest.train(table, forest.ForestConfig(n_trees=15, tree=TreeConfig(split=split)))
    assert evaluation.accuracy(forest.predict(m, table)).first()[0] > 0.95
    assert forest.oob_score(m, table)[0] > 0.8


def test_samples_dealt_by_shuffle(table, monkeypatch):
    monkeypatch.setattr(forest, "LOCAL_VALUES", 0)
    m = forest.train(table, forest.ForestConfig(n_trees=5))
    assert forest.oob_score(m, table)[0] > 0.8


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_trees_are_the_same_both_ways(table, monkeypatch, share):
    cfg = forest.ForestConfig(n_trees=4, bootstrap=share)
    key = lambda m: (sorted((r["tree_id"], r["node_id"], r["feature"], r["threshold"]) for r in m.nodes.collect()), sorted(tuple(r) for r in m.oob.collect()))
    one = key(forest.train(table, cfg))
    monkeypatch.setattr(forest, "LOCAL_VALUES", 0)
    assert one == key(forest.train(table.repartition(5), cfg))


@pytest.mark.parametrize("split,criterion", [("histogram", "gini"), ("histogram", "entropy"), ("exact", "gini"), ("exact", "entropy"), ("extra-trees", "gini"), ("extra-trees", "entropy")])
def test_level_trees_are_the_local_trees(spark, table, split, criterion):
    rng = np.random.default_rng(7)
    rows = [(i, [float(rng.integers(0, 4)), float(rng.normal()), 5.0, float(i % 7)], int(rng.integers(0, 3))) for i in range(250)]
    hard = spark.createDataFrame(rows, "id long, features array<double>, label int")
    few = hard.filter("id < 2")  # of some trees all rows are out of the bag
    options = [({"max_depth": 3, "bins": 8}, hard, 5), ({"bins": 32, "min_samples_leaf": 4, "max_features": "all"}, hard, 3), ({"max_features": 0.3}, table, 2), ({}, few, 6)]
    columns = "tree_id node_id is_leaf feature threshold left right n_samples prediction depth".split()
    if split != "histogram":
        options = [({"max_depth": 3}, hard, 3), ({"max_depth": 2, "min_samples_leaf": 4, "max_features": "all"}, hard, 2), ({"max_depth": 2, "max_features": 0.3}, table, 2), ({}, few, 6)]
    for options, rows, trees in options if criterion == "gini" else options[1:2] + options[3:]:
        cfg = forest.ForestConfig(trees, TreeConfig(split=split, criterion=criterion, **options))
        found = []
        for way in (False, True):
            model = forest.train(rows.repartition(5) if way else rows, replace(cfg, distributed=way))
            found.append(model.nodes.orderBy("tree_id", "node_id").collect())
        assert [[r[c] for c in columns] for r in found[0]] == [[r[c] for c in columns] for r in found[1]]
        for a, b in zip(*found):
            assert np.allclose(a["distribution"], b["distribution"]) and a["decrease"] == pytest.approx(b["decrease"], abs=1e-6) and a["impurity"] == pytest.approx(b["impurity"], abs=1e-9)
    assert max(r["depth"] for r in found[1]) <= 1


def test_depth_is_the_longest_way(model):
    parent = {(r["tree_id"], c): r["node_id"] for r in model.nodes.collect() for c in (r["left"], r["right"]) if c >= 0}
    depth = {}
    for r in model.nodes.orderBy("tree_id", "node_id").collect():  # parents first
        at = (r["tree_id"], r["node_id"])
        depth[at] = depth[(at[0], parent[at])] + 1 if at in parent else 0
        assert depth[at] == r["depth"]
    stats = {r["tree_id"]: r["depth"] for r in model.stats().collect()}
    assert stats == {t: max(v for (u, _), v in depth.items() if u == t) for t in stats} and max(stats.values()) >= 2


def test_samples_dealt_by_shuffle_have_their_share(table, monkeypatch):
    monkeypatch.setattr(forest, "LOCAL_VALUES", 0)
    m = forest.train(table, forest.ForestConfig(n_trees=20, bootstrap=0.5))
    assert m.oob.count() / (20 * 300) == pytest.approx(np.exp(-0.5), abs=0.03)
    assert forest.oob_score(m, table)[0] > 0.8


def test_cross_validation(table):
    cv = evaluation.cross_validate(table, forest.ForestConfig(n_trees=5), 5)
    assert cv["mean"] > 0.85 and len(cv["fold_accuracies"]) == 5
    assert sum(r["n"] for r in cv["confusion"].collect()) == 300
    with pytest.raises(errors.TooFewSamplesForFolds):
        evaluation.cross_validate(table.filter("label <> 0 or id < 9"), forest.ForestConfig(n_trees=1), 5)


def test_importances_and_persistence(table, model, spark, tmp_path):
    rows = forest.importances(model.nodes, model.feature_names).orderBy("rank").collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1) and {r["name"] for r in rows[:3]} == {"f0", "f1", "f2"}
    perm = {r["name"]: r["importance"] for r in forest.permutation_importances(model, table).collect()}
    assert abs(perm["f9"]) < 0.1 and max(perm.values()) > 0.02
    forest.save(model, str(tmp_path / "m"))
    again = forest.load(spark, str(tmp_path / "m"))
    a, b = (forest.predict(m, table).orderBy("id").select("distribution").collect() for m in (model, again))
    assert a == b
    assert model.stats().filter("n_nodes <> 2 * n_leaves - 1").count() == 0
    with pytest.raises(errors.PredictionFeatureMismatch):
        forest.predict(model, spark.createDataFrame([(0, [1.0])], "id long, features array<double>"))


def test_rows_walk_through_a_forest_that_is_not_sent(table, model, monkeypatch):
    rows = table.unionByName(table.filter("id < 9").selectExpr("id + 1000 AS id", "features", "label"))  # copies
    found = []
    for most in (1_000_000, 10):
        monkeypatch.setattr(forest, "SENT_NODES", most)
        proba = {r["id"]: r["distribution"] for r in forest.predict_proba(model, rows).collect()}
        votes = sorted(tuple(r) for r in forest.tree_votes(model, table, model.oob).collect())
        drops = {r["name"]: (r["importance"], r["std"]) for r in forest.permutation_importances(model, table, 3).collect()}
        found.append((proba, votes, drops))
    (p, v, d), (p2, v2, d2) = found
    assert len(p) == 309 and p.keys() == p2.keys() and all(np.allclose(p[i], p2[i]) for i in p) and v == v2 and v
    assert d.keys() == d2.keys() and all(np.allclose(d[i], d2[i]) for i in d)


def test_exact_cut_between_neighbouring_numbers(spark):
    near = [1.0, float(np.nextafter(1.0, 2)), float(np.nextafter(np.nextafter(1.0, 2), 2))]
    rows = spark.createDataFrame([(i, [near[i % 3]], int(i % 3 > 1)) for i in range(30)], "id long, features array<double>, label int")
    found = []
    for way in (False, True):
        m = forest.train(rows, forest.ForestConfig(2, TreeConfig(), distributed=way))
        found.append(sorted(tuple(r) for r in m.nodes.select("tree_id", "node_id", "threshold", "n_samples").collect()))
        assert evaluation.accuracy(forest.predict(m, rows)).first()[0] == 1
    assert found[0] == found[1] and len(found[0]) == 6


def test_trees():
    xor = grow(np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]]), np.array([0, 1, 1, 0]), 2, TreeConfig(max_features="all"), 1)
    assert len(xor) == 7 and (Tree(xor).predict(np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]])) == [0, 1, 1, 0]).all()
    assert len(grow(np.full((4, 1), 5.0), np.array([0, 0, 1, 1]), 2, TreeConfig(), 1)) == 1
    assert len(grow(np.array([[1.0], [10.0]]), np.array([0, 1]), 2, TreeConfig(min_samples_leaf=2), 1)) == 1
    assert grow(np.full((4, 1), 5.0), np.array([0, 0, 1, 1]), 2, TreeConfig(), 1)[0]["prediction"] == 1
    assert feature_edges(np.arange(1.0, 11), 4).tolist() == [3.25, 5.5, 7.75]
    assert resolve_max_features("sqrt", 10) == 4 and resolve_max_features("log2", 10) == 4 and resolve_max_features(0.5, 10) == 5
    for bad in (0, 11):
        with pytest.raises(errors.InvalidMaxFeatures):
            resolve_max_features(bad, 10)
    for options in ({"max_depth": 0}, {"min_samples_split": 1}, {"min_samples_leaf": 0}):
        with pytest.raises(errors.RfError):
            TreeConfig(**options)


def test_confusion_metrics(spark):
    rows = list(zip([0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 0, 1, 1, 1, 2, 2, 2, 0]))
    df = spark.createDataFrame(rows, "label int, predicted int")
    m = evaluation.class_metrics(evaluation.confusion(df, 3)).filter("class = 0").first()
    assert evaluation.accuracy(df).first()[0] == pytest.approx(6 / 9)
    assert (m["precision"], m["recall"], m["support"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 3)


def test_input_errors(spark):
    schema = "id long, features array<double>, label int"
    with pytest.raises(errors.EmptyTraining):
        forest.train(spark.createDataFrame([], schema), forest.ForestConfig(n_trees=1))
    with pytest.raises(errors.ZeroFeatures):
        forest.train(spark.createDataFrame([(0, [], 0)], schema), forest.ForestConfig(n_trees=1))
    with pytest.raises(errors.NonFiniteFeature):
        forest.train(spark.createDataFrame([(0, [float("inf")], 0)], schema), forest.ForestConfig(n_trees=1))
    with pytest.raises(errors.FeatureCountMismatch):
        forest.train(spark.createDataFrame([(0, [1.0], 0), (1, [1.0, 2.0], 0)], schema), forest.ForestConfig(n_trees=1))


def test_samples_of_levels_draw_a_number_once(spark):
    """A row's number follows the law's steps, and its digest stands in the plan once, not for each step."""
    ids = spark.range(200)
    found = forest.bootstrap_counts(ids, 3, 5, 0.7)
    for t in range(3):
        got = [r["n"] for r in found.filter(f"tree_id = {t}").orderBy("id").collect()]
        assert got == forest.bag_counts(np.arange(200), t, 5, 0.7).tolist()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_samples_of_levels_are_the_drawn_rows(spark):
    placed = spark.range(50).selectExpr("id", "int(id % 2) AS label", "array(double(id)) AS x")
    rows = levels._sampled(placed, lambda t, i: F.when(t == 1, 0).otherwise(i % 3).cast("int"), 0, 2)
    got = sorted((r["tree_id"], int(r["x"][0]), r["n"]) for r in rows.collect())
    assert got == sorted([(t, i, i % 3) for t in (0, 2) for i in range(50) if i % 3] + [(1, i, 1) for i in range(50)])  # 1 drew none

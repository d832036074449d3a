"""Random forest: trees by tasks or level by level, everything after that by DataFrame operations over the nodes.

The training table is sent to the executors if it has at most LOCAL_VALUES numbers (counted first), and each tree grows
in a task. Beyond that, trees grow level by level over the distributed table (levels.py), so that no task has a tree's or
a node's rows. Samples, the features of nodes and where extra-trees cut them are drawn from keyed numbers, so the trees
are the same either way.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import errors
from ..functions import series as S
from ..rng import derived_seed, uniform, uniform_value
from ..scratch import written
from .levels import grow_levels
from .pairwise import matrix
from .running import inner_edges, ranked, running_sums
from .trees import NODE_SCHEMA, Tree, TreeConfig, feature_edges, grow, keyed_features, keyed_shares, resolve_max_features

LOCAL_VALUES = 16_000_000
SENT_NODES = 1_000_000  # some 100 MB as arrays
FORMAT_VERSION = 2  # 2: nodes have a depth
FOREST_SCHEMA = f"tree_id int, {NODE_SCHEMA}"


@dataclass(frozen=True)
class ForestConfig:
    n_trees: int = 100
    tree: TreeConfig = TreeConfig()
    bootstrap: float = 1.0
    oob: bool = False
    seed: int = 42
    distributed: bool | None = None  # whether the training table stays where it is; by its size if None

    def __post_init__(self):
        if self.n_trees < 1:
            raise errors.InvalidTreeCount(n_trees=self.n_trees)
        if not 0 < self.bootstrap <= 1:
            raise errors.RfError(bootstrap=self.bootstrap)


@dataclass
class Forest:
    nodes: DataFrame
    n_trees: int
    n_features: int
    n_classes: int
    feature_names: list[str]
    oob: DataFrame | None = None  # (tree_id, id)

    def stats(self) -> DataFrame:
        """(tree_id, n_nodes, n_leaves, depth); a tree that is one leaf has depth 0."""
        return self.nodes.groupBy("tree_id").agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"), F.max("depth").alias("depth"))

    def sent(self, spark: SparkSession) -> Broadcast | None:
        """All trees, sent to the executors; None if they have over SENT_NODES nodes (counted first), which walk() is for."""
        return spark.sparkContext.broadcast(self.trees()) if self.nodes.limit(SENT_NODES + 1).count() <= SENT_NODES else None

    def trees(self) -> dict[int, Tree]:
        by: dict[int, list] = {}
        for r in self.nodes.collect():  # the model
            by.setdefault(r["tree_id"], []).append(r)
        return {t: Tree(rows) for t, rows in by.items()}


def bootstrap_counts(ids: DataFrame, n_trees: int, seed: int, share: float = 1.0) -> DataFrame:
    """(tree_id, id, n): how often each row is in each tree's sample, n = 0 being out of bag. Each row draws its
    own number from the Poisson law of mean share, the limit of share x rows draws with replacement, so no row needs
    the others."""
    return ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id")).select("tree_id", "id", times_drawn(F.col("tree_id"), F.col("id"), seed, share).alias("n"))


def times_drawn(tree: Column, id_: Column, seed: int, share: float) -> Column:
    """The number of bootstrap_counts(). Its digest is made once and not for each step of the law."""
    steps = poisson_steps(share)
    return S.let(uniform(seed, "bag", tree, id_), lambda u: sum(((u >= s).cast("int") for s in steps), F.lit(0)))


def poisson_steps(share: float) -> list[float]:
    """Bounds of the numbers 0, 1, ... of the Poisson law; beyond eleven nothing is left of 32 bits."""
    terms = np.exp(-share) * np.cumprod([1.0, *(share / k for k in range(1, 12))])
    return np.cumsum(terms).tolist()


def bag_counts(ids: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """bootstrap_counts() of one tree, for these ids."""
    return np.searchsorted(poisson_steps(share), [uniform_value(seed, "bag", tree, i) for i in ids.tolist()], "right")


def bootstrap_draws(spark: SparkSession, n: int, draws: int, n_trees: int, seed: int) -> DataFrame:
    """(tree_id, draw, row_idx): uniform draws of positions 0 .. n - 1 with replacement."""
    space = spark.range(n_trees * draws).select((F.col("id") / draws).cast("int").alias("tree_id"), (F.col("id") % draws).alias("draw"))
    return space.withColumn("row_idx", F.floor(uniform(seed, "draw", F.col("tree_id"), F.col("draw")) * n))


def _validated(df: DataFrame) -> tuple[int, int, int]:
    finite = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    row = df.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"), F.max("label").alias("top"), F.min(finite.cast("int")).alias("finite")).first()
    if not row["n"]:
        raise errors.EmptyTraining()
    if not row["high"]:
        raise errors.ZeroFeatures()
    if row["low"] != row["high"]:
        raise errors.FeatureCountMismatch(least=row["low"], most=row["high"])
    if not row["finite"]:
        raise errors.NonFiniteFeature()
    return row["n"], row["high"], row["top"] + 1


def train(df: DataFrame, cfg: ForestConfig, feature_names: list[str] | None = None) -> Forest:
    """df: (id, features array<double>, label int from 0), ids unique."""
    n, n_features, n_classes = _validated(df)
    resolve_max_features(cfg.tree.max_features, n_features)
    names = feature_names or [f"f{i}" for i in range(n_features)]
    spark = df.sparkSession
    counts = bootstrap_counts(df.select("id"), cfg.n_trees, cfg.seed, cfg.bootstrap)
    if n * (n_features + 1) <= LOCAL_VALUES if cfg.distributed is None else not cfg.distributed:
        pdf = df.select("id", "features", "label").toPandas().sort_values("id", kind="stable")
        ids, x, y = pdf["id"].to_numpy(), np.stack(pdf["features"].to_list()), pdf["label"].to_numpy()
        edges = [feature_edges(x[:, f], cfg.tree.bins) for f in range(n_features)] if cfg.tree.split == "histogram" else None
        sent = spark.sparkContext.broadcast((x, y, edges))  # LOCAL_VALUES numbers at most

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, y, edges = sent.value
            for batch in batches:
                for tree in batch["id"]:
                    rows = np.repeat(np.arange(n), bag_counts(ids, tree, cfg.seed, cfg.bootstrap))
                    rows = rows if len(rows) else np.arange(n)  # a few rows may all be out of the bag
                    chosen, share = keyed_features(cfg.seed, tree, n_features, cfg.tree), keyed_shares(cfg.seed, tree)
                    nodes = pd.DataFrame(grow(x[rows], y[rows], n_classes, cfg.tree, derived_seed(cfg.seed, "tree", tree), edges, chosen, share))
                    nodes.insert(0, "tree_id", tree)
                    yield nodes

        slices = min(cfg.n_trees, 4 * spark.sparkContext.defaultParallelism)
        nodes = spark.range(0, cfg.n_trees, numPartitions=slices).mapInPandas(run, FOREST_SCHEMA).persist()
    else:
        drawn = lambda tree, id_: times_drawn(tree, id_, cfg.seed, cfg.bootstrap)
        nodes = grow_levels(df.select("id", "features", "label"), n, drawn, n_features, cfg.n_trees, n_classes, cfg.tree, cfg.seed)
    oob = counts.filter("n = 0").select("tree_id", "id")
    return Forest(nodes, cfg.n_trees, n_features, n_classes, names, oob)


def walk(forest: Forest, rows: DataFrame) -> DataFrame:
    """rows with the leaf's `prediction` and `distribution`, for a forest of any size. rows: (tree_id, features, ...). Nodes
    stay a table: a step joins each row with its node and moves it on; rows that reach a leaf are done. Each step is written."""
    inner = ("is_leaf", "feature", "threshold", "left", "right", "prediction", "distribution")
    nodes = written(forest.nodes.select("tree_id", F.col("node_id").alias("__node"), *[F.col(c).alias(f"__{c}") for c in inner]), "nodes")
    depth = forest.nodes.agg(F.max("depth")).first()[0] or 0
    at, done = rows.withColumn("__node", F.lit(0)), []
    goes_left = F.get("features", F.col("__feature")) <= F.col("__threshold")
    for step in range(depth + 1):
        here = at.join(nodes, ["tree_id", "__node"])
        here = written(here, "walk") if step < depth else here
        done.append(here.filter("__is_leaf").select(*rows.columns, F.col("__prediction").alias("prediction"), F.col("__distribution").alias("distribution")))
        at = here.filter("not __is_leaf").select(*rows.columns, F.when(goes_left, F.col("__left")).otherwise(F.col("__right")).alias("__node"))
    return functools.reduce(DataFrame.unionByName, done)


def predict_proba(forest: Forest, df: DataFrame) -> DataFrame:
    """df with `distribution`: the mean of the trees' leaf distributions. A forest of at most SENT_NODES nodes goes along
    broadcast; rows walk through a larger one by joins, and their leaves are added up by position, class by class."""
    width = df.agg(F.max(F.size("features"))).first()[0]
    if width is not None and width != forest.n_features:
        raise errors.PredictionFeatureMismatch(expected=forest.n_features, got=width)
    sent = forest.sent(df.sparkSession)
    if sent is None:
        return _walked_proba(forest, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [sent.value[t] for t in sorted(sent.value)]
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("features"))
                mean = sum(t.distribution[t.leaves(x)] for t in trees) / len(trees)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean.tolist(), pa.list_(pa.float64()))], [*batch.schema.names, "distribution"])

    schema = T.StructType([*df.schema.fields, T.StructField("distribution", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)


def _walked_proba(forest: Forest, df: DataFrame) -> DataFrame:
    """Rows are named by a digest of their features, so copies walk once."""
    key = F.xxhash64("features").alias("__row"), F.xxhash64(F.lit(1), "features").alias("__row2")
    rows = written(df.select("*", *key), "to-predict")
    each = rows.groupBy("__row", "__row2").agg(F.first("features").alias("features"))
    each = each.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(forest.n_trees - 1))))
    leaves = walk(forest, each)
    mean = F.array(*[F.sum(F.get("distribution", F.lit(c))) / forest.n_trees for c in range(forest.n_classes)])
    return rows.join(leaves.groupBy("__row", "__row2").agg(mean.alias("distribution")), ["__row", "__row2"]).select(*df.columns, "distribution")


def predict(forest: Forest, df: DataFrame) -> DataFrame:
    return predict_proba(forest, df).withColumn("predicted", S.predicted_class(F.col("distribution")).cast("int"))


def tree_votes(forest: Forest, df: DataFrame, where: DataFrame) -> DataFrame:
    """(tree_id, id, label, vote) of the (tree_id, id) pairs in where."""
    return _votes(forest, where.join(df.select("id", "features", "label"), "id").select("tree_id", "id", "label", "features"))


def _votes(forest: Forest, rows: DataFrame) -> DataFrame:
    """rows with `vote` for `features`. rows: (tree_id, features, ...)."""
    keep = [c for c in rows.columns if c != "features"]
    sent = forest.sent(rows.sparkSession)
    if sent is None:
        return walk(forest, rows).select(*keep, F.col("prediction").alias("vote"))

    @F.arrow_udf("int")
    def vote(tree: pa.Array, features: pa.Array) -> pa.Array:
        out, trees = np.zeros(len(tree), np.int32), tree.to_numpy()
        x = matrix(features) if len(features) else np.empty((0, 0))
        for t in np.unique(trees):
            at = np.flatnonzero(trees == t)
            out[at] = sent.value[int(t)].predict(x[at])
        return pa.array(out)

    return rows.select(*keep, vote("tree_id", "features").alias("vote"))


def majority(votes: DataFrame) -> DataFrame:
    """(id, label, predicted): of ties the greatest class."""
    counts = votes.groupBy("id", "label", "vote").agg(F.count("*").alias("n"))
    return counts.groupBy("id", "label").agg(F.max_by("vote", F.struct("n", "vote")).alias("predicted"))


def oob_predictions(forest: Forest, df: DataFrame) -> DataFrame:
    """(id, label, predicted) of rows that some tree has not seen."""
    return majority(tree_votes(forest, df, forest.oob))


def oob_score(forest: Forest, df: DataFrame) -> tuple[float, int]:
    """(accuracy, rows)."""
    row = oob_predictions(forest, df).agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    if not row["n"]:
        raise errors.OobEvaluationFailed()
    return row["a"], row["n"]


def importances(nodes: DataFrame, feature_names: list[str]) -> DataFrame:
    """(name, importance, rank): decrease of impurity, as shares of each tree, then of all; native."""
    spark = nodes.sparkSession
    gains = nodes.filter(~F.col("is_leaf")).groupBy("tree_id", "feature").agg(F.sum("decrease").alias("g"))
    shares = gains.withColumn("g", F.try_divide("g", F.sum("g").over(W.partitionBy("tree_id"))))
    total = shares.groupBy("feature").agg(F.sum("g").alias("g"))
    names = spark.createDataFrame(list(enumerate(feature_names)), "feature int, name string")
    rows = names.join(total, "feature", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    rows = rows.withColumn("importance", F.coalesce(F.try_divide("g", F.sum("g").over(W.partitionBy())), F.lit(0.0)))
    return rows.select("name", "importance", F.row_number().over(W.orderBy(F.desc("importance"), "feature")).alias("rank"))


def permutation_importances(forest: Forest, df: DataFrame, seed: int = 42) -> DataFrame:
    """(name, importance, std, rank): mean drop of each tree's accuracy on its unseen rows when one feature is
    shuffled among them. Of a tree's unseen rows, the n-th by id gets the value of the n-th by numbers keyed with tree,
    feature and id; both numberings are running counts over ranges, so no task has all rows of a tree."""
    unseen = forest.oob.join(df.select("id", "features", "label"), "id").select("tree_id", "id", "label", "features")
    right = F.avg((F.col("label") == F.col("vote")).cast("double"))
    base = _votes(forest, unseen).groupBy("tree_id").agg(right.alias("base"))
    each = unseen.select("tree_id", "id", F.posexplode("features").alias("feature", "v"))
    drawn = ranked(each.withColumn("u", uniform(seed, "permute", F.col("tree_id"), F.col("feature"), F.col("id"))), ["tree_id", "feature"], ["u", "id"], "n")
    placed = ranked(each.select("tree_id", "feature", "id"), ["tree_id", "feature"], ["id"], "n")
    dealt = placed.join(drawn.select("tree_id", "feature", "n", "v"), ["tree_id", "feature", "n"]).select("tree_id", "id", "feature", "v")
    changed = dealt.join(unseen, ["tree_id", "id"])
    changed = changed.select("tree_id", "feature", "label", F.transform("features", lambda x, i: F.when(i == F.col("feature"), F.col("v")).otherwise(x)).alias("features"))
    after = _votes(forest, changed).groupBy("tree_id", "feature").agg(right.alias("after"))
    stats = after.join(base, "tree_id").groupBy("feature").agg(F.avg(F.col("base") - F.col("after")).alias("importance"), F.stddev_pop(F.col("base") - F.col("after")).alias("std"))
    names = df.sparkSession.createDataFrame(list(enumerate(forest.feature_names)), "feature int, name string")
    full = names.join(stats, "feature", "left").na.fill(0.0, ["importance", "std"])
    return full.select("name", "importance", "std", F.row_number().over(W.orderBy(F.desc(F.round("importance", 12)), "feature")).alias("rank"))


def save(forest: Forest, path: str) -> None:
    spark = forest.nodes.sparkSession
    forest.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    meta = [(FORMAT_VERSION, forest.n_trees, forest.n_features, forest.n_classes, forest.feature_names)]
    spark.createDataFrame(meta, "format_version int, n_trees int, n_features int, n_classes int, feature_names array<string>").write.mode("overwrite").parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Forest:
    m = spark.read.parquet(f"{path}/metadata").first()
    if m["format_version"] != FORMAT_VERSION:
        raise errors.ModelVersionMismatch(expected=FORMAT_VERSION, found=m["format_version"])
    return Forest(spark.read.parquet(f"{path}/nodes"), m["n_trees"], m["n_features"], m["n_classes"], list(m["feature_names"]))


# Splits of one node over a whole table: native.


def _long(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(label, feature, value): a row for each feature of each row."""
    every = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.col(label).alias("label"), F.explode(every).alias("v")).select("label", "v.*")


def exact_splits(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, threshold, decrease) of each feature's best Gini split. Values are counted by class first; the counts
    run over distinct values, range by range (running_sums), so a feature's values need not meet in one task."""
    long = _long(df, features, label)
    classes = sorted(r["label"] for r in long.select("label").distinct().collect())  # classes
    own = [f"c{i}" for i in range(len(classes))]
    by_class = [F.sum((F.col("label") == c).cast("long")).alias(name) for name, c in zip(own, classes)]
    counts = long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(*by_class)
    runs = running_sums(counts, ["feature"], ["value"], own, ("value",)).filter(F.col("before_value").isNotNull())
    totals = counts.groupBy("feature").agg(*[F.sum(c).alias(f"t_{c}") for c in own])  # a row for each feature
    left = [F.col(f"run_{c}") - F.col(c) for c in own]
    total = [F.col(f"t_{c}") for c in own]
    add = lambda parts: functools.reduce(operator.add, parts)
    n, nl = add(total), add(left)
    nr = n - nl
    # n I = n - sum(c^2) / n for Gini.
    decrease = add([x * x for x in left]) / nl + add([(t - x) * (t - x) for t, x in zip(total, left)]) / nr - add([t * t for t in total]) / n
    rows = runs.join(F.broadcast(totals), "feature").select("feature", ((F.col("before_value") + F.col("value")) / 2).alias("threshold"), decrease.alias("decrease"))
    best = F.max_by(F.struct("threshold", "decrease"), F.struct(F.round("decrease", 9), -F.col("threshold"))).alias("b")
    return rows.groupBy("feature").agg(best).select("feature", "b.threshold", "b.decrease")


def histogram_thresholds(df: DataFrame, features: list[str], bins: int) -> DataFrame:
    """(feature, threshold): the inner quantiles of each feature, exact and without a state that grows with its values."""
    edges = inner_edges(_long(df.withColumn("__none", F.lit(0)), features, "__none").filter(F.col("value").isNotNull()), bins)
    return edges.select("feature", F.explode("edges").alias("threshold"))


def threshold_splits(df: DataFrame, thresholds: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, threshold, decrease) of given thresholds (feature, threshold); few of them for each feature."""
    counts = _long(df, features, label).groupBy("feature", "value", "label").agg(F.count("*").alias("n"))
    sides = counts.join(thresholds, "feature").groupBy("feature", "threshold", "label").agg(F.sum(F.when(F.col("value") <= F.col("threshold"), F.col("n")).otherwise(0)).alias("l"), F.sum("n").alias("t"))
    sums = sides.groupBy("feature", "threshold").agg(F.sum("l").alias("nl"), F.sum(F.col("l") * F.col("l")).alias("l2"), F.sum("t").alias("n"), F.sum(F.col("t") * F.col("t")).alias("t2"), F.sum((F.col("t") - F.col("l")) * (F.col("t") - F.col("l"))).alias("r2"))
    decrease = F.try_divide("l2", "nl") + F.try_divide(F.col("r2"), F.col("n") - F.col("nl")) - F.col("t2") / F.col("n")
    return sums.select("feature", "threshold", decrease.alias("decrease"))


def feature_ranges(df: DataFrame, node: str, feature: str) -> DataFrame:
    """(node, n, low, high): the rows of each node and the range of a feature among them."""
    return df.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("n"), F.min(feature).alias("low"), F.max(feature).alias("high"))


def permuted(df: DataFrame, column: str, seed: int) -> DataFrame:
    """(id, v): the column's values dealt out anew: the n-th row by id gets the value of the n-th by keyed numbers. Both
    orders are numbered by running counts over ranges, so no task holds all rows."""

    drawn = ranked(df.select("id", F.col(column).alias("v"), uniform(seed, "permute", F.col("id")).alias("u")), [], ["u", "id"], "n").select("n", "v")
    return drawn.join(ranked(df.select("id"), [], ["id"], "n"), "n").select("id", "v")


def random_thresholds(df: DataFrame, features: list[str], seed: int) -> DataFrame:
    """(feature, threshold): one keyed draw in [min, max) for each feature that is not constant."""
    stats = df.agg(*[x for f in features for x in (F.min(F.col(f).cast("double")).alias(f"lo_{f}"), F.max(F.col(f).cast("double")).alias(f"hi_{f}"))])
    rows = stats.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"lo_{f}").alias("lo"), F.col(f"hi_{f}").alias("hi")) for f in features])).alias("s")).select("s.*")
    return rows.filter("lo < hi").select("feature", (F.col("lo") + uniform(seed, "extra", F.col("feature")) * (F.col("hi") - F.col("lo"))).alias("threshold"))

"""Trees grown level by level over a distributed table, all trees of a block at once.

A row stands once in each tree whose sample it is in, with the number of times it was drawn, its values (for histograms
its bins) and the path of its node. A level finds, for each feature that a node drew, the class counts on the left of
each cut it may make:
- histogram: counts by (tree, node, feature, bin), summed before the shuffle, run over a node's bins (at most 256 rows);
- extra-trees: the least and greatest value give the one cut, a second aggregate counts below it;
- exact: counts by (tree, node, feature, value), summed before the shuffle, run over ranges of values (running.py), so
  neither a node of all rows nor a feature without repeats is one task's.
The best split of each node is kept, and the table of splits is joined to the rows, which move on to a child or end in a
leaf. Nothing but node counts leaves the executors' tables, and each level is written, so a lost executor costs a level
at most.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rng import uniform
from ..scratch import written
from .pairwise import matrix
from .running import inner_edges, ranked, running_sums
from .trees import TreeConfig, resolve_max_features

SMALL_ROWS, TASK_ROWS = 10_000, 500_000  # a table of more rows is dealt to all cores, in tasks of that many at most
SENT_NODES = 100_000  # open nodes of a level at most that are sent to all executors
TREES = 16  # trees that grow at once; the rows of a level are as many times the table's


def bin_edges(df: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """The inner quantiles of each feature over all rows: bins - 1 numbers at most for each. df: (features)."""
    found = inner_edges(df.select(F.posexplode("features").alias("feature", "value")), bins).collect()  # a row for each feature
    by = {r["feature"]: r["edges"] for r in found}
    return [np.array(by.get(f, [])) for f in range(n_features)]


def _binned(df: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(id, label, x array<smallint>): how many edges lie below each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("features"))
                bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.int16)
                offsets = pa.array(np.arange(0, bins.size + 1, len(edges)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(offsets, pa.array(bins.ravel()))], ["id", "label", "x"])

    fields = [df.schema["id"], df.schema["label"], T.StructField("x", T.ArrayType(T.ShortType()))]
    return df.select("id", "features", "label").mapInArrow(run, T.StructType(fields))


def _sum(parts: list[Column]) -> Column:
    return functools.reduce(operator.add, parts)


def _spread(counts: Column, criterion: str) -> Column:
    """n times the impurity of an array of class counts; 0 for none."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    p = F.transform(counts, lambda c: F.when(n > 0, c / n).otherwise(0.0))
    if criterion == "gini":
        pure = F.aggregate(p, F.lit(1.0), lambda a, x: a - x * x)
    else:
        pure = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return F.when(n > 0, n * pure).otherwise(0.0)


def _opens(counts: Column, depth: int, cfg: TreeConfig) -> Column:
    """Whether a node of these class counts may be split."""
    if cfg.max_depth is not None and depth >= cfg.max_depth:
        return F.lit(False)
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    return (n >= cfg.min_samples_split) & (F.array_max(counts) < n)


def _classes(n_classes: int) -> list[Column]:
    return [F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).cast("long") for c in range(n_classes)]


def _bin_cuts(values: DataFrame, by: list[str], n_classes: int) -> DataFrame:
    """(*by, cut, left) from counts by bin: a node and feature have no more rows than bins."""
    upto = W.partitionBy(*by).orderBy("cut").rowsBetween(W.unboundedPreceding, 0)
    return values.select(*by, "cut", F.array(*[F.sum(f"c{i}").over(upto) for i in range(n_classes)]).alias("left"))


def _value_cuts(values: DataFrame, by: list[str], n_classes: int) -> DataFrame:
    """(*by, cut, left) from counts by value: halfway between each value and the one before it."""
    names = [f"c{i}" for i in range(n_classes)]
    runs = running_sums(values, by, ["cut"], names, ("cut",)).filter("before_cut IS NOT NULL")
    middle = (F.col("before_cut") + F.col("cut")) / 2
    left = F.array(*[F.col(f"run_{c}") - F.col(c) for c in names])
    return runs.select(*by, F.when(middle < F.col("cut"), middle).otherwise(F.col("before_cut")).alias("cut"), left.alias("left"))


def _random_cuts(each: DataFrame, by: list[str], n_classes: int, seed: int) -> DataFrame:
    """(*by, cut, left): one cut for each node and feature, somewhere in the node's range of it."""
    ranges = each.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low < high")
    share = uniform(seed, "cut", F.col("tree_id"), F.col("path"), F.col("feature"))
    cuts = ranges.select(*by, (F.col("low") + (F.col("high") - F.col("low")) * share).alias("cut"))
    below = each.join(cuts, by).withColumn("n", F.when(F.col("x") <= F.col("cut"), F.col("n")).otherwise(0))
    return below.groupBy(*by, "cut").agg(F.array(*_classes(n_classes)).alias("left"))


def level_splits(rows: DataFrame, nodes: DataFrame, cfg: TreeConfig, n_features: int, n_classes: int, seed: int) -> DataFrame:
    """(tree_id, path, feature, cut, decrease, left): the best split of each open node, `left` being the class counts of its
    rows whose x is at most the cut (a threshold; for histograms a bin). rows: (tree_id, path, label, n, x); nodes:
    (tree_id, path, counts) of open nodes."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda f: F.struct(uniform(seed, "feature", F.col("tree_id"), F.col("path"), f).alias("u"), f.alias("f")))
    features = F.transform(F.slice(F.array_sort(drawn), 1, resolve_max_features(cfg.max_features, n_features)), lambda s: s["f"])
    # nodes come with the hint to send them, if they are few.
    each = rows.join(nodes.select("tree_id", "path", features.alias("features")), ["tree_id", "path"])
    each = each.select("tree_id", "path", "label", "n", "x", F.posexplode("features").alias("nth", "feature")).withColumn("x", F.get("x", F.col("feature")))
    by = ["tree_id", "path", "nth", "feature"]
    if cfg.split == "extra-trees":
        cuts = _random_cuts(each, by, n_classes, seed)
    else:
        values = each.groupBy(*by, F.col("x").alias("cut")).agg(*[c.alias(f"c{i}") for i, c in enumerate(_classes(n_classes))])
        cuts = _bin_cuts(values, by, n_classes) if cfg.split == "histogram" else _value_cuts(values, by, n_classes)
    cuts = cuts.join(nodes.select("tree_id", "path", "counts"), ["tree_id", "path"])
    right = F.zip_with("counts", "left", lambda t, c: t - c)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    cuts = cuts.withColumn("right", right).filter((total(F.col("left")) >= cfg.min_samples_leaf) & (total(F.col("right")) >= cfg.min_samples_leaf))
    decrease = _spread(F.col("counts"), cfg.criterion) - _spread(F.col("left"), cfg.criterion) - _spread(F.col("right"), cfg.criterion)
    best = F.max_by(F.struct("feature", "cut", "decrease", "left"), F.struct(F.round("decrease", 9), -F.col("nth"), -F.col("cut")))
    return cuts.withColumn("decrease", decrease).groupBy("tree_id", "path").agg(best.alias("b")).select("tree_id", "path", "b.*")


def _grow_block(rows: DataFrame, cfg: TreeConfig, n_features: int, n_classes: int, seed: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes of each level, splits of each level) of the trees in rows."""
    nodes = written(rows.groupBy("tree_id", "path").agg(F.array(*_classes(n_classes)).alias("counts")).withColumn("open", _opens(F.col("counts"), 0, cfg)), "level-nodes")
    levels, splits, depth = [nodes], [], 0
    while n_open := nodes.filter("open").count():
        # Few nodes are sent to all, so rows stay where they are: by node, a level's rows may be one task's.
        sent = F.broadcast if n_open <= SENT_NODES else lambda t: t
        found = written(level_splits(rows, sent(nodes.filter("open")), cfg, n_features, n_classes, seed), "level-splits")
        both = nodes.join(found, ["tree_id", "path"]).withColumn("right", F.zip_with("counts", "left", lambda t, c: t - c))
        depth += 1
        child = lambda side, counts: F.struct(F.concat("path", F.lit(side)).alias("path"), counts.alias("counts"), _opens(counts, depth, cfg).alias("open"))  # noqa: B023, E731
        both = both.withColumn("children", F.array(child("L", F.col("left")), child("R", F.col("right"))))
        splits.append(found)
        nodes = written(both.select("tree_id", F.explode("children").alias("c")).select("tree_id", "c.*"), "level-nodes")
        levels.append(nodes)
        where = both.select("tree_id", "path", "feature", "cut", F.get("children", F.lit(0))["open"].alias("l_open"), F.get("children", F.lit(1))["open"].alias("r_open"))
        at = rows.join(sent(where), ["tree_id", "path"])
        goes_left = F.get("x", F.col("feature")) <= F.col("cut")
        at = at.filter(F.when(goes_left, F.col("l_open")).otherwise(F.col("r_open")))
        rows = written(at.select("tree_id", F.concat("path", F.when(goes_left, "L").otherwise("R")).alias("path"), "label", "n", "x"), "level-rows")
    return levels, splits


def _sampled(placed: DataFrame, drawn: Callable[[Column, Column], Column], first: int, last: int) -> DataFrame:
    """(tree_id, path, label, n, x): the rows of each tree's sample. A row draws its number for each tree where it stands,
    once, so nothing is joined. A tree without a row in its sample takes every row once."""
    tree = lambda t: F.struct(t.cast("int").alias("tree_id"), drawn(t, F.col("id")).cast("int").alias("n"))
    times = F.filter(F.transform(F.sequence(F.lit(first), F.lit(last)), tree), lambda t: t["n"] > 0)
    names = ["tree_id", "path", "label", "n", "x"]
    rows = written(placed.select("label", "x", F.explode(times).alias("t")).select("t.tree_id", F.lit("").alias("path"), "label", "t.n", "x"), "level-rows")
    there = {r["tree_id"] for r in rows.select("tree_id").distinct().collect()}  # trees
    bare = [t for t in range(first, last + 1) if t not in there]
    if not bare:
        return rows
    every = placed.select(F.explode(F.array(*map(F.lit, bare))).alias("tree_id"), F.lit("").alias("path"), "label", F.lit(1).alias("n"), "x")
    return written(rows.select(*names).unionByName(every), "level-rows")


def grow_levels(df: DataFrame, n_rows: int, drawn: Callable[[Column, Column], Column], n_features: int, n_trees: int, n_classes: int, cfg: TreeConfig, seed: int) -> DataFrame:
    """The nodes of n_trees trees, as trees.grow() makes them with the whole table's edges and the same features and
    shares. df: (id, features, label) of n_rows rows; drawn: how often the sample of a tree (a column) has a row (its id)."""
    spark = df.sparkSession
    edges = bin_edges(df, n_features, cfg.bins) if cfg.split == "histogram" else []
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS))  # a small file would be one task's
    spread = df.repartition(tasks, "id") if n_rows > SMALL_ROWS else df
    placed = written(_binned(spread, edges) if edges else spread.select("id", "label", F.col("features").alias("x")), "placed")
    levels, splits = [], []
    for a in range(0, n_trees, TREES):
        block = _grow_block(_sampled(placed, drawn, a, min(a + TREES, n_trees) - 1), cfg, n_features, n_classes, seed)
        levels += block[0]
        splits += block[1]
    nodes = functools.reduce(DataFrame.unionByName, levels)
    nodes = ranked(nodes.select("tree_id", "path", "counts"), ["tree_id"], ["path"], "node_id").withColumn("node_id", (F.col("node_id") - 1).cast("int"))
    ids = nodes.select("tree_id", F.col("path").alias("child"), F.col("node_id").alias("child_id"))
    schema = "tree_id int, path string, feature int, cut double, decrease double, left array<bigint>"
    found = functools.reduce(DataFrame.unionByName, splits) if splits else spark.createDataFrame([], schema)
    if edges:
        at = [(f, b, float(e)) for f, some in enumerate(edges) for b, e in enumerate(some)]  # bins - 1 for each feature
        found = found.join(F.broadcast(spark.createDataFrame(at, "feature int, cut int, threshold double")), ["feature", "cut"])
    else:
        found = found.withColumnRenamed("cut", "threshold")
    child = lambda side, name: ids.withColumn("path", F.expr("substring(child, 1, length(child) - 1)")).filter(F.col("child").endswith(side)).select("tree_id", "path", F.col("child_id").alias(name))
    found = found.select("tree_id", "path", "feature", "threshold", "decrease").join(child("L", "left"), ["tree_id", "path"]).join(child("R", "right"), ["tree_id", "path"])
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    rest = lambda c, otherwise: F.coalesce(F.col(c), F.lit(otherwise)).alias(c)
    return nodes.join(found, ["tree_id", "path"], "left").select(
        F.col("tree_id").cast("int").alias("tree_id"), "node_id", F.col("feature").isNull().alias("is_leaf"), rest("feature", -1), rest("threshold", 0.0), rest("left", -1), rest("right", -1),
        (_spread(F.col("counts"), cfg.criterion) / n).alias("impurity"), n.alias("n_samples"), rest("decrease", 0.0),
        F.array_max(F.transform("counts", lambda c, i: F.struct(c.alias("c"), i.alias("i"))))["i"].alias("prediction"),
        F.transform("counts", lambda c: c / n).alias("distribution"), F.length("path").alias("depth"),
    )

"""Decision trees on matrices: the part of forest training that a task does in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .. import errors
from ..rng import uniform_value

SPLITS = ("exact", "extra-trees", "histogram")


@dataclass(frozen=True)
class TreeConfig:
    criterion: str = "gini"
    split: str = "exact"
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: str | int | float = "sqrt"
    bins: int = 256

    def __post_init__(self):
        if self.max_depth is not None and self.max_depth < 1:
            raise errors.InvalidMaxDepth(max_depth=self.max_depth)
        if self.min_samples_split < 2:
            raise errors.InvalidMinSamplesSplit(min_samples_split=self.min_samples_split)
        if self.min_samples_leaf < 1:
            raise errors.InvalidMinSamplesLeaf(min_samples_leaf=self.min_samples_leaf)
        if self.split not in SPLITS or self.criterion not in ("gini", "entropy") or self.bins < 2:
            raise errors.RfError(config=self)


def resolve_max_features(setting: str | int | float, n: int) -> int:
    """sqrt, log2, all, a fraction (float) or a number (int); must lie in [1, n]."""
    if setting == "sqrt":
        m = math.ceil(math.sqrt(n))
    elif setting == "log2":
        m = max(1, math.ceil(math.log2(n)))
    elif setting == "all":
        m = n
    elif isinstance(setting, float):
        m = math.ceil(n * setting)
    else:
        m = setting
    if not isinstance(m, int) or not 1 <= m <= n:
        raise errors.InvalidMaxFeatures(max_features=setting, n_features=n)
    return m


def impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Of class counts along the last axis; 0 where there are none."""
    n = counts.sum(axis=-1, keepdims=True)
    p = counts / np.maximum(n, 1)
    if criterion == "gini":
        return np.where(n[..., 0] > 0, 1 - (p * p).sum(axis=-1), 0.0)
    return -(p * np.log(np.where(p > 0, p, 1))).sum(axis=-1)


def feature_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner quantiles, each once, strictly within the range; none for a constant column."""
    low, high = column.min(), column.max()
    if low == high:
        return np.empty(0)
    values = np.sort(column)
    place = (len(values) - 1) * np.arange(1, bins) / bins
    floor = np.floor(place).astype(np.int64)
    a, b, t = values[floor], values[np.minimum(floor + 1, len(values) - 1)], place - floor
    edges = np.unique(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))
    return edges[(edges > low) & (edges < high)]


def keyed_features(seed: int, tree: int, n_features: int, cfg: TreeConfig) -> Callable[[str], np.ndarray]:
    """The features that a node may split by, in order, from numbers keyed by tree and the node's path ('' for the
    root, then L and R), so that they don't depend on the order in which nodes are made."""
    take = resolve_max_features(cfg.max_features, n_features)

    def chosen(path: str) -> np.ndarray:
        return np.array(sorted(range(n_features), key=lambda f: (uniform_value(seed, "feature", tree, path, f), f))[:take])

    return chosen


def keyed_shares(seed: int, tree: int) -> Callable[[str, int], float]:
    """Where in its range a node of this path cuts a feature (extra-trees)."""
    return lambda path, f: uniform_value(seed, "cut", tree, path, f)


def _cuts(onehot: np.ndarray, groups: np.ndarray, n_groups: int) -> np.ndarray:
    """Running class counts after each group."""
    out = np.zeros((n_groups, onehot.shape[1]))
    np.add.at(out, groups, onehot)
    return np.cumsum(out, axis=0)


def best_split(x: np.ndarray, onehot: np.ndarray, features: np.ndarray, cfg: TreeConfig, share: Callable[[int], float], edges: list[np.ndarray] | None):
    """(feature, threshold, decrease) with the largest decrease n I - n_left I_left - n_right I_right; of ties
    the first feature in the given order and its least threshold. None if nothing can be split. share: where in its
    range a feature is cut (extra-trees)."""
    total = onehot.sum(axis=0)
    n = len(x)
    parent = n * float(impurity(total, cfg.criterion))
    best = None
    for f in features:
        column = x[:, f]
        if cfg.split == "extra-trees":
            low, high = column.min(), column.max()
            if low == high:
                continue
            thresholds = np.array([low + (high - low) * share(int(f))])
            left = onehot[column <= thresholds[0]].sum(axis=0)[None, :]
        elif cfg.split == "histogram" and edges is not None:
            thresholds = edges[f]
            if not len(thresholds):
                continue
            left = _cuts(onehot, np.searchsorted(thresholds, column, "left"), len(thresholds) + 1)[:-1]
        else:
            values, group = np.unique(column, return_inverse=True)
            if len(values) < 2:
                continue
            middle = (values[:-1] + values[1:]) / 2
            thresholds = np.where(middle < values[1:], middle, values[:-1])  # neighbours may have nothing between them
            left = _cuts(onehot, group, len(values))[:-1]
        right = total - left
        n_left, n_right = left.sum(axis=1), right.sum(axis=1)
        allowed = (n_left >= cfg.min_samples_leaf) & (n_right >= cfg.min_samples_leaf)
        if not allowed.any():
            continue
        gain = np.where(allowed, parent - n_left * impurity(left, cfg.criterion) - n_right * impurity(right, cfg.criterion), -np.inf)
        gain = np.round(gain, 9)  # so that ties are ties, however the counts were summed
        at = int(np.argmax(gain))
        if best is None or gain[at] > best[2]:
            best = (int(f), float(thresholds[at]), float(gain[at]))
    return best


#: Columns of a tree's nodes; feature is -1 in leaves.
NODE_SCHEMA = "node_id int, is_leaf boolean, feature int, threshold double, left int, right int, impurity double, n_samples long, decrease double, prediction int, distribution array<double>, depth int"


def grow(x: np.ndarray, y: np.ndarray, n_classes: int, cfg: TreeConfig, seed: int, edges: list[np.ndarray] | None = None, chosen: Callable[[str], np.ndarray] | None = None, share: Callable[[str, int], float] | None = None) -> list[dict]:
    """Nodes in pre-order, the root first. Leaves predict the commonest class, of ties the greatest. edges: of each
    feature's bins, from these rows if not given; chosen and share: give the features of a node by its path, and where
    it cuts one of them; drawn from the seed if not given."""
    rng = np.random.default_rng(seed)
    take = resolve_max_features(cfg.max_features, x.shape[1])
    if edges is None and cfg.split == "histogram":
        edges = [feature_edges(x[:, f], cfg.bins) for f in range(x.shape[1])]
    onehot = np.eye(n_classes)[y]
    nodes: list[dict] = []
    waiting = [(np.arange(len(x)), "", -1, "")]
    while waiting:
        rows, path, parent, side = waiting.pop()
        depth = len(path)
        counts = onehot[rows].sum(axis=0)
        pure = float(impurity(counts, cfg.criterion))
        node = {"node_id": len(nodes), "is_leaf": True, "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "impurity": pure, "n_samples": len(rows), "decrease": 0.0}
        node |= {"prediction": int(n_classes - 1 - np.argmax(counts[::-1])), "distribution": (counts / len(rows)).tolist(), "depth": depth}
        nodes.append(node)
        if parent >= 0:
            nodes[parent][side] = node["node_id"]
        if len(rows) < cfg.min_samples_split or pure == 0 or (cfg.max_depth is not None and depth >= cfg.max_depth):
            continue
        features = chosen(path) if chosen else rng.permutation(x.shape[1])[:take]
        found = best_split(x[rows], onehot[rows], features, cfg, lambda f: share(path, f) if share else rng.random(), edges)  # noqa: B023
        if found is None:
            continue
        f, threshold, gain = found
        goes_left = x[rows, f] <= threshold
        if goes_left.all() or not goes_left.any():
            continue
        node |= {"is_leaf": False, "feature": f, "threshold": threshold, "decrease": gain}
        waiting.append((rows[~goes_left], path + "R", node["node_id"], "right"))
        waiting.append((rows[goes_left], path + "L", node["node_id"], "left"))
    return nodes


class Tree:
    """Nodes as arrays, for prediction."""

    def __init__(self, nodes: list):
        nodes = sorted(nodes, key=lambda r: r["node_id"])
        self.feature, self.threshold, self.left, self.right, self.prediction = (np.array([r[c] for r in nodes]) for c in ("feature", "threshold", "left", "right", "prediction"))
        self.distribution = np.array([r["distribution"] for r in nodes])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            here = at[rows]
            at[rows] = np.where(x[rows, self.feature[here]] <= self.threshold[here], self.left[here], self.right[here])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.prediction[self.leaves(x)]

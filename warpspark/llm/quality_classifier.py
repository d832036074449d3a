"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents whose label says so; all else that training may see is unlabelled web text. A
small network on document statistics minimises the non-negative unbiased risk: the positives' share of the
negative risk is taken off by the class prior, and where the rest would fall below zero, the step goes the
other way. The prior is estimated from both: the least ratio of unlabelled to positive documents above any score of
a first classifier.

Every unlabelled document counts: a step needs of them just sums (of slopes, or how many score above a cut), which
tasks make and Spark adds up. They are dealt to SHARDS by a hash, a step takes one shard, and an epoch all. Only the
trusted positives, which are labelled rows, are a bounded sample (POSITIVES). If the unlabelled are few (LOCAL_ROWS, counted
first) the driver makes the same sums.

Labels, language, source and doc_id are no inputs; labels are read only of the rows that the caller gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, WHITE, Words, chunks, hash_sample, mix, text_bytes, written
from .quality_rules import line_counts, repeated_words

POSITIVES = 20_000  # trusted positives that training reads at most, picked by a hash of doc_id
LOCAL_ROWS = 100_000  # unlabelled rows of which the driver makes the sums itself
SHARDS = 16  # parts of the unlabelled, by a hash of their statistics; a step takes one
EPOCHS, PRIOR_EPOCHS = 12, 2
SPLITS = 8  # of both into halves, for the prior
CUTS = 50  # scores at which the prior's ratio is read
HIDDEN = 12
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = b"!?"
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "dup_lines", "repeats", "log_line", "distinct", "symbol_words")


def features(texts: list[bytes]) -> np.ndarray:
    """One row of statistics for each whole text; an empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in chunks(texts):
        words = Words(texts[a:b])
        n = np.diff(words.first)
        doc = words.doc_of_word()
        key = np.lexsort((words.hash, doc))
        new = np.ones(len(key), bool)
        new[1:] = (words.hash[key][1:] != words.hash[key][:-1]) | (doc[key][1:] != doc[key][:-1])
        distinct = np.bincount(doc[key][new], minlength=b - a)
        buf = np.frombuffer(words.raw, np.uint8)
        signs = np.zeros(256, bool)
        signs[list(_SYMBOLS)] = True
        last = buf[words.end - 1] if len(words.end) else buf[:0]
        ends_in_sign = np.bincount(doc[signs[last]], minlength=b - a)
        most = np.maximum(n, 1)
        out[a:b, 0] = np.log1p(n)
        out[a:b, 7] = repeated_words(words) / most
        out[a:b, 9] = distinct / np.sqrt(most)
        out[a:b, 10] = ends_in_sign / most
        for i in range(a, b):
            t = texts[i]
            chars = max(1, len(t.translate(None, WHITE + CONTINUATION)))
            share = lambda some: (len(t) - len(t.translate(None, some))) / chars  # noqa: B023, E731
            lines, dup = line_counts(t)
            words_here = max(1, int(n[i - a]))
            out[i, 1:7] = min(chars / words_here, 50), share(_SYMBOLS), share(_UPPER), share(_DIGITS), share(_MARKS), dup / max(1, lines)
            out[i, 8] = np.log1p(words_here / max(1, lines))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """One hidden layer on standardised statistics; Adam."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.weights = [rng.standard_normal((len(mean), HIDDEN)) * 0.3, np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * 0.3, np.zeros(1)]
        self._first = [np.zeros_like(w) for w in self.weights]
        self._second = [np.zeros_like(w) for w in self.weights]
        self._steps = 0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(z @ self.weights[0] + self.weights[1])
        return z, h, h @ self.weights[2] + self.weights[3][0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[2]

    def slopes(self, x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """The derivative by all weights, in one row, of a sum whose derivative by each row's logit is slope."""
        z, h, _ = self._forward(x)
        back = np.outer(slope, self.weights[2]) * (1 - h * h)
        return np.concatenate([(z.T @ back).ravel(), back.sum(axis=0), h.T @ slope, [slope.sum()]])

    def step(self, slopes: np.ndarray, rate: float) -> None:
        self._steps += 1
        at = 0
        for k, (w, m, v) in enumerate(zip(self.weights, self._first, self._second)):
            g = slopes[at : at + w.size].reshape(w.shape) + (1e-4 * w if k in (0, 2) else 0)
            at += w.size
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**self._steps)) / (np.sqrt(v / (1 - 0.999**self._steps)) + 1e-8)


def keys(x: np.ndarray) -> np.ndarray:
    """A hash of each row's statistics, from which its shard and its halves follow. Alike rows go together."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for k in range(x.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, k] + np.uint64(k + 1))
    return out


def shard(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(60)).astype(np.int64)


def half(key: np.ndarray, split: int) -> np.ndarray:
    return ((key >> np.uint64(split)) & np.uint64(1)).astype(np.int64)


def moments(x: np.ndarray) -> np.ndarray:
    """(number, sums, sums of squares) in one row."""
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


def class_sums(nets: list[Network]):
    """Of rows with label 0, as the classifiers of positives against unlabelled see them, each net its half of a split:
    for each net the number of rows and the slopes of the sum of their log losses."""

    def sums(x: np.ndarray) -> np.ndarray:
        key, out = keys(x), []
        for i, net in enumerate(nets):
            own = x[half(key, i // 2) == i % 2]
            out += [[len(own)], net.slopes(own, _sigmoid(net.logit(own)))]
        return np.concatenate(out)

    return sums


def above_counts(nets: list[Network], cuts: list[np.ndarray]):
    """For each net, of the rows of the half that it hasn't seen: how many there are, and how many score at each cut or above."""

    def sums(x: np.ndarray) -> np.ndarray:
        key, out = keys(x), []
        for i, (net, cut) in enumerate(zip(nets, cuts)):
            scores = np.sort(net.logit(x[half(key, i // 2) != i % 2]))
            out += [[len(scores)], len(scores) - np.searchsorted(scores, cut)]
        return np.concatenate(out)

    return sums


def risk_sums(net: Network):
    """Of unlabelled rows: their number, the sum of their losses if they were negative, and its slopes."""

    def sums(x: np.ndarray) -> np.ndarray:
        z = net.logit(x)
        return np.concatenate([[len(x), np.logaddexp(0, z).sum()], net.slopes(x, _sigmoid(z))])

    return sums


class LocalRows:
    """The unlabelled as a matrix."""

    def __init__(self, x: np.ndarray):
        self.parts = [x[shard(keys(x)) == k] for k in range(SHARDS)]

    def add_up(self, sums, only: int | None = None) -> np.ndarray:
        """sums(rows) of all rows, or of one shard."""
        return sum(sums(x) for x in ([self.parts[only]] if only is not None else self.parts))


class SharedRows:
    """The unlabelled as a table that is partitioned by shard; tasks make sums, Spark adds them up."""

    def __init__(self, rows: DataFrame, count: int):
        """rows: (x)."""

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = keys(_matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(shard(key).astype(np.int32)), pa.array((key & np.uint64(0xFFFF)).astype(np.int32))], ["x", "shard", "salt"])

        each = max(1, -(-count // (SHARDS * 1_000_000)))  # files of a shard
        dealt = rows.select("x").mapInArrow(marked, "x array<double>, shard int, salt int").repartition(SHARDS * each, "shard", F.col("salt") % each)
        self.rows = written(dealt.select("x", "shard"), "unlabelled", by="shard")

    def add_up(self, sums, only: int | None = None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(sums(_matrix(batch.column("x"))) for batch in batches if batch.num_rows)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.asarray(total, float))], ["place", "v"])

        some = self.rows if only is None else self.rows.filter(F.col("shard") == only)
        found = some.select("x").mapInArrow(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()  # as many as a row of sums has
        if not found:
            return sums(np.empty((0, len(FEATURES))))
        out = np.zeros(len(found))
        for r in found:
            out[r["place"]] = r["v"]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def estimate_prior(p: np.ndarray, u: LocalRows | SharedRows, mean: np.ndarray, spread: np.ndarray) -> float:
    """The share of positives among the unlabelled: no set of documents can hold a smaller share of the
    unlabelled than the prior times its share of the positives, so the least ratio over the sets above a score
    (of a classifier of the one against the other, judged on the half that it hasn't seen, one error of the
    ratio added) bounds it. The median over both halves of SPLITS splits, and no nearer to 0 or 1 than one document of
    the unlabelled."""
    nets = [Network(mean, spread, seed=3 + i) for i in range(2 * SPLITS)]
    key = keys(p)
    seen = [p[half(key, i // 2) == i % 2] for i in range(len(nets))]
    size = 1 + len(nets[0].slopes(p[:0], np.empty(0)))
    for _ in range(PRIOR_EPOCHS):
        for k in range(SHARDS):
            sums = u.add_up(class_sums(nets), k).reshape(len(nets), size)
            for net, own, (n, *slopes) in zip(nets, seen, sums):
                if len(own) and n:
                    net.step(net.slopes(own, _sigmoid(net.logit(own)) - 1) / len(own) + np.array(slopes) / n, 0.05)
    others = [np.sort(net.logit(p[half(key, i // 2) != i % 2])) for i, net in enumerate(nets)]
    cuts = [np.quantile(s, np.linspace(0.0, 0.9, CUTS)) if len(s) else np.zeros(CUTS) for s in others]
    counts = u.add_up(above_counts(nets, cuts)).reshape(len(nets), 1 + CUTS)
    found = [1.0]
    total = counts[:2, 0].sum()
    for scores, cut, (n, *above) in zip(others, cuts, counts):
        if n and len(scores):
            ap, au = np.maximum(1 - np.searchsorted(scores, cut) / len(scores), 1e-9), np.maximum(np.array(above) / n, 1e-9)
            error = np.sqrt((1 - au) / (n * au) + (1 - ap) / (len(scores) * ap))
            found.append(np.min(au / ap * (1 + error)))
    return float(np.clip(np.median(found[1:] or found), 1 / (total + 1), total / (total + 1)))


def risk_slopes(net: Network, p: np.ndarray, sums: np.ndarray, prior: float) -> tuple[np.ndarray, bool]:
    """The slopes of the risk by the weights, and whether the negative risk is above 0; if it isn't, they are those of
    its negative alone. sums: risk_sums() of unlabelled rows."""
    n, loss, of_unlabelled = sums[0], sums[1], sums[2:]
    z = net.logit(p)
    rest = loss / n - prior * np.logaddexp(0, z).mean()
    as_negative = net.slopes(p, prior * _sigmoid(z)) / len(p)
    if rest >= 0:  # d/dz of -log s is s - 1, of -log(1 - s) is s
        return net.slopes(p, prior * (_sigmoid(z) - 1)) / len(p) - as_negative + of_unlabelled / n, True
    return as_negative - of_unlabelled / n, False


def train(p: np.ndarray, u: LocalRows | SharedRows) -> tuple[Network, float]:
    """The network and the prior; p: statistics of positives."""
    n, *sums = u.add_up(moments) + moments(p)
    mean, square = np.array(sums).reshape(2, -1) / n
    spread = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6
    prior = estimate_prior(p, u, mean, spread)
    net = Network(mean, spread)
    for epoch in range(EPOCHS):
        rate = 0.05 if epoch < EPOCHS * 2 // 3 else 0.01
        for k in range(SHARDS):
            found = u.add_up(risk_sums(net), k)
            if found[0]:
                net.step(risk_slopes(net, p, found, prior)[0], rate)
    return net, prior


def score_quality(docs: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """(doc_id, score) of each row of docs. labels: (doc_id, quality); training sees only labels and texts of rows
    where may_learn, a condition on doc_id, holds: others are neither positives nor unlabelled.

    Null and empty texts have the statistics of an empty text and a score like any other; very long texts are
    measured whole. With no positives or nothing unlabelled, all scores are 0.5. Repeated rows are scored each, an
    empty table gives an empty table, other columns are ignored. Statistics are written once. Positives are bounded
    (POSITIVES) and picked by a hash, all unlabelled rows count, so nothing depends on order or partitions but the last
    digits of sums.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])

    spark = docs.sparkSession
    measured = written(docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, x array<double>"), "statistics")
    known = labels.filter(may_learn).select("doc_id", "quality")
    positives = measured.join(known.filter(F.col("quality") == 1).select("doc_id").distinct(), "doc_id", "left_semi")
    unlabelled = measured.filter(may_learn).join(known.select("doc_id").distinct(), "doc_id", "left_anti")
    p = np.array([r["x"] for r in hash_sample(positives, "doc_id", POSITIVES).select("x").collect()])
    count = unlabelled.count()
    model = None
    if len(p) and count:
        rows = LocalRows(np.array([r["x"] for r in unlabelled.select("x").collect()])) if count <= LOCAL_ROWS else SharedRows(unlabelled, count)
        model = train(p, rows)[0]
    model = spark.sparkContext.broadcast(model)  # a few hundred numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            s = np.full(len(x), 0.5) if model.value is None else _sigmoid(model.value.logit(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return measured.mapInArrow(score, "doc_id long, score double")

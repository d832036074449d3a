"""Toxicity: a convolutional text classifier in numpy.

Words are hashed into two small embedding tables with independent hashes; a word's vector is both rows side by
side, so two words are alike only if they clash in both. Filters of several widths slide over the whole text,
their largest answer is kept (max pooling), and a linear layer gives the logit. Training starts the first
coordinate of each row at its log-odds; then filters and weights take Adam's steps and the table's rows plain steps
of bounded size, from the places that won the pooling.

Thresholds are calibrated by language: a quarter of the labelled rows, by a hash, is no part of training. Counts of
their logits by language, label and bin are summed over all of them, and each language's best threshold is read off
and taken off the logit, so that 0.5 is the threshold everywhere. The language is told from the text's own function
words; the column is no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTER, Words, chunks, hash_sample, text_bytes, written

ROWS = 1 << 16  # of each embedding table
DIM = 4  # of each table
WIDTHS = (1, 2, 3)
FILTERS = 8
DOCUMENTS = 12_000  # labelled documents that training reads at most, picked by a hash of doc_id
WORDS = 8_000_000  # words of those documents at most; each comes to the driver as four bytes
BIN = 1 / 64  # of logits, for the thresholds
LEAN = 20  # toxic documents that the common threshold counts for in a language's own
EPOCHS = 4
BATCH = 64
PAD = max(WIDTHS) - 1

#: Function words that tell languages apart.
LANGUAGES = {
    "en": "the of and to that is was for with this by from".split(),
    "de": "der die und das nicht mit ist von dem den sich ein".split(),
    "fr": "le les des du et dans une est pour qui par sur".split(),
    "es": "el los las del y una por con para que como su".split(),
}


def word_rows(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both tables; row 0 is left for the padding."""
    return (hashes >> np.uint64(48)).astype(np.int64) % (ROWS - 1) + 1, (hashes & np.uint64(0xFFFF)).astype(np.int64) % (ROWS - 1) + 1


def _language_table() -> np.ndarray:
    """Language of a row of the first table, 0 for none."""
    out = np.zeros(ROWS, np.int64)
    for i, words in enumerate(LANGUAGES.values(), 1):
        first, _ = word_rows(Words([w.encode() for w in words], letters=LETTER).hash)
        out[first] = i
    return out


class Tokens:
    """Table rows of the words of several texts, each text followed by padding."""

    def __init__(self, first: np.ndarray, second: np.ndarray, n: np.ndarray):
        """Rows of the words of all texts, and how many words each has."""
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(first)) + doc * PAD
        total = len(first) + PAD * len(n)
        self.first, self.second = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.first[at], self.second[at] = first, second
        self.padding = np.ones(total, bool)
        self.padding[at] = False
        self.start = np.cumsum(n + PAD) - (n + PAD)
        self.doc = np.repeat(np.arange(len(n)), n + PAD)

    @classmethod
    def of(cls, texts: list[bytes]) -> Tokens:
        words = Words(texts, lower=True, letters=LETTER)
        return cls(*word_rows(words.hash), np.diff(words.first))

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> Tokens:
        """Of packed rows, as packed_rows() makes them."""
        both = np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, 2)
        return cls(both[:, 0], both[:, 1], np.array([len(x) // 4 for x in blobs], np.int64))


def packed_rows(texts: list[bytes]) -> list[bytes]:
    """Both rows of each word as 16-bit numbers, one blob for each text."""
    out = []
    for a, b in chunks(texts):
        words = Words(texts[a:b], lower=True, letters=LETTER)
        both = np.stack(word_rows(words.hash), 1).astype(np.uint16)
        out += [both[x:y].tobytes() for x, y in zip(words.first[:-1], words.first[1:])]
    return out


class Model:
    def __init__(self, odds_first: np.ndarray, odds_second: np.ndarray, seed: int = 9):
        rng = np.random.default_rng(seed)
        d = 2 * DIM
        self.table = [(rng.standard_normal((ROWS, DIM)) * 0.05).astype(np.float32) for _ in range(2)]
        for table, odds in zip(self.table, (odds_first, odds_second)):
            table[:, 0] = odds
            table[0] = 0
        self.filters = [(rng.standard_normal((w, d, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, [0, DIM], : FILTERS // 2] += 0.7  # half of the filters start as detectors of odd words
        self.bias = [np.full(FILTERS, -1.0, np.float32) for _ in WIDTHS]
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.base = np.zeros(1, np.float32)

    def _answers(self, t: Tokens, kind: type) -> tuple[np.ndarray, list[np.ndarray]]:
        """Vectors of all places, and each filter's answer to the words from each place on. A filter reads at most PAD
        places beyond a word, which is that text's own padding; from the padding itself on it sees nothing."""
        x = np.concatenate([self.table[0][t.first], self.table[1][t.second]], axis=1).astype(kind)
        out = []
        for w, f in zip(WIDTHS, self.filters):
            f = f.astype(kind)
            y = x @ f[0]
            for o in range(1, w):
                y[:-o] += (x @ f[o])[o:]
            y[t.padding] = 0
            out.append(y)
        return x, out

    def logits(self, t: Tokens) -> np.ndarray:
        """In double precision and rounded, so that the order of sums, which depends on the batch's shape, doesn't show."""
        if not len(t.start):
            return np.empty(0)
        _, answers = self._answers(t, np.float64)
        pooled = [np.maximum(np.maximum.reduceat(y, t.start, axis=0) + b, 0) for y, b in zip(answers, self.bias)]
        return np.round(np.concatenate(pooled, axis=1) @ self.out.astype(np.float64) + float(self.base[0]), 9)

    def slopes(self, t: Tokens, y: np.ndarray, weight: np.ndarray) -> dict:
        """Derivatives of the batch's mean weighted log loss: by weights, base, biases and filters, and by those table
        rows that won a pooling, as (rows, values)."""
        kind = self.out.dtype
        x, answers = self._answers(t, kind)
        last = np.append(t.start[1:], len(t.doc)) - 1
        won = [np.stack([s + a[s : e + 1].argmax(axis=0) for s, e in zip(t.start, last)]) for a in answers]
        z = np.concatenate([np.take_along_axis(a, best, axis=0) + b for a, best, b in zip(answers, won, self.bias)], axis=1)
        h = np.maximum(z, 0)
        slope = ((1 / (1 + np.exp(-np.clip(h @ self.out + self.base[0], -30, 30))) - y) * weight / len(y)).astype(kind)
        back = np.outer(slope, self.out) * (z > 0)
        found: dict = {"out": h.T @ slope, "base": slope.sum(keepdims=True), "bias": [], "filters": [], "table": []}
        rows: dict[int, list] = {0: [], 1: []}
        for k, (w, f, best) in enumerate(zip(WIDTHS, self.filters, won)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            found["bias"].append(g.sum(axis=0))
            change = np.zeros_like(f)
            for o in range(w):
                at = np.minimum(best + o, last[:, None])  # a place that won in the padding stays there
                for j in range(FILTERS):
                    change[o, :, j] = x[at[:, j]].T @ g[:, j]
                    wide = np.outer(g[:, j], f[o, :, j])
                    rows[0].append((t.first[at[:, j]], wide[:, :DIM]))
                    rows[1].append((t.second[at[:, j]], wide[:, DIM:]))
            found["filters"].append(change)
        for i in (0, 1):
            used, where = np.unique(np.concatenate([r for r, _ in rows[i]]), return_inverse=True)
            total = np.zeros((len(used), DIM), kind)
            np.add.at(total, where, np.concatenate([v for _, v in rows[i]]))
            total[used == 0] = 0
            found["table"].append((used, total))
        return found

    def train_batch(self, t: Tokens, y: np.ndarray, weight: np.ndarray, adam: _Adam) -> None:
        by = self.slopes(t, y, weight)
        adam.step(self.out, by["out"])
        adam.step(self.base, by["base"])
        for own, change in zip([*self.bias, *self.filters], [*by["bias"], *by["filters"]]):
            adam.step(own, change)
        for table, (used, total) in zip(self.table, by["table"]):
            table[used] -= np.clip(20 * total, -0.05, 0.05)


class _Adam:
    def __init__(self, rate: float = 0.01):
        self.rate = rate
        self.state: dict[int, list] = {}

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        m, v, n = self.state.setdefault(id(w), [np.zeros_like(w), np.zeros_like(w), 0])
        n += 1
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        self.state[id(w)][2] = n
        w -= self.rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-7)


def log_odds(rows: list[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of both tables, how far the share of toxic documents with it is from the others'."""
    seen = np.zeros((2, 2, ROWS))
    for a, b in chunks(rows):
        t = Tokens.unpacked(rows[a:b])
        for i, of in enumerate((t.first, t.second)):
            pairs = np.unique(t.doc * ROWS + of)
            np.add.at(seen[i], (y[a:b][pairs // ROWS].astype(int), pairs % ROWS), 1)
    n = np.maximum(np.bincount(y.astype(int), minlength=2), 1)
    out = []
    for no, yes in seen:
        share = (yes.sum() + 1) / (seen.sum() / 2 + 2)
        odds = np.log((yes + 4 * share) / (n[1] + 4)) - np.log((no + 4 * (1 - share)) / (n[0] + 4))
        sure = np.minimum(1, yes / 8)
        out.append(np.clip(odds * sure, -1, 3).astype(np.float32))
    return out[0], out[1]


def languages(t: Tokens, table: np.ndarray, n: int) -> np.ndarray:
    """The language of each text by its function words; 0 if none is found."""
    code = table[t.first]
    hit = code > 0
    counts = np.zeros((n, len(LANGUAGES) + 1), np.int64)
    np.add.at(counts, (t.doc[hit], code[hit]), 1)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), 0)


def best_threshold(bins: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The logit with the highest F1, in the middle of its gap; 0 if there is nothing to tell apart. bins: of logits,
    in any order, with the numbers of clean and of toxic documents."""
    if not toxic.sum() or not clean.sum():
        return 0.0
    order = np.argsort(-bins, kind="stable")
    bins, hits, taken = bins[order], np.cumsum(toxic[order]), np.cumsum((clean + toxic)[order])
    at = int(np.argmax(2 * hits / (taken + toxic.sum())))
    low = bins[at + 1] + 1 if at + 1 < len(bins) else bins[at] - 2 / BIN
    return float((bins[at] + low) / 2 * BIN)


def train(rows: list[bytes], y: np.ndarray) -> Model:
    """rows: packed table rows of each document."""
    model = Model(*log_odds(rows, y))
    adam, rng = _Adam(), np.random.default_rng(2)
    share = max(y.mean(), 1e-3)
    weight = np.where(y > 0, min(1 / share, 10) / 2, 1.0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            model.train_batch(Tokens.unpacked([rows[i] for i in part]), y[part], weight[part], adam)
    return model


def thresholds(counts: list[tuple[int, int, int, int]]) -> list[float]:
    """The threshold of each language from (language, toxic, bin, number) rows; it leans on that of all."""
    rows = np.array(counts, np.int64).reshape(-1, 4)

    def of(some: np.ndarray) -> float:
        bins, where = np.unique(some[:, 2], return_inverse=True)
        by = [np.bincount(where, weights=some[:, 3] * (some[:, 1] == y), minlength=len(bins)) for y in (0, 1)]
        return best_threshold(bins, *by)

    common = of(rows)
    out = []
    for i in range(len(LANGUAGES) + 1):
        own = rows[rows[:, 0] == i]
        toxic, clean = (own[own[:, 1] == y, 3].sum() for y in (1, 0))
        out.append((toxic * of(own) + LEAN * common) / (toxic + LEAN) if toxic and clean else common)
    return out


def training_rows(docs: DataFrame, known: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Packed table rows and labels of the sample: DOCUMENTS documents, WORDS words at most, in a hash's order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = packed_rows(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([len(x) // 4 for x in rows], pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "toxic", "words", "rows"])

    picked = hash_sample(known, "doc_id", DOCUMENTS)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(pack, "doc_id long, toxic int, words long, rows binary")
    found = written(found.dropDuplicates(["doc_id"]), "labelled")  # DOCUMENTS rows at most
    order = found.select("words", F.xxhash64("doc_id").alias("h")).orderBy("h", "words").collect()
    upto = np.searchsorted(np.cumsum([r["words"] for r in order]), WORDS, "right")
    if upto < len(order):
        found = found.filter(F.xxhash64("doc_id") < order[upto]["h"])
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id").select("rows", "toxic").collect()
    return [bytes(r["rows"]) for r in rows], np.array([float(r["toxic"]) for r in rows])


def score_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """(doc_id, score) of each row of docs, 0.5 being the threshold. labels: (doc_id, toxic); only those of
    rows where may_learn, a condition on doc_id, holds are read. The network is fitted on a bounded sample of three
    quarters of them (DOCUMENTS, WORDS); all of the last quarter set the thresholds.

    Null and empty texts are scored as padding alone; very long texts are scored whole. Without labels of both kinds,
    all scores are 0. Repeated rows are scored each (a doc_id with several labels is toxic if one says so), an empty
    table gives an empty table, other columns are ignored.
    """
    spark = docs.sparkSession
    known = labels.filter(may_learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibrates")), F.lit(4)) == 0
    rows, y = training_rows(docs, known.filter(~calibrates))
    model = spark.sparkContext.broadcast(train(rows, y) if len(y) and 0 < y.sum() < len(y) else None)  # 2 MB
    del rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _language_table()
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            z, language = np.zeros(len(texts)), np.zeros(len(texts), np.int32)
            for a, b in chunks(texts):
                t = Tokens.of(texts[a:b])
                z[a:b], language[a:b] = model.value.logits(t), languages(t, table, b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z), pa.array(language)], ["doc_id", "z", "language"])

    if model.value is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    logits = written(docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, z double, language int"), "logits")
    counts = logits.join(known.filter(calibrates), "doc_id").groupBy("language", "toxic", F.floor(F.col("z") / BIN).alias("bin")).count()
    shift = F.element_at(F.array(*map(F.lit, thresholds([tuple(r) for r in counts.collect()]))), F.col("language") + 1)  # counts: of bounded number
    return logits.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("z") - shift))))).alias("score"))

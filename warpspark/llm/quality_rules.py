"""Quality rules with adaptive thresholds.

Each document's counts come from one pass over the texts. For each language and source, every metric's
distribution is kept as a mergeable quantile sketch: logarithmic bins of a fixed relative width and their
counts, so that two sketches merge by adding counts and a grouped sum is the whole merge. A cutoff is a natural
break of the sketch: where the outer part, of a quarter of the documents at most, stands apart from the rest by
SEPARATION times the spreads of both, and is too large for chance (more documents than SEPARATION times the error of
their number), the cutoff lies in the gap between them; the rest is looked at again until no part stands apart. No
value of a metric is fixed anywhere, and sources that differ have cutoffs that differ.

A source's break leans on its language's cutoff, and a language's on that of all, as PRIOR documents would: the more
documents a sketch has, the more it decides by itself. A sketch without a break takes the cutoff above it, unless
that would cut off more than a quarter of its documents: then it is of another kind, and nothing is cut off. The
cutoffs are joined back to the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, WHITE, Words, chunks, grams, mix, text_bytes, written

_SYMBOLS = b"#*$%&|<>"
GAMMA = 1.02  # width of a sketch's bins: values within 1 %
LEAST = 1e-4  # smaller values share the lowest bin
PRIOR = 500  # documents that the cutoff above a group's counts for
SEPARATION = 3.0  # spreads of both parts between their means at a break, and errors of the outer part's number
METRICS = ("symbols", "dup_lines", "repeats", "upper", "word_length")
TWO_SIDED = ("word_length",)  # metrics with a lower cutoff too
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
_UPPER = bytes(range(65, 91))


def repeated_words(words: Words) -> np.ndarray:
    """For each text, its words within 3-word windows that occur twice or more in it."""
    n = len(words.hash)
    out = np.zeros(len(words.first) - 1, np.int64)
    if n < 3:
        return out
    doc = words.doc_of_word()
    inside = doc[:-2] == doc[2:]
    at = np.flatnonzero(inside)
    key = mix(grams(words.hash, 3)[at] + mix(doc[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(at), bool)
    hit[1:] |= same
    hit[:-1] |= same
    starts = at[order[hit]]
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + 3, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(out))


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def count_text(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the counts of each whole text, and the columns `keep`; null texts count as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            columns: list[list] = [[] for _ in range(7)]
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                columns[0] += np.diff(words.first).tolist()
                columns[4] += repeated_words(words).tolist()
            for t in texts:
                lines, dup = line_counts(t)
                columns[1].append(len(t.translate(None, WHITE + CONTINUATION)))
                columns[2].append(len(t) - len(t.translate(None, _SYMBOLS)))
                columns[3].append(dup)
                columns[5].append(lines)
                columns[6].append(len(t) - len(t.translate(None, _UPPER)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(c, pa.int64()) for c in columns] + [batch.column(c) for c in keep],
                ["doc_id", "lang", "source", *(x.split()[0] for x in COUNTS.split(", ")), *keep],
            )

    extra = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "lang", "source", "text", *keep).mapInArrow(run, f"doc_id long, lang string, source string, {COUNTS}{extra}")


def _bin(value):
    return F.when(value <= LEAST, F.lit(0)).otherwise(F.ceil(F.log(value / LEAST) / math.log(GAMMA))).cast("int")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): the sketch of each source's documents that passed the base rules."""
    rows = measured.filter(~F.col("base_failed"))
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bin(F.col(m)).alias("bin")) for m in METRICS])).alias("v")
    return rows.select("lang", "source", values).groupBy("lang", "source", "v.metric", "v.bin").agg(F.count("*").alias("n"))


def edges(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper values of the bins."""
    return np.where(bins > 0, LEAST * GAMMA ** (bins - 1.0), 0.0), LEAST * GAMMA ** bins.astype(float)


def natural_break(bins: np.ndarray, n: np.ndarray, upper: bool = True) -> float | None:
    """The cutoff of a sketch (bins rising, with their counts) on one side; None if nothing stands apart."""
    low, high = edges(bins)
    value, inner, outer = np.where(bins > 0, (low + high) / 2, 0.0), high, low
    if not upper:
        value, inner, outer, n = -value[::-1], -low[::-1], -high[::-1], n[::-1]
    cut = None
    while len(n) > 1:
        count, total, square = (np.cumsum(x.astype(float)) for x in (n, n * value, n * value**2))
        c1, c2 = count[:-1], count[-1] - count[:-1]
        m1, m2 = total[:-1] / c1, (total[-1] - total[:-1]) / c2
        between = np.where((c1 >= 3 * c2) & (c2 > SEPARATION**2), c1 * c2 * (m2 - m1) ** 2, -1)
        k = int(np.argmax(between))
        s1, s2 = (math.sqrt(max(0.0, x)) for x in (square[k] / c1[k] - m1[k] ** 2, (square[-1] - square[k]) / c2[k] - m2[k] ** 2))
        if between[k] < 0 or m2[k] - m1[k] <= SEPARATION * (s1 + s2):
            break
        cut = (inner[k] + outer[k + 1]) / 2
        value, inner, outer, n = value[: k + 1], inner[: k + 1], outer[: k + 1], n[: k + 1]
    return cut if cut is None or upper else -cut


def leaning(bins: np.ndarray, n: np.ndarray, above: float | None, upper: bool = True) -> float | None:
    """The cutoff of a sketch below another one, whose cutoff is `above`; None if nothing is cut off."""
    own = natural_break(bins, n, upper)
    if above is None or own is not None:
        return own if above is None else (n.sum() * own + PRIOR * above) / (n.sum() + PRIOR)
    low, high = edges(bins)
    beyond = n[low >= above] if upper else n[high <= above]
    return above if 4 * beyond.sum() <= n.sum() else None


def cutoffs(sketch: DataFrame, by: list[str], above: DataFrame | None = None) -> DataFrame:
    """(*by, metric, low, high): cutoffs of each group's merged sketch, null for none. above: those of the groups
    that hold these. A sketch has a bounded number of bins, so a group is one small row."""
    merged = sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
    rows = merged.groupBy(*by, "metric").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    if above is None:
        rows = rows.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    else:
        rows = rows.join(above, [*by[:-1], "metric"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = [], []
            for metric, bins, a, b in zip(*(batch.column(c).to_pylist() for c in ("metric", "bins", "low", "high"))):
                at, n = np.array([x["bin"] for x in bins], np.int64), np.array([x["n"] for x in bins], np.int64)
                low.append(leaning(at, n, a, False) if metric in TWO_SIDED else None)
                high.append(leaning(at, n, b))
            keep = [batch.column(c) for c in (*by, "metric")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(low, pa.float64()), pa.array(high, pa.float64())], [*by, "metric", "low", "high"])

    return rows.mapInArrow(run, "".join(f"{c} string, " for c in by) + "metric string, low double, high double")


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each language and source with the lower and upper cutoff of each metric."""
    of_all = F.broadcast(cutoffs(sketch, []))  # one row for each metric
    t = cutoffs(sketch, ["lang", "source"], cutoffs(sketch, ["lang"], of_all))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    return t.groupBy("lang", "source").agg(*[of(m, c) for m in METRICS for c in ("low", "high")])


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, counts, base_failed and kept for each row of docs, with the columns `keep`.

    Null language or source is a group of its own (shown as ''). A null, empty or blank text has no words and fails
    the base rule. Very long texts are counted whole. Rows that repeat a doc_id are judged each, equal ones alike. An
    empty table gives an empty table. Other columns are ignored, so their names may be those of inner ones. A value
    at a cutoff is kept. Texts are read once; what is written and joined has counts only. The hot source's documents
    are summed before the shuffle, and the join's cutoffs have one row for each source (sent to all tasks only if
    Spark finds them small).
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    counted = count_text(docs, keep).withColumns({
        "lang": F.coalesce("lang", F.lit("")),
        "source": F.coalesce("source", F.lit("")),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
        "upper": F.col("n_upper") / chars,
        "word_length": F.col("word_chars") / n,
    })
    measured = written(counted, "rules")
    cut = written(thresholds(sketches(measured)), "cutoffs", small=True)
    inside = F.lit(True)
    for m in METRICS:
        inside &= F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        if m in TWO_SIDED:
            inside &= F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    joined = measured.join(cut, ["lang", "source"], "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), *keep
    )

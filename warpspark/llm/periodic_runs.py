"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

The words of a text are numbers, and the suffix array, its inverse and the common prefixes of neighbours (lcp) are
made for a batch of texts at once by prefix doubling; suffixes of different texts never share a prefix. Each place of the
array with lcp d parts an interval of common prefix d in two. The suffixes i of the smaller part are looked at: if i + d
or i - d lies in the other part by the inverse array, a word sequence of length d stands there twice in a row and can't
be moved on to the right. Every run has just one such square for its period, so squares are rotated to the left as
far as they go and that is the run. Squares whose root is a power itself are no periods. No tree is built, and the
smaller parts have n log n suffixes in all.

The ranks of prefix doubling stay, so common prefixes of any two places take a step for each doubling.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, text_bytes

LEAST = 6  # words of a run
TIMES = 4  # periods of a run
PIECE = 1 << 21  # suffixes of smaller parts looked at together


class SuffixArray:
    """Suffixes of several sequences in order, their inverse, and ranks by prefixes of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray):
        """symbols of all sequences; those of sequence i are first[i]:first[i+1]."""
        n = len(symbols)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        _, symbol = np.unique(symbols, return_inverse=True)
        key = doc * (int(symbol.max(initial=0)) + 1) + symbol
        order = np.argsort(key, kind="stable")
        at = key[order]
        begins = np.concatenate([[True], at[1:] != at[:-1]]) if n else np.zeros(0, bool)
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))  # a group's rank is its first place
        self.doc, self.end = doc, first[1:][doc]
        self.ranks, size = [rank], 1
        group = np.cumsum(begins) - 1
        crowded = order[np.bincount(group, minlength=1)[group] > 1]  # suffixes that share their rank, in order of ranks
        while len(crowded):
            ahead = crowded + size
            second = np.where(ahead < self.end[crowded], rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
            head = rank[crowded].astype(np.int64)
            move = np.argsort(head * (n + 1) + second, kind="stable")
            head, second, crowded = head[move], second[move], crowded[move]
            new_head = np.concatenate([[True], head[1:] != head[:-1]])
            begins = new_head | np.concatenate([[True], second[1:] != second[:-1]])
            inner = np.arange(len(head))
            place = head + inner - np.maximum.accumulate(np.where(new_head, inner, 0))
            order[place] = crowded
            rank = rank.copy()
            rank[crowded] = place[np.maximum.accumulate(np.where(begins, inner, 0))]
            self.ranks.append(rank)
            group = np.cumsum(begins) - 1
            crowded = crowded[np.bincount(group)[group] > 1]
            size *= 2
        self.order, self.place = order, rank  # in the end each suffix has a rank of its own

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, different places within the array."""
        out = np.zeros(len(a), np.int64)
        last = len(self.place) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + out, b + out
            rank = self.ranks[k]
            same = (x <= last) & (y <= last)
            same &= rank[np.minimum(x, last)] == rank[np.minimum(y, last)]
            out += same.astype(np.int64) << k
        return out

    def lcp(self) -> np.ndarray:
        """The common prefix of each suffix and the one before it in the array; 0 for the first."""
        n = len(self.order)
        out = np.zeros(n, np.int64)
        rank = self.ranks[0][self.order]
        at = np.flatnonzero(np.concatenate([[False], rank[1:] == rank[:-1]])) if n else np.empty(0, np.int64)
        out[at] = self.common(self.order[at - 1], self.order[at])
        return out


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place with a value above 0 the last one before it with a smaller value, by pointers that jump over
    pointers. The first value must be the least of all."""
    to = np.arange(-1, len(values) - 1)
    at = np.flatnonzero(values > 0)
    while len(at):
        at = at[values[to[at]] >= values[at]]
        to[at] = to[to[at]]
    return to


def _parts(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, first, last) of each place k with lcp > 0: first..k-1 and k..last are the two parts of its interval, where
    of equal values in one interval the part before ends at the one before."""
    at = np.flatnonzero(lcp > 0)
    first = _smaller_before(lcp)[at]
    last = len(lcp) - _smaller_before(np.concatenate([[-1], lcp[::-1]]))[1:][::-1][at] - 1
    by = np.lexsort((lcp[at], first))  # stable, so places rise within one value
    again = (first[by[1:]] == first[by[:-1]]) & (lcp[at[by[1:]]] == lcp[at[by[:-1]]])
    left = first.copy()
    left[by[1:][again]] = at[by[:-1][again]]
    return at, left, last


def squares(sa: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of all branching squares: the root stands twice in a row, and the word after differs from
    the one a root before it."""
    lcp = sa.lcp()
    at, first, last = _parts(lcp)
    starts, roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    n = len(lcp)
    less_left = at - first <= last - at + 1
    low, size = np.where(less_left, first, at), np.where(less_left, at - first, last - at + 1)
    other_low, other_high = np.where(less_left, at, first), np.where(less_left, last, at - 1)
    # Dealt to pieces, so that temporaries stay bounded.
    upto = np.cumsum(size)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PIECE, "right")))
        which = np.repeat(np.arange(a, b), size[a:b])
        inner = np.arange(len(which)) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])
        i, d = sa.order[low[which] + inner].astype(np.int64), lcp[at[which]]
        for other, start in ((i + d, i), (i - d, i - d)):
            there = sa.place[np.clip(other, 0, n - 1)]
            hit = (other >= 0) & (other < n) & (there >= other_low[which]) & (there <= other_high[which])
            starts.append(start[hit])
            roots.append(d[hit])
        a = b
    return np.concatenate(starts), np.concatenate(roots)


def _least_factors(limit: int) -> np.ndarray:
    """The least prime factor of each number up to limit."""
    out = np.arange(limit + 1)
    for p in range(2, int(limit**0.5) + 1):
        if out[p] == p:
            multiples = out[p * p :: p]
            multiples[multiples == np.arange(p * p, limit + 1, p)] = p
    return out


def _powers(sa: SuffixArray, start: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which roots are powers of something shorter: by each prime factor of their length."""
    out = np.zeros(len(root), bool)
    factors, rest = _least_factors(int(root.max(initial=1))), root.copy()
    at = np.flatnonzero(rest > 1)
    while len(at):
        p = factors[rest[at]]
        short = root[at] // p
        out[at] |= sa.common(start[at], start[at] + short) >= root[at] - short
        rest[at] //= p
        at = at[(rest[at] > 1) & ~out[at]]
    return out


def runs(sa: SuffixArray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of at least `least` words and `times` periods, by start, then
    period. Starts are places in the joined sequences."""
    start, root = squares(sa)
    origin = first[sa.doc[start]]
    # A run of so many periods also repeats `times - 2` periods before its last square.
    back = (times - 2) * root
    at = np.flatnonzero(start - back >= origin)
    at = at[sa.common(start[at] - back[at], start[at] - back[at] + root[at]) >= back[at] + root[at]]
    start, root, origin = start[at], root[at], origin[at]
    at = ~_powers(sa, start, root)
    start, root, origin = start[at], root[at], origin[at]
    # Rotated to the left: the most places that fit, by bisection.
    low, high = (times - 2) * root, start - origin
    while (low < high).any():
        middle = (low + high + 1) // 2
        fits = sa.common(start - middle, start - middle + root) >= middle
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    start, length = start - low, 2 * root + low
    at = np.flatnonzero(length >= np.maximum(least, times * root))
    at = at[np.lexsort((root[at], start[at]))]
    return start[at], length[at], root[at]


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int]:
    """(first word, period) of the tail that a tenth of the documents, by a hash of their id, have instead of their own;
    the period is 0 for the others."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or n == 0:
        return n, 0
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _found(texts: list[bytes], ids: list, tail: Callable[[int | None, int], tuple[int, int]] | None) -> Iterator[dict]:
    """What find_runs() returns of each text."""
    words = Words(texts)
    first = words.first
    source = np.arange(len(words.hash))  # the word that stands at each place
    for i, doc_id in enumerate(ids):
        if tail is not None:
            a, p = tail(doc_id, int(first[i + 1] - first[i]))
            if p:
                from_, to = first[i] + a, first[i + 1]
                source[from_:to] = from_ + np.arange(to - from_) % p
    sa = SuffixArray(words.hash[source], first)
    start, length, period = runs(sa, first)
    cut = np.searchsorted(start, first)
    kept = np.zeros(len(source) + 1, np.int64)  # +1 where a dropped stretch begins, -1 behind it
    np.add.at(kept, start + period, 1)
    np.add.at(kept, start + length, -1)
    kept = np.cumsum(kept[:-1]) == 0
    for i, text in enumerate(texts):
        a, b = int(first[i]), int(first[i + 1])
        own = slice(cut[i], cut[i + 1])
        rows = np.stack([start[own] - a, length[own], period[own]], 1)
        if len(rows) or (source[a:b] != np.arange(a, b)).any():
            left = source[a:b][kept[a:b]].tolist()
            text = b" ".join([words.raw[words.start[k] : words.end[k]] for k in left])
        else:
            text = b" ".join(text.split())  # splits at the same bytes
        yield {"runs": rows, "text": text}


def find_runs(docs: DataFrame, tail: Callable[[int | None, int], tuple[int, int]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of each row: all periodic runs of words of at least LEAST words and TIMES periods, by
    start, then period, and the words that no run holds after its first period, joined by one space. tail: gives the first
    word and the period of a tail that is put in a document's place, by its id and number of words.

    Texts are looked at whole; a text's arrays take some 20 bytes for each word and doubling of its longest repeat.
    Null and empty texts have no runs and an empty rest. Repeated rows are treated each, rows without a doc_id like
    all others (their tail stays). An empty table gives an empty table; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = text_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in chunks(texts):
                rows = list(_found(texts[a:b], ids[a:b], tail))
                spans = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r["runs"].tolist()] for r in rows], _RUNS)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), spans, pa.array([r["text"].decode("utf-8", "replace") for r in rows], pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def digest_runs(docs: DataFrame) -> DataFrame:
    """One row for each document: number of runs, the longest (ties: first start, then period) and digests of all runs
    and of the text without repeats, with repeated_tail() in a tenth of the documents."""
    found = find_runs(docs, repeated_tail)
    r = F.col("runs")
    longest = F.array_max(F.transform(r, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform(r, lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size(r).cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size(r) > 0, F.lit("\n")).otherwise(F.lit(""))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

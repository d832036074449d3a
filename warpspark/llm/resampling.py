"""Importance resampling towards a target distribution: array-scored weights, then parallel sorting by regular sampling.

Features are the runs of one to three words, hashed into BUCKETS buckets by their crc32. Both corpora's buckets are
counted over all rows (each task sends its sums, one row for each bucket), and a bucket's gain is the floored log ratio
of its shares. The gains are one array of fixed length that goes along to score whole documents.

Ranks come from a sample sort: each task's rows are a locally sorted run; every so many rows of a run give a regular
sample, from which splitters are read; rows are exchanged by segment between splitters, sorted (merged) within it,
and numbered from the count of all segments before. Only segments that reach into the drawn share are exchanged. Ties
are no trouble, as splitters are pairs of score and doc_id.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, Words, chunks, text_bytes, written

BUCKETS = 10_000
SEED = 42
SEGMENT = 250_000  # rows of a segment, on average, at most
SAMPLES = 16  # regular samples for each segment
_SHORT = 128  # bytes; longer words are hashed one by one


def _byte_table() -> np.ndarray:
    """The checksum's step of each byte (reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_STEP = _byte_table()


def _shift_table() -> np.ndarray:
    """What each byte of a checksum becomes when so many zero bytes follow: [bytes that follow, which byte, its value]."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(_SHORT + 1):
        now = _STEP[now & 0xFF] ^ (now >> 8)
        out.append(now)
    return np.stack(out)


_SHIFT = _shift_table().ravel()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums as they count in front of n further bytes; checksums are linear, so texts join without being read anew."""
    long = np.flatnonzero(n > _SHORT + 1)
    at = np.minimum(n, _SHORT + 1) * 1024
    out = _SHIFT[at + (crc & 0xFF)]
    for k in (1, 2, 3):
        out ^= _SHIFT[at + (256 * k + ((crc >> np.uint32(8 * k)) & 0xFF))]
    for i in long.tolist():  # the checksum of n zero bytes, linear part alone
        zeros = bytes(int(n[i]))
        out[i] = zlib.crc32(zeros, int(crc[i])) ^ zlib.crc32(zeros, 0)
    return out


def word_crcs(words: Words) -> np.ndarray:
    """crc32 of each word's bytes: byte after byte for all words at once."""
    raw = np.frombuffer(words.raw, np.uint8)
    size = words.end - words.start
    out = np.full(len(size), 0xFFFFFFFF, np.uint32)
    at, done = np.flatnonzero(size <= _SHORT), 0
    while len(at):
        now = out[at]
        out[at] = _STEP[(now ^ raw[words.start[at] + done]) & 0xFF] ^ (now >> np.uint32(8))
        done += 1
        at = at[size[at] > done]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = zlib.crc32(words.raw[words.start[i] : words.end[i]])
    return out


def feature_buckets(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two and three words: (first word of each run, bucket)."""
    one = word_crcs(words)
    size = words.end - words.start
    spaced = _shifted(np.full(len(one), zlib.crc32(b" "), np.uint32), size) ^ one  # of a space and the word
    doc = words.doc_of_word()
    out, now = [(np.arange(len(one)), one % BUCKETS)], one
    for k in (1, 2):
        now = _shifted(now[:-1], size[k:] + 1) ^ spaced[k:]
        out.append((at := np.flatnonzero(doc[:-k] == doc[k:]), now[at] % BUCKETS))
    return out


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends BUCKETS rows at most, and so does the sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for a, b in chunks(texts):
                for _, bucket in feature_buckets(Words(texts[a:b], lower=True, letters=LETTER)):
                    total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    sums = rows.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, target over source."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(y + 1) * s) / (float(x + 1) * t))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """The keyed Gumbel draw of a document, in thousandths."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row; the score of a row without a doc_id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = text_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            words, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for a, b in chunks(texts):
                w = Words(texts[a:b], lower=True, letters=LETTER)
                words[a:b] = np.diff(w.first)
                each = np.zeros(len(w.hash), np.int64)
                for at, bucket in feature_buckets(w):
                    each[at] += gain[bucket]
                upto = np.concatenate([[0], np.cumsum(each)])
                weight[a:b] = upto[w.first[1:]] - upto[w.first[:-1]]
            features = sum(np.maximum(words - k, 0) for k in range(3))
            score = [None if i is None else int(w) + noise(i, seed) for i, w in zip(ids, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def segments(score: np.ndarray, ids: np.ndarray, split_score: np.ndarray, split_id: np.ndarray) -> np.ndarray:
    """How many splitters (by falling score, then rising id) stand at or before each row."""
    low = np.searchsorted(-split_score, -score, "left")
    high = np.searchsorted(-split_score, -score, "right")
    out = low.astype(np.int32)
    tied = np.flatnonzero(high > low)
    for a in np.unique(low[tied]).tolist():
        rows = tied[low[tied] == a]
        out[rows] += np.searchsorted(split_id[a : high[rows[0]]], ids[rows], "right").astype(np.int32)
    return out


def draw_highest(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored with `rank`, 1, 2, 3... of the floor(percent * N / 100) highest scores of the N rows that have
    least_words words and a score; null elsewhere. Of ties the smaller doc_id goes first.

    What reaches the driver: SAMPLES pairs of numbers for each segment and one for each run, and one count for each
    segment; segments are as many as shuffle partitions, or as there are SEGMENT rows if that is more."""
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    runs = written(scored.sortWithinPartitions(*order), "runs")  # each file is a sorted run
    fit = runs.filter((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    total = fit.count()
    drawn = percent * total // 100
    none = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return runs.select("doc_id", "n_features", "weight", "score", none)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SEGMENT))
    step = max(1, total // (SAMPLES * parts))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange(-seen % step, batch.num_rows, step)))
            seen += batch.num_rows

    found = fit.select("score", "doc_id").mapInArrow(sample, "score long, doc_id long").toPandas()
    found = found.sort_values(["score", "doc_id"], ascending=[False, True])
    at = np.unique(np.arange(1, parts) * len(found) // parts)
    split_score, split_id = found["score"].to_numpy()[at], found["doc_id"].to_numpy()[at]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = segments(batch.column("score").to_numpy(), batch.column("doc_id").to_numpy(), split_score, split_id)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.int32())], [*batch.schema.names, "segment"])

    placed = fit.mapInArrow(place, "doc_id long, n_words long, n_features long, weight long, score long, segment int")
    sizes = np.zeros(len(at) + 1, np.int64)
    for r in placed.groupBy("segment").count().collect():  # a row for each segment
        sizes[r["segment"]] = r["count"]
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    last = int(np.searchsorted(before, drawn, "left")) - 1  # the last segment with a drawn row

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = -1, 0  # segment and its rows so far
        for batch in batches:
            segment = batch.column("segment").to_numpy()
            start = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(segment)]])
            rank = np.empty(len(segment), np.int64)
            for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
                if a == b:
                    continue
                now, done = (now, done) if segment[a] == now else (int(segment[a]), 0)
                rank[a:b] = before[now] + done + np.arange(1, b - a + 1)
                done += b - a
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_features", "weight", "score")] + [pa.array(rank, mask=rank > drawn)], ["doc_id", "n_features", "weight", "score", "rank"])

    top = placed.filter(F.col("segment") <= last).repartition(last + 1, "segment").sortWithinPartitions("segment", *order)
    ranked = top.mapInArrow(number, "doc_id long, n_features long, weight long, score long, rank long")
    rest = placed.filter(F.col("segment") > last).select("doc_id", "n_features", "weight", "score", none)
    unfit = runs.filter(~F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False)))
    return ranked.unionByName(rest).unionByName(unfit.select("doc_id", "n_features", "weight", "score", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs: its log importance towards the texts of
    target, with keyed noise, and its rank among those drawn (null if it isn't).

    Null and empty texts have no features and weight 0; very long texts are scored whole. A row without a doc_id
    is counted in the buckets, but has no score and is never drawn. Repeated rows are scored and ranked each (alike in
    score, they follow one another by n_features). Empty tables count nothing: without documents the result is
    empty, without target texts all buckets gain by their rarity alone. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return draw_highest(score_documents(docs, gain, seed), percent, least_words)

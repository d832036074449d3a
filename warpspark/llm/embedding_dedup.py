"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank by cosine.

1. On a bounded sample, principal axes and a rotation are learnt so that the signs of the turned coordinates
   lose least; each bit is cut at its median, so codes are balanced. Several rotations from different starts
   give more bits than the vectors have coordinates.
2. The codes are cut into substrings, one table each. Two vectors meet in a table if that substring is equal,
   so all pairs that differ in fewer bits than there are tables meet. A substring has about log2(rows) - 4 bits,
   so buckets keep their size as the input grows; the number of tables follows from the chance MISS that a pair
   just at the threshold meets in none. Every row is in every table.
3. Within a bucket the original vectors decide, in double precision. A pair that meets in several tables counts
   in the first of them. A bucket of more than BLOCK rows is cut into blocks, and each pair of blocks is a task
   of its own; equal vectors are one row with a count from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, keyed_runs, written
from .components import components

SAMPLE = 20_000  # vectors that the rotations are learnt from
ROUNDS = 25
MISS = 0.005
BLOCK = 2048
FEW = 256  # vectors of one length that are compared without an index
CODE_BITS = (4, 28)  # bounds of a substring's length


def learn_rotation(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes, cuts): x @ axes > cuts are the bits. Alternates signs and the best rotation to them."""
    d = x.shape[1]
    centred = x - x.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    v = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    for _ in range(ROUNDS):
        bits = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(bits.T @ v)
        turn = (left @ right).T
    axes = axes @ turn
    return axes, np.median(x @ axes, axis=0)


class Index:
    def __init__(self, sample: np.ndarray, rows: int, threshold: float):
        d = sample.shape[1]
        width = min(max(round(math.log2(max(rows, 2))) - 4, CODE_BITS[0]), CODE_BITS[1], d)
        same = 1 - math.acos(threshold) / math.pi  # chance that a bit of a pair at the threshold is equal
        self.width, self.dim = width, d
        self.tables = math.ceil(math.log(MISS) / math.log1p(-(same**width)))
        each = d // width
        self.rotations = [learn_rotation(sample, 11 + i) for i in range(-(-self.tables // each))]

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """Rows of substrings, one column for each table."""
        power = (1 << np.arange(self.width)).astype(np.int64)
        out = []
        for axes, cuts in self.rotations:
            bits = (x @ axes) > cuts
            for i in range(self.dim // self.width):
                out.append(bits[:, i * self.width : (i + 1) * self.width] @ power)
        return np.stack(out[: self.tables], 1)


def unit_rows(raw: list[bytes], dtype: type) -> np.ndarray:
    """Vectors as rows of doubles of length 1. Scaling by the largest component first avoids overflow."""
    x = np.stack([np.frombuffer(v, dtype) for v in raw]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_blobs(vectors: DataFrame, dtype: type) -> DataFrame:
    """(vec_id, dim, vector): the components as they are; null if the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, dims = [], []
            for v in batch.column("embedding"):
                x = v.values
                good = x is not None and len(x) > 0 and x.null_count == 0
                a = x.to_numpy(zero_copy_only=False).astype(dtype) if good else None
                if good and np.isfinite(a).all() and a.any():
                    blobs.append(a.tobytes())
                    dims.append(len(a))
                else:
                    blobs.append(None)
                    dims.append(0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["vec_id", "dim", "vector"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, vector binary")


def link_block(ids: np.ndarray, side: np.ndarray, codes: np.ndarray, copies: np.ndarray, x: np.ndarray, table: int, threshold: float) -> tuple:
    """Links of a bucket or a pair of its blocks: (edges that join what links join, ids, their links).
    side: 0 if rows meet one another, else rows of side 1 meet rows of side 2 only."""
    cross = bool(side.any())
    a = np.flatnonzero(side == 1) if cross else np.arange(len(ids))
    b = np.flatnonzero(side == 2) if cross else a
    close = x[a] @ x[b].T >= threshold
    if not cross:
        close &= np.tri(len(a), k=-1, dtype=bool)
    i, j = np.nonzero(close)
    i, j = a[i], b[j]
    earlier = (codes[i, :table] == codes[j, :table]).any(axis=1) if table > 0 else np.zeros(len(i), bool)
    i, j = i[~earlier], j[~earlier]
    links = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
    label = np.arange(len(ids))
    while len(i):  # hook each row to the least label around, until nothing changes
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(ids)))
    some = np.flatnonzero(links)
    return ids[moved], ids[label[moved]], ids[some], links[some].astype(np.int64)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Null or zero vectors, and those with null or non-finite components, link with nothing. Vectors of different
    lengths don't link; each length has its own index. Rows that repeat a vec_id with the same vector count once, with
    another vector they are compared each. A row without a vec_id links with nothing and is kept. An empty table gives
    an empty table. Other columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType
    dtype = np.float32 if kind == T.ArrayType(T.FloatType(), kind.containsNull) else np.float64
    blobs = written(vector_blobs(vectors, dtype), "vectors")
    alike = blobs.filter("vector is not null and vec_id is not null").select("vec_id", "dim", "vector", F.md5("vector").alias("digest"))
    classes = written(
        alike.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector")),
        "vector-classes",
    )
    # A row for each length that many vectors have; the vectors of others are one bucket for each length.
    lengths = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().filter(F.col("count") > FEW).collect()}
    samples = {d: hash_sample(classes.filter(F.col("dim") == d), "rep", SAMPLE).select("vector").collect() for d in sorted(lengths)}
    indexes = {d: Index(unit_rows([r["vector"] for r in rows], dtype), lengths[d], threshold) for d, rows in samples.items()}
    sent = spark.sparkContext.broadcast(indexes)
    del samples

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            raw = batch.column("vector").to_pylist()
            codes = [b""] * len(raw)
            for dim in np.unique(dims).tolist():
                if dim in sent.value:
                    some = np.flatnonzero(dims == dim).tolist()
                    found = sent.value[dim].substrings(unit_rows([raw[i] for i in some], dtype)).astype(np.int32)
                    for i, row in zip(some, found):
                        codes[i] = row.tobytes()
            places = [np.frombuffer(c, np.int32).tolist() for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(places, pa.list_(pa.int32()))], [*batch.schema.names, "codes", "places"])

    coded = written(classes.select("rep", "copies", "dim", "vector").mapInArrow(encode, "rep long, copies long, dim int, vector binary, codes binary, places array<int>"), "codes")
    # The bucket of each table; a length without an index is one bucket, of table 0.
    usual = F.transform("places", lambda c, t: F.struct(t.alias("table"), c.alias("code")))
    place = F.explode(F.when(F.size("places") > 0, usual).otherwise(F.array(F.struct(F.lit(0).alias("table"), F.lit(0).alias("code"))))).alias("place")
    bucket = ["dim", "table", "code"]
    dealt = coded.select("rep", "copies", "dim", "vector", "codes", place).select("rep", "copies", "dim", "vector", "codes", "place.table", "place.code")
    # Just crowded buckets are cut into blocks. They are few (each has over BLOCK rows) and written first, so Spark
    # knows their size and sends them to the rows if they are small, instead of dealing all rows twice.
    counts = coded.select("dim", place).groupBy("dim", "place.table", "place.code").count().filter(F.col("count") > BLOCK)
    crowded = written(counts.select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "crowded", small=True)
    dealt = dealt.join(crowded, bucket, "left").na.fill(1, ["blocks"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    me, other = F.col("block"), F.sequence(F.lit(0), F.col("blocks") - 1)
    side = lambda x: F.when(x == me, 0).when(me < x, 1).otherwise(2)
    tiles = F.transform(other, lambda x: F.struct(F.least(me, x).alias("i"), F.greatest(me, x).alias("j"), side(x).alias("side")))
    dealt = dealt.withColumn("tile", F.explode(tiles)).select(
        F.xxhash64(*bucket, "tile.i", "tile.j").alias("key"), *bucket, F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), F.col("tile.side").alias("side"), "rep", "copies", "vector", "codes"
    )
    order = ["key", *bucket, "i", "j"]
    dealt = dealt.repartition("key").sortWithinPartitions(*order)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple] = []
        for run in keyed_runs(batches, "key"):
            whole = run.combine_chunks().to_batches()[0]
            named = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in order[1:]], 1)
            cut = np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1  # keys that hash alike are kept apart
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(named)]):
                if b - a < 2:
                    continue
                part = whole.slice(a, b - a)
                codes = np.stack([np.frombuffer(c, np.int32) for c in part.column("codes").to_pylist()])
                x = unit_rows(part.column("vector").to_pylist(), dtype)
                edges.append(link_block(part.column("rep").to_numpy(), part.column("side").to_numpy(), codes, part.column("copies").to_numpy(), x, int(named[a, 1]), threshold))
            if len(edges) >= 2000:
                yield _pairs(edges)
                edges = []
        if edges:
            yield _pairs(edges)

    found = written(dealt.mapInArrow(rerank, "kind int, a long, b long"), "links")
    joined = components(found.filter("kind = 0").select("a", "b")).select(F.col("id").alias("rep"), "component")
    links = found.filter("kind = 1").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    by_class = classes.select("digest", "rep", "copies").join(joined, "rep", "left").join(links, "rep", "left")
    by_class = by_class.select("digest", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    digest = F.when(F.col("vec_id").isNotNull(), F.md5("vector")).alias("digest")
    out = blobs.select("vec_id", digest).join(by_class, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast(T.LongType()).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    a, b, ids, n = (np.concatenate(x) for x in zip(*found))
    kind = np.repeat([0, 1], [len(a), len(ids)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([a, ids])), pa.array(np.concatenate([b, n]))], ["kind", "a", "b"])

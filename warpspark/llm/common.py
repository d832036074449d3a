"""Shared pieces of the training-data operators: tables, scratch space and vectorised word hashing.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. UTF-8 never uses these bytes inside a longer
character, so cutting the bytes gives the same words as cutting the characters.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WHITE = bytes([0x20, *range(0x09, 0x0E)])
LETTER = np.zeros(256, bool)  # lower-cased ASCII letters and digits, and all of longer characters
LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
CONTINUATION = bytes(range(0x80, 0xC0))
CHUNK = 1 << 20  # bytes of text hashed at once; bounds the temporaries of a Python worker


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. If unset, one machine (tests) has a folder of our
    own; a cluster has none that all can see, which is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="warpspark-")
        sc.setCheckpointDir(at)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def written(df: DataFrame, tag: str, small: bool = False, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. small: of rows
    that are few and cheap to make, so they go to one file for each core and not to one for each partition. by: a column
    (the last) that has a folder for each value, so a filter by it reads no others."""
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/warpspark-{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the tables that written() made in this program, once no result that reads them is needed; their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that df has no column of (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes together; a longer document stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG = 128  # bytes; longer words are hashed one by one


def _word_hashes(buf: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans of buf: eight bytes at a time, mixed after each, for all words at once."""
    size = end - start
    out = mix(size.astype(np.uint64) * _STEP)
    padded = buf + bytes(8)
    blocks = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    at = np.flatnonzero(size <= _LONG)
    done = 0
    while len(at):
        rest = size[at] - done
        keep = np.minimum(rest, 8)
        block = blocks[start[at] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * keep.astype(np.uint64)))
        out[at] = mix((out[at] ^ block) * _STEP + np.uint64(done + 1))
        at, done = at[rest > 8], done + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """Words of several texts: byte spans, 64-bit hashes and the range of words of each text.

    Every eight bytes of a word pass a mixing step of their own, so no arrangement of a word's bytes cancels out as
    in polynomial hashes; two different words are equal by hash with a chance of 2**-64.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, letters: np.ndarray | None = None):
        """letters: which bytes (after lower-casing) are of words; all but white space if not given."""
        joined = b"\n".join(texts)
        if lower:
            joined = joined.lower()  # bytes.lower() changes A-Z only
        self.raw = joined
        buf = np.frombuffer(joined, np.uint8)
        n = len(buf)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        inside = np.empty(n + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = (~SPACE if letters is None else letters)[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        cut = np.searchsorted(self.start, self.text_start)
        self.first = np.append(cut, len(self.start))  # words of text i: first[i]:first[i+1]
        self.hash = _word_hashes(joined, self.start, self.end)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_GRAM = np.uint64(0xD6E8FEB86659FD93)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _GRAM + right)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words (over text limits too; the caller drops those). Runs are put together
    from runs of half their length and mixed each time."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    power, size, out, have = hashes, 1, None, 0
    while True:
        if n & size:
            out = power if out is None else _pair(out[: len(hashes) - have - size + 1], power[have:])
            have += size
        if 2 * size > n:
            return mix(out)
        power = _pair(power[:-size], power[size:])
        size *= 2


def keyed_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches that come in the key's order. Holds one key's rows and a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if a == b:
                continue
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


FILTER_LOG = (16, 29)  # bits of a filter of ids, as powers of two: 64 MB at most


def id_filter(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A filter of the ids of a column, 16 bits for each of them between the bounds, and the power of two of its bits.
    Slices of it are made on the executors; a full one lets more rows pass and never fewer."""
    total = ids.count()
    log = min(max(int(16 * total).bit_length(), FILTER_LOG[0]), FILTER_LOG[1])
    each = 1 << (log - 8)

    at = F.shiftrightunsigned(F.xxhash64(column), 64 - log)
    dealt = ids.select(F.floor(at / each).cast("int").alias("slice"), (at % each).alias("bit")).distinct().repartition("slice").sortWithinPartitions("slice")
    out = np.zeros((1 << log) // 8, np.uint8)
    for row in dealt.mapInArrow(lambda batches: keyed_bits(batches, each), "slice int, bits binary").toLocalIterator():
        a = row["slice"] * each // 8
        out[a : a + each // 8] = np.frombuffer(row["bits"], np.uint8)
    return out, log


def keyed_bits(batches: Iterator[pa.RecordBatch], each: int) -> Iterator[pa.RecordBatch]:
    """One packed slice for each run of rows (slice, bit), rows coming in order of slices."""
    at, bits = None, np.zeros(0, np.uint8)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])
    for batch in batches:
        slices, places = batch.column("slice").to_numpy(), batch.column("bit").to_numpy()
        for s in np.unique(slices).tolist():
            if s != at:
                if at is not None:
                    yield row()
                at, bits = s, np.zeros(each, np.uint8)
            bits[places[slices == s]] = 1
    if at is not None:
        yield row()


def passes(hashes: np.ndarray, filled: np.ndarray, log: int) -> np.ndarray:
    """Which rows the filter lets through, by the 64-bit hashes of their ids."""
    at = (hashes.astype(np.int64).view(np.uint64) >> np.uint64(64 - log)).astype(np.int64)
    return ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def hash_sample(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n rows with the least hashes of an id, or all if there are fewer. Only about n rows and a little more
    come to the driver's merge, however many partitions there are: the rest lies above a bound that follows from
    the count. The sample doesn't depend on order or partitions."""
    total = rows.count()
    h = F.xxhash64(column)
    if total > 2 * n:
        share = min(1.0, (n + 6 * math.sqrt(n) + 20) / total)
        bound = int(share * (1 << 64)) - (1 << 63)
        fewer = rows.filter(h <= F.lit(min(bound, (1 << 63) - 1)))
        if fewer.limit(n).count() == n:  # ids that repeat may hash above it together
            rows = fewer
    return rows.orderBy(h, column).limit(n)

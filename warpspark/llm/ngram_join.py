"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact intersection.

1. One pass gives each document its set of word n-grams (sorted 64-bit hashes), the set's digest and its band
   keys. Documents with equal sets are one class, kept as its least doc_id.
2. Classes that share a band key (`ROWS` min-hashes alike) become candidates for one another. Band keys only
   say which classes are to be compared at all: their number is chosen so that a pair at the threshold shares
   none with a probability under `MISS`, whatever the input. Each task first joins the classes that meet within
   it, so a key has at most one row for each batch, however many documents share it.
   Candidate groups are the connected components of those edges. A group of more than CROWD classes is keyed anew
   with twice the min-hashes in a key, so that sets which are alike by chance or by a template fall apart.
3. Candidate groups are cut into tiles by set size: a set is compared only with sets whose size allows the
   threshold, so a tile holds one size band and the next. A band of many sets is cut further into blocks, and
   pairs of blocks are tiles; so a crowded group is many tiles, not one.
4. In a tile each set has a bitmap of the parities of its hashed elements. The bits in which two bitmaps differ
   are at most the elements in which the sets differ, so they bound the overlap from above; only pairs within
   the bound are intersected exactly. Each pair is compared in one tile, and all links are counted there; what
   a tile gives are a count for each set and a spanning forest, never more rows than twice its sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, grams, id_filter, keyed_runs, mix, passes, text_bytes, written
from .components import components

ROWS = 6
MISS = 1e-9
BITS = 1024
TILE = 2048  # sets of a block at most; a tile holds two
WHOLE = 512  # sets of a group that is one tile
SPLIT = 8  # blocks that a band has at least, if they hold WHOLE / 2 sets each
CROWD = 32_768  # classes of a candidate group that is keyed anew
TILE_BYTES = 32 << 20  # of a block's elements, so that long texts don't make a large tile
PART = 1 << 20  # elements of sets that are intersected with one set at once
BUCKETS = 128  # groups of band keys, at least
BUCKET_BYTES = 64 << 20  # of a group's keys and ids


def bands(threshold: float, rows: int = ROWS) -> int:
    """Band keys so that a pair at the threshold shares none with a probability of at most MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))


def gram_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, A-Z lower-cased. Fewer words: the whole sequence is
    the one element. No words: empty."""
    for a, b in chunks(texts):
        words = Words(texts[a:b], lower=True)
        all_grams = grams(words.hash, n)
        for i in range(b - a):
            x, y = words.first[i], words.first[i + 1]
            if y - x >= n:
                yield np.unique(all_grams[x : y - n + 1])
            elif y > x:
                yield mix(grams(words.hash[x:y], y - x) + np.uint64(y - x))
            else:
                yield np.empty(0, np.uint64)


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def band_keys(elements: np.ndarray, count: int, coefficients: tuple[np.ndarray, np.ndarray], per_key: int = ROWS) -> np.ndarray:
    """Keys of the bands; each is a hash of per_key min-hashes and the band's number."""
    mul, add = coefficients
    x = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(count * per_key, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):  # bounds the temporary for very long texts
        part = np.multiply.outer(mul, x[at : at + 4096])
        part += add[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    rows = least.reshape(count, per_key).astype(np.uint64)
    key = np.arange(count, dtype=np.uint64)
    for j in range(per_key):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j] + np.uint64(1))
    return key


def documents_sets(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, docs, n_shingles, digest, keys): the digest of each set and its band keys, packed. Documents of a
    batch with equal sets are one row, named by the least of their ids, so a set that very many documents share
    has a row for each batch wherever its digest is shuffled."""
    count = bands(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients = _coefficients(count * ROWS)
        for batch in batches:
            members: dict[bytes, list] = {}
            sizes, keys = [], []
            for doc, s in zip(batch.column("doc_id").to_pylist(), gram_sets(text_bytes(batch.column("text")), n)):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest not in members:
                    members[digest] = []
                    sizes.append(len(s))
                    keys.append(band_keys(s, count, coefficients).tobytes() if len(s) else None)
                members[digest].append(doc)
            least = [min((d for d in some if d is not None), default=None) for some in members.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(least, pa.int64()),
                    pa.array(list(members.values()), pa.list_(pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.array(list(members), pa.binary()),
                    pa.array(keys, pa.binary()),
                ],
                ["doc_id", "docs", "n_shingles", "digest", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, docs array<long>, n_shingles long, digest binary, keys binary")


def star_edges(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, id) rows: the edges from each id to the least id of its key, without repeats; and one row for
    each key with that least id."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = ids[first][np.cumsum(first) - 1]
    other = ids != least
    edges = np.unique(np.stack([ids[other], least[other]], 1), axis=0)
    return edges[:, 0], edges[:, 1], keys[first], ids[first]


def candidate_edges(classes: DataFrame, buckets: int) -> DataFrame:
    """(a, b) of classes that share a band key, as stars. classes: (doc_id, keys)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc_id").to_numpy()
            raw = [np.frombuffer(k, np.uint64) for k in batch.column("keys").to_pylist()]
            if not raw:
                continue
            a, b, keys, ids = star_edges(np.concatenate(raw), np.repeat(docs, [len(k) for k in raw]))
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cut))
            blobs = [(keys[order[cut[i] : cut[i + 1]]].tobytes(), ids[order[cut[i] : cut[i + 1]]].tobytes()) for i in used]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([used, np.full(int(len(a) > 0), -1)]).astype(np.int64)),
                    pa.array([x for x, _ in blobs] + [a.tobytes()] * (len(a) > 0), pa.binary()),
                    pa.array([y for _, y in blobs] + [b.tobytes()] * (len(a) > 0), pa.binary()),
                ],
                ["bucket", "x", "y"],
            )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, _, _ = star_edges(np.frombuffer(b"".join(pdf["x"]), np.uint64), np.frombuffer(b"".join(pdf["y"]), np.int64))
        return pd.DataFrame({"a": a, "b": b})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], ["a", "b"])

    parts = written(classes.mapInArrow(local, "bucket long, x binary, y binary"), "bands")
    met = parts.filter("bucket >= 0").groupBy("bucket").applyInPandas(meet, "a long, b long")
    own = parts.filter("bucket < 0").mapInArrow(unpack, "a long, b long")
    return met.unionByName(own)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps, one row of 64-bit words for each set."""
    out = np.zeros((len(sets), BITS), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def count_tile(ids: np.ndarray, sets: list[np.ndarray], percent: int, copies: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """(links that join all of the tile's sets that links join: a spanning forest; the number of links of each id,
    weighted by the copies of the other end). side: sets of side 1 meet sets of side 2 only, those of 0 all."""
    order = np.lexsort((ids, [len(s) for s in sets]))
    ids = ids[order]
    copies = np.ones(len(ids), np.int64) if copies is None else copies[order]
    side = np.zeros(len(ids), np.int64) if side is None else side[order]
    size = np.array([len(sets[i]) for i in order], np.int64)
    marks = bitmaps([sets[i] for i in order])
    # Elements by number, so that one row of marks says which of them a set has.
    _, number = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    number = np.split(number.astype(np.int32), np.cumsum(size)[:-1])
    has = np.zeros(1 + max((int(x.max()) for x in number if len(x)), default=0), bool)
    group = np.arange(len(ids))
    links, found = [], np.zeros(len(ids), np.int64)
    # 100 |A&B| >= percent |A|B| means |A^B| <= (100 - percent) / (100 + percent) (|A| + |B|).
    for i in range(1, len(ids)):
        low = np.searchsorted(size[:i], -(-percent * size[i] // 100))
        if low == i:
            continue
        differ = np.bitwise_count(marks[low:i] ^ marks[i]).sum(axis=1)
        near = (100 + percent) * differ.astype(np.int64) <= (100 - percent) * (size[low:i] + size[i])
        near &= (ids[low:i] != ids[i]) & ((side[low:i] != side[i]) | (side[i] == 0))
        near = low + np.flatnonzero(near)
        has[number[i]] = True
        for part in np.split(near, np.flatnonzero(np.diff(np.cumsum(size[near]) // PART)) + 1):
            if not len(part):
                continue
            both = np.add.reduceat(has[np.concatenate([number[j] for j in part])].astype(np.int64), np.cumsum(size[part]) - size[part])
            part = part[100 * both >= percent * (size[i] + size[part] - both)]
            found[i] += copies[part].sum()
            found[part] += copies[i]
            other, first = np.unique(group[part], return_index=True)
            fresh = other != group[i]
            links += [(int(ids[i]), int(ids[j])) for j in part[first[fresh]]]
            if fresh.any():
                group[np.isin(group, other[fresh])] = group[i]
        has[number[i]] = False
    some = np.flatnonzero(found)
    return links, dict(zip(ids[some].tolist(), found[some].tolist()))


def link_tile(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all of the tile's sets that links join: a spanning forest."""
    return count_tile(ids, sets, percent)[0]


def similar_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """similar_links() without n_links: doc_id, n_shingles, component_id."""
    return similar_links(docs, n, percent).drop("n_links")


def similar_links(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least doc_id that links reach), n_links
    (the number of other doc_ids whose set is similar, those with an equal set included).

    Documents without words, or with a null text, have an empty set and no links. Equal sets always link.
    Repeated rows of one doc_id with equal texts give a row each and count once. A row without a doc_id is no link of
    others and joins just the class of its own set, whose links it has. An empty table gives an empty table. Very
    long texts are whole sets, hashed and keyed part by part. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    sets = written(documents_sets(docs, n, threshold), "sets")
    named = sets.filter("n_shingles > 0").select("digest", F.explode("docs").alias("doc"))
    classes = named.groupBy("digest").agg(F.min("doc").alias("rep"), F.count_distinct("doc").alias("copies"))
    joined = written(sets.select("doc_id", "docs", "n_shingles", "digest").join(classes, "digest", "left").drop("digest"), "classes")
    reps = joined.filter("doc_id = rep").select("doc_id").distinct()
    keyed = sets.filter("n_shingles > 0").select("doc_id", "keys").join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    groups = components(candidate_edges(keyed, key_buckets(spark, sets.count(), bands(threshold))))
    crowds = groups.groupBy("component").count().filter(F.col("count") > CROWD).select("component")
    if not crowds.isEmpty():
        inside = written(groups.join(crowds, "component", "left_semi").select("id"), "crowds", small=True)
        again = components(candidate_edges(*stricter_keys(docs, inside, n, threshold)))
        groups = groups.join(crowds, "component", "left_anti").select("id", "component").unionByName(again)
    copies = joined.filter("doc_id = rep").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    candidates = groups.select(F.col("id").alias("doc_id"), F.col("component").alias("group")).join(copies, "doc_id")
    links = written(tile_links(docs, candidates, n, percent), "links")
    found = components(links.filter("n is null").select("a", "b"))
    counts = links.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    named = joined.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").join(counts, "rep", "left")
    each = named.select(F.explode("docs").alias("doc_id"), "n_shingles", "component", "rep", "copies", "links")
    own = F.coalesce("copies", F.lit(0)) - (F.col("rep").isNotNull() & F.col("doc_id").isNotNull()).cast("long")
    return each.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"), (own + F.coalesce("links", F.lit(0))).alias("n_links"))


def key_buckets(spark: SparkSession, sets: int, count: int) -> int:
    """Buckets of band keys so that one holds BUCKET_BYTES of keys and ids."""
    return max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sets * 16 * count // BUCKET_BYTES))


def stricter_keys(docs: DataFrame, ids: DataFrame, n: int, threshold: float) -> tuple[DataFrame, int]:
    """(doc_id, keys) of these documents with twice the min-hashes in a key, and buckets for them. ids: (id)."""
    spark, per_key = docs.sparkSession, 2 * ROWS
    count = bands(threshold, per_key)
    filled, log = id_filter(ids, "id")
    sent = spark.sparkContext.broadcast(filled)  # of bounded size, see FILTER_LOG

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients = _coefficients(count * per_key)
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(passes(batch.column("h").to_numpy(), sent.value, log))))
            keys = [band_keys(s, count, coefficients, per_key).tobytes() if len(s) else b"" for s in gram_sets(text_bytes(batch.column("text")), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary())], ["doc_id", "keys"])

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "doc_id long, keys binary")
    return keyed.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), key_buckets(spark, ids.count(), count)


def tile_links(docs: DataFrame, candidates: DataFrame, n: int, percent: int) -> DataFrame:
    """Exact links (a, b, null) within the candidate groups, as spanning forests of their tiles, and (a, null, n): n
    links of a that its tile has. Each pair is in one tile. candidates: (doc_id, group, copies)."""
    spark = docs.sparkSession
    candidates = written(candidates, "candidates", small=True)
    filled, log = id_filter(candidates, "doc_id")
    sent = spark.sparkContext.broadcast(filled)  # of bounded size, see FILTER_LOG

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(passes(batch.column("h").to_numpy(), sent.value, log))
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
            made = list(gram_sets(text_bytes(batch.column("text")), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())],
                ["doc_id", "size", "elements"],
            )

    sets = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(make, "doc_id long, size long, elements binary")
    sets = sets.filter("size > 0").join(candidates, "doc_id")
    sets = written(sets.withColumn("band", F.floor(F.log(F.col("size")) / -math.log(percent / 100)).cast("int")), "members")
    counts = sets.groupBy("group", "band").agg(F.count("*").alias("sets"), (F.sum("size") * 8 / TILE_BYTES).alias("filled"))
    # Blocks of a band: as many as it needs, by sets or by bytes of elements, so no tile holds more than two of them.
    each = F.least(F.lit(TILE), F.greatest(F.lit(WHOLE // 2), F.ceil(F.col("sets") / SPLIT)))
    blocks = counts.select("group", "band", F.ceil(F.greatest(F.col("sets") / each, "filled")).cast("int").alias("blocks"))
    whole = counts.groupBy("group").agg(((F.sum("sets") <= WHOLE) & (F.sum("filled") <= 1)).alias("whole"))
    after = blocks.select("group", (F.col("band") - 1).alias("band"), F.col("blocks").alias("next"))
    before = blocks.select("group", (F.col("band") + 1).alias("band"), F.col("blocks").alias("previous"))
    plan = blocks.join(after, ["group", "band"], "left").join(before, ["group", "band"], "left").join(whole, "group").na.fill(0, ["next", "previous"])
    # Written first: the join then has plain shuffles on both sides, so Spark can deal a crowded band out anew, or sends
    # the plan to the sets if it is small.
    plan = written(plan, "tiles", small=True)
    placed = sets.join(plan, ["group", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    seq = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda band, kind, i, j, side: F.struct(band.alias("band"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    me, band = F.col("block"), F.col("band")
    half = lambda x: F.when(x == me, 0).when(me < x, 1).otherwise(2)
    own = F.transform(seq(F.col("blocks")), lambda x: tile(band, 0, F.least(me, x), F.greatest(me, x), half(x)))
    up = F.transform(seq(F.col("next")), lambda x: tile(band, 1, me, x, F.lit(1)))
    down = F.transform(seq(F.col("previous")), lambda x: tile(band - 1, 1, x, me, F.lit(2)))
    single = F.array(tile(F.lit(0), 2, F.lit(0), F.lit(0), F.lit(0)))
    tiles = F.when(F.col("whole"), single).otherwise(F.concat(own, up, down))
    dealt = placed.select("group", "doc_id", "copies", "elements", F.explode(tiles).alias("tile"))
    place = ["group", "band", "kind", "i", "j"]
    dealt = dealt.select(F.xxhash64("group", "tile.band", "tile.kind", "tile.i", "tile.j").alias("key"), "group", *[F.col(f"tile.{c}") for c in (*place[1:], "side")], "doc_id", "copies", "elements")
    dealt = dealt.repartition("key").sortWithinPartitions("key", *place)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in keyed_runs(batches, "key"):
            whole = run.combine_chunks().to_batches()[0]
            named = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in place], 1)
            cut = np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1  # keys that hash alike are kept apart
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(named)]):
                part = whole.slice(a, b - a)
                _, once = np.unique(part.column("doc_id").to_numpy(), return_index=True)  # rows may repeat a doc_id
                part = part.take(pa.array(once))
                sets = [np.frombuffer(x, np.uint64) for x in part.column("elements").to_pylist()]
                ids, copies, side = (part.column(c).to_numpy() for c in ("doc_id", "copies", "side"))
                links, counts = count_tile(ids, sets, percent, copies, side)
                x = pa.array([p for p, _ in links] + list(counts), pa.int64())
                y = pa.array([q for _, q in links] + [None] * len(counts), pa.int64())
                yield pa.RecordBatch.from_arrays([x, y, pa.array([None] * len(links) + list(counts.values()), pa.int64())], ["a", "b", "n"])

    return dealt.mapInArrow(link, "a long, b long, n long")

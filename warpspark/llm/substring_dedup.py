"""Substring dedup: repeated windows of words through prefix-partitioned suffix trees.

Every word position begins a suffix. A suffix is written as nine letters: a byte for each of its first eight words
and a 64-bit letter for the whole window of `window` words, which stands for the rest of it. This alphabet has an
order, so suffixes have one too, and a tree of them has nodes at depths of 0 to 8 words and at the window's depth.

Suffixes are split by prefixes of variable length: those of two words are counted first; where more than GROUP
suffixes begin alike, four words are counted, then six and eight. Neighbouring small prefixes share a group. A prefix
that is crowded even at eight words is reduced in two steps, first by the task that read it, then by the rest of the
window, so that neither one window that recurs everywhere nor many windows behind one phrase meet in one task. A
task builds the tree of its group: the suffixes in order and the common prefixes of neighbours. Its inner nodes at
the window's depth or deeper are the repeats; the leaves of such a node are its places, and all but the first are
taken out. Runs of such places in a document are the maximal repeats.

Most suffixes share a window with no other, so they need not be dealt at all. The least of the hashes of the
`ANCHOR`-word runs in a window is the same wherever the window stands; a first pass counts only those anchors,
and a filter of bounded size with the anchors of two or more documents sends on just the suffixes whose window
can recur (a full filter sends on more of them, and is never wrong the other way). The counts of prefixes are of
what passes it. Repeats within a batch are found there, so a passage that a third of all documents share is dealt
once for each batch, not once for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, fresh, grams, keyed_runs, mix, text_bytes, written

WINDOW = 20
ANCHOR = 10
GROUP = 1 << 16  # suffixes of a group
DEALT = 4 << 20  # bytes of suffixes and places that a task gets, about
LETTERS = 8  # words with a letter of their own
LEVELS = (2, 4, 6, 8)  # words of the prefixes that are counted, each time for those that are crowded so far
LOG_BITS = (20, 29)  # of the anchor filter: 64 MB at most
BUCKETS = 128
BUCKET_BYTES = 64 << 20  # of a bucket's anchors or places
FLUSH = 1 << 20
UNIT = 6 << 20  # bytes of text whose windows a worker holds at once


def window_anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one text, the text of each, and its anchor."""
    n = len(words.hash)
    if n < window:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    k = min(ANCHOR, window)
    least = grams(words.hash, k)
    span, have = window - k + 1, 1
    while have < span:  # the least of `span` neighbours by doubling
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    doc = words.doc_of_word()
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    return at, doc[at], least[at]


def suffix_letters(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the suffixes at these words: those of the first words in one number, the first word highest,
    and the letter of the whole window."""
    one = mix(hashes * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)) >> np.uint64(56)
    one = np.concatenate([one, np.zeros(LETTERS, np.uint64)])
    key, size = one, 1
    while size < LETTERS:
        key = (key[:-size] << np.uint64(8 * size)) | key[size:]
        size *= 2
    key = key[at]
    if window < LETTERS:
        key &= ~np.uint64((1 << 8 * (LETTERS - window)) - 1)
    return key, grams(hashes, window)[at]


def common_prefixes(key: np.ndarray, mark: np.ndarray, window: int) -> np.ndarray:
    """Words that each suffix shares with the one before it, of suffixes in order; the first shares none. Depths
    between the letters of single words and the window count as the former."""
    out = np.zeros(len(key), np.int64)
    differ = key[1:] ^ key[:-1]
    for j in range(1, min(LETTERS, window) + 1):
        out[1:] += differ >> np.uint64(64 - 8 * j) == 0
    out[1:][(differ == 0) & (mark[1:] == mark[:-1])] = window
    return out


def deep_nodes(key: np.ndarray, mark: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree of a group: (leaves in order, the first leaf of the deep node that each of them hangs on). A leaf
    that shares no window hangs on itself."""
    order = np.lexsort((start, doc, mark, key))
    own = common_prefixes(key[order], mark[order], window) < window
    return order, order[np.flatnonzero(own)[np.cumsum(own) - 1]]


class Prefixes:
    """The groups: lower bounds of their keys, rising from 0, and into how many parts a group is split."""

    def __init__(self, bounds: np.ndarray, parts: np.ndarray):
        self.bounds, self.parts = bounds, parts

    def group(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, key, "right") - 1


_PARTS = 1 << 20  # numbers of the parts of a group


def plan_prefixes(counted: DataFrame, limit: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Of the counted children of crowded prefixes, (parent, prefix, n): the first prefix and the size of each group
    (less than twice the limit, or one crowded prefix), and the prefixes that are crowded. The driver gets a row for each group, not for each prefix."""
    running = Window.partitionBy("parent").orderBy("prefix")
    before = F.coalesce(F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crowded = F.col("n") > limit
    turns = F.sum(F.when(crowded | F.lag(crowded, 1, False).over(running), 1).otherwise(0)).over(running)
    rows = counted.withColumns({"before": before, "turn": turns}).withColumn("slot", F.floor(F.col("before") / limit))
    groups = rows.groupBy("parent", "turn", "slot").agg(F.min("prefix").alias("prefix"), F.sum("n").alias("n"), F.max(crowded).alias("crowded")).collect()
    return [(r["prefix"], r["n"]) for r in groups], [r["prefix"] for r in groups if r["crowded"]]


def _by_bucket(values: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(cut)):
        yield int(i), values[order[cut[i] : cut[i + 1]]]


def anchor_table(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, one, more, n): anchors of one document and of more within a batch, by range of hashes, and their
    number."""
    shift = np.uint64(64 - int(buckets - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            kept = []
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                at, doc, anchor = window_anchors(words, window)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                anchor, doc = anchor[new], doc[new]
                order = np.lexsort((doc, anchor))
                anchor, doc = anchor[order], doc[order]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                kept.append(anchor[new])  # once for each document
            if not kept:
                continue
            values, n = np.unique(np.concatenate(kept), return_counts=True)
            one = dict(_by_bucket(values[n == 1], (values[n == 1] >> shift).astype(np.int64), buckets))
            more = dict(_by_bucket(values[n > 1], (values[n > 1] >> shift).astype(np.int64), buckets))
            keys = sorted({*one, *more})
            blob = lambda d, k: d[k].tobytes() if k in d else b""
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([blob(one, k) for k in keys], pa.binary()),
                    pa.array([blob(more, k) for k in keys], pa.binary()),
                    pa.array([sum(len(d[k]) for d in (one, more) if k in d) for k in keys], pa.int64()),
                ],
                ["bucket", "one", "more", "n"],
            )

    return docs.select("text").mapInArrow(run, "bucket long, one binary, more binary, n long")


def split_buckets(anchors: DataFrame, buckets: int, by: int) -> DataFrame:
    """Each of the buckets as `by` smaller ranges of hashes; both are powers of two."""
    shift, mask = np.uint64(64 - (buckets * by).bit_length() + 1), np.uint64(by - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "one", "more"))):
                one, more = ({k: v.tobytes() for k, v in _by_bucket(x, (x >> shift & mask).astype(np.int64), by)} for x in (np.frombuffer(b, np.uint64) for b in blobs))
                keys = sorted({*one, *more})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([bucket * by + k for k in keys], pa.int64()),
                        pa.array([one.get(k, b"") for k in keys], pa.binary()),
                        pa.array([more.get(k, b"") for k in keys], pa.binary()),
                    ],
                    ["bucket", "one", "more"],
                )

    return anchors.select("bucket", "one", "more").mapInArrow(run, "bucket long, one binary, more binary")


def recurring(anchors: DataFrame) -> DataFrame:
    """(bucket, found, n): the anchors of two or more documents of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in keyed_runs(batches, "bucket"):
            raw = b"".join(rows.column("one").to_pylist())
            more = b"".join(rows.column("more").to_pylist())
            values, n = np.unique(np.frombuffer(raw + more + more, np.uint64), return_counts=True)
            values = values[n > 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows.column("bucket")[0].as_py()]), pa.array([values.tobytes()], pa.binary()), pa.array([len(values)])], ["bucket", "found", "n"]
            )

    dealt = anchors.select("bucket", "one", "more").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "bucket long, found binary, n long")


def anchor_filter(found: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """A bit for each recurring anchor: 32 bits for each of them, between the bounds. What comes to the
    driver are the slices of the filter, not the anchors."""
    total = found.agg(F.sum("n")).first()[0] or 0
    log = min(max(int(32 * total).bit_length() - 1, LOG_BITS[0]), LOG_BITS[1])
    log = max(log, int(buckets - 1).bit_length() + 3)
    each = (1 << log) // buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = []
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("found").to_pylist()):
                bits = np.zeros(each, np.uint8)
                bits[(np.frombuffer(raw, np.uint64) >> np.uint64(64 - log)).astype(np.int64) - bucket * each] = 1
                slices.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(slices, pa.binary())], ["bucket", "bits"])

    out = np.zeros((1 << log) // 8, np.uint8)
    for row in found.select("bucket", "found").mapInArrow(run, "bucket long, bits binary").toLocalIterator():
        out[row["bucket"] * each // 8 : (row["bucket"] + 1) * each // 8] = np.frombuffer(row["bits"], np.uint8)
    return out, log


def runs(starts: np.ndarray) -> np.ndarray:
    """Rising starts as (start, length) pairs of runs without a gap."""
    if not len(starts):
        return np.empty((0, 2), np.int32)
    edge = np.flatnonzero(np.diff(starts) != 1)
    first = starts[np.append(0, edge + 1)]
    last = starts[np.append(edge, len(starts) - 1)]
    return np.stack([first, last - first + 1], 1).astype(np.int32)


def _doc_rows(doc: np.ndarray, start: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Starts of windows, packed for each document."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.flatnonzero(np.diff(doc)) + 1
    ids = doc[np.append(0, cut)].tolist() if len(doc) else []
    return ids, [runs(part).tobytes() for part in np.split(start, cut)] if len(doc) else []


_DEALT = ["group", "key", "mark", "at"]  # groups below 0 are buckets of documents with places found
_SCHEMA = "group long, key binary, mark binary, at binary"


def _packed(doc: np.ndarray, start: np.ndarray) -> bytes:
    return doc.astype(np.int64).tobytes() + start.astype(np.int32).tobytes()


def _place_rows(doc: np.ndarray, start: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places packed for each bucket of documents."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    bucket = np.abs(doc) % buckets
    parts = dict(_by_bucket(np.arange(len(doc)), bucket, buckets))
    none = pa.nulls(len(parts), pa.binary())
    blobs = pa.array([_packed(doc[p], start[p]) for p in parts.values()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([-1 - k for k in parts], pa.int64()), none, none, blobs], _DEALT)


def _suffix_rows(group: np.ndarray, key: np.ndarray, mark: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Suffixes packed for each group."""
    by = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.diff(group[by])) + 1
    parts = np.split(by, cut) if len(by) else []
    for i in range(0, len(parts), 256):
        some = parts[i : i + 256]
        blob = lambda of: pa.array([of(p) for p in some], pa.binary())  # noqa: B023, E731
        columns = [blob(lambda p: key[p].tobytes()), blob(lambda p: mark[p].tobytes()), blob(lambda p: _packed(doc[p], start[p]))]
        yield pa.RecordBatch.from_arrays([pa.array([int(group[p[0]]) for p in some], pa.int64()), *columns], _DEALT)


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of packed places."""
    doc = np.concatenate([np.frombuffer(x[: len(x) // 12 * 8], np.int64) for x in blobs])
    return doc, np.concatenate([np.frombuffer(x[len(x) // 12 * 8 :], np.int32) for x in blobs])


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of documents whose repeats are found together before anything is dealt."""
    for batch in batches:
        ids, texts = batch.column("doc_id").to_numpy(), text_bytes(batch.column("text"))
        for a, b in chunks(texts, UNIT):
            yield ids[a:b], texts[a:b]


def _anchor_bits(docs: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """The filter of recurring anchors, and the number of its bits as a power of two."""
    wanted = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = 1 << int(wanted - 1).bit_length()
    anchors = written(anchor_table(docs, window, buckets), "anchors")
    # The first pass can't know how many anchors there are; if too many for its buckets, they are split.
    total = anchors.agg(F.sum("n")).first()[0] or 0
    by = 1 << int(8 * total // (buckets * BUCKET_BYTES)).bit_length()
    if by > 1:
        anchors, buckets = split_buckets(anchors, buckets, by), buckets * by
    return anchor_filter(written(recurring(anchors), "recurring"), buckets)


class _Unit:
    """The suffixes of a unit's texts: places rise with doc_id and start. `head` is the first place of each window
    within the unit, `later` the others, `first` the heads that the filter lets through."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int, filled: np.ndarray, shift: np.uint64):
        by = np.argsort(ids, kind="stable")
        ids, texts = ids[by], [texts[i] for i in by]
        kept: list[tuple] = [(np.empty(0, np.uint64), np.empty(0, np.uint64), ids[:0], np.empty(0, np.int32), np.empty(0, bool))]
        for a, b in chunks(texts):
            words = Words(texts[a:b])
            at, doc, anchor = window_anchors(words, window)
            if len(at):
                bit = (anchor >> shift).astype(np.int64)
                may = ((filled[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
                kept.append((*suffix_letters(words.hash, at, window), ids[a + doc], (at - words.first[doc]).astype(np.int32), may))
        self.key, self.mark, self.doc, self.start, may = (np.concatenate(x) for x in zip(*kept))
        del kept
        order = np.argsort(self.mark, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (self.mark[order[1:]] != self.mark[order[:-1]]) | (self.key[order[1:]] != self.key[order[:-1]])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        self.later = order[(self.doc[order] != self.doc[head]) | (self.start[order] != self.start[head])]
        first = np.sort(order[new])
        self.first = first[may[first]]


def plan(docs: DataFrame, window: int, sent, shift: np.uint64) -> tuple[Prefixes, int, int]:
    """The groups of suffixes that pass the filter, the number of these, and of places found within units."""
    spark = docs.sparkSession
    heavy, bounds, sizes, suffixes, places, before = np.empty(0, np.uint64), [], [], 0, 0, 0
    for level in LEVELS:
        above = spark.sparkContext.broadcast(heavy)  # one number for each GROUP of suffixes at most
        down, up = np.uint64(64 - 8 * level), np.uint64(64 - 8 * before)

        def count(batches: Iterator[pa.RecordBatch], down=down, up=up, above=above, root=before == 0) -> Iterator[pa.RecordBatch]:
            total = later = 0
            prefixes, numbers = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for ids, texts in units(batches):
                unit = _Unit(ids, texts, window, sent.value, shift)
                later += len(unit.later)
                key = unit.key[unit.first]
                if not root:
                    key = key[np.isin(key >> up, above.value)]
                found, n = np.unique(key >> down, return_counts=True)
                prefixes.append(found)
                numbers.append(n)
                total += len(found)
                if total > FLUSH:  # the same prefixes in many units are one row of the task
                    prefixes, numbers = (lambda x, y: ([x], [y]))(*_summed(prefixes, numbers))
                    total = len(prefixes[0])
            found, n = _summed(prefixes, numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(found.view(np.int64), -1)), pa.array(np.append(np.zeros(len(found), bool), True)), pa.array(np.append(n, later))], ["prefix", "later", "n"]
            )

        rows = docs.select("doc_id", "text").mapInArrow(count, "prefix long, later boolean, n long").groupBy("prefix", "later").agg(F.sum("n").alias("n"))
        rows = written(rows, "prefixes", small=True)
        if before == 0:
            got = {r["later"]: r["n"] for r in rows.groupBy("later").agg(F.sum("n").alias("n")).collect()}
            suffixes, places = got.get(False, 0), got.get(True, 0)
        # Prefixes of eight words are signed here; their order within a parent is kept by flipping the sign.
        unsigned = F.col("prefix").bitwiseXOR(F.lit(-(1 << 63))) if level == LETTERS else F.col("prefix")
        parent = F.shiftrightunsigned("prefix", 8 * (level - before)) if before else F.lit(0)
        groups, crowded = plan_prefixes(rows.filter(~F.col("later")).select(parent.alias("parent"), unsigned.alias("prefix"), "n"), GROUP)
        back = (lambda x: (x + (1 << 63))) if level == LETTERS else (lambda x: x)
        bounds += [back(p) << (64 - 8 * level) for p, _ in groups]
        sizes += [n for _, n in groups]
        heavy = np.array(sorted(back(p) for p in crowded), np.uint64)
        before = level
        if not len(heavy):
            break
    # A crowded prefix has a bound at each level; the groups below it begin at or after it, the last one counts.
    table = {0: 0} | dict(zip(bounds, sizes))
    keys = sorted(table)
    parts = np.array([max(1, -(-table[k] // GROUP)) for k in keys], np.int64)
    last = set((int(k) << (64 - 8 * before)) for k in heavy.tolist())
    parts[[k not in last for k in keys]] = 1
    return Prefixes(np.array(keys, np.uint64), np.minimum(parts, _PARTS)), suffixes, places


def _summed(prefixes: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(prefixes), return_inverse=True)
    return found, np.bincount(where, weights=np.concatenate(numbers), minlength=len(found)).astype(np.int64)


def repeat_places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, places): windows whose words also begin earlier, as packed (start, length) runs of starts, one
    row for each document that has any."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    bits, log = _anchor_bits(docs, window)
    sent, shift = spark.sparkContext.broadcast(bits), np.uint64(64 - log)  # of bounded size, see LOG_BITS
    prefixes, suffixes, places = plan(docs, window, sent, shift)
    planned = spark.sparkContext.broadcast(prefixes)  # 16 bytes for each GROUP of suffixes
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS, least, -(-12 * (suffixes + places) // BUCKET_BYTES))
    tasks = max(least, -(-(28 * suffixes + 12 * places) // DEALT))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = planned.value
        for salt, (ids, texts) in enumerate(units(batches), 31 * TaskContext.get().partitionId()):
            unit = _Unit(ids, texts, window, sent.value, shift)
            if len(unit.later):
                yield _place_rows(unit.doc[unit.later], unit.start[unit.later], buckets)
            first = unit.first
            group = groups.group(unit.key[first])
            parts = groups.parts[group]
            yield from _suffix_rows(group * _PARTS + salt % parts, unit.key[first], unit.mark[first], unit.doc[first], unit.start[first])

    def grow(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        groups = planned.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in keyed_runs(batches, "group"):
            number = rows.column("group")[0].as_py()
            if number < 0:
                yield from rows.to_batches()
                continue
            key, mark = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint64) for c in ("key", "mark"))
            doc, start = _unpack(rows.column("at").to_pylist())
            del rows
            order, node = deep_nodes(key, mark, doc, start, window)
            later = order[(doc[order] != doc[node]) | (start[order] != start[node])]
            held.append((doc[later], start[later]))
            if not last and groups.parts[number // _PARTS] > 1:  # the first leaves go on, by the rest of the window
                first = order[order == node]
                part = (mark[first] % groups.parts[number // _PARTS].astype(np.uint64)).astype(np.int64)
                yield from _suffix_rows(number // _PARTS * _PARTS + part, key[first], mark[first], doc[first], start[first])
            if sum(len(d) for d, _ in held) >= FLUSH:
                yield _place_rows(*(np.concatenate(x) for x in zip(*held)), buckets)
                held = []
        if held:
            yield _place_rows(*(np.concatenate(x) for x in zip(*held)), buckets)

    def trees(dealt: DataFrame, last: bool) -> DataFrame:
        return dealt.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(lambda batches: grow(batches, last), _SCHEMA)

    found = trees(docs.mapInArrow(deal, _SCHEMA), False)
    if (prefixes.parts > 1).any():
        found = written(found, "crowded")
        found = found.filter("group < 0").unionByName(trees(found.filter("group >= 0"), True))
    found = found.select("group", "at").repartition("group").sortWithinPartitions("group")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in keyed_runs(batches, "group"):
            ids, places = _doc_rows(*_unpack(rows.column("at").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.binary())], ["doc_id", "places"])

    return found.mapInArrow(gather, "doc_id long, places binary")


def maximal_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, n_words): the stretches of words of each document that repeat earlier ones, as long as their
    windows overlap or touch without a gap between starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in batch.column("places").to_pylist()]
            doc = np.repeat(batch.column("doc_id").to_numpy(), [len(p) for p in pairs])
            both = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(both[:, 0].astype(np.int64)), pa.array(both[:, 1].astype(np.int64) + window - 1)], ["doc_id", "start", "n_words"])

    return repeat_places(docs, window).mapInArrow(run, "doc_id long, start long, n_words long")


def removed_words(places: bytes | None, n_words: int, window: int) -> np.ndarray:
    """The words that the windows at these places cover."""
    change = np.zeros(n_words + 1, np.int32)
    if places:
        pairs = np.frombuffer(places, np.int32).reshape(-1, 2)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 0] + pairs[:, 1] + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def with_places(docs: DataFrame, window: int, name: str) -> DataFrame:
    """docs with a column of that name for the places of repeats."""
    key = fresh(docs, "__place_doc")
    places = repeat_places(docs, window).select(F.col("doc_id").alias(key), F.col("places").alias(name))
    return docs.join(places, docs["doc_id"] == places[key], "left").drop(key)


def digest_kept(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words joined by one blank.

    Null texts have no words. Windows are judged on the input. Rows that repeat a doc_id with the same text
    count as one document (a doc_id is to name one text). Texts of fewer words than a window lose nothing, nor do
    rows without a doc_id, which take no part in the comparison. Very long texts are hashed a part of a batch at a
    time and compared whole. An empty table gives an empty table; other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digest = [], [], []
            for text, places in zip(text_bytes(batch.column("text")), batch.column("__places").to_pylist()):
                words = text.split()
                gone = removed_words(places, len(words), window)
                n.append(len(words))
                removed.append(int(gone.sum()))
                kept = words if not places else [w for w, g in zip(words, gone.tolist()) if not g]
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = with_places(docs.select("doc_id", "text"), window, "__places").select("doc_id", "text", "__places")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words taken out of `text`. The white space after each kept word stays as it was,
    so lines stay lines; texts without repeats stay byte for byte, null stays null. Other columns stay as they are;
    else as digest_kept()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            raw = batch.column(at).cast(pa.large_binary()).to_pylist()
            places = batch.column(name).to_pylist()
            out = []
            for text, found in zip(raw, places):
                if text and found:
                    words = Words([text])
                    gone = removed_words(found, len(words.start), window)
                    ends = np.append(words.start[1:], len(text))
                    text = b"".join(text[a:b] for a, b, g in zip(words.start.tolist(), ends.tolist(), gone.tolist()) if not g)
                out.append(text)
            columns = batch.columns
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            names = batch.schema.names
            keep = [i for i, n in enumerate(names) if n != name]
            yield pa.RecordBatch.from_arrays([columns[i] for i in keep], [names[i] for i in keep])

    name = fresh(docs, "__places")
    return with_places(docs, window, name).mapInArrow(run, docs.schema)

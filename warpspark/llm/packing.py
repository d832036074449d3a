"""Packing of documents into windows of tokens by Karmarkar-Karp multiway differencing.

A document is cut into whole windows and a rest; the rests of some hundred windows are one group, in which rests of
a few tokens go together as one item. Differencing keeps, for each partial partition, the sums of all windows; it
always merges the two partitions with the largest imbalance, the fullest window of one with the emptiest of the
other, so that the imbalances cancel and all windows come out near-equal. What a window then holds beyond its
capacity is cut off one of its items and put where there is room, so a rest is cut only if need be. If the pieces
(of LEAST tokens at least) can't be placed so, capacity is exceeded: the number of windows rises by one and the group
is partitioned anew.

Groups are formed within a task, in the order of its rows: no shuffle, no state beyond one group, and a task
that runs again gives the same rows. Every document in the table may be of one source; nothing is keyed.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import default_vocabulary, ranked_encoder
from .common import text_bytes

LENGTH = 1024
GROUP = 128  # windows that are balanced together
LEAST = 8  # tokens of the shortest piece that is cut off
TINY = 64  # tokens up to which short rests go together


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item by multiway differencing; ties go by position, so it is deterministic."""
    m = len(sizes)
    if windows <= 1 or m == 0:
        return np.zeros(m, np.int64)
    sums = np.zeros((m, windows), np.int64)
    sums[:, 0] = sizes  # falling order in each partition
    nodes = np.full((m, windows), -1, np.int64)
    nodes[:, 0] = np.arange(m)
    left, right = [], []  # parts of joined nodes, numbered from m on
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = m
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        na, nb = nodes[a], nodes[b][::-1]
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        joined = np.maximum(na, nb)
        left.append(na[both])
        right.append(nb[both])
        joined[both] = np.arange(made, made + len(both))
        made += len(both)
        order = np.argsort(-total, kind="stable")
        sums[a], nodes[a] = total[order], joined[order]
        heapq.heappush(heap, (int(sums[a, -1] - sums[a, 0]), a))
    last = heap[0][1]
    window = np.full(made, -1, np.int64)
    used = nodes[last] >= 0
    window[nodes[last][used]] = np.flatnonzero(used)
    lefts, rights = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    for node in range(made - 1, m - 1, -1):  # a joined node comes after its parts
        window[lefts[node - m]] = window[rights[node - m]] = window[node]
    return window[:m]


def level(pieces: list[list[tuple[int, int, int]]], capacity: int, least: int, whole: set[int]) -> bool:
    """Moves what the windows hold beyond capacity to those with room, in place; whether all of it could be placed.
    pieces: (item, start, length) of each window; items of `whole` aren't cut."""
    room = [capacity - sum(n for _, _, n in w) for w in pieces]
    loose: list[tuple[int, int, int]] = []
    for w, own in enumerate(pieces):
        while room[w] < 0:
            k = max(range(len(own)), key=lambda i: (own[i][0] not in whole, own[i][2]))
            item, start, n = own[k]
            off = max(-room[w], least)
            if item in whole or n - off < least:
                off = n
                own.pop(k)
            else:
                own[k] = (item, start, n - off)
            loose.append((item, start + n - off, off))
            room[w] += off
    for item, start, n in sorted(loose, key=lambda x: -x[2]):
        while n:
            fits = [w for w, r in enumerate(room) if r >= n]
            if fits:
                w, part = min(fits, key=lambda w: room[w]), n
            else:  # a part of it, which leaves a rest that isn't too short
                w = max(range(len(room)), key=lambda w: room[w])
                part = min(room[w], n - least)
                if item in whole or part < least:
                    return False
            pieces[w].append((item, start, part))
            room[w] -= part
            start, n = start + part, n - part
    return True


def pack(sizes: np.ndarray, capacity: int, least: int = LEAST, whole: set[int] = frozenset()) -> list[list[tuple[int, int, int]]]:
    """(item, start, length) of the pieces of each window; no window holds more than capacity. Items of over capacity
    aren't allowed, items of `whole` aren't cut."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        pieces: list[list[tuple[int, int, int]]] = [[] for _ in range(windows)]
        for i, w in enumerate(difference(sizes, windows).tolist()):
            pieces[w].append((i, 0, int(sizes[i])))
        if level(pieces, capacity, least, whole):
            return pieces
        windows += 1


def bundles(sizes: list[int], tiny: int) -> list[list[int]]:
    """Items: each size by itself, but those of at most tiny together up to that sum."""
    out: list[list[int]] = []
    filled = 0
    last: list[int] | None = None
    for i, n in enumerate(sizes):
        if n > tiny:
            out.append([i])
        elif last is None or filled + n > tiny:
            out.append(last := [i])
            filled = n
        else:
            last.append(i)
            filled += n
    return out


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids, if asked for).

    Each document is its ids and end_id, so even an empty or null text has one token. Within a sequence the
    offsets have no gap from 0. sequence_id is the task's number and a count, so it follows the partitions of the
    input. Very long texts are encoded whole and give whole windows. Repeated rows are packed each; an empty table
    gives an empty table; other columns, whatever their names, are ignored.
    """
    path = vocabulary or default_vocabulary()
    least, tiny = max(1, min(LEAST, length // 8)), max(1, min(TINY, length // 4))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ranked_encoder(path)
        base, count = TaskContext.get().partitionId() << 36, 0
        rows: list[tuple] = []
        rests: list[tuple[int | None, int, bytes, int]] = []  # document, start, ids, tokens of the document
        waiting = 0

        def emit(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces)) if pieces else [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<i4") for x in columns[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        def add(doc: int | None, start: int, raw: bytes, total: int, offset: int) -> None:
            rows.append((doc, start, len(raw) // 4, zlib.crc32(raw), total, base + count, offset, raw if with_ids else None))

        def balance() -> None:
            nonlocal count
            sizes = [len(r[2]) // 4 for r in rests]
            items = bundles(sizes, tiny)
            together = {k for k, of in enumerate(items) if len(of) > 1}
            for window in pack(np.array([sum(sizes[i] for i in of) for of in items], np.int64), length, least, together):
                offset = 0
                for k, at, n in sorted(window):
                    for i in items[k]:
                        doc, start, raw, total = rests[i]
                        raw = raw if k in together else raw[4 * at : 4 * (at + n)]
                        add(doc, start + (0 if k in together else at), raw, total, offset)
                        offset += len(raw) // 4
                count += bool(window)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                ids = enc.encode(text) + end
                total = len(ids) // 4
                for start in range(0, total - length + 1, length):
                    add(doc, start, ids[4 * start : 4 * (start + length)], total, 0)
                    count += 1
                if total % length:
                    start = total - total % length
                    rests.append((doc, start, ids[4 * start :], total))
                    waiting += total % length
                if waiting >= GROUP * length:
                    balance()
                    rests.clear()
                    waiting = 0
                if len(rows) >= 20_000:
                    yield emit(rows)
                    rows.clear()
        if rests:
            balance()
        if rows:
            yield emit(rows)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))

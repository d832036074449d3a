"""Token counts by section through offset-mapped attribution.

A document is encoded once as a whole; the tokens' character spans are then interval-joined to the spans of
its sections (or fields), and each token is counted in exactly one of them.

Rule for tokens that cross a border: a token belongs to the section that holds its first character. So the
counts of a document's sections add up to its tokens. `n_crossing` says how many of a section's tokens reach
into the next one. A line end belongs to the line that it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import default_vocabulary, ranked_encoder
from .common import text_bytes

_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def line_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text begin; the empty text has one empty line."""
    buf = np.frombuffer(text, np.uint8)
    return np.concatenate([[0], np.flatnonzero(buf == 0x0A) + 1])


def token_spans(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the tokens of a text."""
    ends = np.cumsum(lengths[ids])
    return ends - lengths[ids], ends


def attribute(starts: np.ndarray, token_start: np.ndarray, token_end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and tokens that reach into a later section, of each section. Both sides are in order, so the
    interval join is a binary search for each token."""
    at = np.searchsorted(starts, token_start, "right") - 1
    ends = np.append(starts[1:], size)
    crossing = at[token_end > ends[at]]
    return np.bincount(at, minlength=len(starts)), np.bincount(crossing, minlength=len(starts))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, sections: str | None = None) -> DataFrame:
    """One row for each section of each document: doc_id, section (from 0), start, end (code points, end
    exclusive), n_tokens, n_crossing, doc_tokens.

    Sections are the lines of `text`, or, with `sections`, an array<int> column of the rising code points at
    which sections begin (0 is added if missing, values beyond the text or null are left out). Null text is
    the empty text: one section without tokens. Sections that begin at the same place are one. Narrow: one
    pass, no shuffle; a document's rows come from the task that read it. Very long texts are encoded whole. Repeated
    rows are counted each, an empty table gives an empty table, other columns, whatever their names, are ignored.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ranked_encoder(path)
        lengths = enc.vocabulary.length
        for batch in batches:
            given = batch.column("sections").to_pylist() if sections else None
            rows, out = [], []
            for i, text in enumerate(text_bytes(batch.column("text"))):
                ids = np.frombuffer(enc.encode(text), "<u4")
                buf = np.frombuffer(text, np.uint8)
                points = np.concatenate([[0], np.cumsum(_LEAD[buf])])  # code points before each byte
                if given is None:
                    starts = line_starts(text)
                else:
                    n = int(points[-1])
                    want = sorted({0, *(x for x in given[i] or [] if x is not None and 0 <= x < n)})
                    starts = np.searchsorted(points, np.array(want) + 1, "left") - 1 if n else np.array([0])
                n_tokens, crossing = attribute(starts, *token_spans(ids, lengths), len(text))
                edge = points[np.append(starts, len(text))]
                rows.append(np.full(len(starts), i))
                out.append((np.arange(len(starts)), edge[:-1], edge[1:], n_tokens, crossing, np.full(len(starts), len(ids))))
            if rows:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(np.concatenate(rows))), *columns],
                    ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
                )

    source = docs.select("doc_id", "text", docs[sections].alias("sections")) if sections else docs.select("doc_id", "text")
    return source.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long")

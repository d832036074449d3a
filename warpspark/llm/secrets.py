"""Secret scans: fixed patterns, and guess costs of values that stand in a credential context.

The patterns give the base spans. Beyond them, a value after a credential word is a secret if guessing it is
dear: the cheapest way to cut it into words, dates, repeats, keyboard walks and brute-force spans is found by
dynamic programming over its positions, and the guesses of the parts multiply.

Parts may begin and end anywhere and have any length:
- a word of the list, by its rank, doubled for capitals, times four for letters written as digits or signs;
- a date in digits, with or without separators, or a year;
- a walk of three keys or more from neighbour to neighbour: 36 first keys, six ways for each turn, its length;
- a unit of any length written twice or more, three characters at least: the unit's brute force times the number;
- a single character by brute force over its kind's alphabet.
The list is the words of passwords below, then the words of the vocabulary file (its tokens of three ASCII letters
or more that begin a word, in the order of their ids, which is by how often they are used). The file is read where
the task runs and never copied.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .common import text_bytes
from .periodic_runs import SuffixArray, runs

KINDS = ("assign", "access", "hex", "guess")
GUESSES = 9.0  # log10 of the guesses from which a value is a secret

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_CONTEXT = re.compile(
    rb"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?)["']?\x20*(?:=>|[:=])\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\x00-\x20]+))""",
    re.IGNORECASE,
)
_TAIL = b"\"',;"  # not of a bare value when they end it
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"credential")
_HEX_MAP = bytes(0 if chr(b) in "0123456789abcdef" else 1 for b in range(256))
_HEX_RUN = bytes(32)

#: Common words of passwords, the commonest first; they come before those of the vocabulary.
WORDS = """password qwerty dragon monkey letmein football baseball welcome admin login master hello shadow
sunshine princess superman batman trustno iloveyou starwars whatever freedom secret test guest root user
default changeme changeit example sample dummy token key pass access private public server database system
winter spring summer autumn january february march april may june july august september october november
december monday tuesday wednesday thursday friday saturday sunday love money secure security temp demo""".split()



@lru_cache(maxsize=2)
def word_ranks(vocabulary: str | None) -> dict[str, int]:
    """Word: rank, from 1; without a vocabulary file, of the words of passwords alone. The empty word has the length
    of the longest."""
    ranks = {w: i + 1 for i, w in enumerate(WORDS)}
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            tokens = json.load(f)["model"]["vocab"]
        for token in sorted(tokens, key=tokens.get):
            word = token[1:].lower()
            if token[0] == "\u0120" and len(word) >= 3 and word.isascii() and word.isalpha():  # U+0120 is a blank
                ranks.setdefault(word, len(ranks) + 1)
    ranks[""] = max(map(len, ranks))
    return ranks


#: Rows of a keyboard, and letters that digits and signs stand for.
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("013457@$!", "oieastasi")
_PLACE = {c: (x + 0.5 * y, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}
_YEAR, _MONTH, _DAY, _SIGN = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[-/.]?"
#: Forms of dates, with the days each can mean in 120 years; every form that matches at a place is a part.
DATES = [
    (re.compile(form), days)
    for form, days in (
        (_YEAR, 120),
        (_YEAR + _SIGN + _MONTH, 120 * 12),
        (_YEAR + _SIGN + _MONTH + _SIGN + _DAY, 120 * 365),
        (_DAY + _SIGN + _MONTH + _SIGN + _YEAR, 120 * 365),
        (_MONTH + _SIGN + _DAY + _SIGN + _YEAR, 120 * 365),
        (_DAY + _SIGN + _MONTH + _SIGN + r"\d\d", 100 * 365),
        (r"\d\d" + _SIGN + _MONTH + _SIGN + _DAY, 100 * 365),
    )
]


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _alphabet(c: str) -> int:
    return 10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1000


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, width): the stretches of period `width` that hold two units or more and can't be longer. A
    stretch of a shorter period that covers one of a multiple of it stands for both, as its unit is cheaper."""
    if len(value) < 2:
        return []
    code = np.fromiter(map(ord, value), np.uint32, len(value))
    first = np.array([0, len(code)])
    start, length, period = runs(SuffixArray(code, first), first, 2, 2)
    return list(zip(start.tolist(), (start + length).tolist(), period.tolist()))


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation. Empty: 0. A start within a repeat or a walk is left out where
    an earlier one in step with it gives no dearer part to every end, which changes no cost and keeps the work of a long
    repeat in step with its length."""
    ranks = word_ranks(None) if ranks is None else ranks
    longest = ranks.get("", 0)
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value  # a few letters change their length
    plain = low.translate(LEET)
    single = np.array([math.log10(_alphabet(c)) for c in value])
    spelled = np.concatenate([[0.0], np.cumsum(single)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    begins: dict[int, list[tuple[int, int, dict[int, int]]]] = {}
    for a, b, width in repeats(value):
        begins.setdefault(a, []).append((b, width, {}))
    running: list[tuple[int, int, dict[int, int]]] = []  # end, width, and the last start kept of each place in the unit
    # The end of the walk that each place is in, and the turns from the first step on.
    near = [_near(a, b) for a, b in zip(low, low[1:])]
    step = [(_PLACE[b][0] - _PLACE[a][0], _PLACE[b][1] - _PLACE[a][1]) if x else None for x, a, b in zip(near, low, low[1:])]
    turned = np.concatenate([[0, 0], np.cumsum([a != b for a, b in zip(step, step[1:])])]) if n > 1 else np.zeros(1)
    walk_end = np.arange(1, n + 1)
    for i in range(n - 2, -1, -1):
        if near[i]:
            walk_end[i] = walk_end[i + 1]
    walk_of, walk_from = -1, -1  # the end of the walk at hand, and the last start kept in it
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + single[i])
        for form, days in DATES if "0" <= value[i] <= "9" else ():
            m = form.match(value, i)
            if m:
                best[m.end()] = min(best[m.end()], here + math.log10(days))
        for j in range(i + 3, min(n, i + longest) + 1):
            rank, twist = ranks.get(low[i:j]), 1
            if rank is None:
                rank, twist = ranks.get(plain[i:j]), 4
            if rank:
                twist *= 1 if low[i:j] == value[i:j] else 2
                best[j] = min(best[j], here + math.log10(rank * twist + 1))
        end, k = int(walk_end[i]), walk_from
        if end - i >= 3 and (walk_of != end or best[k] + (turned[i + 1] - turned[k + 1]) * math.log10(6) + math.log10((i - k + 3) / 3) > here):
            walk_of, walk_from = end, i
            at = np.arange(i + 3, end + 1)
            turns = 1 + turned[at - 1] - turned[i + 1]
            best[at] = np.minimum(best[at], here + math.log10(36) + turns * math.log10(6) + np.log10(at - i))
        running = [x for x in running if x[0] - i >= 2 * x[1]] + begins.get(i, [])
        for end, width, kept in running:
            k = kept.get(i % width)
            if k is not None and best[k] + math.log10((i - k + 2 * width) / (2 * width)) <= here:
                continue
            kept[i % width] = i
            at = np.arange(i + 2 * width, end + 1, width)
            cost = here + spelled[i + width] - spelled[i] + np.log10((at - i) / width)
            at, cost = (at[1:], cost[1:]) if width == 1 else (at, cost)  # two alike are no repeat
            best[at] = np.minimum(best[at], cost)
    return float(best[n])


@lru_cache(maxsize=20_000)
def _cost(value: bytes, vocabulary: str | None) -> float:
    return guess_cost(value.decode("utf-8", "replace"), word_ranks(vocabulary))


def scan(text: bytes, vocabulary: str | None = None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 of guesses) in bytes, by start and then kind."""
    found: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", *m.span(), None) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        found += [("access", *m.span(), None) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if _HEX_RUN in text.translate(_HEX_MAP):
        found += [("hex", *m.span(), None) for m in _HEX.finditer(text) if len(m[0]) >= 32]
    if any(w in low for w in _CONTEXT_WORDS):
        base = sorted((a, b) for _, a, b, _ in found)
        reach = [0, *accumulate((b for _, b in base), max)]  # how far the first base spans go
        for m in _CONTEXT.finditer(text):
            a, b = m.span(m.lastindex)
            if m.lastindex == 3:
                b = a + len(m[3].rstrip(_TAIL))
            if b > a and reach[bisect_right(base, (a, len(text)))] < b and (cost := _cost(text[a:b], vocabulary)) >= GUESSES:
                found.append(("guess", a, b, cost))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _points(text: bytes, spans: list[tuple]) -> list[dict]:
    """Spans in code points."""
    if text.isascii():
        return [{"kind": k, "start": a, "end": b, "log10_guesses": g} for k, a, b, g in spans]
    place, count, before = {}, 0, 0
    for at in sorted({at for _, a, b, _ in spans for at in (a, b)}):
        count, before = count + len(text[before:at].decode("utf-8", "replace")), at
        place[at] = count
    return [{"kind": k, "start": place[a], "end": place[b], "log10_guesses": g} for k, a, b, g in spans]


def _redact(text: bytes, spans: list[tuple]) -> bytes:
    """Each run of overlapping spans becomes one mark."""
    out, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], b"[SECRET]"]
        at = max(at, b)
    return b"".join([*out, text[at:]])


SPANS = "array<struct<kind: string, start: long, end: long, log10_guesses: double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))


def find_secrets(docs: DataFrame, redact: bool = False, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, spans), or with redact the given columns with each secret of `text` replaced by a mark.

    Spans are code points, end exclusive, by start and then kind; null or empty texts have none (and stay as
    they are). A value in quotes ends at the closing quote, another at white space. Very long texts are searched
    whole and very long values costed whole (the work grows with a value's length, but for long walks that keep
    turning, where it grows with the walk's square). Repeated rows have
    a row each, an empty table gives an empty table; extra columns are ignored, with redact they stay as they are.
    Narrow: one pass, no shuffle. vocabulary: the file with the list of words.
    """
    path = vocabulary or default_vocabulary()
    if not redact:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [_points(t, scan(t, path)) for t in text_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPAN_TYPE)], ["doc_id", "spans"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            raw = batch.column(at).cast(pa.large_binary()).to_pylist()
            texts = [t if not t or not (s := scan(t, path)) else _redact(t, s) for t in raw]
            columns = batch.columns
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

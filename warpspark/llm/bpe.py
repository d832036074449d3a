"""BPE encoding and decoding.

Encoder: one Aho-Corasick pass over a piece gives the longest token that starts at each byte. Tokens are
then laid from the left; a token may follow another only if the pair-compatibility table allows it, that
is, if no merge would ever join parts of both. If none of the prefixes of the longest match fits, the
encoder goes one token back and marks the position as dead, so that each position is left at most once:
linear time, and exactly the merges' result. Decoder: one blob of all tokens' bytes with an offset table,
gathered for a whole array of ids.

Before the merges, texts are cut into pieces by the vocabulary's pattern. Within a text whose white space
is single blanks and line ends only, pieces never cross a blank or line end, so whole blank-separated words
can be looked up in a bounded cache; every other text takes the pattern itself.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, text_bytes

#: The piece pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: UTF-8 of the white space beyond blank and line end that the pattern's \s knows.
_RARE = (b"\t", b"\x0b", b"\x0c", b"\r", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_STOPS = (b".", b",")
_LETTERS = regex.compile(r"\p{L}+").fullmatch
_TWO = (b"  ", b" \n", b"\n ", b"\n\n")
_GENERAL = regex.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
CACHE_WORDS = 150_000  # entries of each of the two generations of a worker's word cache
CACHE_PIECES = 60_000
CACHE_WORD_BYTES = 48  # longer words are not kept


def _byte_letters() -> dict[str, int]:
    """The vocabulary file writes bytes as letters: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    letters = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            letters[chr(0x100 + len(letters) - len(plain))] = b
    return letters


class Vocabulary:
    def __init__(self, path: str, merges: bool = True):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        model = data["model"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max([*model["vocab"].values(), *special.values()]) + 1
        token = [b""] * self.size
        for s, i in model["vocab"].items():
            if s not in special:
                token[i] = to_bytes(s)
        self.id_of = {t: i for i, t in enumerate(token) if t}
        for s, i in special.items():
            token[i] = s.encode()
        self.special = {s.encode(): i for s, i in special.items()}
        self.token = token
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"] if merges else ()):
            a, b = (self.id_of[to_bytes(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[a, b] = r
            self.parts.setdefault(self.id_of[token[a] + token[b]], (a, b, r))
        self.length = np.fromiter(map(len, token), np.int64, self.size)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.blob = np.frombuffer(b"".join(token), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered through the offset table."""
        if not len(ids):
            return b""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        index = np.repeat(self.offset[ids] - (ends - lengths), lengths)
        index += np.arange(ends[-1])
        return self.blob[index].tobytes()


_LAST = 1 << 60  # the rank of a merge that never comes


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, the form that all callers need."""

    needs_merges = True

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path, self.needs_merges)
        self.prepare(v)
        self.pieces: dict[str, bytes] = {}
        self.words = _WordCache(self)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile(b"(" + b"|".join(map(regex.escape, v.special)) + b")") if v.special else None

    def prepare(self, v: Vocabulary) -> None:
        """The tables of piece()."""
        self.automaton = ahocorasick.Automaton()
        for t, i in v.id_of.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size = v.length.tolist()
        #: The longest token that is a proper prefix of each token, -1 if there is none.
        self.shorter = [next((v.id_of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in v.id_of), -1) for t in v.token]
        self._compatible: dict[int, bool] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}

    def _spine(self, token: int, side: int, have: dict) -> list[tuple[int, int]]:
        """The token and its outermost parts on one side, each with the rank of the merge that uses it up."""
        if token not in have:
            out, at, until = [], token, _LAST
            while True:
                out.append((at, until))
                if at not in self.vocabulary.parts:
                    break
                until, at = self.vocabulary.parts[at][2], self.vocabulary.parts[at][side]
            have[token] = out
        return have[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side: merges run by rank, so parts a and b at the border
        would be joined if their merge comes before the one that uses up a and not after the one that uses
        up b (of equal ranks the left place comes first)."""
        rank, fits = self.vocabulary.rank, True
        for a, a_until in self._spine(left, 1, self._right):
            for b, b_until in self._spine(right, 0, self._left):
                r = rank.get((a, b))
                if r is not None and r < a_until and r <= b_until:
                    fits = False
        if len(self._compatible) > 500_000:
            self._compatible.clear()
        self._compatible[left << 20 | right] = fits
        return fits

    def piece(self, piece: bytes) -> bytes:
        letters = piece.decode("latin-1")
        # First the longest tokens one after the other; if each fits the one before, no step back is needed.
        greedy = [token for _, token in self.automaton.iter_long(letters)]
        known, size, n = self._compatible, self.size, len(piece)
        at, before = 0, -1
        out: list[int] = []
        for token in greedy:
            if before >= 0:
                fits = known.get(before << 20 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    break
            out.append(token)
            at += size[token]
            before = token
        if at == n:
            return array("I", out).tobytes()
        longest = [-1] * n
        for end, token in self.automaton.iter(letters):
            longest[end - size[token] + 1] = token  # ends rise, so the last to come is the longest
        dead = bytearray(n + 1)
        shorter = self.shorter
        token = longest[at]
        while at < n:
            while token >= 0:
                if not dead[at + size[token]]:
                    if before < 0:
                        break
                    fits = known.get(before << 20 | token)
                    if self.compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                before = token
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                back = out.pop()
                before = out[-1] if out else -1
                at -= size[back]
                token = shorter[back]
        return array("I", out).tobytes()

    def segment(self, text: str) -> bytes:
        """Ids of any text without special tokens."""
        out = []
        pieces = self.pieces
        for p in self.split(text):
            ids = pieces.get(p)
            if ids is None:
                raw = p.encode("utf-8", "replace")
                ids = self.piece(raw)
                if len(raw) <= CACHE_WORD_BYTES:
                    if len(pieces) >= CACHE_PIECES:
                        pieces.clear()
                    pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def plain(self, text: bytes) -> bool:
        """Single blanks and line ends only, none at the end, and no special token."""
        return not (
            text[-1:] in (b" ", b"\n")
            or any(x in text for x in _TWO)
            or any(x in text for x in _RARE)
            or b"\xe2\x80" in text
            and _GENERAL.search(text)
            or any(x in text for x in self.vocabulary.special)
        )

    def encode(self, text: bytes) -> bytes:
        if not text:
            return b""
        if self.plain(text):
            first, *words = text.replace(b"\n", b" \n").split(b" ")
            return self.segment(first.decode("utf-8", "replace")) + b"".join(map(self.words.__getitem__, words))
        out = []
        for part in self.special.split(text) if self.special else [text]:
            token = self.vocabulary.special.get(part)
            out.append(self.segment(part.decode("utf-8", "replace")) if token is None else token.to_bytes(4, "little"))
        return b"".join(out)


class _WordCache(dict):
    """Ids of a blank and a word, or of a line end and the word after it. When it is full it becomes the
    older generation, from which words still in use move over; so its size is bounded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[bytes, bytes] = {}
        self.stops = {x: encoder.piece(x) for x in _STOPS}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha() and word[:1] != b"\n":  # ASCII letters after a blank are one piece
                ids = self.encoder.piece(b" " + word)
            elif word[-1:] in _STOPS and word[:-1].isalpha():
                ids = self[word[:-1]] + self.stops[word[-1:]]
            else:
                text = word.decode("utf-8", "replace")
                if _LETTERS(text):  # so are other letters; marks and digits take the pattern
                    ids = self.encoder.piece(b" " + word)
                else:
                    ids = self.encoder.segment(text if word[:1] == b"\n" else " " + text)
        if len(word) <= CACHE_WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class RankedEncoder(Encoder):
    """The same ids by a library's ranked merges of single pieces, for operators that only need ids."""

    needs_merges = False

    def prepare(self, v: Vocabulary) -> None:
        import tiktoken

        self._merge = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=v.id_of, special_tokens={})._encode_single_piece

    def piece(self, piece: bytes) -> bytes:
        return array("I", self._merge(piece)).tobytes()


@lru_cache(maxsize=2)
def ranked_encoder(path: str) -> Encoder:
    return RankedEncoder(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every text; null is the empty text.

    Narrow: one pass, no shuffle. Very long texts are encoded whole. Extra columns, whatever their names, are
    ignored, repeated rows are encoded each, an empty table gives an empty table.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in chunks(texts):
                ids = [np.frombuffer(enc.encode(t), "<u4") for t in texts[a:b]]
                back = [enc.vocabulary.decode(x).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The digests of encode_documents() without carrying ids and texts through the JVM."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for t in text_bytes(batch.column("text")):
                ids = enc.encode(t)
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                back = enc.vocabulary.decode(np.frombuffer(ids, "<u4"))
                text_hex.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

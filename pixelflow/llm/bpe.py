"""Byte-pair tables and the two merge procedures: a heap over a linked list, and a segment tree."""

from __future__ import annotations

import ctypes
import json
import re
import unicodedata
import weakref
from contextlib import contextmanager
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import regex

#: White space as the tokenizers' patterns mean it (Unicode White_Space), spelled out because Python's own class has four more.
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pre-token patterns of the two vocabularies (fixed values).
BYTE_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
#: A space before something visible always starts a pre-token of BYTE_PATTERN.
SPLIT_BEFORE_WORD = re.compile(f" (?=[^{SPACES}])")
#: Texts without these have single blanks or newlines between visible characters only.
UNEVEN_BLANKS = re.compile(f"[{SPACES}]{{2}}|^[{SPACES}]|[{SPACES}]\\Z|[\\t\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
NOT_BLANKS = re.compile("[\\x1c-\\x1f]")  # str.split() takes these for blanks
BLANKS = re.compile(f"[{SPACES}]+")

MARKS = frozenset(",.;:?!|")

CACHE_WORDS = 500_000  # entries kept by a worker's cache before it drops half of them, some 80 MB
KEPT_WORDS = 200_000  # entries that a cache may take over to its worker's next task, some 30 MB
CACHE_CHARS = 64  # longer pieces aren't kept

_SHIFT, _LOW = 32, (1 << 32) - 1
_NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next unused one from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Tables:
    """Vocabulary and merges of a tokenizer file: symbols are ids; a pair's key gives its rank, a rank the id it makes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for a, b in model["merges"]:
            self.rank[vocab[a] << 20 | vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        out = [self.first[b] for b in raw]
        if self.end and out:
            out[-1] = self.last[raw[-1]]
        return out

    def segments(self, text: str):
        """(part, id): ordinary parts with id None, and special tokens with theirs."""
        if not self.special or not any(s in text for s in self.special):
            yield text, None
            return
        for part in self.split_special.split(text):
            if part:
                yield part, self.special.get(part)


@lru_cache(maxsize=4)
def tables(path: str) -> Tables:
    return Tables(path)


def heap_count(symbols: list[int], t: Tables) -> int:
    """Symbols left after all merges: a heap gives the lowest-ranked, leftmost pair; a linked list its neighbours.

    Entries that a merge made stale are known by a rank that is no longer their pair's. No identifier is returned."""
    n = len(symbols)
    if n < 2:
        return n
    rank, made = t.rank, t.made
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << _SHIFT | i for i in range(n - 1) if (r := rank.get(symbols[i] << 20 | symbols[i + 1])) is not None]
    heapify(heap)
    merges = 0
    while heap:
        e = heappop(heap)
        i, r = e & _LOW, e >> _SHIFT
        j = after[i]
        if symbols[i] < 0 or j >= n or rank.get(symbols[i] << 20 | symbols[j]) != r:
            continue
        symbols[i], symbols[j] = made[r], -1
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := rank.get(symbols[i] << 20 | symbols[k])) is not None:
                heappush(heap, r << _SHIFT | i)
        if (p := before[i]) >= 0 and (r := rank.get(symbols[p] << 20 | symbols[i])) is not None:
            heappush(heap, r << _SHIFT | p)
    return n - merges


def tree_encode(symbols: list[int], t: Tables) -> list[int]:
    """Identifiers after all merges: a segment tree over the ranks of adjacent pairs has the leftmost lowest one at its
    root; a merge updates three leaves, each in logarithmic time, until the root is empty."""
    n = len(symbols)
    if n < 2:
        return symbols
    rank, made = t.rank, t.made
    size = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if (r := rank.get(symbols[i] << 20 | symbols[i + 1])) is not None:
            tree[size + i] = r << _SHIFT | i
    for v in range(size - 1, 0, -1):
        a, b = tree[2 * v], tree[2 * v + 1]
        tree[v] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        v = size + i
        tree[v] = value
        v >>= 1
        while v:
            a, b = tree[2 * v], tree[2 * v + 1]
            if b < a:
                a = b
            if tree[v] == a:
                return
            tree[v] = a
            v >>= 1

    while (e := tree[1]) != _NONE:
        i, r = e & _LOW, e >> _SHIFT
        j = after[i]
        symbols[i], symbols[j] = made[r], -1
        after[i] = k = after[j]
        if j < n - 1:
            put(j, _NONE)
        if k < n:
            before[k] = i
            r = rank.get(symbols[i] << 20 | symbols[k])
        else:
            r = None
        put(i, _NONE if r is None else r << _SHIFT | i)
        if (p := before[i]) >= 0:
            r = rank.get(symbols[p] << 20 | symbols[i])
            put(p, _NONE if r is None else r << _SHIFT | p)
    return [s for s in symbols if s >= 0]


class Pieces(dict):
    """Value of a piece of text by ``make``, kept for short pieces; when full, the later half goes, so memory is bounded."""

    __hash__ = object.__hash__
    live: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, make):
        super().__init__()
        self.make = make
        Pieces.live.add(self)

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.shrink(CACHE_WORDS // 2)
            self[piece] = value
        return value

    def shrink(self, kept: int) -> None:
        """Keep the entries that came first, which frequent pieces do."""
        if len(self) > kept:
            first = list(islice(self.items(), kept))
            self.clear()
            self.update(first)


@contextmanager
def pieces_of_a_task(kept: int = 0):
    """All but ``kept`` entries of each cache go with the task that took them: Spark's Python workers live on, and other
    operators run in them."""
    try:
        yield
    finally:
        for p in list(Pieces.live):
            p.shrink(kept)
        _trim()


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def normal_words(chunk: str) -> list[str]:
    """Pre-tokens of a chunk without blanks for the word-end vocabulary: composed, lower-cased one character at a time."""
    low = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
    if low.isalpha():  # most chunks are a word, or a word and a mark
        return [low]
    if low[-1:] in MARKS and low[:-1].isalpha():
        return [low[:-1], low[-1]]
    return WORD_PATTERN.findall(low)


def byte_pieces(chunk: str) -> list[str]:
    """Pre-tokens of a text for the byte vocabulary; most chunks are a word, or a word and a mark, after a space."""
    word = chunk.removeprefix(" ")
    if chunk.isascii():
        if word.isalpha():
            return [chunk]
        if word[-1:] in MARKS and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
    return BYTE_PATTERN.findall(chunk)


def chunks(text: str) -> list[str]:
    """Parts of a text between blanks."""
    return text.split() if not NOT_BLANKS.search(text) else [c for c in BLANKS.split(text) if c]


def byte_chunks(text: str):
    """(lines' first chunks, chunks that follow a space, newlines) whose pre-tokens together are those of ``text``."""
    if UNEVEN_BLANKS.search(text):
        head, *rest = SPLIT_BEFORE_WORD.split(text)
        return [head], rest, 0
    heads, rest = [], []
    lines = text.split("\n")
    for line in lines:
        head, *more = line.split(" ")
        heads.append(head)
        rest += more
    return heads, rest, len(lines) - 1

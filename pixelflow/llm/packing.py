"""Order-preserving packing of token streams by dynamic programming.

The documents of an input partition are one token stream. Candidate cuts are document ends and sentence ends; only where
neither comes for more than a window's size, every GRID tokens of that stretch are candidates too. best(j) = min over cuts i with 0 < j - i <= size of best(i) + padding(j - i) +
penalty(j): since padding is size - (j - i), the minimum of best(i) + i over a sliding window is kept in a monotone queue,
so each cut enters and leaves it once. Lengths that are powers of two need no padding and are looked up apart.

The stream is planned BLOCK tokens at a time, so memory is bounded whatever a document's length; a block's end isn't a
cut: its last CARRIED windows are planned again with the tokens that follow. Nothing is shuffled. Null text is an empty document (its end token only); repeated rows
are packed as often as they come; an empty table gives an empty result."""

from __future__ import annotations

import struct
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelflow.llm import bpe

SIZE = 2048
BLOCK = 1 << 18  # tokens planned at once
CARRIED = 8  # windows at a block's end that wait for the next block
GRID = 64  # tokens between cuts offered where there is no boundary for a whole window
SENTENCE_CUT, PLAIN_CUT = 4.0, 24.0  # padding tokens that a cut inside a document, or inside a sentence, is worth
END_ID = 1
STEP = 64
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _power_windows(cuts: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Pairs (j, i) of cuts that are a power of two below ``size`` apart, by j; with an end mark."""
    place = np.full(int(cuts[-1]) + 1, -1, np.int64)
    place[cuts] = np.arange(len(cuts))
    to, since = [], []
    for p in range(size.bit_length() - 1):
        j = np.flatnonzero(cuts >= 1 << p)
        i = place[cuts[j] - (1 << p)]
        to.append(j[i >= 0])
        since.append(i[i >= 0])
    to, since = np.concatenate(to), np.concatenate(since)
    order = np.argsort(to, kind="stable")
    return [*to[order].tolist(), -1], since[order].tolist()


def plan(cuts: list[int], penalties: list[float], size: int = SIZE) -> list[int]:
    """Indices into ``cuts`` (ascending, first 0, gaps of at most ``size``) of the best chain from the first to the last."""
    n = len(cuts)
    best, came = [0.0] * n, [0] * n
    exact = _power_windows(np.asarray(cuts, np.int64), size)
    nxt, (to, since) = 0, exact
    queue: deque[int] = deque([0])
    value = [0.0] * n  # best(i) + i
    value[0] = float(cuts[0])
    for j in range(1, n):
        at = cuts[j]
        while cuts[queue[0]] < at - size:
            queue.popleft()
        i = queue[0]
        low = value[i] + size - at
        while to[nxt] == j:
            k = since[nxt]
            nxt += 1
            if best[k] < low:
                low, i = best[k], k
        best[j] = low + penalties[j]
        came[j] = i
        value[j] = v = best[j] + at
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    chain = [n - 1]
    while chain[-1]:
        chain.append(came[chain[-1]])
    return chain[::-1]


class LibraryIds:
    """Ids of texts by the tokenizers library: its model merges each word that is new to the cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = bpe.tables(path)
        self.model = Tokenizer.from_file(path).model
        self.symbol = bpe.byte_symbols()
        self.words = bpe.Pieces(self._word)
        self.packed = bpe.Pieces(lambda chunk: b"".join([self.words[w] for w in bpe.normal_words(chunk)]))

    def _word(self, w: str) -> bytes:
        letters = w if w.isascii() and w.isprintable() else "".join([self.symbol[b] for b in w.encode()])
        out = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(out)}I", *out)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out = []
        for part, special in self.t.segments(text or ""):
            if special is None:
                out += map(self.packed.__getitem__, bpe.chunks(part))
            else:
                out.append(struct.pack("<I", special))
        return b"".join(out)


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


class Packer:
    """Plans block after block of one partition and gives the pieces of each."""

    def __init__(self, path: str, size: int, first_sequence: int):
        self.codec = library_ids(path)
        self.size, self.sequence = size, first_sequence
        t = self.codec.t
        self.stops = np.zeros(max(t.text) + 1, bool)
        for i, s in t.text.items():
            core = s.removesuffix(t.end)
            self.stops[i] = bool(core) and core[-1] in ".!?"
        self.held: list[tuple] = []  # (doc_id, ids, start, doc_tokens)
        self.tokens, self.block = 0, max(BLOCK, 4 * CARRIED * size)

    def add(self, doc_id, text):
        raw = self.codec.encode_bytes(text)
        ids = np.frombuffer(raw + np.uint32(END_ID).tobytes(), "<u4")
        for at in range(0, len(ids), self.block):
            part = ids[at : at + self.block]
            self.held.append((doc_id, part, at, len(ids)))
            self.tokens += len(part)
            if self.tokens >= self.block:
                yield from self.flush(last=False)

    def _candidates(self) -> tuple[list[int], list[float]]:
        """Places where the held stream may be cut, and what a cut costs there; its start and end are among them."""
        places, costs, at = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, ids, start, whole in self.held:
            closed = start + len(ids) == whole  # else more of the document follows
            ends = np.flatnonzero(self.stops[ids[: len(ids) - closed]]) + 1
            places.append(ends + at)
            costs.append(np.full(len(ends), SENTENCE_CUT))
            at += len(ids)
            if closed:
                places.append(np.array([at]))
                costs.append(np.zeros(1))
        cuts, pen = np.concatenate(places), np.concatenate(costs)
        if cuts[-1] < at:  # the end of what is known of a document
            cuts, pen = np.append(cuts, at), np.append(pen, PLAIN_CUT)
        gaps = np.flatnonzero(np.diff(cuts) > self.size)
        if len(gaps):
            extra = np.concatenate([np.arange(cuts[g] + GRID, cuts[g + 1], GRID) for g in gaps])
            cuts, pen = np.concatenate([cuts, extra]), np.concatenate([pen, np.full(len(extra), PLAIN_CUT)])
            order = np.argsort(cuts, kind="stable")
            cuts, pen = cuts[order], pen[order]
        return cuts.tolist(), pen.tolist()

    def flush(self, last: bool = True):
        """Pieces of what is held; but for the partition's end, the last windows stay, to be planned again."""
        if not self.held:
            return
        cuts, penalties = self._candidates()
        chain = [cuts[k] for k in plan(cuts, penalties, self.size)]
        if not last:
            chain = chain[: -1 - CARRIED]
        yield from self._pieces(chain)
        self._drop(chain[-1])

    def _drop(self, end: int) -> None:
        left, at = [], 0
        for doc_id, ids, start, whole in self.held:
            gone = min(max(end - at, 0), len(ids))
            if gone < len(ids):
                left.append((doc_id, ids[gone:].copy(), start + gone, whole))
            at += len(ids)
        self.held, self.tokens = left, at - end

    def _pieces(self, chain: list[int]):
        k, base = 0, 0
        for doc_id, ids, start, whole in self.held:
            at, end = base, min(base + len(ids), chain[-1])
            while at < end:
                while chain[k + 1] <= at:
                    k += 1
                stop = min(end, chain[k + 1])
                piece = ids[at - base : stop - base]
                yield doc_id, start + at - base, stop - at, zlib.crc32(piece), whole, self.sequence + k, at - chain[k]
                at = stop
            base += len(ids)
        self.sequence += len(chain) - 1


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts there, how long it is, and where it lies in its sequence."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = [None, *[pa.int64()] * 6]

    def run(batches):
        packer = Packer(tokenizer_path, size, TaskContext.get().partitionId() << 40)

        def out(rows, id_kind):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k or id_kind) for c, k in zip(cols, kinds)], FIELDS)

        id_kind, rows = None, []
        with bpe.pieces_of_a_task():
            for b in batches:
                id_kind = b.column(0).type
                for at in range(0, b.num_rows, STEP):
                    for doc_id, text in zip(b.column(0).slice(at, STEP).to_pylist(), b.column(1).slice(at, STEP).to_pylist()):
                        rows += packer.add(doc_id, text)
                    if len(rows) > 8192:
                        yield out(rows, id_kind)
                        rows = []
            rows += packer.flush()
            if rows:
                yield out(rows, id_kind)

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)

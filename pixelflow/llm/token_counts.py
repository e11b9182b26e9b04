"""Token counts without identifiers: heap-and-linked-list byte-pair merging.

Null text counts as empty (0 bytes, 0 tokens). Any row order, repeated rows and extra columns are fine: a row's counts
depend on its text alone. An empty table gives an empty result with the full schema."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelflow.llm import bpe

STEP = 256  # texts held as Python strings at a time


class Counter:
    def __init__(self, path: str):
        self.t = bpe.tables(path)
        self.pieces = bpe.Pieces(lambda p: bpe.heap_count(self.t.symbols(p), self.t))  # words come with different marks
        self.bare = bpe.Pieces(self._count)
        self.spaced = bpe.Pieces(lambda c: self._count(" " + c))
        self.newline = self._count("\n")

    def _count(self, chunk: str) -> int:
        return sum(map(self.pieces.__getitem__, bpe.byte_pieces(chunk)))

    def count(self, text: str | None) -> int:
        total = 0
        for part, special in self.t.segments(text or ""):
            if special is not None:
                total += 1
                continue
            heads, rest, newlines = bpe.byte_chunks(part)
            total += newlines * self.newline + sum(map(self.bare.__getitem__, heads)) + sum(map(self.spaced.__getitem__, rest))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit for every row; one pass, no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("body"))

    def run(batches):
        c = counter(tokenizer_path)
        with bpe.pieces_of_a_task(bpe.KEPT_WORDS):
            for b in batches:
                texts, counts = b.column(2), []
                for at in range(0, b.num_rows, STEP):
                    counts += [c.count(x) for x in texts.slice(at, STEP).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)

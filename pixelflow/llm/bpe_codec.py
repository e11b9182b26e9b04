"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

``encode`` gives each row its identifiers, ``decode`` the text they stand for, ``digest`` both as digests in one pass.
Null text counts as empty. Rows are independent, so order, repeats and extra columns don't matter."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelflow.llm import bpe

STEP = 256


class Codec:
    """Encoder of a word-end vocabulary; each chunk's identifiers are kept as bytes."""

    def __init__(self, path: str):
        self.t = bpe.tables(path)
        self.words = bpe.Pieces(lambda w: bpe.tree_encode(self.t.symbols(w), self.t))
        self.packed = bpe.Pieces(lambda c: np.array(self.ids_of_chunk(c), "<u4").tobytes())
        self.written = bpe.Pieces(self._written)

    def ids_of_chunk(self, chunk: str) -> list[int]:
        return [i for w in bpe.normal_words(chunk) for i in self.words[w]]

    def _written(self, chunk: str) -> tuple[int, bytes, bytes]:
        ids = self.ids_of_chunk(chunk)
        return len(ids), " ".join(map(str, ids)).encode(), self.text(ids).encode()

    def encode_bytes(self, text: str | None) -> bytes:
        """Identifiers as little-endian unsigned 32-bit numbers."""
        out = []
        for part, special in self.t.segments(text or ""):
            if special is None:
                out += map(self.packed.__getitem__, bpe.chunks(part))
            else:
                out.append(np.uint32(special).tobytes())
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def text(self, ids) -> str:
        """What the identifiers stand for: this vocabulary has no decoder, so tokens are joined by spaces."""
        return " ".join(self.t.text[i] for i in ids if i in self.t.text)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        parts = []
        for part, special in self.t.segments(text or ""):
            parts += map(self.written.__getitem__, bpe.chunks(part)) if special is None else [(1, b"%d" % special, self.t.text[special].encode())]
        parts = [p for p in parts if p[0]]
        return (sum(p[0] for p in parts), *(hashlib.sha256(b" ".join([p[k] for p in parts])).hexdigest() for k in (1, 2)))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _over_texts(docs: DataFrame, id_col: str, text_col: str, fields: list[tuple[str, str, pa.DataType]], value) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        with bpe.pieces_of_a_task(bpe.KEPT_WORDS):
            for b in batches:
                for at in range(0, b.num_rows, STEP):
                    got = [value(x) for x in b.column(1).slice(at, STEP).to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, STEP), *(pa.array([g[k] for g in got], kind) for k, (_, _, kind) in enumerate(fields))], ["id", *(f[0] for f in fields)])

    schema = ", ".join([f"id {id_type}", *(f"{n} {s}" for n, s, _ in fields)])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _over_texts(docs, id_col, text_col, [("token_ids", "array<int>", pa.list_(pa.int32()))], lambda x: (codec(tokenizer_path).encode(x),))


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    return _over_texts(encoded, id_col, ids_col, [("text", "string", pa.string())], lambda x: (codec(tokenizer_path).text(x or []),))


def digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and the digests of the written identifiers and of the decoded text."""
    fields = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _over_texts(docs, id_col, text_col, fields, lambda x: codec(tokenizer_path).digest(x))

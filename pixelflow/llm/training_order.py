"""Training-order materialisation: token sequences in a keyed random order, in shards of fixed-stride records.

Every document's token ids, with an end token, are cut into sequences of LENGTH ids. Sequences are numbered in scan order
(partition, place in it); a keyed Feistel network on the smallest even number of bits that holds the numbers permutes
them, and numbers that leave the range walk on along their cycle until they are back. So slots are a bijection of
0 .. N-1 that needs no sort and no memory. Shards of PER_SHARD slots are dealt by ranges of slots, all of one size, and a
record's place is slot * stride: a reader that stopped at a slot goes on there. Ids have two bytes, so the vocabulary
must be below 65,536.

Tokens are written once to the shared folder, and shuffled once. ``shards`` gives rows, ``write_files`` files of them. Null text is an empty document: one sequence with the
end token. Repeated rows are sequences of their own. An empty table gives no shards. Extra columns are left out."""

from __future__ import annotations

import base64
import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelflow.llm.common import materialize

LENGTH, PER_SHARD, ROUNDS = 512, 512, 4
TASK_BYTES = 32 << 20  # of records that one task writes
MAX_BROADCAST_TASKS = 1 << 20  # 16 MB of first numbers; beyond it the join is Spark's choice
STEP = 64


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x ^ np.uint64(key & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed bijection of 0 .. n-1 and its inverse."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [int(_mixed(np.array([key], np.uint64), 0x9E3779B97F4A7C15 * (r + 1))[0]) for r in range(ROUNDS)]

    def _walk(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        x = np.asarray(x).astype(np.uint64).copy()
        todo, half, mask = np.arange(len(x)), np.uint64(self.half), np.uint64((1 << self.half) - 1)
        while len(todo):
            left, right = x[todo] >> half, x[todo] & mask
            for k in keys:
                if back:
                    left, right = right ^ (_mixed(left, k) & mask), left
                else:
                    left, right = right, left ^ (_mixed(right, k) & mask)
            x[todo] = left << half | right
            todo = todo[x[todo] >= np.uint64(self.n)]
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


class Tokens:
    """Ids of a text as two-byte numbers, by one call of the library: where most words are new, it is quicker than looking words up."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        if self.end >= 1 << 16:
            raise ValueError("ids of more than two bytes")
        self.library = tiktoken.Encoding("shards", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """The text's ids and the end token."""
        return np.array(self.library.encode_ordinary(text or "") + [self.end], "<u2").tobytes()


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def sequences(docs: DataFrame, ranks_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """task, place, doc_id, part and ids (two bytes each) of every sequence, in scan order."""

    def run(batches):
        t, task, place = tokens(ranks_path), TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                ids, parts, cut = [], [], []
                for doc_id, text in zip(b.column(0).slice(at, STEP).to_pylist(), b.column(1).slice(at, STEP).to_pylist()):
                    raw = t.encode(text)
                    for k in range(0, len(raw), 2 * length):
                        ids.append(doc_id)
                        parts.append(k // (2 * length))
                        cut.append(raw[k : k + 2 * length])
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(cut, pa.binary())], ["task", "place", "doc_id", "part", "ids"])
                place += n

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "task long, place long, doc_id long, part long, ids binary")


def shards(docs: DataFrame, ranks_path: str, key: int, length: int = LENGTH, per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each shard: shard, first_slot, n_slots, stride, payload (n_slots records of stride bytes), crc32, and
    the doc_id, part and number of ids of every record."""
    made = materialize(sequences(docs, ranks_path, length, id_col, text_col), "sequences")
    per_task = materialize(made.groupBy("task").count(), "tasks")  # a row for each task of the scan
    n_tasks, total = per_task.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    stride = 2 * length
    n_shards = -(-total // per_shard)
    tasks = max(1, min(n_shards, -(-total * stride // TASK_BYTES)))
    order = Permutation(max(total, 1), key)
    starts = per_task.select("task", (F.sum("count").over(Window.orderBy("task")) - F.col("count")).alias("start"))

    @F.arrow_udf("long")
    def slot(index: pa.Array) -> pa.Array:
        return pa.array(order.slot(index.to_numpy()))

    placed = made.join(F.broadcast(starts) if n_tasks <= MAX_BROADCAST_TASKS else starts, "task").select(slot(F.col("start") + F.col("place")).alias("slot"), "doc_id", "part", "ids")
    ranged = placed.repartitionById(tasks, F.expr(f"cast((slot div {per_shard}) * {tasks} div {max(n_shards, 1)} as int)")).sortWithinPartitions("slot")

    def write(batches):
        end, held = tokens(ranks_path).end, []
        pad = np.uint16(end).tobytes()

        def shard():
            payload = b"".join(x[3] + pad * ((stride - len(x[3])) // 2) for x in held)
            first = held[0][0]
            row = [[first // per_shard], [first], [len(held)], [stride], [payload], [zlib.crc32(payload)], [[x[1] for x in held]], [[x[2] for x in held]], [[len(x[3]) // 2 for x in held]]]
            longs = pa.list_(pa.int64())
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), longs, longs, longs]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "first_slot", "n_slots", "stride", "payload", "crc32", "doc_ids", "parts", "n_ids"])

        for b in batches:
            for x in zip(*(b.column(k).to_pylist() for k in range(4))):
                if held and x[0] // per_shard != held[0][0] // per_shard:
                    yield shard()
                    held = []
                held.append(x)
        if held:
            yield shard()

    return ranged.mapInArrow(write, "shard long, first_slot long, n_slots long, stride long, payload binary, crc32 long, doc_ids array<long>, parts array<long>, n_ids array<long>")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Each shard's records as one file ``shard-<number>.bin`` in ``folder``, which all executors have mounted; returns
    shard, first_slot, n_slots, stride, crc32 and path. A file gets its name when it is whole, so a repeated task replaces
    it by the same bytes."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths = []
            for shard, payload in zip(b.column(0).to_pylist(), b.column(5)):
                path = os.path.join(folder, f"shard-{shard:09d}.bin")
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(payload.as_buffer())
                os.replace(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(paths, pa.string())], ["shard", "first_slot", "n_slots", "stride", "crc32", "path"])

    return rows.select("shard", "first_slot", "n_slots", "stride", "crc32", "payload").mapInArrow(run, "shard long, first_slot long, n_slots long, stride long, crc32 long, path string")


def read_files(folder: str, first_slot: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD):
    """(slot, ids with padding) of up to ``n`` slots from ``first_slot`` on, in order: a slot's place follows from its number
    alone, so a reader that stopped anywhere goes on by one seek."""
    slot, stride = first_slot, 2 * length
    while slot < first_slot + n:
        path = os.path.join(folder, f"shard-{slot // per_shard:09d}.bin")
        if not os.path.exists(path):
            return
        with open(path, "rb") as f:
            f.seek(slot % per_shard * stride)
            while slot < first_slot + n and (record := f.read(stride)):
                yield slot, np.frombuffer(record, "<u2")
                slot += 1
                if slot % per_shard == 0:
                    break
            else:
                return


def read(written: DataFrame, first_slot: int, n: int) -> list[tuple[int, np.ndarray]]:
    """(slot, ids with padding) of up to ``n`` slots from ``first_slot`` on: only the shards that hold them are read."""
    out = []
    rows = written.filter((F.col("first_slot") + F.col("n_slots") > first_slot) & (F.col("first_slot") < first_slot + n)).sort("first_slot")
    for r in rows.toLocalIterator():
        for k in range(max(0, first_slot - r["first_slot"]), min(r["n_slots"], first_slot + n - r["first_slot"])):
            out.append((r["first_slot"] + k, np.frombuffer(r["payload"], "<u2", r["stride"] // 2, k * r["stride"])))
    return out

"""Positions and prefix digests within keys of any size.

Rows are sorted over range partitions of (key, order), so a key with a third of all rows lies in many partitions and none of
them holds more than its share. Each partition is scanned once as a stream, which leaves local positions and digests; what
a key has had in the partitions before is carried into each partition's first run: at most two rows a partition reach the
driver, which folds them, and the carries come back as a table of one row a partition.

The digest of a key's rows up to position i is, in each of LANES lanes, the sum of v_j * B^j over j <= i modulo the prime P,
where v_j is the lane's 31 bits of the row's own cryptographic digest. Unlike a chained hash it can be added up in parts, so a
run that starts in the middle of a key needs its predecessors' sum and length only. Two different sequences agree in all lanes
with a probability of about (length / 2^31)^4."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelflow.llm.common import materialize

P = (1 << 31) - 1  # prime
LANES = 4
BASES = [pow(16807, e, P) for e in (1009, 2003, 3001, 4001)]  # powers of a primitive root
MASK = P


def pack(lanes: list) -> tuple:
    """Four lanes as two longs; ints or arrays."""
    return (lanes[0] << 31) + lanes[1], (lanes[2] << 31) + lanes[3]


def unpack(a: Column, b: Column) -> list[Column]:
    return [F.shiftright(a, 31), a.bitwiseAND(F.lit(MASK)), F.shiftright(b, 31), b.bitwiseAND(F.lit(MASK))]


def pack_columns(lanes: list[Column]) -> tuple[Column, Column]:
    return F.shiftleft(lanes[0], 31) + lanes[1], F.shiftleft(lanes[2], 31) + lanes[3]


class _Run:
    """The run that a partition's scan is in: its key, length and lanes."""

    def __init__(self):
        self.key, self.n, self.sums, self.first, self.begun = None, 0, [0] * LANES, True, False

    def scan(self, key: pa.Array, digest: pa.Array | None):
        """Positions, whether rows are of the partition's first run, inclusive and exclusive lanes of a batch."""
        n = len(key)
        change = np.ones(n, bool)
        if n > 1:
            a, b = key.slice(1), key.slice(0, n - 1)
            change[1:] = np.asarray(pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))))
        change[0] = not self.begun or key[0].as_py() != self.key
        first = self.first and (not self.begun or not change[0])
        starts = np.flatnonzero(change)
        run = np.cumsum(change)  # 0: goes on from the batch before
        origin = np.concatenate([[0], starts])[run]
        local = np.arange(n) - origin
        at = local + np.where(run == 0, self.n, 0)
        lead = (run == (0 if first and self.begun else 1)) if first else np.zeros(n, bool)
        out = []
        if digest is not None:
            words = np.frombuffer(b"".join(digest.to_pylist()), ">u4").reshape(n, LANES).astype(np.int64)
            for k, base in enumerate(BASES):
                power = _powers(base, n)[local]
                power = np.where(run == 0, power * pow(base, self.n, P) % P, power)
                term = (words[:, k] % P) * power % P
                total = np.cumsum(term)
                before = np.concatenate([[0], total])[origin]
                total = (total - before + np.where(run == 0, self.sums[k], 0)) % P
                out.append((total, (total - term) % P))
        self.key, self.begun, self.n, self.first = key[n - 1].as_py(), True, int(at[-1]) + 1, bool(lead[-1])
        self.sums = [int(t[-1]) for t, _ in out] or self.sums
        return at, lead, out


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo P, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), P) % P])
    return out[:n]


def numbered(rows: DataFrame, key: str, order: list, digest: str | None = None) -> DataFrame:
    """``rows`` (narrow: all of them are sorted) with ``at``, the position from 0 among its key's rows in ``order``, null keys
    being one key. With ``digest``, a binary column of 16 bytes, also ``a`` and ``b``, the digest of the key's rows up to
    this one, and ``before_a`` and ``before_b``, that without it. Rows equal in ``order`` come in either order."""
    names = rows.columns
    extra = ["a", "b", "before_a", "before_b"] if digest else []
    place = names.index(key), names.index(digest) if digest else -1
    kept = [k for k, c in enumerate(names) if c != digest]

    def marked(batch, part, at, lead, lanes, last):
        tail = np.zeros(batch.num_rows, bool)
        tail[-1] = last
        more = [pa.array(x) for upto in (0, 1) for x in pack([t[upto] for t in lanes])] if digest else []
        columns = [*(batch.column(k) for k in kept), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at), pa.array(lead), pa.array(tail), *more]
        return pa.RecordBatch.from_arrays(columns, [*(names[k] for k in kept), "_part", "at", "_lead", "_tail", *extra])

    def scan(batches):
        from pyspark import TaskContext

        part, run, held = TaskContext.get().partitionId(), _Run(), None
        for batch in batches:
            if batch.num_rows:
                if held:  # a batch waits for the next one, so that the partition's last row is known
                    yield marked(*held, False)
                held = (batch, part, *run.scan(batch.column(place[0]), batch.column(place[1]) if digest else None))
        if held:
            yield marked(*held, True)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{names[k]}` {kinds[names[k]]}" for k in kept), "_part int, at long, _lead boolean, _tail boolean", *(f"{c} long" for c in extra)])
    keys = [F.col(key).asc_nulls_first(), *order]
    scanned = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(scan, schema), "scanned")
    edges = scanned.filter("_tail or (_lead and at = 0)").select("_part", key, "at", "_lead", "_tail", *extra[:2]).collect()
    carried = _carries(edges, key, bool(digest))
    out = scanned
    if carried:
        sums = [f"_c{k}" for k in range(LANES)] if digest else []
        powers = [f"_p{k}" for k in range(LANES)] if digest else []
        table = rows.sparkSession.createDataFrame(carried, "_of int, _n long" + "".join(f", {c} long" for c in sums + powers))
        out = out.join(F.broadcast(table), (F.col("_part") == F.col("_of")) & F.col("_lead"), "left")  # a row a partition at most
        n = F.coalesce("_n", F.lit(0).cast("long"))
        for a, b in (("a", "b"), ("before_a", "before_b")) if digest else ():
            moved = pack_columns([(F.col(c) + x * F.col(p)) % P for c, p, x in zip(sums, powers, unpack(F.col(a), F.col(b)))])
            out = out.withColumns({a: F.coalesce(moved[0], F.col(a)), b: F.coalesce(moved[1], F.col(b))})
        out = out.withColumn("at", F.col("at") + n)
    return out.select(*(names[k] for k in kept), "at", *extra)


def _carries(edges: list, key: str, lanes: bool) -> list[tuple]:
    """For each partition whose first run goes on from before: its number, and the length, sums and powers that it takes over."""
    heads = {e["_part"]: e[key] for e in edges if e["_lead"] and e["at"] == 0}
    split = lambda e: [e["a"] >> 31, e["a"] & MASK, e["b"] >> 31, e["b"] & MASK] if lanes else []
    out, held = [], None
    for e in sorted((e for e in edges if e["_tail"]), key=lambda e: e["_part"]):
        into = held if held and held[0] == heads[e["_part"]] else None
        powers = [pow(base, into[1], P) for base in BASES] if into and lanes else []
        if into:
            out.append((e["_part"], into[1], *into[2], *powers))
        if into and e["_lead"]:
            held = (e[key], into[1] + e["at"] + 1, [(c + g * p) % P for c, g, p in zip(into[2], split(e), powers)])
        else:
            held = (e[key], e["at"] + 1, split(e))
    return out

"""Grouping neighbouring hits: per-shot density clusters and time-ordered greedy centroids.

Both deal their groups (shots, or pieces between gaps) over Spark's shuffle partitions, sort within them and stream them
through Arrow batches: a task holds one shot, or the open clusters of one piece, whatever the partition's size, and
adaptive execution sizes partitions by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelflow.functions.ordering import SPANS, bounds_of, spanned
from pixelflow.operators import huge_shots
from pixelflow.sources import store

DENSE = 512  # points up to which all pairs of a shot are compared at once
SMALL = 64  # points up to which shots of one size are compared together
PAIRS = 1 << 20  # pairs that are compared at a time in a larger one
Z_NS = 500.0  # time of flight, in ns, that is worth eps
HUGE = 1_000_000  # points of a shot beyond which files' clustering deals it over tasks
LISTED = 200_000  # shots that are broadcast
GRAINS = 1 << 16  # groups of shots that are counted first: a shot is huge only if its group is


def neighbours(points: DataFrame, eps: float, keys: list[str], pid: str = "pid") -> DataFrame:
    """Pairs (pid, other) within eps in (x, y, z), self left out, by a grid: each cell meets itself and the 13 of its
    26 neighbours that follow it, and a pair that is found is given both ways."""
    cell = {c: F.floor(F.col(c) / eps).cast("long") for c in "xyz"}
    left = points.select(*keys, pid, "x", "y", "z", *(v.alias(f"c{c}") for c, v in cell.items()))
    after = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]
    right = points.select(*keys, F.col(pid).alias("other"), *(F.col(c).alias(f"o{c}") for c in "xyz"), *(v.alias(f"c{c}") for c, v in cell.items()))
    right = right.withColumn("_d", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("xyz", d))) for d in after))))
    for c in "xyz":
        right = right.withColumn(f"c{c}", F.col(f"c{c}") + F.col(f"_d.{c}"))
    near = sum((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "xyz") <= eps * eps
    once = (F.col("_d") != F.struct(F.lit(0), F.lit(0), F.lit(0))) & (F.col(pid) != F.col("other")) | (F.col(pid) < F.col("other"))
    pairs = left.join(right, [*keys, "cx", "cy", "cz"]).filter(near & once)
    ways = F.array(F.struct(F.col(pid).alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col(pid).alias("b")))
    return pairs.select(*keys, F.explode(ways).alias("_p")).select(*keys, F.col("_p.a").alias(pid), F.col("_p.b").alias("other"))


def _near(xyz: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of points within eps: all at once for few points, else each with its cell and the cells that follow it."""
    n = len(xyz)
    if n <= DENSE:
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
        i, j = np.nonzero(d <= eps)
        return i[i < j], j[i < j]
    whole = np.flatnonzero(np.isfinite(xyz).all(axis=1))
    code, step = np.zeros(len(whole), np.int64), []
    for v in xyz[whole].T:  # cells' numbers with gaps closed but for one, so that only neighbours are neighbours
        found, of = np.unique(np.floor(v / eps), return_inverse=True)
        close = np.append(0, np.cumsum(np.minimum(np.diff(found), 2))).astype(np.int64) + 1
        size = int(close[-1]) + 2
        step = [s * size for s in step] + [1]
        if (int(code.max(initial=0)) + 2) * size >= 1 << 62:
            raise ValueError("a shot spreads too far for one task: cluster it in boxes")
        code = code * size + close[of.ravel()]
    turn = np.argsort(code, kind="stable")
    code, at, whole = code[turn], xyz[whole[turn]], whole[turn]
    after = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for d in after:
        other = code + sum(k * s for k, s in zip(d, step))
        low, high = np.searchsorted(code, other), np.searchsorted(code, other, "right")
        low = low if any(d) else np.arange(1, len(code) + 1)  # within the cell, each pair once
        ends = np.cumsum(high - low)
        start = 0
        while start < len(code):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            n_ = (high - low)[start:stop]
            i = np.repeat(np.arange(start, stop), n_)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n_) - n_, n_) + np.repeat(low[start:stop], n_)
            near = np.sqrt(((at[i] - at[j]) ** 2).sum(axis=1)) <= eps
            found.append((whole[i[near]], whole[j[near]]))
            start = stop
    left, right = (np.concatenate(x) for x in zip(*found))
    return np.minimum(left, right), np.maximum(left, right)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first point of each point's component, by the pairs i, j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _labels(xyz: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Components of core points, numbered by their first point; -1 for the rest."""
    n = len(xyz)
    i, j = _near(xyz, eps)
    core = np.bincount(i, minlength=n) + np.bincount(j, minlength=n) >= min_points
    joined = core[i] & core[j]
    out = np.full(n, -1, np.int64)
    out[core] = np.unique(_roots(n, i[joined], j[joined])[core], return_inverse=True)[1]
    return out


def _labels_of(xyz: np.ndarray, starts: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """``_labels`` of each of the groups that begin at ``starts``: those of one size, if they are small, together."""
    out, size = np.empty(len(xyz), np.int64), np.diff(starts, append=len(xyz))
    for n in np.unique(size):
        first = starts[size == n]
        if n > SMALL:
            for k in first:
                out[k : k + n] = _labels(xyz[k : k + n], eps, min_points)
            continue
        each = max(1, PAIRS // int(n * n))
        for part in (first[k : k + each] for k in range(0, len(first), each)):
            at = part[:, None] + np.arange(n)
            v = xyz[at]
            near = np.sqrt(sum((v[:, :, None, c] - v[:, None, :, c]) ** 2 for c in range(3))) <= eps
            near[:, np.arange(n), np.arange(n)] = False
            core = near.sum(axis=2) >= min_points
            near &= core[:, :, None] & core[:, None, :]
            near[:, np.arange(n), np.arange(n)] = True
            root = np.broadcast_to(np.arange(n), core.shape)
            while True:  # the least point that is told along links, until nothing changes
                new = np.where(near, root[:, None, :], n).min(axis=2)
                new = np.take_along_axis(new, new, axis=1)
                if (new == root).all():
                    break
                root = new
            number = np.cumsum(core & (root == np.arange(n)), axis=1) - 1
            out[at] = np.where(core, np.take_along_axis(number, root, axis=1), -1)
    return out


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream sorted by ``key``: tables of some of them, and where each starts; a group may go over batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(key)
        value, null = c.drop_null().to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)
        at = np.maximum(np.cumsum(~null) - 1, 0)
        value = value[at] if len(value) else np.zeros(b.num_rows)
        differs = np.append(False, (value[1:] != value[:-1]) & ~(null[1:] & null[:-1]) | (null[1:] != null[:-1]))
        differs[0] = bool(held) and held[-1].column(key)[-1].as_py() != c[0].as_py()
        cuts = np.flatnonzero(differs)
        if not len(cuts):
            held.append(b)
            continue
        before = sum(x.num_rows for x in held)
        starts = np.append(0, cuts[:-1] + before)
        yield pa.Table.from_batches([*held, b.slice(0, cuts[-1])]), np.unique(starts)
        held = [b.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, np.int64)


def _none_over(points: DataFrame, shot: str, huge: int) -> bool:
    """Whether no group of shots, and so no shot, has more than ``huge`` points: what is shuffled are the groups' numbers."""
    key = F.col(shot) + F.lit(0.0) if points.schema[shot].dataType.typeName() in ("float", "double") else F.col(shot)  # -0.0 is 0.0
    counts = points.filter(F.col(shot).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(GRAINS)).alias("_g")).count()
    return counts.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] <= huge


def density(points: DataFrame, eps: float, min_points: int, shot: str = "shot", order: list[str] = ("pid",), huge: int | None = None, limit: int = huge_shots.LIMIT) -> DataFrame:
    """``points`` (with x, y, tof in seconds) with ``cluster``: from 0 within each shot, -1 for noise. Border points are
    noise, and so is all without a shot.

    A shot is one task, but for those of more than ``huge`` points, if that is given: a pass counts the points of groups of
    shots, one more, if some group is that large, those of the shots, and ``huge_shots`` deals the large ones over tasks, in boxes of ``limit`` places. In these, points that lack a place are noise."""
    if huge is not None and not _none_over(points, shot, huge):
        sizes = points.filter(F.col(shot).isNotNull()).groupBy(F.col(shot).alias("_big")).count().filter(F.col("count") > huge).select("_big")
        sizes = huge_shots._written(sizes, f"{store.scratch(points.sparkSession)}/huge")
        if n := sizes.count():
            sizes = F.broadcast(sizes) if n <= LISTED else sizes
            on = F.col(shot) == F.col("_big")
            large = points.join(sizes, on, "left_semi")
            found = huge_shots.clustered(large, f"tof * {eps / (Z_NS * 1e-9)!r}D", eps, min_points, shot, list(order), limit)
            return density(points.join(sizes, on, "left_anti"), eps, min_points, shot, order).unionByName(found)
    fields = points.schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "cluster long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches, shot):
            at = lambda c: t.column(c).cast(pa.float64()).to_numpy()
            xyz = np.column_stack([at("x"), at("y"), at("tof") * (eps / (Z_NS * 1e-9))])
            found = _labels_of(xyz, starts, eps, min_points)
            found[t.column(shot).is_null().to_numpy()] = -1
            yield from t.append_column("cluster", pa.array(found)).combine_chunks().to_batches()

    return points.repartition(shot).sortWithinPartitions(shot, *order).mapInArrow(run, schema)


def numbered(clustered: DataFrame, shot: str = "shot") -> DataFrame:
    """Labels that count up over shots in ascending order: ``label``, -1 for noise."""
    sizes = clustered.filter("cluster >= 0").groupBy(shot).agg((F.max("cluster") + 1).alias("_n"))
    spans = spanned(sizes, shot, [])
    total = spans.groupBy("_span").agg(F.sum("_n").alias("_t"))
    assert SPANS <= 4096  # rows of the next window
    total = total.withColumn("_base", F.sum("_t").over(Window.orderBy("_span")) - F.col("_t")).select(F.col("_span").alias("_s"), "_base")
    inner = F.sum("_n").over(Window.partitionBy("_span").orderBy(shot)) - F.col("_n")
    base = spans.withColumn("_in", inner).join(F.broadcast(total), F.col("_span") == F.col("_s")).select(F.col(shot).alias("_shot"), (F.col("_base") + F.col("_in")).alias("_start"))
    out = clustered.join(base, F.col(shot) == F.col("_shot"), "left")
    return out.withColumn("label", F.when(F.col("cluster") < 0, F.lit(-1)).otherwise(F.col("_start") + F.col("cluster")).cast("long")).drop("_shot", "_start")


def numbered_in_order(clustered: DataFrame, shot: str, order: list[str], huge: int = HUGE) -> DataFrame:
    """``numbered``, with the rows in the order of shot (null last), label and ``order`` from partition to partition.

    Spans of shots are dealt over tasks in their order, so rows are shuffled once and joined with nothing but the spans' first
    numbers. With a shot of more than ``huge`` rows all columns are sorted over tasks instead, as a span would hold it whole."""
    bounds = bounds_of(clustered, shot)
    sizes = clustered.groupBy(shot).agg(F.coalesce(F.max("cluster") + 1, F.lit(0)).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    spans = spanned(sizes, shot, [], bounds).groupBy("_span").agg(F.sum("_n").alias("_n"), F.max("_rows").alias("_rows")).orderBy("_span").collect()
    assert len(spans) <= SPANS + 1  # and one of nulls
    if max((r["_rows"] for r in spans), default=0) > huge:
        return numbered(clustered, shot).orderBy(shot, "label", *order)
    ends = np.cumsum([r["_n"] for r in spans])
    starts = clustered.sparkSession.createDataFrame([(r["_span"], int(e) - r["_n"]) for r, e in zip(spans, ends)], "_s int, _start long")
    rows = spanned(clustered, shot, [], bounds).join(F.broadcast(starts), F.col("_span") == F.col("_s")).drop("_s")
    tasks = max(1, min(SPANS, int(clustered.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("_task", F.expr(f"cast(_span * {tasks} div {len(bounds) + 2} as int)")).repartitionById(tasks, "_task")
    keys, by = ["_task", "_span"], [shot, "cluster", *order]
    w = Window.partitionBy(*keys).orderBy(*by)  # as the rows are dealt and sorted, so it shuffles and sorts nothing
    same = F.lag("cluster").over(w).eqNullSafe(F.col("cluster")) & F.lag(shot).over(w).eqNullSafe(F.col(shot))
    rows = rows.sortWithinPartitions(*keys, *by).withColumn("_first", ((F.col("cluster") >= 0) & ~same).cast("long"))
    count = F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("label", F.when(F.col("cluster") < 0, F.lit(-1)).otherwise(F.col("_start") + count - 1).cast("long"))
    return rows.select(*clustered.columns, "label")


class Cells:
    """Open clusters of a pass over hits in time order; ``add`` gives those that a hit closes, ``close`` the rest."""

    def __init__(self, eps_space: float, eps_time: float, slots: int):
        self.eps_space, self.eps_time, self.open = eps_space, eps_time, [None] * slots

    def add(self, x, y, t, w) -> list[tuple]:
        best, far, out = -1, None, []
        for k, c in enumerate(self.open):
            if c is None:
                continue
            if t - c[2] > self.eps_time:
                out.append(tuple(c))
                self.open[k] = None
                continue
            d = abs(x - c[0]) + abs(y - c[1])
            if d <= self.eps_space and (far is None or d < far):
                best, far = k, d
        if best >= 0:
            c = self.open[best]
            if w > c[3]:
                c[0], c[1], c[3] = x, y, w
            return out
        free = next((k for k, c in enumerate(self.open) if c is None), None)
        if free is None:
            free = min(range(len(self.open)), key=lambda k: self.open[k][2])
            out.append(tuple(self.open[free]))
        self.open[free] = [x, y, t, w]
        return out

    def close(self) -> list[tuple]:
        out = [tuple(c) for c in self.open if c is not None]
        self.open = [None] * len(self.open)
        return out


def greedy_cells(x, y, toa, tot, eps_space: float, eps_time: float, slots: int) -> list[tuple]:
    """One pass over hits in time order: (x, y, toa, tot) of each cluster, in the order in which they close."""
    cells = Cells(eps_space, eps_time, slots)
    return [c for hit in zip(x, y, toa, tot) for c in cells.add(*hit)] + cells.close()


def greedy(hits: DataFrame, eps_space: float, eps_time: float, slots: int = 64, scope: list[str] = ()) -> DataFrame:
    """Centroids x, y, toa, tot of each scope (such as a buffer). Hits are ordered by (toa, x, y, tot) and cut into pieces
    at gaps of more than eps_time, which close every cluster, so pieces are independent."""
    scope = list(scope)
    # Only gaps within a span of time and the one before its first hit are looked for; a span starts a piece by its own gap test.
    df = spanned(hits, "toa", scope)
    last = df.groupBy(*scope, "_span").agg(F.max("toa").alias("_last"))
    last = last.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*scope).orderBy("_span"))).select(*(F.col(c).alias(f"_t_{c}") for c in scope), F.col("_span").alias("_ts"), "_prev")
    on = F.col("_span") == F.col("_ts")
    for c in scope:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    df = df.join(last if scope else F.broadcast(last), on, "left").drop("_ts", *(f"_t_{c}" for c in scope))
    w = Window.partitionBy(*scope, "_span").orderBy("toa", "x", "y", "tot")
    before = F.coalesce(F.lag("toa").over(w), F.col("_prev"))
    df = df.withColumn("_cut", (before.isNull() | (F.col("toa") - before > eps_time)).cast("long"))
    cuts = df.groupBy(*scope, "_span").agg(F.sum("_cut").alias("_cuts"))
    cuts = cuts.withColumn("_before", F.sum("_cuts").over(Window.partitionBy(*scope).orderBy("_span")) - F.col("_cuts")).select(*(F.col(c).alias(f"_t_{c}") for c in scope), F.col("_span").alias("_ts"), "_before")
    df = df.join(cuts if scope else F.broadcast(cuts), on, "left").drop("_ts", *(f"_t_{c}" for c in scope))
    df = df.withColumn("_piece", F.col("_before") + F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = hits.select(*scope, "x", "y", "toa", "tot").schema
    keys, values = [*scope, "_piece"], ["x", "y", "toa", "tot"]
    sorted_ = df.select(*keys, *values).repartition(*keys).sortWithinPartitions(*keys, *values[2:3], "x", "y", "tot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, key, names = Cells(eps_space, eps_time, slots), None, None
        types = None
        for b in batches:
            types = types or [b.schema.field(c).type for c in (*scope, *values)]
            names, out = [*scope, *values], []
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, *values))):
                if row[: len(keys)] != key:
                    out += [(*key[:-1], *c) for c in cells.close()] if key is not None else []
                    key = row[: len(keys)]
                out += [(*key[:-1], *c) for c in cells.add(*row[len(keys) :])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if rest := ([(*key[:-1], *c) for c in cells.close()] if key is not None else []):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest), types)], names)

    return sorted_.mapInArrow(run, kinds)

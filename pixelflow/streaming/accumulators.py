"""Live accumulators as a stateful stream: image, spectrum, regions and rates, cleared by hand or by the data's time.

Hits are first counted where they are read: each Arrow batch becomes a few rows of slots and counts by accumulator, shard and time
slice, so what is shuffled is bounded by the number of batches and shards, however popular a pixel is. A state holds one shard of
one accumulator (a line of an image, SHARD bins of a spectrum, one region):

* ``open``: counts by time slice, while the watermark hasn't passed the slice's end;
* ``settled``: the sum of all slices before, since the last clear. A timer at a slice's end moves it over.

So hits count whatever order they arrive in, up to ``delay`` behind the newest; what comes later than its slice's end plus that is
dropped and counted by Spark (numRowsDroppedByWatermark). A clear takes effect at the start of the slice that holds its time and reaches every shard;
as only open slices lie behind it, the result equals that of the batch functions over the hits since. With ``every``, sums start
anew at whole multiples of it, as in ``histogram.cleared_images``. Rates are kept by slice and forgotten when it settles. The
state is bounded by slots of a shard, times the slices that a ``delay`` spans.

Each update replaces what its accumulator, shard and period had; ``latest`` picks the last ones of a table of updates, from
which ``image``, ``spectrum``, ``counts`` and ``rates`` make the batch functions' rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pixelflow import schemas as S
from pixelflow.operators.histogram import Roi

SHARD = 64  # bins of a spectrum, and ways that rates are dealt
ORIGIN_US = 366 * 86_400_000_000  # where time 0 stands on the watermark's clock, which takes what isn't after 1970 for late
PARTIAL = "acc string, shard int, slice long, last long, slots array<long>, counts array<long>, command string"
UPDATE = "acc string, shard int, period long, slots array<long>, counts array<long>"


@dataclass(frozen=True)
class Plan:
    """What is accumulated. Times are whole units of ``unit_us`` microseconds; ``every`` is a whole multiple of ``slice``.
    ``since``: by region, the time from which it counts."""

    slice: int
    axis: tuple[int, int, int]  # of the spectrum: low, high, bins
    rois: list[Roi] = field(default_factory=list)
    every: int | None = None
    delay: str = "10 seconds"
    unit_us: float = 1.0
    since: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.every is not None and self.every % self.slice:
            raise ValueError("every is a whole multiple of slice")

    def shards(self) -> list[tuple[str, int]]:
        """Every running accumulator's shards, which a clear has to reach."""
        lines = range(S.SENSOR)
        out = [("image", y) for y in lines] + [("spectrum", k) for k in range(-(-self.axis[2] // SHARD))]
        return out + [("roi", k) for k in range(len(self.rois))] + [(f"roi:{r.name}", y) for r in self.rois for y in lines]


def _counted(acc: str, shard: np.ndarray, at: np.ndarray, slot: np.ndarray, toa: np.ndarray) -> list[tuple]:
    """A row for each shard and slice: its last time, and its slots with their counts."""
    if not len(at):
        return []
    order = np.lexsort((slot, at, shard))
    shard, at, slot, toa = shard[order], at[order], slot[order], toa[order]
    group = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (at[1:] != at[:-1])]))
    new = np.concatenate([[True], slot[1:] != slot[:-1]])
    new[group] = True
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(slot))
    cut = np.append(np.searchsorted(first, group), len(first))
    last = np.maximum.reduceat(toa, group)
    return [(acc, int(shard[g]), int(at[g]), int(last[i]), slot[first[a:b]], n[a:b], None) for i, (g, a, b) in enumerate(zip(group, cut, cut[1:]))]


def partials(events: DataFrame, plan: Plan) -> DataFrame:
    """Counts of each batch of ``events`` (x, y, toa, tof, t_trigger; batch or stream)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x, y, toa, tof, trigger = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            x, y, at = np.clip(x, 0, S.SENSOR - 1), np.clip(y, 0, S.SENSOR - 1), np.floor_divide(toa, plan.slice)
            low, high, bins = plan.axis
            place = np.where(tof == high, bins - 1, np.floor((tof - low) * bins / (high - low))).astype(np.int64)
            seen = (tof >= low) & (tof <= high)
            rows = _counted("image", y, at, x, toa) + _counted("spectrum", place[seen] // SHARD, at[seen], place[seen], toa[seen])
            rate = [(np.zeros(len(at), np.int64), np.ones(len(at), bool))]
            for k, r in enumerate(plan.rois):
                inside = (tof >= r.low) & (tof <= r.high)
                rate.append((np.full(len(at), k + 1), inside))
                inside = inside & (toa >= plan.since.get(r.name, np.iinfo(np.int64).min))
                rows += _counted("roi", np.full(inside.sum(), k), at[inside], np.zeros(inside.sum(), np.int64), toa[inside])
                rows += _counted(f"roi:{r.name}", y[inside], at[inside], x[inside], toa[inside])
            series, when, until = (np.concatenate([v[m] for v, (_, m) in zip(each, rate)]) for each in ([s for s, _ in rate], [at] * len(rate), [toa] * len(rate)))
            rows += _counted("rate", when % SHARD, when, series, until) + _counted("shots", trigger % SHARD, at, trigger, toa)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
            names = ["acc", "shard", "slice", "last", "slots", "counts", "command"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return events.select(*(F.col(c).cast("long").alias(c) for c in ("x", "y", "toa", "tof", "t_trigger"))).mapInArrow(run, PARTIAL)


def clears(commands: DataFrame, plan: Plan) -> DataFrame:
    """Rows that clear every shard at the times ``at`` of ``commands``."""
    every = F.array(*(F.struct(F.lit(a).alias("acc"), F.lit(k).alias("shard")) for a, k in plan.shards()))
    rows = commands.select(F.col("at").cast("long").alias("at"), F.explode(every).alias("to"))
    none = F.array().cast("array<long>")
    return rows.select("to.acc", "to.shard", F.floor(F.col("at") / plan.slice).alias("slice"), F.col("at").alias("last"), none.alias("slots"), none.alias("counts"), F.lit("clear").alias("command"))


def _merged(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    slots, counts = (np.concatenate([np.asarray(p[k], np.int64) for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    found, place = np.unique(slots, return_inverse=True)
    return found, np.bincount(place.ravel(), counts, len(found)).astype(np.int64)


def _bytes(part: tuple[np.ndarray, np.ndarray]) -> bytes:
    return np.concatenate(part).astype("<i8").tobytes()


def _part(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, "<i8")
    return both[: len(both) // 2], both[len(both) // 2 :]


class Accumulate(StatefulProcessor):
    def __init__(self, plan: Plan):
        self.plan = plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "period long, cleared long, data binary")
        self.open = handle.getMapState("open", "slice long", "data binary")

    def _period(self, at: int) -> int:
        return at * self.plan.slice // self.plan.every if self.plan.every else 0

    def _state(self) -> tuple[int, int, tuple]:
        got = self.settled.get() if self.settled.exists() else None
        return (got[0], got[1], _part(got[2])) if got else (np.iinfo(np.int64).min, np.iinfo(np.int64).min, _merged())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        acc, shard = key
        by_slice, came, cleared_now = acc in ("rate", "shots"), {}, None
        for part in rows:  # what a batch has of one shard: its Arrow batches' counts
            for at, slots, counts, command in zip(part["slice"], part["slots"], part["counts"], part["command"]):
                if command == "clear":
                    cleared_now = max(int(at), cleared_now if cleared_now is not None else int(at))
                else:
                    came.setdefault(int(at), []).append((slots, counts))
        period, cleared, sums = self._state()
        touched = set()
        if cleared_now is not None and cleared_now > cleared:
            cleared, sums = cleared_now, _merged()
            for (at,) in list(self.open.keys()):
                if at < cleared:
                    self.open.removeKey((at,))
                    touched.add(self._period(at))
            touched.add(max(period, self._period(cleared)) if self.plan.every else 0)
            self.settled.update((period, cleared, _bytes(sums)))
        for at, parts in came.items():
            if at < cleared and not by_slice:
                continue
            if self.open.containsKey((at,)):
                parts.append(_part(self.open.getValue((at,))[0]))
            merged = _merged(*parts)
            if acc == "shots":  # each trigger once, however often it is told
                merged = merged[0], np.ones(len(merged[0]), np.int64)
            self.open.updateValue((at,), (_bytes(merged),))
            self.handle.registerTimer(self._end(at))
            touched.add(at if by_slice else self._period(at))
        if by_slice:
            made = [(at, _part(self.open.getValue((at,))[0])) for at in sorted(touched)]
            made = [(at, (np.zeros(1, np.int64), np.array([len(p[0])]))) if acc == "shots" else (at, p) for at, p in made]
        else:
            there = [(self._period(k[0]), _part(v[0])) for k, v in self.open.iterator()] + [(period, sums)]
            made = [(p, _merged(*(v for q, v in there if q == p or not self.plan.every))) for p in sorted(touched)]
        if made:
            yield pd.DataFrame({"acc": [acc] * len(made), "shard": [shard] * len(made), "period": [p for p, _ in made], "slots": [v[0].tolist() for _, v in made], "counts": [v[1].tolist() for _, v in made]})

    def _end(self, at: int) -> int:
        """Milliseconds at which a slice ends."""
        return int(-(-((at + 1) * self.plan.slice * self.plan.unit_us + ORIGIN_US) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        period, cleared, sums = self._state()
        ended = sorted(at for (at,) in self.open.keys() if self._end(at) <= expiredTimerInfo.getExpiryTimeInMs())
        for at in ended:
            if key[0] not in ("rate", "shots"):
                now = self._period(at)
                sums = _merged(_part(self.open.getValue((at,))[0]), *([sums] if now == period or not self.plan.every else []))
                period = now
            self.open.removeKey((at,))
        if ended and key[0] not in ("rate", "shots"):
            self.settled.update((period, cleared, _bytes(sums)))
        return iter(())

    def close(self) -> None:
        pass


def accumulated(events: DataFrame, plan: Plan, commands: DataFrame | None = None) -> DataFrame:
    """Updates of a stream of events; ``commands``: a stream with the times ``at`` of clears."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = partials(events, plan)
    if commands is not None:
        rows = rows.unionByName(clears(commands, plan))
    timed = rows.withColumn("ts", F.timestamp_micros((F.col("last") * plan.unit_us).cast("long") + ORIGIN_US)).withWatermark("ts", plan.delay)
    return timed.groupBy("acc", "shard").transformWithStateInPandas(Accumulate(plan), UPDATE, "Update", "eventTime")


def started(updates: DataFrame, folder: str, checkpoint: str, **trigger):
    """The stream of updates into a Parquet table with each batch's number; a batch that is run again replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "300 milliseconds"})).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """acc, shard, period, slot and count after the last batch."""
    rows = spark.read.schema(f"{UPDATE}, batch long").parquet(folder)
    last = rows.groupBy("acc", "shard", "period").agg(F.max_by(F.struct("slots", "counts"), "batch").alias("v"))
    return last.select("acc", "shard", "period", F.explode(F.arrays_zip("v.slots", "v.counts")).alias("z")).select("acc", "shard", "period", F.col("z.slots").alias("slot"), F.col("z.counts").alias("count"))


def image(rows: DataFrame, roi: str | None = None) -> DataFrame:
    """period, x, y and count."""
    found = rows.filter(F.col("acc") == (f"roi:{roi}" if roi else "image"))
    return found.select("period", F.col("slot").cast("int").alias("x"), F.col("shard").alias("y"), "count")


def spectrum(rows: DataFrame, plan: Plan) -> DataFrame:
    """period, bin, lo, hi, center and count of every bin that has hits."""
    low, width, b = plan.axis[0], (plan.axis[1] - plan.axis[0]) / plan.axis[2], F.col("bin")
    found = rows.filter("acc = 'spectrum'").select("period", F.col("slot").cast("int").alias("bin"), "count")
    return found.select("period", "bin", (b * width + low).alias("lo"), ((b + 1) * width + low).alias("hi"), ((b + 0.5) * width + low).alias("center"), "count")


def counts(rows: DataFrame, plan: Plan) -> DataFrame:
    """period, roi and count of the regions that have hits."""
    names = F.array(*(F.lit(r.name) for r in plan.rois))
    return rows.filter("acc = 'roi'").select("period", F.get(names, F.col("shard")).alias("roi"), "count")


def rates(rows: DataFrame, plan: Plan) -> DataFrame:
    """tick, series and rate of the slices: events over distinct trigger times."""
    names = F.array(F.lit("total"), *(F.lit(r.name) for r in plan.rois))
    shots = rows.filter("acc = 'shots'").groupBy(F.col("period").alias("_tick")).agg(F.sum("count").alias("_shots"))
    n = rows.filter("acc = 'rate'").select(F.col("period").alias("tick"), F.get(names, F.col("slot").cast("int")).alias("series"), "count")
    return n.join(shots, F.col("tick") == F.col("_tick")).select("tick", "series", (F.col("count") / F.col("_shots")).alias("rate"))

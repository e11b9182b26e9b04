"""Hits to their preceding triggers, two streams in event time.

Time is cut into slices of SLICE windows. A hit belongs to its slice, a trigger to those that its window touches, and a slice is a
state: what each batch brought of it, appended as it came. When the watermark has passed a slice's end, no hit or trigger of it can
come any more; a timer then sorts its triggers, finds each hit's own by binary search, and drops the state. So a hit is held, moved and
compared once, however many triggers lie in its reach. A task holds one slice, as the batch join's tasks hold buckets.

The watermark is that of the slower stream, ``delay`` behind the newest time seen. So what has been given out lies before
the last trigger's time less ``delay``: a next trigger is known, and the events are those of ``correlate.live`` over the whole run, in whatever
order batches came. Hits of the last ``delay`` and slice wait for a later trigger. Rows that come later than the watermark are dropped, and counted: see
``dropped``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ORIGIN_US = 366 * 86_400_000_000  # where time 0 stands on the watermark's clock, which takes what isn't after 1970 for late
SLICE = 16  # windows of a slice, which is a millisecond at least
HIT = ["x", "y", "toa", "tot"]
OUT = 1 << 16  # rows that are given out at a time


def _bytes(rows: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def own(hits: pd.DataFrame, triggers: np.ndarray, low: int, high: int) -> pd.DataFrame:
    """Hits with the last of the ``triggers`` that isn't after them as t_trigger, and tof, if low <= tof <= high."""
    times, toa = np.unique(triggers), hits["toa"].to_numpy()
    at = np.searchsorted(times, toa, "right") - 1
    hits, toa, at = hits[at >= 0], toa[at >= 0], at[at >= 0]
    tof = toa - times[at]
    kept = (tof >= low) & (tof <= high)
    return hits[kept].assign(t_trigger=times[at[kept]], tof=tof[kept])


class Slices(StatefulProcessor):
    def __init__(self, low: int, high: int, span: int, unit_us: float):
        self.low, self.high, self.span, self.unit_us = low, high, span, unit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "rows binary")
        self.triggers = handle.getListState("triggers", "times binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            hit = part["hit"].to_numpy(bool)
            if hit.any():
                self.hits.appendValue((_bytes(part.loc[hit, HIT]),))
            if not hit.all():
                self.triggers.appendValue((np.unique(part["toa"].to_numpy()[~hit]).astype("<i8").tobytes(),))
        end = (int(key[0]) + 1) * self.span
        self.handle.registerTimer(int(-(-(end * self.unit_us + ORIGIN_US) // 1000)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(v[0]).read_all() for v in self.hits.get()]
        times = [np.frombuffer(v[0], "<i8") for v in self.triggers.get()]
        self.hits.clear()
        self.triggers.clear()
        if parts and times:
            hits = pa.concat_tables(parts, promote_options="permissive").to_pandas()
            made = own(hits, np.concatenate(times), self.low, self.high)
            for k in range(0, len(made), OUT):
                yield made.iloc[k : k + OUT]

    def close(self) -> None:
        pass


def live(hits: DataFrame, triggers: DataFrame, low: int, high: int, delay: str = "10 seconds", unit_us: float = 1.0) -> DataFrame:
    """x, y, toa, tot, t_trigger and tof of the hits with low <= tof <= high. Streams of x, y, toa, tot and of toa, in whole units of
    ``unit_us`` microseconds. Equal hits come as often as they were sent; triggers of one time count once."""
    hits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    width = max(1, high + 1)
    span = width * max(SLICE, int(1000 / (width * unit_us)) + 1)
    clock = F.timestamp_micros((F.col("toa") * unit_us).cast("long") + ORIGIN_US)
    kinds = {f.name: f.dataType for f in hits.schema.fields}
    seen = hits.select("x", "y", F.col("toa").cast("long").alias("toa"), "tot").filter("toa is not null").withColumn("at", clock).withWatermark("at", delay)
    seen = seen.select(F.floor(F.col("toa") / span).alias("slice"), *HIT, "at", F.lit(True).alias("hit"))
    times = triggers.select(F.col("toa").cast("long").alias("toa")).filter("toa is not null").withColumn("at", clock).withWatermark("at", delay)
    none = {c: F.lit(0).cast(kinds[c]).alias(c) for c in ("x", "y", "tot")}
    reach = F.explode(F.sequence(F.floor(F.col("toa") / span), F.floor((F.col("toa") + high) / span))).alias("slice")
    times = times.select(reach, none["x"], none["y"], "toa", none["tot"], "at", F.lit(False).alias("hit"))
    schema = ", ".join([*(f"{c} {'long' if c == 'toa' else kinds[c].simpleString()}" for c in HIT), "t_trigger long, tof long"])
    return seen.unionByName(times).groupBy("slice").transformWithStateInPandas(Slices(low, high, span, unit_us), schema, "Append", "eventTime")


def dropped(query) -> int:
    """Rows of either stream, and of what was made of them, that came too late."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)

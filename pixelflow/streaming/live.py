"""Live acquisition as a structured stream: recorded files in, decoded and correlated tables out, and its controls."""

from __future__ import annotations

import json
import time
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelflow import schemas as S
from pixelflow.operators import correlate, decode
from pixelflow.operators.filters import triggers_of
from pixelflow.sources import frames, packed, runs, store, tpx3

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Packets of ``.tpx3`` files as they arrive; micro-batches are bounded by their number of files."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.tpx3").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return frames.packets_of(frames.frames_of(files))


def followed_stream(spark: SparkSession, folder: str, progress: str, max_bytes: int = tpx3.MAX_BYTES) -> DataFrame:
    """Packets of a folder of ``.tpx3`` files that is still written to: micro-batches end after ``max_bytes`` or with their trigger,
    frames wait until they are whole. ``progress``: a folder of the query's own."""
    tpx3.register(spark)
    return frames.packets_of(spark.readStream.format("tpx3").option("max_bytes", max_bytes).option("progress", progress).load(folder))


#: What a recording keeps unless told otherwise.
KEPT = {"events": True, "pixels": True, "triggers": True}


class Bus:
    """Named events to subscribers, '*' for all; a subscriber's failure is kept, not raised."""

    def __init__(self):
        self._subscribers: dict[str, list] = {}
        self.errors: list[Exception] = []

    def subscribe(self, event: str, f) -> None:
        """Once, however often it is asked for."""
        if f not in self._subscribers.setdefault(event, []):
            self._subscribers[event].append(f)

    def unsubscribe(self, event: str, f) -> None:
        if f in self._subscribers.get(event, []):
            self._subscribers[event].remove(f)

    def publish(self, event: str, *args, **more) -> int:
        """How many subscribers were called."""
        called = 0
        for name, arguments in ((event, args), ("*", (event, *args))):
            for f in list(self._subscribers.get(name, [])):
                called += 1
                try:
                    f(*arguments, **more)
                except Exception as e:  # noqa: BLE001  a subscriber must not stop the others
                    self.errors.append(e)
        return called

    def events(self) -> list[str]:
        return sorted(k for k, v in self._subscribers.items() if v)

    def subscriber_count(self, event: str) -> int:
        return len(self._subscribers.get(event, []))

    def clear(self) -> None:
        self._subscribers.clear()


class Recorder:
    """Writes each micro-batch of packets as pixels, triggers and events of the recording that is on.

    A batch is written under its number, in overwrite mode, so a batch that is run again replaces itself. Hits wait for
    the trigger that follows theirs: hits and the last trigger of a batch are carried to the next one as tables in
    ``state``: all hits in the event window of that trigger, and those of the last two windows before the newest hit. So
    pairs across batches aren't lost, however far apart triggers are, and the state stays bounded: a batch's own and its
    predecessor's are kept, for a batch that is run again.

    ``correlator``: what makes events of hits and triggers, ``correlate.live`` unless told otherwise. With ``packed_files``
    the recording is also written as packed record files, exactly once a batch, in seconds, in ``<out>/<run>``, which
    must then be a folder that the executors share."""

    def __init__(self, spark: SparkSession, out: str, window: tuple[int, int], tdc_id: int = 1, edge: int = 0, bus: Bus | None = None, correlator=correlate.live, packed_files: bool = False):
        self.spark, self.out, self.window, self.tdc_id, self.edge = spark, out, window, tdc_id, edge
        self.correlator, self.packed_files, self.home = correlator, packed_files, out
        packed.register(spark)  # before a stream starts, whose session is a copy
        self.bus, self.run, self.kept = bus or Bus(), None, dict(KEPT)
        self.progress: deque = deque(maxlen=100)

    def _carried(self, batch: int, kind: str, schema: str) -> DataFrame:
        path = f"{self.home}/_state/{batch - 1}/{kind}"
        return self.spark.read.schema(schema).parquet(path) if store.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _pack(self, kind: str, table: DataFrame, batch: int) -> None:
        """The batch's records as packed files, one for each task that has any; a batch that comes again adds nothing."""
        seconds = lambda c: (F.col(c) * (S.PIXEL_TICK_S / S.TICKS_PER_PIXEL_TICK)).alias(c)
        rows = table.select(*(seconds(n) if n in ("t_trigger", "toa", "tof") else F.col(n) for n, _, _ in S.LAYOUTS[kind]))
        writer = rows.write.format("packed").option("kind", kind).option("name", self.run).option("batch", batch)
        writer.mode("append").save(f"{self.out}/{self.run}")

    def __call__(self, packets: DataFrame, batch: int) -> None:
        packets, began = packets.persist(), time.time()
        try:
            hits = decode.pixels(packets).select("x", "y", (F.col("toa_ticks") * S.TICKS_PER_PIXEL_TICK).alias("toa"), "tot")
            triggers = decode.triggers(packets).withColumnRenamed("ticks", "toa")
            all_hits = hits.unionByName(self._carried(batch, "hits", "x int, y int, toa long, tot long"))
            chosen = triggers_of(triggers, self.tdc_id, self.edge).select("toa").unionByName(self._carried(batch, "triggers", "toa long"))
            events = self.correlator(all_hits, chosen, *self.window)
            last = chosen.agg(F.max("toa").alias("last"))
            later = all_hits.join(F.broadcast(last), F.col("last").isNull() | (F.col("toa") >= F.col("last"))).drop("last")
            newest = all_hits.agg(F.max("toa").alias("newest"))
            recent = newest.join(last).select((F.col("newest") - 2 * (self.window[1] + 1)).alias("recent"), (F.col("last") + self.window[1]).alias("end"))
            later = later.join(F.broadcast(recent), (F.col("toa") >= F.col("recent")) | (F.col("toa") <= F.col("end"))).drop("recent", "end")
            state = f"{self.home}/_state/{batch}"
            later.write.mode("overwrite").parquet(f"{state}/hits")
            last.select(F.col("last").alias("toa")).filter("toa is not null").write.mode("overwrite").parquet(f"{state}/triggers")
            if self.run:
                for kind, table in (("events", events), ("pixels", hits), ("triggers", triggers)):
                    if self.kept[kind]:
                        table.write.mode("overwrite").parquet(f"{self.out}/{kind}/run={self.run}/batch={batch}")
                        if self.packed_files:
                            self._pack(kind, table, batch)
            store.remove(self.spark, f"{self.home}/_state/{batch - 2}")
            for kind, table in (("events", events), ("pixels", hits)):
                if self.bus.subscriber_count(kind):  # a subscriber takes the batch's table, and says itself what it collects
                    self.bus.publish(kind, table, batch)
            n_hits, n_triggers = (t.count() for t in (hits, triggers))
            self.progress.append({"batch": batch, "pixels": n_hits, "triggers": n_triggers, "seconds": time.time() - began})
            self.bus.publish("batch", batch)
        finally:
            packets.unpersist()


class Controller:
    """Start, stop and status of recordings, by the command dictionaries that clients send."""

    def __init__(self, recorder: Recorder):
        self.recorder, self.query = recorder, None

    def start(self, packets: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = packets.writeStream.foreachBatch(self.recorder).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 milliseconds")).start()
        return self.query

    def start_record(self, filename: str, output_dir: str | None = None, **kinds: bool) -> bool:
        """False if raw data are asked for: their record is the landing folder, nothing is copied. Flags and folder hold for
        this recording only; metadata are written beside it at once."""
        if kinds.pop("save_raw", False):
            return False
        if self.recorder.run:
            self.stop_record()
        r = self.recorder
        r.kept = KEPT | {k.removeprefix("save_"): bool(v) for k, v in kinds.items() if k.startswith("save_")}
        r.out = output_dir or r.home
        files = {k: f"{filename}{S.SUFFIXES[k]}" for k, kept in r.kept.items() if kept}
        ns = tuple(round(w * S.PIXEL_TICK_S / S.TICKS_PER_PIXEL_TICK * 1e9) for w in r.window)
        store.write_text(r.spark, f"{r.out}/{filename}/{filename}_meta.json", json.dumps(runs.metadata(r.tdc_id, r.edge, ns, files), indent=2))
        self.recorder.run = filename
        self.recorder.bus.publish("recording_started", filename)
        return True

    def run_for(self, packets: DataFrame, checkpoint: str, seconds: float, filename: str | None = None) -> bool:
        """A bounded run: records until ``seconds`` are over or the stream ends by itself, under ``filename`` or the time's
        name. True if the stream ended by itself."""
        self.start_record(filename or time.strftime("run_%Y%m%d_%H%M%S"))
        query = self.start(packets, checkpoint)
        try:
            return bool(query.awaitTermination(seconds))
        finally:
            query.stop()
            self.stop_record()

    def rolling(self, n: int = 20) -> dict:
        """Diagnostics of the last ``n`` batches: sums of pixels and triggers, mean seconds a batch."""
        last = list(self.recorder.progress)[-n:]
        return {"batches": len(last), "pixels": sum(p["pixels"] for p in last), "triggers": sum(p["triggers"] for p in last), "mean_seconds": sum(p["seconds"] for p in last) / len(last) if last else 0.0}

    def stop_record(self) -> bool:
        was, self.recorder.run = self.recorder.run, None
        if was:
            self.recorder.bus.publish("recording_stopped", was)
        return was is not None

    def status(self) -> dict:
        last = self.query.lastProgress if self.query else None
        return {"recording": self.recorder.run is not None, "filename": self.recorder.run, "pipeline_running": bool(self.query and self.query.isActive), "rows_per_second": (last or {}).get("processedRowsPerSecond", 0.0) if isinstance(last, dict) else getattr(last, "processedRowsPerSecond", 0.0)}

    def handle(self, request: dict) -> dict:
        cmd = request.get("cmd")
        if cmd == "ping":
            return {"status": "pong"}
        if cmd == "status":
            return {"status": "ok", **self.status()}
        if cmd == "stop_record":
            self.stop_record()
            return {"status": "ok", "recording": False}
        if cmd == "start_record":
            if not request.get("filename"):
                return {"status": "error", "message": "filename required"}
            done = self.start_record(request["filename"], request.get("output_dir"), **{k: v for k, v in request.items() if k.startswith("save_")})
            if not done:
                return {"status": "error", "message": "save_raw: the landing folder is the raw record"}
            return {"status": "ok", "recording": done, "filename": request["filename"]}
        return {"status": "error", "message": f"Unknown command: {cmd!r}"}

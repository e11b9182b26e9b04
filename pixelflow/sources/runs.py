"""A run's folder: discovery, metadata, events, pixels, triggers, status and lookups."""

from __future__ import annotations

import glob
import json
import re
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelflow import schemas as S
from pixelflow.operators import aggregate
from pixelflow.operators.filters import triggers_of
from pixelflow.sources import packed


def stem(file_name: str) -> str:
    """Name of the run that a saver's file belongs to."""
    return re.sub(r"(_saver\d+)?_events\.dat$", "", file_name)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """``key,correction`` lines; bad lines are dropped."""
    return spark.read.schema("tof double, correction double").option("mode", "DROPMALFORMED").csv(path).dropna()


class Run:
    """Lazy tables of one run: all that a folder holds, or what belongs to the run of one of its event files."""

    def __init__(self, spark: SparkSession, path: str, tdc_id: int = 1, edge: int = 0):
        packed.register(spark)
        self.spark, self.path = spark, Path(path)
        self.folder = self.path if self.path.is_dir() else self.path.parent
        self.name = self.folder.name if self.path.is_dir() else stem(self.path.name)
        meta = sorted(self.folder.glob("*_meta.json" if self.path.is_dir() else f"{glob.escape(self.name)}_meta.json"))
        self.meta = json.loads(meta[0].read_text()) if meta else {}
        self.tdc_id, self.edge = self.meta.get("tdc_id", tdc_id), self.meta.get("edge", edge)

    def rows(self, kind: str) -> DataFrame:
        """All rows of a kind, in no order."""
        files = self.spark.read.format("packed").option("kind", kind).option("recursive", "false")
        return (files if self.path.is_dir() else files.option("name", self.name)).load(str(self.folder))

    def table(self, kind: str, by: str) -> DataFrame:
        """All rows of a kind, in time order with the other fields as tie-breakers."""
        rows = self.rows(kind)
        return rows.orderBy(by, *(c for c in rows.columns if c != by))

    @property
    def events(self) -> DataFrame:
        return self.table("events", "t_trigger")

    @property
    def pixels(self) -> DataFrame:
        return self.table("pixels", "toa")

    @property
    def triggers(self) -> DataFrame:
        return self.table("triggers", "toa")

    @property
    def primary_triggers(self) -> DataFrame:
        """Channel 0 means any channel."""
        return triggers_of(self.triggers, self.tdc_id, self.edge)

    def events_for_shot(self, i: int) -> DataFrame:
        return aggregate.events_of_shots(self.events, i, i + 1)

    def events_in_range(self, start: int, stop: int) -> DataFrame:
        return aggregate.events_of_shots(self.events, start, stop)


def metadata(tdc_id: int, edge: int, window_ns: tuple[int, int], files: dict, centroiding: dict | None = None, workers: int = 4) -> dict:
    """What ``<name>_meta.json`` of a recording holds."""
    label = lambda codes, code: next(k for k, v in codes.items() if v == code)
    told = lambda kind: ",".join(f"{n}({c})" for n, c, _ in S.LAYOUTS[kind])
    return {
        "format_version": "2.0", "created": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "tdc_id": tdc_id, "tdc_label": label(S.CHANNELS, tdc_id), "edge": edge, "edge_label": label(S.EDGES, edge),
        "event_window_ns": list(window_ns), "num_workers": workers, "centroiding": {"enabled": False, "eps_space_px": 2, "eps_time_ns": 100.0, "b_size": 16} | (centroiding or {}),
        "files": {k: None for k in ("events", "triggers", "pixels", "raw")} | files, "event_dtype": told("events"), "trigger_dtype": told("triggers"),
    }


def write_metadata(folder: str, name: str, tdc_id: int, edge: int, window_ns: tuple[int, int], files: dict, centroiding: dict | None = None, workers: int = 4) -> dict:
    """``<name>_meta.json`` in a folder of the driver's file system."""
    meta = metadata(tdc_id, edge, window_ns, files, centroiding, workers)
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / f"{name}_meta.json").write_text(json.dumps(meta, indent=2))
    return meta


def listing(spark: SparkSession, root: str) -> DataFrame:
    """run, kind, size, mtime of every event and centroid file under ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    kind = F.when(F.col("path").endswith("_events.dat"), "events").when(F.col("path").endswith("_centroids.datbin"), "centroids")
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("run"), kind.alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).filter("kind is not null")


def labelled_run(events: DataFrame, eps: float, min_points: int, tof_max: float, corrections: DataFrame | None = None, scope: list[str] = (), huge: int | None = None) -> DataFrame:
    """Events up to ``tof_max`` with ``tof_c`` (corrected) and ``cluster`` by shot, -1 for noise. ``scope``: further columns
    that part shots, such as the file for parity with file-by-file processing. ``huge``: as ``cluster.density`` takes it."""
    from pixelflow.operators import cluster, correlate

    scope = list(scope)
    kept = events.filter(F.col("tof") <= tof_max)
    kept = correlate.interpolated(kept, corrections, "tot", "_c").withColumn("tof_c", F.col("tof") - F.col("_c")).drop("_c") if corrections is not None else kept.withColumn("tof_c", F.col("tof"))
    order = ["x", "y", "tof", "tot"]
    if not scope:
        return cluster.density(kept, eps, min_points, "t_trigger", order, huge)
    shots = kept.withColumn("_shot", F.xxhash64("t_trigger", *scope))
    return cluster.density(shots, eps, min_points, "_shot", ["t_trigger", *scope, *order], huge).drop("_shot")


def centroid_run(events: DataFrame, triggers: DataFrame, eps: float, min_points: int, tof_max: float, corrections: DataFrame | None = None, huge: int | None = None) -> DataFrame:
    """Merged centroids of a run: filter, correct, cluster by shot, weigh, and place among the triggers.

    Shots keep their absolute times, so shot_index is the position of the trigger that the hits belong to."""
    return centroids_of(labelled_run(events, eps, min_points, tof_max, corrections, huge=huge), triggers)


def centroids_of(labelled: DataFrame, triggers: DataFrame) -> DataFrame:
    """``centroid_run`` of what ``labelled_run`` gives."""
    from pixelflow.operators import correlate

    labelled = labelled.filter("cluster >= 0")
    means = aggregate.weighted_centroids(labelled, ["t_trigger", "cluster"], "tof_c").drop("cluster")
    return correlate.shot_index(means, triggers).orderBy("shot_index", "x", "y")

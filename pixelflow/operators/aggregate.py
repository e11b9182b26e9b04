"""Centroids, run summaries and shot lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelflow.functions.ordering import with_index


def weighted_centroids(labelled: DataFrame, keys: list[str], tof: str = "tof") -> DataFrame:
    """Tot-weighted means of x, y and tof, and the largest tot, of each cluster; NaN where the weights are 0."""
    total = F.sum("tot").cast("double")
    mean = lambda c: F.when(total == 0, F.lit(float("nan"))).otherwise(F.sum(F.col(c).cast("double") * F.col("tot")) / F.nullif(total, F.lit(0.0)))
    return labelled.groupBy(*keys).agg(mean("x").alias("x"), mean("y").alias("y"), mean(tof).alias("tof"), F.max("tot").alias("tot"))


def rebased(df: DataFrame, shot: str, scope: list[str]) -> DataFrame:
    """Shots counted from 1 at the scope's first."""
    first = df.groupBy(*scope).agg(F.min(shot).alias("_first"))
    return df.join(first, scope).withColumn(shot, F.col(shot) - F.col("_first") + 1).drop("_first")


def merged(*frames: DataFrame, by: str | None = None) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(by) if by else out


def indexed_shots(events: DataFrame, key: str = "t_trigger") -> DataFrame:
    """Distinct trigger times with at least one event, and their position."""
    return with_index(events.select(key).distinct(), key, [], "shot")


def events_of_shots(events: DataFrame, start: int, stop: int, key: str = "t_trigger") -> DataFrame:
    """Events of the shots start .. stop-1; none beyond the last."""
    wanted = indexed_shots(events, key).filter((F.col("shot") >= max(0, start)) & (F.col("shot") < stop))
    return events.join(wanted, key)


def absolute_times(events: DataFrame) -> DataFrame:
    return events.withColumn("t_abs", F.col("t_trigger") + F.col("tof"))


def run_summary(events: DataFrame, triggers: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and duration of each run: from its first and last trigger, else from its events' trigger times, else null."""
    e = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), (F.max("t_trigger") - F.min("t_trigger")).alias("_de"))
    t = triggers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_triggers"), (F.max("toa") - F.min("toa")).alias("_dt"))
    return e.join(t, keys, "full").select(*keys, F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_triggers", F.lit(0)).alias("n_triggers"), F.coalesce("_dt", "_de").alias("duration"))


def run_status(files: DataFrame, keys: list[str]) -> DataFrame:
    """EMPTY, READY, STALE or DONE, with file count, centroid count and newest time. ``files``: kind (events or centroids), size, mtime."""
    e, c = F.col("kind") == "events", (F.col("kind") == "centroids") & (F.col("size") > 0)
    g = files.groupBy(*keys).agg(F.count_if(e).alias("n_files"), F.max(F.when(e, F.col("mtime"))).alias("newest"), F.max(F.when(c, F.col("mtime"))).alias("made"), F.coalesce(F.sum(F.when(c, F.floor(F.col("size") / 48))), F.lit(0)).alias("n_centroids"))
    status = F.when(F.col("n_files") == 0, "EMPTY").when(F.col("made").isNull(), "READY").when(F.col("made") < F.col("newest"), "STALE").otherwise("DONE")
    return g.select(*keys, status.alias("status"), "n_files", "n_centroids", F.coalesce("newest", "made").alias("newest"))

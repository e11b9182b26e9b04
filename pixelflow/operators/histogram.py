"""Images, spectra, regions of interest and rates. Counts are partial sums in the map stage, then one small exchange."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelflow.functions.ordering import with_index
from pixelflow.functions.packets import clip

Roi = namedtuple("Roi", "name low high")


def image(hits: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts by pixel, coordinates clipped to the sensor."""
    return hits.groupBy(*keys, clip(F.col("x")).alias("x"), clip(F.col("y")).alias("y")).agg(F.count(F.lit(1)).alias("count"))


def bin_of(v: Column, low: int, high: int, bins: int) -> Column:
    """Bin number: half-open, the last one closed; null outside."""
    at = F.floor((v - low) * bins / (high - low)).cast("int")
    return F.when(v == high, bins - 1).when((v >= low) & (v < high), at)


def spectrum(hits: DataFrame, col: str, low: int, high: int, bins: int) -> DataFrame:
    """bin, lo, hi, center, count of every bin that has hits."""
    width = (high - low) / bins
    b = F.col("bin")
    got = hits.select(bin_of(F.col(col), low, high, bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return got.select("bin", (b * width + low).alias("lo"), ((b + 1) * width + low).alias("hi"), ((b + 0.5) * width + low).alias("center"), "count")


def _in(rois: list[Roi], col: str) -> Column:
    """Names of the regions that hold the value; the list is a parameter, so it is part of the expression."""
    hit = [F.when(F.col(col).between(r.low, r.high), F.lit(r.name)) for r in rois]
    return F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull()))


def roi_images(hits: DataFrame, rois: list[Roi], col: str = "tof") -> DataFrame:
    return image(hits.withColumn("roi", _in(rois, col)), ["roi"])


def roi_counts(hits: DataFrame, rois: list[Roi], col: str = "tof") -> DataFrame:
    """Count and share of each region, in one pass; the share is null without hits."""
    sums = hits.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(col).between(r.low, r.high)).alias(f"_{k}") for k, r in enumerate(rois)))
    rows = F.explode(F.array(*(F.struct(F.lit(r.name).alias("roi"), F.col(f"_{k}").alias("count")) for k, r in enumerate(rois))))
    return sums.select("total", rows.alias("r")).select("r.roi", "r.count", "total", F.try_divide(F.col("r.count") * 100.0, F.col("total")).alias("yield_pct"))


class Rois:
    """Regions by name, as they are defined over time: each counts from its definition or last change on (``since``, a time
    of the data), as a live accumulator does; with ``since`` None all data count."""

    def __init__(self):
        self.regions: dict[str, tuple] = {}

    def add(self, name: str, low, high, since=None) -> None:
        if name in self.regions:
            raise ValueError(f"there is a region {name!r}")
        self.regions[name] = (low, high, since)

    def update(self, name: str, low, high, since=None) -> None:
        if name not in self.regions:
            raise KeyError(name)
        self.regions[name] = (low, high, since)

    def remove(self, name: str) -> None:
        self.regions.pop(name, None)

    def rename(self, old: str, new: str) -> None:
        """The region keeps its place, bounds and counts."""
        if new != old and new in self.regions:
            raise ValueError(f"there is a region {new!r}")
        self.regions = {new if k == old else k: v for k, v in self.regions.items()}

    def names(self) -> list[str]:
        return list(self.regions)

    def range_of(self, name: str) -> tuple:
        return self.regions[name][:2]

    def set_only(self, low, high, since=None) -> None:
        """The one unnamed region of older clients."""
        self.regions = {"ROI": (low, high, since)}

    def clear(self) -> None:
        self.regions = {}

    def __bool__(self) -> bool:
        return bool(self.regions)

    def holds(self, name: str, col: str, time: str) -> Column:
        low, high, since = self.regions[name]
        inside = F.col(col).between(low, high)
        return inside if since is None else inside & (F.col(time) >= since)

    def counts(self, hits: DataFrame, col: str = "tof", time: str = "toa") -> DataFrame:
        """roi, count, low and high of every region, in their order of definition."""
        sums = hits.agg(*(F.count_if(self.holds(k, col, time)).alias(f"_{i}") for i, k in enumerate(self.regions)))
        rows = F.array(*(F.struct(F.lit(k).alias("roi"), F.col(f"_{i}").alias("count"), F.lit(v[0]).cast("long").alias("low"), F.lit(v[1]).cast("long").alias("high")) for i, (k, v) in enumerate(self.regions.items())))
        return sums.select(F.inline(rows))

    def images(self, hits: DataFrame, col: str = "tof", time: str = "toa") -> DataFrame:
        hit = F.array(*(F.when(self.holds(k, col, time), F.lit(k)) for k in self.regions))
        return image(hits.withColumn("roi", F.explode(F.filter(hit, lambda x: x.isNotNull()))), ["roi"])


def cleared_images(hits: DataFrame, every: int, time: str = "toa") -> DataFrame:
    """Images of an accumulator that is cleared at whole multiples of ``every``: ``period``, x, y, count."""
    return image(hits.withColumn("period", F.floor(F.col(time) / every)), ["period"])


def since(hits: DataFrame, cleared, time: str = "toa") -> DataFrame:
    """What counts after an accumulator was cleared by hand at ``cleared``."""
    return hits.filter(F.col(time) >= cleared)


def coalesced(batches: DataFrame, period: int, sent: str = "toa", sizes: list[str] = ()) -> DataFrame:
    """Batches joined to at most one update a ``period``: its first sending time, number of batches and summed sizes."""
    by = batches.groupBy(F.floor(F.col(sent) / period).alias("update"))
    return by.agg(F.min(sent).alias("t_sent"), F.count(F.lit(1)).alias("n_batches"), *(F.sum(c).alias(c) for c in sizes))


def diagnostics(chunks: DataFrame, n: int, order: str, sums: list[str]) -> DataFrame:
    """Sums and counts over every ``n`` consecutive chunks, the last ones perhaps fewer. ``chunks``: one row for each."""
    placed = with_index(chunks, order, []).withColumn("block", F.floor(F.col("index") / n))
    return placed.groupBy("block").agg(F.count(F.lit(1)).alias("n_chunks"), *(F.sum(c).alias(c) for c in sums))


def stats(events: DataFrame, pixels: DataFrame, rois: list[Roi] = (), col: str = "tof") -> DataFrame:
    """Totals of both streams, and each region's count as ``roi_<name>``: one row."""
    e = events.agg(F.count(F.lit(1)).alias("total_events"), *(F.count_if(F.col(col).between(r.low, r.high)).alias(f"roi_{r.name}") for r in rois))
    p = pixels.agg(F.count(F.lit(1)).alias("total_pixels"), F.coalesce(F.sum("tot"), F.lit(0)).alias("pixel_sum"))
    return e.join(F.broadcast(p), F.lit(True))  # one row each


def rates(events: DataFrame, tick: int, rois: list[Roi] = (), per: str = "shot", time: str = "t_trigger", unit: int = 1_000_000) -> DataFrame:
    """tick, series and rate: events of the tick over its new triggers, or the count itself where there are none.

    ``per='shot'``: triggers are the tick's distinct trigger times. ``per='compat'``: they are the growth of the running
    largest whole second of trigger time (``unit`` to the second)."""
    at = F.floor(F.col(time) / tick).alias("tick")
    counts = [F.count(F.lit(1)).alias("n_total"), *(F.count_if(F.col("tof").between(r.low, r.high)).alias(f"n_{k}") for k, r in enumerate(rois))]
    shots = F.countDistinct(time) if per == "shot" else F.max(F.floor(F.col(time) / unit))
    by = events.groupBy(at).agg(*counts, shots.alias("shots"))
    if per != "shot":
        w = Window.orderBy("tick")  # a row a tick
        top = F.max("shots").over(w.rowsBetween(Window.unboundedPreceding, 0))
        by = by.withColumn("shots", top).withColumn("shots", F.col("shots") - F.lag("shots", 1, 0).over(w))
    rate = lambda c: F.when(F.coalesce(F.col("shots"), F.lit(0)) <= 0, F.col(c).cast("double")).otherwise(F.col(c) / F.col("shots"))
    series = F.explode(F.array(F.struct(F.lit("total").alias("series"), rate("n_total").alias("rate")), *(F.struct(F.lit(r.name).alias("series"), rate(f"n_{k}").alias("rate")) for k, r in enumerate(rois))))
    return by.select("tick", series.alias("s")).select("tick", "s.series", "s.rate")


def last_n(series: DataFrame, n: int, key: str = "series", order: str = "tick") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return series.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")

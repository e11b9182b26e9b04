"""Packets to pixel hits and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelflow import schemas as S
from pixelflow.functions import packets as P


def classify(packets: DataFrame) -> DataFrame:
    return packets.withColumn("kind", P.kind(F.col("packet"))).withColumn("sub", P.subheader(F.col("packet")))


def pixels(packets: DataFrame, keep: list[str] = ()) -> DataFrame:
    """x, y, toa_ticks (pixel ticks), tot of every pixel packet. ``packets``: packet, min_ts."""
    p, m = F.col("packet"), F.col("min_ts")
    rows = packets.filter(P.kind(p) == "pixel")
    return rows.select(*keep, P.pixel_x(p).alias("x"), P.pixel_y(p).alias("y"), P.extend(P.pixel_time(p), m, 34).alias("toa_ticks"), P.pixel_tot(p).alias("tot"))


def triggers(packets: DataFrame, keep: list[str] = ()) -> DataFrame:
    """ticks (sixths of a pixel tick), tdc_id, edge of every trigger packet."""
    p, m = F.col("packet"), F.col("min_ts")
    rows = packets.filter(P.kind(p) == "trigger")
    return rows.select(*keep, P.trigger_ticks(p, m).alias("ticks"), P.trigger_channel(P.subheader(p)).alias("tdc_id"), P.trigger_edge(P.subheader(p)).alias("edge"))


def pixel_seconds(df: DataFrame, ticks: str = "toa_ticks", out: str = "toa") -> DataFrame:
    return df.withColumn(out, F.col(ticks) * F.lit(S.PIXEL_TICK_S))


def trigger_seconds(df: DataFrame, ticks: str = "ticks", out: str = "toa", clock: str = "compat") -> DataFrame:
    """``compat``: the truncated constant; ``exact``: a sixth of the pixel tick."""
    return df.withColumn(out, F.col(ticks) * F.lit(S.TRIGGER_TICK_S if clock == "compat" else S.PIXEL_TICK_S / 6))


def decode(packets: DataFrame, clock: str = "compat") -> tuple[DataFrame, DataFrame]:
    """(pixels, triggers) in seconds."""
    return pixel_seconds(pixels(packets)), trigger_seconds(triggers(packets), clock=clock)


def time_range(frames: DataFrame) -> DataFrame:
    """Smallest and largest frame time, (0, 0) without frames."""
    return frames.agg(F.coalesce(F.min("min_ts"), F.lit(0)).alias("min_ts"), F.coalesce(F.max("max_ts"), F.lit(0)).alias("max_ts"))

"""Predicates and subsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelflow.functions.packets import clip


def triggers_of(triggers: DataFrame, tdc_id: int, edge: int) -> DataFrame:
    """One channel (0: any) and edge."""
    return triggers.filter(((F.col("tdc_id") == tdc_id) | F.lit(tdc_id == 0)) & (F.col("edge") == edge))


def within(v: Column, low, high) -> Column:
    """Inclusive at both ends."""
    return v.between(low, high)


def at_most(df: DataFrame, threshold, col: str = "tof") -> DataFrame:
    return df.filter(F.col(col) <= threshold)


def without_noise(labels: DataFrame) -> DataFrame:
    return labels.filter("label != -1")


def clipped(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": clip(F.col("x")), "y": clip(F.col("y"))})


def shown(events: DataFrame, pixels: DataFrame, mode: str) -> DataFrame:
    """The stream that a display shows: ``events`` or ``pixels``."""
    if mode not in ("events", "pixels"):
        raise ValueError(f"unknown display mode {mode!r}")
    return events if mode == "events" else pixels


def stride(fraction: float) -> int:
    return max(1, round(1 / min(1.0, max(0.01, fraction))))


def every_nth(df: DataFrame, fraction: float, order: list[str], batch: list[str]) -> DataFrame:
    """Every stride-th row of each batch, in order, from the first."""
    w = Window.partitionBy(*batch).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") % stride(fraction) == 0).drop("_n")

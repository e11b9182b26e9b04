"""Record layouts, codes and constants of the detector's data (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

PIXEL_TICK_S = 1.5625e-9
TRIGGER_TICK_S = 260.41666e-12  # as used for parity; the exact value is PIXEL_TICK_S / 6
TICKS_PER_PIXEL_TICK = 6
TOT_STEP_NS = 25
SENSOR = 256
FRAME_SIGNATURE = 0x33585054
CHANNELS = {"BOTH": 0, "TDC1": 1, "TDC2": 2}
EDGES = {"RISING": 0, "FALLING": 1}
#: sub-header of a trigger packet: (channel, edge); any other is (0, 0)
TRIGGER_KINDS = {0xF: (1, 0), 0xA: (1, 1), 0xE: (2, 0), 0xB: (2, 1)}

#: Packed little-endian records without header: (field, struct code, Spark type).
LAYOUTS = {
    "events": [("t_trigger", "f8", T.DoubleType()), ("x", "u2", T.IntegerType()), ("y", "u2", T.IntegerType()), ("tof", "f8", T.DoubleType()), ("tot", "u4", T.LongType())],
    "pixels": [("x", "u2", T.IntegerType()), ("y", "u2", T.IntegerType()), ("toa", "f8", T.DoubleType()), ("tot", "u4", T.LongType())],
    "triggers": [("toa", "f8", T.DoubleType()), ("tdc_id", "u1", T.ShortType()), ("edge", "u1", T.ShortType())],
    "centroids": [(c, "f8", T.DoubleType()) for c in ("t_trigger", "x", "y", "tof", "tot")],
    "merged": [("shot_index", "u8", T.LongType())] + [(c, "f8", T.DoubleType()) for c in ("t_trigger", "x", "y", "tof", "tot")],
    "tofbin": [(c, "f8", T.DoubleType()) for c in ("shot", "x", "y", "tof", "tot")],
    "labels": [(c, "f8", T.DoubleType()) for c in ("shot", "x", "y", "tof", "tot", "label")],
}
SUFFIXES = {"events": "_events.dat", "pixels": "_pixels.dat", "triggers": "_triggers.trg"}


def schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, _, t in LAYOUTS[kind]])


def channel(label: str) -> int:
    """Code of a channel's label; ValueError if there is none."""
    if label not in CHANNELS:
        raise ValueError(f"unknown channel {label!r}")
    return CHANNELS[label]

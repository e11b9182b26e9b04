"""Column expressions over 64-bit packets (as LONG bit patterns): shifts and masks only, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelflow import schemas as S


def bits(p: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(p, low).bitwiseAND(F.lit((1 << width) - 1))


def kind(p: Column) -> Column:
    """'pixel', 'trigger' or null."""
    header = bits(p, 60, 4)
    return F.when(header.isin(0xA, 0xB), "pixel").when(header == 6, "trigger")


def subheader(p: Column) -> Column:
    return bits(p, 56, 4)


def pixel_x(p: Column) -> Column:
    return (bits(p, 53, 7) * 2 + bits(p, 46, 1)).cast("int")


def pixel_y(p: Column) -> Column:
    return (bits(p, 47, 6) * 4 + bits(p, 44, 2)).cast("int")


def pixel_tot(p: Column) -> Column:
    return bits(p, 20, 10) * S.TOT_STEP_NS


def pixel_time(p: Column) -> Column:
    """Raw time before extension; negative where the fine part exceeds the rest."""
    return (bits(p, 0, 16) * 16384 + bits(p, 30, 14)) * 16 - bits(p, 16, 4)


def extend(t: Column, around: Column, width: int) -> Column:
    """The time closest to ``around`` whose low ``width`` bits are those of ``t`` (signed half range)."""
    full, mask = 1 << width, F.lit((1 << width) - 1)
    d = (t - around.bitwiseAND(mask)).bitwiseAND(mask)
    return around + F.when(d >= full // 2, d - full).otherwise(d)


def trigger_ticks(p: Column, around: Column) -> Column:
    """Trigger time in sixths of a pixel tick."""
    return extend(bits(p, 9, 35) * 2, around, 36) * S.TICKS_PER_PIXEL_TICK + bits(p, 5, 4) - 1


def _of_kind(sub: Column, part: int) -> Column:
    out = F.lit(0)
    for code, pair in S.TRIGGER_KINDS.items():
        out = F.when(sub == code, pair[part]).otherwise(out)
    return out.cast("short")


def trigger_channel(sub: Column) -> Column:
    return _of_kind(sub, 0)


def trigger_edge(sub: Column) -> Column:
    return _of_kind(sub, 1)


def clip(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(S.SENSOR - 1), v))


def pixel_word(header: Column, dcol: Column, spix: Column, pix: Column, coarse: Column, tot10: Column, ftoa: Column, spidr: Column) -> Column:
    """The inverse, for tests and made-up streams."""
    out = F.shiftleft(header.cast("long"), 60)
    for v, at in ((dcol, 53), (spix, 47), (pix, 44), (coarse, 30), (tot10, 20), (ftoa, 16), (spidr, 0)):
        out = out.bitwiseOR(F.shiftleft(v.cast("long"), at))
    return out


def trigger_word(sub: Column, coarse35: Column, fine: Column) -> Column:
    out = F.shiftleft(F.lit(6).cast("long"), 60)
    for v, at in ((sub, 56), (coarse35, 9), (fine, 5)):
        out = out.bitwiseOR(F.shiftleft(v.cast("long"), at))
    return out

"""Hits to their preceding triggers, and lookups by position or range.

The as-of join is a range join on buckets: each trigger's interval, cut to the event window, is listed under the time
buckets that it touches; hits join on their own bucket. No side is broadcast and hits are never sorted. A bucket is as
wide as the window, so an interval touches few of them."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelflow.functions.ordering import bounds_of, with_index, with_next


def _joined(hits: DataFrame, spans: DataFrame, low: int, high: int, scope: list[str], toa: str) -> DataFrame:
    """Hits within [first, last] of a span, by buckets."""
    width = max(1, high - low + 1)
    buckets = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width)))
    spans = spans.filter("first <= last").withColumn("_bucket", buckets).withColumnsRenamed({c: f"_s_{c}" for c in scope})
    on = (F.floor(F.col(toa) / width) == F.col("_bucket")) & F.col(toa).between(F.col("first"), F.col("last"))
    for c in scope:
        on = on & (F.col(c) == F.col(f"_s_{c}"))
    return hits.join(spans, on).drop("_bucket", "first", "last", *(f"_s_{c}" for c in scope))


def live(hits: DataFrame, triggers: DataFrame, low: int, high: int, toa: str = "toa", scope: list[str] = ()) -> DataFrame:
    """Hits with t_trigger and tof, if low <= tof <= high; hits after the last trigger go. Integer times in one unit.

    ``scope``: columns within which triggers count, such as the buffer for parity with buffered processing."""
    scope = list(scope)
    given = triggers.select(*scope, F.col(toa).alias("t_trigger"))
    spans = with_next(given.distinct(), "t_trigger", "next", scope, bounds_of(given, "t_trigger")).filter("next is not null")
    spans = spans.select(*scope, "t_trigger", (F.col("t_trigger") + low).alias("first"), F.least(F.col("next") - 1, F.col("t_trigger") + high).alias("last"))
    return _joined(hits, spans.withColumn("first", F.greatest("first", "t_trigger")), low, high, scope, toa).withColumn("tof", F.col(toa) - F.col("t_trigger"))


def offline(hits: DataFrame, triggers: DataFrame, low: int, high: int, toa: str = "toa", scope: list[str] = ()) -> DataFrame:
    """Hits with event_num, the position of their trigger in time order (the last of equal ones), and tof. The last trigger
    counts too; fewer than two triggers give nothing."""
    scope = list(scope)
    given = triggers.select(*scope, F.col(toa).alias("t_trigger"))
    bounds = bounds_of(given, "t_trigger")
    placed = with_index(given, "t_trigger", [], "event_num", scope, bounds)
    times = placed.groupBy(*scope, "t_trigger").agg(F.max("event_num").alias("event_num"))
    enough = placed.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")
    times = times.join(enough, scope, "left_semi") if scope else times.join(F.broadcast(enough), F.lit(True), "left_semi")
    spans = with_next(times, "t_trigger", "next", scope, bounds)
    end = F.col("t_trigger") + high
    spans = spans.select(*scope, "t_trigger", "event_num", F.greatest(F.col("t_trigger") + low, F.col("t_trigger")).alias("first"), F.least(F.coalesce(F.col("next") - 1, end), end).alias("last"))
    return _joined(hits, spans, low, high, scope, toa).withColumn("tof", F.col(toa) - F.col("t_trigger"))


def shot_index(rows: DataFrame, triggers: DataFrame, toa: str = "toa", key: str = "t_trigger") -> DataFrame:
    """``rows`` with the position of their trigger time among all triggers; the first of equal ones."""
    placed = with_index(triggers.select(F.col(toa).alias("_t")), "_t", [], "shot_index").groupBy("_t").agg(F.min("shot_index").alias("shot_index"))
    return rows.join(placed, F.col(key) == F.col("_t"), "left").drop("_t")


def interpolated(rows: DataFrame, knots: DataFrame, x: str, out: str, key: str = "tof", value: str = "correction") -> DataFrame:
    """Piecewise-linear lookup, clamped at both ends. ``knots`` is a correction table: 2 to MAX_KNOTS rows, which become
    literals of the expression, so each row costs one binary search and no join. Of equal keys the smallest value counts;
    null gives null, NaN the last value."""
    n = knots.limit(MAX_KNOTS + 1).count()
    if not 2 <= n <= MAX_KNOTS:
        raise ValueError(f"a correction table has 2 to {MAX_KNOTS} rows")
    table = knots.groupBy(F.col(key).cast("double").alias("a")).agg(F.min(F.col(value).cast("double")).alias("fa")).orderBy("a").collect()
    at, got = [r["a"] for r in table], [r["fa"] for r in table]
    slope = [(g - f) / (b - a) for a, b, f, g in zip(at, at[1:], got, got[1:])]
    v = F.col(x).cast("double")
    deal = Bucketizer(splits=[-float("inf"), *at, float("inf")], inputCol="_v", outputCol="_k", handleInvalid="keep")
    placed = deal.transform(rows.withColumn("_v", v)).withColumn("_k", F.col("_k").cast("int") - 1)
    of = lambda values: F.get(F.lit(values), F.col("_k"))
    line = of(got) + (F.col("_v") - of(at)) * of([*slope, 0.0])
    end = F.when(F.col("_k") < 0, F.lit(got[0])).when(F.col("_k") >= len(at) - 1, F.lit(got[-1])).otherwise(line)
    return placed.withColumn(out, F.when(F.col("_v").isNull(), F.lit(None)).otherwise(end)).drop("_v", "_k")


MAX_KNOTS = 10_000

"""Positions and neighbours in a global order without a global sort in one task.

Values are dealt into at most SPANS spans of the key, between its approximate quantiles (mergeable sketches, a pass over the
key alone), so spans hold like numbers of rows wherever the key's values lie; a window works within a span (and scope),
and one row for each span carries counts or first values across. The spans' tables have at most SPANS rows a scope. Only
rows that share one key stay together, sorted in one task, with spill. Null keys are a span of their own, the last."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPANS = 512


#: Bounds by session, plan and key, the last KNOWN of them. They only balance the spans, so bounds of a table that has changed since
#: are still right.
KNOWN = 64
_known: OrderedDict = OrderedDict()


def bounds_of(df: DataFrame, key: str) -> list[float]:
    """Where spans of the key end: a pass over the key, unless the same plan's bounds are known."""
    keys = df.select(F.col(key).cast("double").alias("_k")).filter("_k is not null and not isnan(_k)")
    plan = (df.sparkSession.sparkContext.applicationId, keys.semanticHash())
    if plan not in _known:
        found = keys.approxQuantile("_k", [k / SPANS for k in range(1, SPANS)], 0.5 / SPANS)
        _known[plan] = sorted({b for b in found if abs(b) != float("inf")})
        while len(_known) > KNOWN:
            _known.popitem(last=False)
    _known.move_to_end(plan)
    return _known[plan]


def spanned(df: DataFrame, key: str, scope: list[str], bounds: list[float] | None = None) -> DataFrame:
    """``df`` with ``_span``, which never falls as the key grows; the same spans serve all scopes. ``bounds``: those of a table
    with much the same keys."""
    inner = bounds_of(df, key) if bounds is None else bounds
    if not inner:
        return df.withColumn("_span", F.lit(0))
    deal = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_k", outputCol="_s", handleInvalid="keep")
    return deal.transform(df.withColumn("_k", F.col(key).cast("double"))).withColumn("_span", F.col("_s").cast("int")).drop("_k", "_s")


def _with_span_table(df: DataFrame, table: DataFrame, scope: list[str], cols: list[str]) -> DataFrame:
    table = table.withColumnsRenamed({c: f"_t_{c}" for c in [*scope, "_span"]})
    on = F.col("_span") == F.col("_t__span")
    for c in scope:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    side = table.select(*(f"_t_{c}" for c in [*scope, "_span"]), *cols)
    return df.join(side if scope else F.broadcast(side), on, "left").drop(*(f"_t_{c}" for c in [*scope, "_span"]))


def with_next(df: DataFrame, key: str, out: str = "next", scope: list[str] = (), bounds: list[float] | None = None) -> DataFrame:
    """The next larger row's key, null for the last; ``df`` should hold each key once."""
    scope = list(scope)
    df = spanned(df, key, scope, bounds)
    first = df.groupBy(*scope, "_span").agg(F.min(key).alias("_first"))
    first = first.withColumn("_after", F.lead("_first").over(Window.partitionBy(*scope).orderBy("_span")))
    df = df.withColumn("_in", F.lead(key).over(Window.partitionBy(*scope, "_span").orderBy(key)))
    return _with_span_table(df, first, scope, ["_after"]).withColumn(out, F.coalesce("_in", "_after")).drop("_in", "_after", "_span")


def with_index(df: DataFrame, key: str, ties: list[str], out: str = "index", scope: list[str] = (), bounds: list[float] | None = None) -> DataFrame:
    """Position from 0 in the order of ``key``, then ``ties``."""
    scope = list(scope)
    df = spanned(df, key, scope, bounds)
    sizes = df.groupBy(*scope, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*scope).orderBy("_span")) - F.col("_n")
    sizes = sizes.withColumn("_before", before)
    df = df.withColumn("_in", F.row_number().over(Window.partitionBy(*scope, "_span").orderBy(key, *ties)))
    return _with_span_table(df, sizes, scope, ["_before"]).withColumn(out, (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_in", "_before", "_span")

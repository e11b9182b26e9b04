"""Density clusters of shots that are too large for one task: tiles with halos, joined by their shared points.

Points at one place count once, with a weight. A shot's grid cells (SIDE eps wide) are dealt into boxes of about ``limit`` points
by counts along z, then y, then x; a box also gets the cells that touch its own, so it sees all that its points are near to. A
task clusters one box, of less than three ``limit`` and a cell, and names each cluster after its least point (by x, y, z). A point that two boxes tell of links the
names that they give it; these links are joined by stars that alternate between greater and smaller neighbours, in rounds
that grow with the logarithm of a cluster's boxes. A task holds its box and the cells around it, however
large the shot; no links pass the driver, and every round is a written table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelflow.functions.ordering import with_index
from pixelflow.sources import store

SIDE = 16  # eps
LIMIT = 50_000  # places that a box is filled up with
AT = ["_x", "_y", "_z"]
CELL = ["_cx", "_cy", "_cz"]


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxes(cells: DataFrame, limit: int) -> DataFrame:
    """``cells`` (_shot, the cell's numbers, _n) with ``_box``: runs of planes, of rows in these, and of cells in those, that start
    anew whenever they hold ``limit`` places."""
    keys = ["_shot"]
    for c in reversed(CELL):
        part = f"_b{c}"
        sums = cells.groupBy(*keys, c).agg(F.sum("_n").alias("_t"))
        before = F.sum("_t").over(Window.partitionBy(*keys).orderBy(c)) - F.col("_t")
        cells = cells.join(sums.withColumn(part, F.floor(before / limit)).drop("_t"), [*keys, c])
        keys.append(part)
    return cells.select("_shot", *CELL, F.concat_ws(":", *keys).alias("_box"))


def components(links: DataFrame, folder: str) -> DataFrame:
    """``links`` (_shot, u, v) to (_shot, u, v): each u that isn't the least of its component, and that least as v."""
    both = lambda e: e.unionByName(e.select("_shot", F.col("v").alias("u"), F.col("u").alias("v")))
    down = links.filter("u != v").select("_shot", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, k = _written(down, f"{folder}/round=0"), 0
    while True:
        # Greater neighbours of each node, and then each node and its smaller neighbours, are tied to the least that it sees.
        all_ = both(now)
        least = all_.groupBy("_shot", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = all_.join(least, ["_shot", "u"]).filter("v > u").select("_shot", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("_shot", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["_shot", "u"]).filter("v != m").select("_shot", F.col("v").alias("u"), F.col("m").alias("v"))
        k += 1
        now = _written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"{folder}/round={k}")
        store.remove(now.sparkSession, f"{folder}/round={k - 1}")
        ends = now.select("_shot", F.col("v").alias("u")).distinct()
        if now.groupBy("_shot", "u").count().filter("count > 1").isEmpty() and now.join(ends, ["_shot", "u"], "left_semi").isEmpty():
            return now


def clustered(points: DataFrame, z: str, eps: float, min_points: int, shot: str, order: list[str], limit: int = LIMIT) -> DataFrame:
    """``points`` with ``cluster`` as ``cluster.density`` gives it, for shots of any size; ``z``: the third place, as SQL. No null shots. Points that
    lack a place are noise."""
    from pixelflow.operators.cluster import _near, _roots

    folder = store.scratch(points.sparkSession)
    where = [F.col("x").cast("double"), F.col("y").cast("double"), F.expr(z)]
    rows = _written(points.select("*", *(F.when(~F.isnan(w), w + F.lit(0.0)).alias(a) for a, w in zip(AT, where))), f"{folder}/rows")
    places = rows.dropna(subset=AT).groupBy(F.col(shot).alias("_shot"), *AT).agg(F.count(F.lit(1)).alias("_n"))
    places = places.select("*", *(F.floor(F.col(a) / (SIDE * eps)).cast("long").alias(c) for a, c in zip(AT, CELL)))
    places = _written(places, f"{folder}/places")
    dealt = _written(boxes(places.groupBy("_shot", *CELL).agg(F.count(F.lit(1)).alias("_n")), limit), f"{folder}/boxes")
    around = dealt.withColumn("_own", F.lit(0))
    for c in CELL:
        around = around.withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("_d")).withColumn("_own", F.col("_own") + F.abs("_d")).drop("_d")
    around = around.groupBy("_shot", *CELL, "_box").agg((F.min("_own") == 0).alias("_own"))

    def box(t: pa.Table) -> pa.Table:
        xyz = np.column_stack([t.column(a).to_numpy() for a in AT])
        turn = np.lexsort(xyz.T[::-1])
        t, xyz = t.take(pa.array(turn)), xyz[turn]
        n, own = t.column("_n").to_numpy(), t.column("_own").to_numpy(zero_copy_only=False)
        i, j = _near(xyz, eps)
        core = n - 1 + np.bincount(i, n[j], len(n)) + np.bincount(j, n[i], len(n)) >= min_points
        linked = core[i] & core[j] & (own[i] | own[j])
        i, j = i[linked], j[linked]
        told = own & core
        told[i] = told[j] = True
        root = _roots(len(n), i, j)[told]
        out = t.filter(pa.array(told)).select(["_shot", *AT])
        for a, v in zip("abc", xyz[root].T):
            out = out.append_column(a, pa.array(v))
        return out

    kind = points.schema[shot].dataType.simpleString()
    told = places.join(around, ["_shot", *CELL]).select("_box", "_shot", *AT, "_n", "_own")
    told = told.groupBy("_box").applyInArrow(box, f"_shot {kind}, _x double, _y double, _z double, a double, b double, c double")
    names = F.collect_set(F.struct("a", "b", "c"))  # of the 27 boxes at most that see a point
    told = _written(told.groupBy("_shot", *AT).agg(names.alias("names")).withColumn("m", F.array_min("names")), f"{folder}/told")
    links = told.filter("size(names) > 1").select("_shot", F.explode("names").alias("u"), F.col("m").alias("v"))
    roots = components(links, f"{folder}/links").select("_shot", F.col("u").alias("m"), F.col("v").alias("_root"))
    core = told.join(roots, ["_shot", "m"], "left").select(F.col("_shot").alias(shot), *AT, F.coalesce("_root", "m").alias("_root"))
    out = _written(rows.join(core, [shot, *AT], "left"), f"{folder}/out")
    first = out.filter("_root is not null").groupBy(shot, "_root").agg(F.min(F.struct(*order)).alias("_first"))
    first = first.select(F.col(shot).alias("_shot"), F.col("_root").alias("_of"), *(F.col(f"_first.{c}").alias(f"_o{k}") for k, c in enumerate(order)))
    number = with_index(first, "_o0", [*(f"_o{k}" for k in range(1, len(order))), "_of"], "_number", ["_shot"]).select("_shot", "_of", "_number")
    out = out.join(number, (F.col(shot) == F.col("_shot")) & (F.col("_root") == F.col("_of")), "left")
    return out.select(*points.columns, F.coalesce("_number", F.lit(-1)).cast("long").alias("cluster"))

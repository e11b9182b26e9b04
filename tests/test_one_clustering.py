"""A run is clustered once, however many files are made of it, and small shots are clustered together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelflow.operators import cluster, huge_shots
from pixelflow.plans import queries as detector
from pixelflow.sources import processing, runs

SF = "/root/testdata/sf0.001"


def test_a_run_is_clustered_once(spark, monkeypatch):
    rows, of = spark.sparkContext.accumulator(0), runs.labelled_run

    def counted(*args, **options):
        found = of(*args, **options)

        def run(batches):
            for b in batches:
                rows.add(b.num_rows)
                yield b

        return found.mapInArrow(run, found.schema)

    monkeypatch.setattr(runs, "labelled_run", counted)
    folder = detector._run_folder(spark, SF)
    processing.process_run(spark, folder, 6.0, 1, 1.0, labels=True)
    assert rows.value == runs.Run(spark, folder).events.count() > 0


def test_shots_of_one_size_are_clustered_together(monkeypatch):
    rng = np.random.default_rng(1)
    size = np.append(rng.integers(1, 9, 400), [cluster.SMALL, cluster.SMALL + 1, 200])
    starts = np.cumsum(size) - size
    xyz = rng.integers(0, 20, (size.sum(), 3)).astype(float)
    xyz[::97, 2], xyz[::131] = np.nan, np.inf
    for points in range(4):
        want = np.concatenate([cluster._labels(part, 3.0, points) for part in np.split(xyz, starts[1:])])
        with monkeypatch.context() as m:
            calls, one = [], cluster._labels
            m.setattr(cluster, "_labels", lambda part, *rest: calls.append(len(part)) or one(part, *rest))
            assert (cluster._labels_of(xyz, starts, 3.0, points) == want).all()
        assert sorted(calls) == [cluster.SMALL + 1, 200]


def test_shots_are_not_counted_one_by_one_without_a_huge_group(spark, monkeypatch):
    points = spark.range(400).select((F.col("id") % 100).cast("double").alias("shot"), "id", (F.col("id") % 7).alias("x"), (F.col("id") % 5).alias("y"), F.lit(0.0).alias("tof"))
    points = points.withColumn("shot", F.when((F.col("shot") == 0) & (F.col("id") > 150), F.lit(-0.0)).otherwise(F.col("shot")))
    calls, written = [], huge_shots._written
    monkeypatch.setattr(huge_shots, "_written", lambda *a: calls.append(a[1]) or written(*a))
    assert cluster.density(points, 2.0, 1, order=["id"], huge=4).count() == 400 and not calls
    assert not cluster._none_over(points, "shot", 3)  # 0.0 and -0.0 are one shot


@pytest.mark.parametrize("huge", [1000, 3])
def test_labels_in_order_are_those_of_numbered(spark, huge):
    rng, rows = np.random.default_rng(2), []
    for shot in rng.permutation(700):
        n = int(rng.integers(0, 4))  # clusters; some shots are noise only
        of = [*range(n), *rng.integers(-1, n, int(rng.integers(1, 6))).tolist()]
        rows += [(float(shot) / 8 if shot else float("nan"), c, int(x)) for c, x in zip(of, rng.integers(0, 3, len(of)))]
    clustered = spark.createDataFrame(rows, "t double, cluster long, x long").repartition(5)
    wanted = cluster.numbered(clustered, "t").orderBy("t", "label", "x").collect()
    found = cluster.numbered_in_order(clustered, "t", ["x"], huge)
    assert [repr(r) for r in found.collect()] == [repr(r) for r in wanted]
    assert cluster.numbered_in_order(clustered.limit(0), "t", ["x"], huge).collect() == []


def test_label_files_rows_are_shuffled_once_and_not_joined(spark):
    clustered = spark.range(1000).select((F.col("id") % 300).cast("double").alias("t"), (F.col("id") % 3 - 1).alias("cluster"), F.col("id").alias("x"))
    plan = cluster.numbered_in_order(clustered, "t", ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("BroadcastExchange ") + 1 and plan.count("Sort ") == 1 and "MergeJoin" not in plan

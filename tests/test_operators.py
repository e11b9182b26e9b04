import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelflow import schemas
from pixelflow.functions.ordering import with_index, with_next
from pixelflow.operators import aggregate, cluster, correlate, filters, histogram


def hits_of(spark, times):
    return spark.createDataFrame([(k, t) for k, t in enumerate(times)], "id long, toa long")


def times_of(spark, times):
    return spark.createDataFrame([(t,) for t in times], "toa long")


def brute(hits, triggers, low, high, last):
    triggers = sorted(triggers)
    out = []
    for k, t in enumerate(hits):
        i = int(np.searchsorted(triggers, t, side="right")) - 1
        if i >= 0 and (last or i < len(triggers) - 1) and len(triggers) > 1 and low <= t - triggers[i] <= high:
            out.append((k, i, t - triggers[i]))
    return out


def test_worked_example(spark):
    hits, triggers = hits_of(spark, [50, 100, 199, 200, 300, 350]), times_of(spark, [100, 200, 300])
    assert sorted((r.t_trigger, r.tof) for r in correlate.live(hits, triggers, 0, 50).collect()) == [(100, 0), (200, 0)]
    assert sorted((r.event_num, r.tof) for r in correlate.offline(hits, triggers, 0, 50).collect()) == [(0, 0), (1, 0), (2, 0), (2, 50)]


@pytest.mark.parametrize("seed", [1, 2])
def test_correlators_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    hits, triggers = [rng.randint(0, 3000) for _ in range(300)], [rng.randint(0, 3000) for _ in range(25)] + [2900, 2900]
    for low, high in ((0, 40), (5, 500)):
        got = correlate.live(hits_of(spark, hits), times_of(spark, triggers), low, high).collect()
        assert sorted((r.id, r.tof) for r in got) == sorted((k, tof) for k, _, tof in brute(hits, triggers, low, high, False))
        got = correlate.offline(hits_of(spark, hits), times_of(spark, triggers), low, high).collect()
        assert sorted((r.id, r.event_num, r.tof) for r in got) == sorted(brute(hits, triggers, low, high, True))


def test_one_trigger_gives_nothing(spark):
    hits, one = hits_of(spark, [5, 6]), times_of(spark, [1])
    assert correlate.live(hits, one, 0, 9).count() == correlate.offline(hits, one, 0, 9).count() == 0
    assert correlate.live(hits, one.limit(0), 0, 9).columns == ["id", "toa", "t_trigger", "tof"]


def test_order_helpers(spark):
    values = [random.Random(k).randint(-10**6, 10**6) for k in range(200)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v long, k long")
    assert [r.v for r in with_index(df, "v", ["k"]).orderBy("index").collect()] == sorted(values)
    distinct = sorted(set(values))
    got = dict(with_next(df.select("v").distinct(), "v").select("v", "next").collect())
    assert got == dict(zip(distinct, [*distinct[1:], None]))


def test_lookup_clamps_and_interpolates(spark):
    knots = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (40.0, 4.0)], "tof double, correction double")
    rows = spark.createDataFrame([(float(v),) for v in (5, 10, 15, 20, 30, 40, 50)], "tot double")
    assert [r.c for r in correlate.interpolated(rows, knots, "tot", "c").orderBy("tot").collect()] == [1, 1, 2, 3, 3.5, 4, 4]
    with pytest.raises(ValueError):
        correlate.interpolated(rows, knots.limit(1), "tot", "c")


def test_shot_index_uses_the_first_of_equal_triggers(spark):
    rows = spark.createDataFrame([(2,)], "t_trigger long")
    assert correlate.shot_index(rows, times_of(spark, [1, 2, 2, 4])).first().shot_index == 1


def test_density_examples(spark):
    df = spark.createDataFrame([(1, k, x, 0.0, 0.0, t) for k, (x, t) in enumerate([(0.0, 10), (1.5, 20), (3.0, 30), (100.0, 5)])], "shot long, pid long, x double, y double, tof double, tot long")
    label = lambda n: [r.cluster for r in cluster.density(df, 2.0, n).orderBy("pid").collect()]
    assert label(1) == [0, 0, 0, -1] and label(2) == [-1, 0, -1, -1] and label(0) == [0, 0, 0, 1]
    c = aggregate.weighted_centroids(filters.without_noise(cluster.numbered(cluster.density(df, 2.0, 1))), ["shot", "label"]).first()
    assert (c.x, c.tot) == (2.0, 30)
    near = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1), (1, 1, 0.0, 0.0, 4e-7, 1), (2, 0, 0.0, 0.0, 0.0, 1), (2, 1, 0.0, 0.0, 6e-7, 1)], df.schema)
    assert [(r.shot, r.cluster) for r in cluster.density(near, 2.0, 1).orderBy("shot", "pid").collect()] == [(1, 0), (1, 0), (2, -1), (2, -1)]


def test_density_equals_brute_force():
    rng = np.random.default_rng(4)
    for n, least in ((60, 1), (60, 3), (0, 1)):
        xyz = rng.uniform(0, 12, (n, 3))
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)) <= 2.0
        core = d.sum(1) - 1 >= least
        got, label, want = cluster._labels(xyz, 2.0, least), 0, np.full(n, -1)
        for i in range(n):
            if core[i] and want[i] < 0:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if core[j] and want[j] < 0:
                        want[j] = label
                        todo += np.flatnonzero(d[j]).tolist()
                label += 1
        assert (got == want).all()


def test_greedy_example_and_pieces(spark):
    hits = [(0, 10, 10, 50), (20, 11, 10, 80), (60, 13, 10, 30), (150, 10, 10, 20)]
    assert cluster.greedy_cells(*zip(*((x, y, t, w) for t, x, y, w in hits)), 2, 100, 16) == [(11, 10, 0, 80), (10, 10, 150, 20)]
    rng = random.Random(5)
    rows = sorted((rng.randint(0, 4000), rng.randint(0, 9), rng.randint(0, 9), rng.randint(1, 99)) for _ in range(300))
    want = cluster.greedy_cells(*zip(*((x, y, t, w) for t, x, y, w in rows)), 3, 30, 4)
    df = spark.createDataFrame([(x, y, t, w) for t, x, y, w in rows], "x int, y int, toa long, tot long")
    assert sorted(map(tuple, cluster.greedy(df, 3, 30, 4).collect())) == sorted(want) and len(want) <= len(rows)
    assert cluster.greedy(df.limit(0), 3, 30, 4).collect() == []


def test_histograms(spark):
    v = spark.createDataFrame([(x,) for x in (-10, 0, 19, 20, 99, 100, 101)], "tof long")
    got = {r.bin: r["count"] for r in histogram.spectrum(v, "tof", 0, 100, 5).collect()}
    assert got == {0: 2, 1: 1, 4: 2}
    image = histogram.image(spark.createDataFrame([(-3, 4), (300, 4), (255, 4)], "x int, y int"))
    assert sorted(map(tuple, image.collect())) == [(0, 4, 1), (255, 4, 2)]
    rois = [histogram.Roi("a", 10, 20), histogram.Roi("b", 20, 30)]
    counts = histogram.roi_counts(spark.createDataFrame([(10,), (20,), (31,)], "tof long"), rois).collect()
    assert [(r.roi, r["count"]) for r in counts] == [("a", 2), ("b", 1)]
    assert histogram.roi_counts(v.limit(0), rois).first().yield_pct is None


def test_subsampling(spark):
    assert [filters.stride(f) for f in (0.67, 0.66, 0.4, 1, 0.0)] == [1, 2, 2, 1, 100]
    df = spark.createDataFrame([(k, 0) for k in range(5)], "k long, b long")
    assert [r.k for r in filters.every_nth(df, 0.4, ["k"], ["b"]).orderBy("k").collect()] == [0, 2, 4]


def test_runs_and_shots(spark):
    files = spark.createDataFrame([("a", "raw", 1, 1), ("b", "events", 24, 5), ("c", "events", 24, 5), ("c", "centroids", 48, 4), ("d", "events", 24, 5), ("d", "centroids", 96, 6), ("e", "events", 24, 5), ("e", "centroids", 0, 9)], "run string, kind string, size long, mtime long")
    assert {r.run: r.status for r in aggregate.run_status(files, ["run"]).collect()} == {"a": "EMPTY", "b": "READY", "c": "STALE", "d": "DONE", "e": "READY"}
    events = spark.createDataFrame([(1.0, 1), (1.0, 2), (3.5, 3)], "t_trigger double, k long")
    assert [r.k for r in aggregate.events_of_shots(events, 1, 2).collect()] == [3] and aggregate.events_of_shots(events, 2, 9).count() == 0


def test_codes():
    assert schemas.channel("TDC2") == 2
    with pytest.raises(ValueError):
        schemas.channel("TDC3")

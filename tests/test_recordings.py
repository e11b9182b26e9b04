import json
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelflow.functions.ordering import spanned, with_index
from pixelflow.operators import cluster, correlate, histogram
from pixelflow.plans import oracle
from pixelflow.plans import queries as detector
from pixelflow.sources import frames, packed, processing, runs, store
from pixelflow.streaming import live
from tests.test_sources_streaming import pixel, trigger

SF = "/root/testdata/sf0.001"


def events(spark, rows):
    return spark.createDataFrame([(float(t), x, y, float(f), w) for t, x, y, f, w in rows], packed.S.schema("events"))


def save(df, folder, name, mode="append", **options):
    w = df.write.format("packed").option("kind", "events").option("name", name)
    for k, v in options.items():
        w = w.option(k, v)
    w.mode(mode).save(str(folder))


def load(spark, folder, **options):
    r = spark.read.format("packed").option("kind", "events")
    for k, v in options.items():
        r = r.option(k, v)
    return sorted(r.x for r in r.load(str(folder)).collect())


def test_append_keeps_and_overwrite_replaces_its_own_run(spark, tmp_path):
    packed.register(spark)
    one = lambda x: events(spark, [(1, x, 0, 0, 1), (2, x, 0, 0, 1)]).coalesce(1)
    save(one(1), tmp_path, "run")
    save(one(2), tmp_path, "run")
    save(one(3).repartition(2), tmp_path, "run")
    save(one(7), tmp_path, "run2")
    assert load(spark, tmp_path, name="run") == [1, 1, 2, 2, 3, 3] and load(spark, tmp_path, name="run2") == [7, 7]
    save(one(4), tmp_path, "run", "overwrite")
    assert load(spark, tmp_path, name="run") == [4, 4] and load(spark, tmp_path) == [4, 4, 7, 7]
    save(one(5), tmp_path, "run", saver=3)
    save(one(6), tmp_path, "run", saver=3)
    assert load(spark, tmp_path, name="run") == [4, 4, 6, 6]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_records_that_do_not_fit_are_errors(spark, tmp_path):
    packed.register(spark)
    for bad in ([(1, -1, 0, 0, 1)], [(1, 70_000, 0, 0, 1)]):
        with pytest.raises(Exception, match="out of the range"):
            save(events(spark, bad), tmp_path, "run")
    assert load(spark, tmp_path) == []


def test_runs_in_one_folder(spark, tmp_path):
    packed.register(spark)
    for name, x in (("a", 1), ("ab", 2)):
        save(events(spark, [(1, x, 0, 0, 1)]).coalesce(1), tmp_path, name)
        runs.write_metadata(str(tmp_path), name, x, 0, (0, 10), {})
    got = runs.Run(spark, str(tmp_path / "a_events.dat"))
    assert [r.x for r in got.events.collect()] == [1] and got.tdc_id == 1
    assert sorted(r.x for r in runs.Run(spark, str(tmp_path)).events.collect()) == [1, 2]


def test_metadata_fields(tmp_path):
    meta = runs.write_metadata(str(tmp_path), "r", 1, 0, (0, 10000), {"events": "r_events.dat"})
    assert meta["event_dtype"] == "t_trigger(f8),x(u2),y(u2),tof(f8),tot(u4)" and meta["files"] == {"events": "r_events.dat", "triggers": None, "pixels": None, "raw": None}
    assert time.strptime(meta["created"], "%Y-%m-%dT%H:%M:%SZ") and meta["centroiding"]["b_size"] == 16


def test_an_outlier_leaves_the_spans_even(spark):
    df = spark.range(20_000).select(F.col("id").alias("t")).unionByName(spark.createDataFrame([(10**15,), (None,)], "t long"))
    sizes = [r["count"] for r in spanned(df, "t", []).groupBy("_span").count().collect()]
    assert max(sizes) < 200
    assert with_index(df.filter("t is not null"), "t", []).filter("t != index and t < 20000").count() == 0


def test_a_hot_shot_beside_many_small_ones(spark):
    rng = np.random.default_rng(1)
    hot = rng.uniform(0, 60, (3000, 2)).round(3)
    rows = [(7, k, float(x), float(y), 0.0, 1) for k, (x, y) in enumerate(hot)] + [(100 + k // 3, k, float(k % 3), 0.0, 0.0, 1) for k in range(900)] + [(None, 1, 0.0, 0.0, 0.0, 1)] * 2
    df = spark.createDataFrame(rows, "shot long, pid long, x double, y double, tof double, tot long")
    got = {(r.shot, r.pid): r.cluster for r in cluster.density(df, 1.0, 2).collect()}
    d = np.sqrt(((hot[:, None] - hot[None]) ** 2).sum(-1)) <= 1.0
    core = d.sum(1) - 1 >= 2
    label, want = 0, np.full(len(hot), -1)
    for i in range(len(hot)):
        if core[i] and want[i] < 0:
            todo, want[i] = [i], label
            while todo:
                for j in np.flatnonzero(d[todo.pop()]):
                    if core[j] and want[j] < 0:
                        want[j] = label
                        todo.append(j)
            label += 1
    assert [got[7, k] for k in range(3000)] == want.tolist() and got[None, 1] == -1
    assert all(got[100 + k // 3, k] == (0 if k % 3 == 1 else -1) for k in range(900))


def test_lookup_of_nulls_and_ties(spark):
    knots = spark.createDataFrame([(1.0, 5.0), (1.0, 4.0), (3.0, 8.0)], "tof double, correction double")
    rows = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (1.0,)], "tot double")
    assert [r.c for r in correlate.interpolated(rows, knots, "tot", "c").collect()] == [None, 8.0, 6.0, 4.0]


def test_processing_of_runs_and_files(spark, tmp_path):
    packed.register(spark)
    folder = tmp_path / "night" / "run1"
    save(events(spark, [(2, 10, 10, 1e-6, 10), (2, 11, 10, 1e-6, 30), (2, 90, 90, 1e-6, 5)]).coalesce(1), folder, "run1")
    save(events(spark, [(1, 5, 5, 1e-6, 7), (1, 5, 6, 1e-6, 7), (1, 5, 5, 9.0, 7)]).coalesce(1), folder, "run1")
    seen = []
    assert processing.process_files(spark, str(folder), progress=lambda *x: seen.append(x)) == {"run1": 1, "run1_saver0": 1} and len(seen) == 2
    first = processing.process_run(spark, str(folder), labels=True)
    assert first["made"] and first["n_centroids"] == 2 and not processing.process_run(spark, str(folder))["made"]
    merged = spark.read.format("packed").option("kind", "merged").load(str(folder)).collect()
    assert [(r.shot_index, r.t_trigger, r.x, r.tot) for r in merged] == [(0, 1.0, 5.0, 7.0), (1, 2.0, 10.75, 30.0)]
    labels = spark.read.format("packed").option("kind", "labels").load(str(folder)).collect()
    assert sorted((r.shot, r.label) for r in labels) == [(1.0, 0.0), (1.0, 0.0), (2.0, -1.0), (2.0, 1.0), (2.0, 1.0)]
    (tmp_path / "night" / "broken").mkdir()
    (tmp_path / "night" / "broken" / "b_events.dat").write_bytes(b"")
    done = {r.run: (r.n_centroids, r.error) for r in processing.process_all(spark, str(tmp_path / "night"), force=True).collect()}
    assert done == {"run1": (2, None), "broken": (0, None)}
    processing.main([str(folder), "--force", "--min-points", "5"])
    assert (folder / "run1_centroids.datbin").stat().st_size == 0
    assert processing.convert_events(spark, str(folder), str(tmp_path), "t") == 6 and (tmp_path / "t.tofbin").stat().st_size == 240


def test_packed_recording_with_flags_of_its_own(spark, tmp_path):
    raw, out = tmp_path / "in", tmp_path / "out"
    raw.mkdir()
    (raw / "a.tpx3").write_bytes(frames.frame_bytes([trigger(800), pixel(2, 110), pixel(4, 150)], 0, 1))
    (raw / "b.tpx3").write_bytes(frames.frame_bytes([trigger(1600), pixel(6, 210), trigger(2400), pixel(8, 310)], 0, 1))
    for k, name in enumerate("ab"):
        os.utime(raw / f"{name}.tpx3", (1_700_000_000 + k, 1_700_000_000 + k))
    control = live.Controller(live.Recorder(spark, str(out), (0, 96 * 100), packed_files=True))
    seen = []
    control.recorder.bus.subscribe("events", lambda table, batch: seen.append((batch, table.count())))
    control.start_record("one", save_pixels=False)
    query = control.start(live.raw_stream(spark, str(raw), 1), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(120)
    assert query.exception() is None and seen == [(0, 0), (1, 3)]
    assert control.rolling(1) == {"batches": 1, "pixels": 2, "triggers": 2, "mean_seconds": pytest.approx(control.rolling(1)["mean_seconds"])} and control.rolling()["pixels"] == 4
    folder = out / "one"
    meta = json.loads((folder / "one_meta.json").read_text())
    assert meta["files"]["pixels"] is None and meta["files"]["events"] == "one_events.dat"
    run = runs.Run(spark, str(folder))
    assert sorted((r.x, round(r.tof / 25e-9)) for r in run.events.collect()) == [(2, 10), (4, 50), (6, 10)] and run.triggers.count() == 3 and run.pixels.count() == 0
    assert sorted(p.name for p in (out / "_state").iterdir()) == ["0", "1"]
    control.start_record("two", output_dir=str(tmp_path / "else"))
    assert control.recorder.kept["pixels"] and (tmp_path / "else" / "two" / "two_meta.json").exists()
    assert control.handle({"cmd": "status"})["pipeline_running"] is False


def test_bounded_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tpx3").write_bytes(frames.frame_bytes([trigger(800), pixel(2, 110)], 0, 1))
    control = live.Controller(live.Recorder(spark, str(tmp_path / "out"), (0, 10)))
    assert control.run_for(live.raw_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "cp"), 15, "timed") is False
    assert control.status()["recording"] is False and spark.read.parquet(str(tmp_path / "out" / "pixels" / "run=timed")).count() == 1


def test_frames_over_chunk_bounds(spark):
    stream = b"".join(frames.frame_bytes([trigger(800 + k), pixel(2, 110)], 0, 1) for k in range(5))
    parts = list(frames.reframed(stream[k : k + 50] for k in range(0, len(stream), 50)))
    assert b"".join(parts) == stream and all(frames.walk(p)[1] == len(p) for p in parts)
    files = spark.createDataFrame([("a", stream), ("b", stream[:-9])], "path string, content binary")
    size = len(stream) // 5
    assert [tuple(r) for r in frames.unread(files).collect()] == [("b", size - 9)]


def test_regions_over_time(spark):
    rois = histogram.Rois()
    rois.add("a", 0, 10)
    rois.add("b", 5, 20)
    rois.update("a", 0, 15, since=100)
    rois.rename("b", "c")
    with pytest.raises(ValueError):
        rois.add("c", 0, 1)
    hits = spark.createDataFrame([(3, 3, 7, 50), (3, 3, 7, 150), (4, 4, 18, 150)], "x int, y int, tof long, toa long")
    assert [tuple(r)[:2] for r in rois.counts(hits).collect()] == [("a", 1), ("c", 3)] and rois.names() == ["a", "c"] and rois.range_of("a") == (0, 15)
    assert sorted(tuple(r) for r in rois.images(hits).collect()) == [("a", 3, 3, 1), ("c", 3, 3, 2), ("c", 4, 4, 1)]
    rois.clear()
    assert not rois


def test_store(spark, tmp_path):
    store.write_text(spark, str(tmp_path / "x" / "y.txt"), "é")
    assert store.exists(spark, str(tmp_path / "x")) and (tmp_path / "x" / "y.txt").read_text() == "é"
    store.remove(spark, str(tmp_path / "x"))
    assert not store.exists(spark, str(tmp_path / "x"))


@pytest.mark.parametrize("name", ["greedy_centroids", "parse_packets", "merged_run", "roi_lifecycle", "chunk_diagnostics", "correlate_offline_by_buffer", "label_files", "tofbin_scan"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = detector.queries()[name](spark, SF)
    result = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(result.fetchall())

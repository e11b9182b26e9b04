import json
import os

import numpy as np

from pixelflow.sources import frames, packed, runs
from pixelflow.streaming import live
from tests.test_decode import signed


def test_packed_round_trip_of_every_kind(spark, tmp_path):
    packed.register(spark)
    for kind in ("events", "pixels", "triggers", "centroids", "merged", "labels", "tofbin"):
        names = [n for n, _, _ in packed.S.LAYOUTS[kind]]
        df = spark.createDataFrame([tuple(t.fromInternal(k + i) if False else (float(k + i) if c == "f8" else k + i) for i, (_, c, t) in enumerate(packed.S.LAYOUTS[kind])) for k in range(7)], packed.S.schema(kind)).coalesce(1)
        df.write.format("packed").option("kind", kind).option("name", "r1").mode("append").save(str(tmp_path / kind))
        back = spark.read.format("packed").option("kind", kind).load(str(tmp_path / kind))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())) and back.columns == names
        assert len(list((tmp_path / kind).iterdir())) == 1


def test_partial_record_is_ignored_and_empty_folder_reads(spark, tmp_path):
    packed.register(spark)
    rows = np.zeros(3, packed.dtype("events"))
    (tmp_path / "a_events.dat").write_bytes(rows.tobytes() + b"\1\2")
    assert spark.read.format("packed").option("kind", "events").load(str(tmp_path)).count() == 3
    assert spark.read.format("packed").option("kind", "pixels").load(str(tmp_path)).count() == 0


def test_run_folder(spark, tmp_path):
    events = np.array([(3.5, 1, 1, 0.1, 7), (1.0, 2, 2, 0.2, 8), (1.0, 3, 3, 0.3, 9)], packed.dtype("events"))
    triggers = np.array([(1.0, 1, 0), (2.0, 1, 0), (3.5, 2, 0)], packed.dtype("triggers"))
    (tmp_path / "r_saver0_events.dat").write_bytes(events[:1].tobytes())
    (tmp_path / "r_saver1_events.dat").write_bytes(events[1:].tobytes())
    (tmp_path / "r_triggers.trg").write_bytes(triggers.tobytes())
    meta = runs.write_metadata(str(tmp_path), "r", 0, 0, (0, 10000), {"events": "r_events.dat"})
    assert json.loads((tmp_path / "r_meta.json").read_text()) == meta and meta["tdc_label"] == "BOTH"
    run = runs.Run(spark, str(tmp_path))
    assert [r.t_trigger for r in run.events.collect()] == [1.0, 1.0, 3.5]
    assert run.primary_triggers.count() == 3 and runs.stem("r_saver1_events.dat") == "r"
    assert run.events_for_shot(1).first().x == 1 and run.events_in_range(0, 5).count() == 3
    assert {(r.run, r.kind) for r in runs.listing(spark, str(tmp_path)).collect()} == {(tmp_path.name, "events")}
    got = runs.centroid_run(run.events, run.triggers, 2.0, 1, 1.0)
    assert got.columns == ["t_trigger", "x", "y", "tof", "tot", "shot_index"]


def test_corrections_drop_bad_lines(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1.0,2.0\nbad\n3.0,4.0\n")
    assert sorted(map(tuple, runs.read_corrections(spark, str(tmp_path / "c.txt")).collect())) == [(1.0, 2.0), (3.0, 4.0)]


def pixel(x, coarse):
    return 0xB << 60 | (x // 2) << 53 | coarse << 30 | 1 << 20


def trigger(ticks12):
    return 0x6F << 56 | ticks12 << 9 | 1 << 5


def test_stream_to_recordings(spark, tmp_path):
    raw, out = tmp_path / "in", tmp_path / "out"
    raw.mkdir()
    # hits at 16 pixel ticks a coarse step (96 sixths); triggers at 12 sixths a step: 100, 200 and 300 coarse steps
    (raw / "a.tpx3").write_bytes(frames.frame_bytes([trigger(800), pixel(2, 110), pixel(4, 150)], 0, 1))
    (raw / "b.tpx3").write_bytes(frames.frame_bytes([trigger(1600), pixel(6, 210), trigger(2400), pixel(8, 310)], 0, 1))
    control = live.Controller(live.Recorder(spark, str(out), (0, 96 * 100)))
    seen = []
    control.recorder.bus.subscribe("batch", seen.append)
    assert control.handle({"cmd": "start_record", "filename": "one", "save_pixels": False})["status"] == "ok"
    query = control.start(live.raw_stream(spark, str(raw), 1), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(120)
    assert query.exception() is None and seen == [0, 1]
    events = spark.read.parquet(str(out / "events" / "run=one"))
    assert sorted((r.x, r.tof // 96) for r in events.collect()) == [(2, 10), (4, 50), (6, 10)]
    assert not (out / "pixels").exists() and (out / "triggers" / "run=one").exists()


def test_hits_wait_for_a_distant_trigger(spark, tmp_path):
    raw, out = tmp_path / "in", tmp_path / "out"
    raw.mkdir()
    # triggers further apart than two windows, and a stray hit between
    (raw / "a.tpx3").write_bytes(frames.frame_bytes([trigger(800), pixel(2, 110), pixel(4, 350)], 0, 1))
    (raw / "b.tpx3").write_bytes(frames.frame_bytes([pixel(6, 380)], 0, 1))
    (raw / "c.tpx3").write_bytes(frames.frame_bytes([trigger(3200), pixel(8, 410)], 0, 1))
    for k, name in enumerate("abc"):
        os.utime(raw / f"{name}.tpx3", (1_700_000_000 + k, 1_700_000_000 + k))
    control = live.Controller(live.Recorder(spark, str(out), (0, 96 * 100)))
    control.start_record("one")
    query = control.start(live.raw_stream(spark, str(raw), 1), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(120)
    assert query.exception() is None
    events = spark.read.parquet(str(out / "events" / "run=one"))
    assert [(r.x, r.tof // 96) for r in events.collect()] == [(2, 10)]
    carried = spark.read.parquet(str(out / "_state" / "2" / "hits"))
    assert [r.x for r in carried.collect()] == [8]


def test_controller_protocol(spark, tmp_path):
    control = live.Controller(live.Recorder(spark, str(tmp_path), (0, 10)))
    assert control.handle({"cmd": "ping"}) == {"status": "pong"}
    assert control.handle({"cmd": "start_record"}) == {"status": "error", "message": "filename required"}
    assert control.handle({"cmd": "nope"})["status"] == "error"
    for name in ("a", "b"):
        assert control.handle({"cmd": "start_record", "filename": name})["recording"] is True
        assert control.handle({"cmd": "status"})["filename"] == name
    assert control.handle({"cmd": "stop_record"}) == {"status": "ok", "recording": False}


def test_raw_recordings_are_refused(spark, tmp_path):
    control = live.Controller(live.Recorder(spark, str(tmp_path), (0, 10)))
    assert control.handle({"cmd": "start_record", "filename": "a", "save_raw": True})["status"] == "error"
    assert control.handle({"cmd": "status"})["recording"] is False
    assert control.handle({"cmd": "start_record", "filename": "a", "save_raw": False})["recording"] is True


def test_bus():
    bus, got = live.Bus(), []
    bus.subscribe("a", lambda *x: got.append(x))
    bus.subscribe("*", lambda *x: got.append(("any", *x)))
    bus.subscribe("a", lambda *x: 1 / 0)
    bus.publish("a", 5)
    assert got == [(5,), ("any", "a", 5)] and len(bus.errors) == 1 and bus.subscriber_count("a") == 2 and bus.events() == ["*", "a"]
    bus.clear()
    assert bus.events() == []


def test_signed():
    assert signed(1 << 63) == -(1 << 63)

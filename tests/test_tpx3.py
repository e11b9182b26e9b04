"""Split and followed ``.tpx3`` files."""

import random

import pytest
from pyspark.sql import functions as F

from pixelflow.sources import frames, tpx3


def frame(k, n=None):
    return frames.frame_bytes([k * 1000 + i for i in range(n if n is not None else k % 7)], k, k + 1)


def rows(df):
    return sorted((r.min_ts, list(r.packets)) for r in df.collect())


@pytest.fixture
def source(spark):
    tpx3.register(spark)
    return spark


def test_split_files_equal_whole_ones(source, tmp_path):
    rng = random.Random(1)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.tpx3").write_bytes(b"".join(frame(k, rng.randint(0, 300)) for k in range(400)))
    (tmp_path / "sub" / "b.tpx3").write_bytes(b"".join(frame(k) for k in range(400, 420)))
    (tmp_path / "broken.tpx3").write_bytes(frame(500, 9) + frame(501, 9) + b"\0" * 8 + frame(502, 9))
    (tmp_path / "short.tpx3").write_bytes(frame(600, 9) + frame(601, 9)[:-8])
    (tmp_path / "empty.tpx3").write_bytes(b"")
    (tmp_path / "odd.tpx3").write_bytes(frame(700, 9) + b"TPX3\0\0\7")
    whole = frames.frames_of(source.read.format("binaryFile").option("pathGlobFilter", "*.tpx3").option("recursiveFileLookup", "true").load(str(tmp_path)))
    key = lambda df: sorted((r.path.removeprefix("file:").lstrip("/"), r.frame, r.min_ts, r.max_ts, tuple(r.packets)) for r in df.collect())
    read = source.read.format("tpx3").option("split", 4096).load(str(tmp_path))
    assert read.rdd.getNumPartitions() > 100
    assert key(read) == key(whole) == key(tpx3.split_frames(source, str(tmp_path), 4096))
    sizes = read.groupBy(F.spark_partition_id()).agg(F.sum(F.size("packets")).alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 4096 // 8
    assert tpx3.split_frames(source, str(tmp_path / "sub"), 1 << 20, tasks=1).count() == sum(k % 7 > 1 for k in range(400, 420))


def test_large_file_is_read_by_many_tasks(source, tmp_path):
    block = b"".join(frame(k, 8000) for k in range(1, 17))  # a MB
    with open(tmp_path / "large.tpx3", "wb") as f:
        for _ in range(64):
            f.write(block)
    read = source.read.format("tpx3").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 8 and read.count() == 64 * 16


class Followed:
    """A stream over a folder into a Parquet table, run until it has read all there is."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.folder, self.out, self.check = spark, tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
        self.folder.mkdir(exist_ok=True)
        self.options = {"max_bytes": 2000, "split": 600, **options}

    def run(self):
        stream = self.spark.readStream.format("tpx3").options(**self.options).load(str(self.folder))
        query = stream.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.check).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
            return [p.numInputRows for p in query.recentProgress if p.numInputRows]
        finally:
            query.stop()

    def add(self, name, raw):
        with open(self.folder / name, "ab") as f:
            f.write(raw)

    def got(self):
        return rows(self.spark.read.schema(frames.SCHEMA).parquet(self.out))


def wanted(keys):
    return sorted((k, [k * 1000 + i for i in range(9)]) for k in keys)


@pytest.mark.parametrize("progress", [False, True])
def test_stream_of_halves_and_of_frames_across_files(source, tmp_path, progress):
    s = Followed(source, tmp_path, **({"progress": str(tmp_path / "progress")} if progress else {}))
    f = [frame(k, 9) for k in range(60)]
    s.add("a.tpx3", f[0] + f[1][:20])
    assert s.run() and s.got() == wanted([0])
    s.add("a.tpx3", f[1][20:] + f[2] + f[3][:3])  # a restart, the other half, and a part of a header
    assert s.run() and s.got() == wanted([0, 1, 2])
    assert not s.run()
    s.add("b.tpx3", f[3][3:50])
    assert not s.run()
    s.add("c.tpx3", f[3][50:] + f[4])  # one frame in three files
    assert s.run() and s.got() == wanted(range(5))
    s.add("d.tpx3", f[5] + f[6][:40])
    s.add("e.tpx3", f[7] + b"\0" * 16 + f[8])  # starts anew, so 6 is given up; 8 follows a broken header
    s.add("f.tpx3", b"".join(f[9:60]))
    batches = s.run()
    assert s.got() == wanted([*range(6), 7, *range(9, 60)])
    assert len(batches) >= (3 if progress else 1) and (not progress or max(batches) <= 2000 // len(f[9]))
    assert not s.run()


def test_batches_are_cut_by_bytes(source, tmp_path):
    s = Followed(source, tmp_path, progress=str(tmp_path / "progress"))
    f = [frame(k, 9) for k in range(101)]
    s.add("a.tpx3", f[100])
    s.run()
    s.add("a.tpx3", b"".join(f[:100]))
    assert len(s.run()) >= 100 * len(f[0]) // 2000
    assert s.got() == wanted(range(101))


def test_planned_batch_is_run_again(source, tmp_path):
    """A batch that was planned but not committed is read again from its offsets, and no other frame with it."""
    s = Followed(source, tmp_path, progress=str(tmp_path / "progress"))
    s.add("a.tpx3", frame(1, 9))
    s.run()
    s.add("a.tpx3", frame(2, 9))
    s.run()
    (tmp_path / "check" / "commits" / "1").unlink()  # as if the driver had died before it
    for crc in (tmp_path / "check" / "commits").glob(".1*"):
        crc.unlink()
    s.add("a.tpx3", frame(3, 9))
    s.run()
    assert s.got() == wanted([1, 2, 3])


def test_raw_sink(source, tmp_path):
    df = source.createDataFrame([(frame(k, 9),) for k in range(20)], "content binary").repartition(3)
    out = str(tmp_path / "raw")
    df.write.format("tpx3").option("name", "r").mode("append").save(out)
    assert rows(source.read.format("tpx3").load(out)) == wanted(range(20)) and len(list((tmp_path / "raw").iterdir())) == 3
    df.coalesce(1).write.format("tpx3").option("name", "r").mode("append").save(out)
    assert source.read.format("tpx3").load(out).count() == 40
    df.coalesce(1).write.format("tpx3").option("name", "r").mode("overwrite").save(out)
    assert [p.name for p in (tmp_path / "raw").iterdir()] == ["r.tpx3"] and source.read.format("tpx3").load(out).count() == 20


def test_recorder_follows_a_growing_file(source, tmp_path):
    from pixelflow.streaming import live
    from tests.test_sources_streaming import pixel, trigger

    raw = tmp_path / "in"
    raw.mkdir()
    a = frames.frame_bytes([trigger(800), pixel(2, 110), pixel(4, 150)], 0, 1)
    b = frames.frame_bytes([trigger(1600), pixel(6, 210), trigger(2400), pixel(8, 310)], 0, 1)
    (raw / "a.tpx3").write_bytes(a + b[:24])
    control = live.Controller(live.Recorder(source, str(tmp_path / "out"), (0, 96 * 100)))
    control.start_record("one")
    query = control.start(live.followed_stream(source, str(raw), str(tmp_path / "progress")), str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
        with open(raw / "a.tpx3", "ab") as f:
            f.write(b[24:])
        query.processAllAvailable()
    finally:
        query.stop()
    events = source.read.parquet(str(tmp_path / "out" / "events" / "run=one"))
    assert sorted((r.x, r.tof // 96) for r in events.collect()) == [(2, 10), (4, 50), (6, 10)]

"""Exactly-once stream sink, single files written in parallel, and blocks chosen by filters."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelflow.sources import packed, store

SCHEMA = packed.S.schema("events")


@pytest.fixture
def source(spark):
    packed.register(spark)
    return spark


def table(spark, start, stop):
    return spark.range(start, stop).select(F.col("id").cast("double").alias("t_trigger"), (F.col("id") % 256).cast("int").alias("x"), F.lit(1).alias("y"), (F.col("id") / 2).alias("tof"), F.col("id").alias("tot"))


def tots(spark, folder):
    return sorted(r.tot for r in spark.read.format("packed").option("kind", "events").load(str(folder)).collect())


class Stream:
    def __init__(self, spark, tmp_path):
        self.spark, self.source, self.out, self.check = spark, tmp_path / "in", tmp_path / "out", tmp_path / "check"

    def run(self, *span):
        if span:
            table(self.spark, *span).repartition(3).write.mode("append").parquet(str(self.source))
        rows = self.spark.readStream.schema(SCHEMA).parquet(str(self.source))
        query = rows.writeStream.format("packed").option("kind", "events").option("name", "r").option("checkpointLocation", str(self.check)).trigger(availableNow=True).start(str(self.out))
        query.awaitTermination()
        assert query.exception() is None

    def forget(self, batch):
        """As if the driver had died before the batch was noted as done."""
        for p in (self.check / "commits").iterdir():
            if p.name in (str(batch), f".{batch}.crc"):
                p.unlink()


def test_repeated_batches_add_nothing(source, tmp_path):
    s = Stream(source, tmp_path)
    s.run(0, 100)
    s.run(100, 150)
    names = sorted(p.name for p in s.out.glob("r_*"))
    assert len(names) == 6 and tots(source, s.out) == list(range(150))  # several savers a batch
    s.forget(1)
    s.run()
    assert sorted(p.name for p in s.out.glob("r_*")) == names and tots(source, s.out) == list(range(150))
    log = s.out / "_commits" / "r_events.dat" / "1.json"
    second = [n for n in names if n.startswith("r_saver10000")]
    assert sorted(json.loads(log.read_text())) == second and len(second) > 1
    log.unlink()  # as if it had died in the middle of the commit: some files are in place, one isn't
    (s.out / second[0]).unlink()
    s.forget(1)
    s.run()
    assert tots(source, s.out) == list(range(150))
    assert not [p for p in s.out.iterdir() if p.name.startswith(".")]
    s.run(150, 160)
    assert tots(source, s.out) == list(range(160))


def test_batches_of_foreach_batch(source, tmp_path):
    write = lambda rows, batch: rows.write.format("packed").option("kind", "events").option("name", "r").option("batch", batch).mode("append").save(str(tmp_path))
    write(table(source, 0, 10), 0)
    write(table(source, 10, 20), 1)
    write(table(source, 10, 20), 1)
    assert tots(source, tmp_path) == list(range(20))
    write(table(source, 0, 0), 2)
    assert (tmp_path / "_commits" / "r_events.dat" / "2.json").exists()


def test_single_file_of_many_tasks(source, tmp_path, monkeypatch):
    rows = table(source, 0, 50_000).repartitionByRange(7, "t_trigger").sortWithinPartitions("t_trigger")
    monkeypatch.setattr(packed, "COPY", 4096)
    assert packed.write_single(rows, "events", str(tmp_path), "all") == 50_000
    got = np.fromfile(tmp_path / "all_events.dat", packed.dtype("events"))
    assert (got["t_trigger"] == np.arange(50_000)).all() and [p.name for p in tmp_path.iterdir()] == ["all_events.dat"]
    assert packed.write_single(rows.limit(0), "events", str(tmp_path), "all") == 0 and (tmp_path / "all_events.dat").stat().st_size == 0
    assert tots(source, tmp_path) == []


def test_stores_that_cannot_join_say_so(source, tmp_path):
    assert store.is_local(source, str(tmp_path))
    for name in "ab":
        (tmp_path / name).write_bytes(b"x")
    with pytest.raises(Exception, match="UnsupportedOperation|not supported|Not implemented"):
        store.concatenated(source, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "c"))
    store.concatenated(source, [str(tmp_path / "a")], str(tmp_path / "c"))
    assert (tmp_path / "c").read_bytes() == b"x"




def test_filters_choose_blocks(source, tmp_path):
    n = 20 * packed.BLOCK
    table(source, 0, n).coalesce(1).sortWithinPartitions("t_trigger").write.format("packed").option("kind", "events").option("name", "r").option("index", "true").mode("append").save(str(tmp_path))
    options = {"kind": "events", "path": str(tmp_path)}

    def blocks(*filters):
        reader = packed.Reader(options)
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark still applies them
        return [(s.first // packed.BLOCK, -(-s.n // packed.BLOCK)) for s in reader.partitions() if s.n]

    at = lambda k: float(k * packed.BLOCK)
    t, tof = ("t_trigger",), ("tof",)
    assert blocks() == [(0, 20)]
    assert blocks(packed.GreaterThanOrEqual(t, at(5)), packed.LessThan(t, at(5) + 10)) == [(5, 1)]
    assert blocks(packed.EqualTo(t, at(7) - 1)) == [(6, 1)] and blocks(packed.GreaterThan(t, at(19) + 5), packed.LessThanOrEqual(tof, 3.0)) == []
    assert blocks(packed.LessThanOrEqual(tof, at(1) / 2)) == [(0, 2)]  # half of the numbers, so the second block's first one
    rows = source.read.format("packed").option("kind", "events").load(str(tmp_path))
    some = rows.filter((F.col("t_trigger") >= at(5) - 3) & (F.col("t_trigger") < at(5) + 3))
    assert sorted(r.tot for r in some.collect()) == list(range(5 * packed.BLOCK - 3, 5 * packed.BLOCK + 3))
    assert rows.filter("x = 3 and t_trigger > 5").count() == sum(k % 256 == 3 for k in range(6, n))
    (tmp_path / "r_events.dat").write_bytes(b"")  # an index of another size counts for nothing
    assert rows.filter("t_trigger > 5").count() == 0


def test_ten_shots_read_their_blocks_only(source, tmp_path):
    n = 30 * packed.BLOCK
    table(source, 0, n).coalesce(1).write.format("packed").option("kind", "events").option("name", "r").option("index", "true").mode("append").save(str(tmp_path))
    with open(tmp_path / "r_events.dat", "r+b") as f:  # every other block is made unreadable: it holds times that the filter asks for
        for k in range(0, 30, 2):
            f.seek(k * packed.BLOCK * packed.dtype("events").itemsize)
            f.write(np.full(packed.BLOCK, np.array((packed.BLOCK + 5.0, 0, 0, 0, 999_999), packed.dtype("events"))).tobytes())
    rows = source.read.format("packed").option("kind", "events").load(str(tmp_path))
    got = rows.filter((F.col("t_trigger") >= packed.BLOCK + 1.0) & (F.col("t_trigger") <= packed.BLOCK + 10.0)).collect()
    assert sorted(r.tot for r in got) == list(range(packed.BLOCK + 1, packed.BLOCK + 11))


def test_events_whose_trigger_is_missing_are_an_error(source, tmp_path):
    from pixelflow.sources import processing

    folder = tmp_path / "run"
    pairs = table(source, 1, 3).unionByName(table(source, 1, 3))  # a cluster for each of two shots
    pairs.coalesce(1).write.format("packed").option("kind", "events").option("name", "run").mode("append").save(str(folder))
    known = source.createDataFrame([(1.0, 1, 0)], packed.S.schema("triggers")).coalesce(1)
    known.write.format("packed").option("kind", "triggers").option("name", "run").mode("append").save(str(folder))
    with pytest.raises(Exception, match="in no trigger file"):
        processing.process_run(source, str(folder), tof_threshold=10.0)
    errors = {}
    assert processing.process_files(source, str(folder), output="/proc/none", errors=errors) == {"run": None} and errors["run"]

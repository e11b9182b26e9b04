"""Live accumulators against the batch functions, after every batch."""

import random

import pytest
from pyspark.sql import functions as F

from pixelflow.operators import histogram
from pixelflow.operators.histogram import Roi
from pixelflow.streaming import accumulators

EVENT = "x int, y int, toa long, tof long, tot long, t_trigger long"
ROIS = [Roi("near", 0, 300), Roi("far", 250, 900)]
SECOND = 1_000_000


def events(seed, start, stop, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        toa = rng.randrange(start, stop)
        trigger = toa - toa % 1000
        out.append((rng.choice([5, 5, rng.randint(-3, 260)]), rng.choice([7, rng.randint(-3, 260)]), toa, toa - trigger, 25, trigger))
    return out


class Live:
    def __init__(self, spark, tmp_path, plan, with_commands=False):
        self.spark, self.plan, self.n = spark, plan, 0
        self.folder, self.commands, self.out, self.check = (str(tmp_path / n) for n in ("in", "commands", "out", "check"))
        self.with_commands = with_commands
        for f, schema in ((self.folder, EVENT), (self.commands, "at long")):
            spark.createDataFrame([], schema).write.mode("append").parquet(f)

    def run(self, rows, *cleared):
        """One batch with the rows (and the clears), from where the stream ended."""
        self.spark.createDataFrame(rows, EVENT).repartition(3).write.mode("append").parquet(self.folder)
        if cleared:
            self.spark.createDataFrame([(t,) for t in cleared], "at long").coalesce(1).write.mode("append").parquet(self.commands)
        stream = lambda f, schema: self.spark.readStream.schema(schema).parquet(f)
        made = accumulators.accumulated(stream(self.folder, EVENT), self.plan, stream(self.commands, "at long") if self.with_commands else None)
        query = accumulators.started(made, self.out, self.check, availableNow=True)
        query.awaitTermination()
        assert query.exception() is None
        self.state = [s.numRowsTotal for p in query.recentProgress for s in [p.stateOperators[0]]][-1]
        self.dropped = sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress)
        return accumulators.latest(self.spark, self.out)


def rows(df):
    return sorted(map(tuple, df.collect()))


def nonzero(df):
    return rows(df.filter("count > 0"))


def test_equal_to_batch_after_every_batch(spark, tmp_path):
    plan = accumulators.Plan(SECOND, (0, 1000, 130), ROIS, delay="5 seconds", since={"far": 6 * SECOND})
    live, sent = Live(spark, tmp_path, plan), []
    for k in range(4):  # each batch reaches back into the one before
        new = events(k, max(0, k * 4 - 3) * SECOND, (k * 4 + 4) * SECOND, 300)
        sent += new
        got, all_ = live.run(new), spark.createDataFrame(sent, EVENT)
        assert rows(accumulators.image(got).drop("period")) == rows(histogram.image(all_))
        assert rows(accumulators.spectrum(got, plan).drop("period")) == rows(histogram.spectrum(all_, "tof", 0, 1000, 130))
        rois = histogram.Rois()
        rois.add("near", 0, 300)
        rois.add("far", 250, 900, 6 * SECOND)
        assert rows(accumulators.counts(got, plan).select("roi", "count")) == nonzero(rois.counts(all_).select("roi", "count"))
        far = rois.images(all_).filter("roi = 'far'").select("x", "y", "count")
        assert rows(accumulators.image(got, "far").drop("period")) == rows(far)
        assert rows(accumulators.rates(got, plan)) == rows(histogram.rates(all_, SECOND, ROIS).filter("rate > 0"))
        assert live.dropped == 0


def test_clears_by_hand(spark, tmp_path):
    plan = accumulators.Plan(SECOND, (0, 1000, 10), delay="4 seconds")
    live, sent = Live(spark, tmp_path, plan, with_commands=True), []
    for k, cleared in enumerate([(), (9 * SECOND,), (), (14 * SECOND, 13 * SECOND)]):
        new = events(10 + k, max(0, k * 4 - 2) * SECOND, (k * 4 + 4) * SECOND, 200)
        sent += new
        got = live.run(new, *cleared)
        at = {0: 0, 1: 9, 2: 9, 3: 14}[k] * SECOND
        assert rows(accumulators.image(got).drop("period")) == rows(histogram.image(histogram.since(spark.createDataFrame(sent, EVENT), at)))


def test_clears_by_time(spark, tmp_path):
    plan = accumulators.Plan(SECOND, (0, 1000, 10), every=5 * SECOND, delay="3 seconds")
    live, sent = Live(spark, tmp_path, plan), []
    for k in range(4):
        new = events(20 + k, max(0, k * 4 - 2) * SECOND, (k * 4 + 4) * SECOND, 200)
        sent += new
        got = live.run(new)
        want = histogram.cleared_images(spark.createDataFrame(sent, EVENT), 5 * SECOND)
        assert rows(accumulators.image(got)) == rows(want.select("period", "x", "y", "count"))


def test_state_is_bounded_and_late_hits_are_dropped(spark, tmp_path):
    plan = accumulators.Plan(SECOND, (0, 1000, 10), delay="2 seconds")
    live, sizes = Live(spark, tmp_path, plan), []
    line = lambda start: [(x, 3, start + t * SECOND, 5, 25, start + t * SECOND) for t in range(4) for x in range(20)]
    for k in range(6):
        live.run(line(k * 4 * SECOND))
        sizes.append(live.state)
    assert max(sizes[2:]) <= sizes[1] + 4
    before = rows(accumulators.image(accumulators.latest(spark, live.out)))
    got = live.run([(1, 3, 100, 5, 25, 100)])
    assert live.dropped > 0 and rows(accumulators.image(got)) == before == [(0, x, 3, 24) for x in range(20)]


def test_periods_are_whole_slices():
    with pytest.raises(ValueError):
        accumulators.Plan(3, (0, 10, 2), every=10)


def test_counts_before_the_shuffle(spark):
    plan = accumulators.Plan(SECOND, (0, 1000, 10))
    df = spark.createDataFrame([(1, 1, 5, 5, 25, 0)] * 5000, EVENT).coalesce(1)
    got = accumulators.partials(df, plan).groupBy("acc").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.get("counts", F.lit(0))).alias("n")).collect()
    batches = -(-5000 // int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
    assert {(r.acc, r.rows, r.n) for r in got} == {(a, batches, 5000) for a in ("image", "spectrum", "rate", "shots")}

"""Correlation of two streams against the same over the whole run."""

import random

from pixelflow.operators import correlate
from pixelflow.streaming import correlation

HIT, TIME = "x int, y int, toa long, tot long", "toa long"
SECOND = 1_000_000


class Pair:
    def __init__(self, spark, tmp_path, low, high, delay):
        self.spark, self.window, self.delay = spark, (low, high), delay
        self.hits, self.triggers, self.out, self.check = (str(tmp_path / n) for n in ("hits", "triggers", "out", "check"))
        for f, schema in ((self.hits, HIT), (self.triggers, TIME)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f)

    def run(self, hits, triggers):
        if hits:
            self.spark.createDataFrame(hits, HIT).repartition(2).write.mode("append").parquet(self.hits)
        if triggers:
            self.spark.createDataFrame([(t,) for t in triggers], TIME).coalesce(1).write.mode("append").parquet(self.triggers)
        stream = lambda f, schema: self.spark.readStream.schema(schema).parquet(f)
        made = correlation.live(stream(self.hits, HIT), stream(self.triggers, TIME), *self.window, self.delay)
        query = made.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.check).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        self.dropped = correlation.dropped(query)
        self.state = sum(s.numRowsTotal for s in query.recentProgress[-1].stateOperators)

    def got(self):
        return sorted(map(tuple, self.spark.read.parquet(self.out).select("x", "y", "toa", "tot", "t_trigger", "tof").collect()))


def test_equals_the_run_for_shuffled_batches(spark, tmp_path):
    rng = random.Random(2)
    pair, sent, times, states = Pair(spark, tmp_path, 20_000, 700_000, "3 seconds"), [], [], []
    triggers = sorted(rng.randrange(0, 20 * SECOND) for _ in range(60))
    hits = [(rng.randint(0, 3), 1, rng.randrange(0, 20 * SECOND), 25) for _ in range(800)]
    hits += [(9, 9, triggers[5] + 30_000, 50)] * 3  # equal hits
    triggers += triggers[:4]  # and triggers
    for k in range(5):  # a batch holds four seconds, and what of the two before them comes late
        mine = lambda t: (t + (2 * SECOND if t % 3 == 0 else 0)) // (4 * SECOND) == k  # noqa: B023, E731
        a, b = [h for h in hits if mine(h[2])], [t for t in triggers if mine(t)]
        rng.shuffle(a)
        sent, times = sent + a, times + b
        pair.run(a, b)
        assert pair.dropped == 0
        states.append(pair.state)
    end = 40 * SECOND
    pair.run([(0, 0, end, 1)], [end])
    run = spark.createDataFrame(sent, HIT), spark.createDataFrame([(t,) for t in [*times, end]], TIME)
    want = correlate.live(*run, *pair.window).select("x", "y", "toa", "tot", "t_trigger", "tof")
    assert pair.got() == sorted(map(tuple, want.collect())) and len(pair.got()) > 300
    assert max(states) < 900 and pair.state < 20  # what the watermark has passed is dropped


def test_late_hits_are_dropped_and_counted(spark, tmp_path):
    pair = Pair(spark, tmp_path, 0, 1000, "1 second")
    pair.run([(1, 1, 500, 1), (1, 1, 8 * SECOND, 1)], [0, 8 * SECOND])
    assert pair.got() == [(1, 1, 500, 1, 0, 500)]
    pair.run([(2, 2, 600, 1)], [9 * SECOND])
    assert pair.dropped > 0 and pair.got() == [(1, 1, 500, 1, 0, 500)]


def test_a_hit_is_held_once_however_many_triggers_are_in_reach(spark, tmp_path):
    pair, n = Pair(spark, tmp_path, 0, 900_000, "1 second"), 400
    hits = [(k % 5, 1, 1000 * k + 500, 25) for k in range(n)]
    pair.run(hits, [1000 * k for k in range(n)])
    assert pair.state <= 2 * n + 20
    pair.run([(0, 0, 90 * SECOND, 1)], [90 * SECOND])
    assert pair.got() == sorted((*h, h[2] - 500, 500) for h in hits)

"""One query for each operator, over the virtual detector tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelflow.functions import packets as P
from pixelflow.functions.ordering import with_index
from pixelflow.operators import aggregate, cluster, correlate, decode, filters, histogram
from pixelflow.operators.histogram import Roi
from pixelflow.plans import virtual as V
from pixelflow.sources import frames, packed, processing, runs, tpx3
from pixelflow.sources.store import scratch
from pixelflow.streaming import accumulators, correlation

WINDOW = (0, 600_000_000)  # microseconds
AXIS = (0, 600_000_000, 1000)
ROIS = [Roi("early", 0, 60_000_000), Roi("middle", 50_000_000, 300_000_000), Roi("late", 300_000_001, 600_000_000)]
TICK = 3_600_000_000
EPS, LEAST_POINTS = 6.0, 1
DAY, CLEARED = 86_400_000_000, 5_000_000_000_000  # microseconds


def _primary(s, d):
    return filters.triggers_of(V.triggers(s, d), 1, 0)


def _events(s, d):
    return correlate.live(V.hits(s, d), _primary(s, d), *WINDOW)


def classify_packets(s, d):
    return decode.classify(V.packets(s, d)).groupBy(F.coalesce("kind", F.lit("other")).alias("kind"), F.col("sub").cast("int").alias("sub")).agg(F.count(F.lit(1)).alias("n"))


def decode_pixel_address(s, d):
    return decode.pixels(V.packets(s, d), ["k1", "k2"]).select("k1", "k2", "x", "y")


def decode_pixel_time(s, d):
    rows = V.packets(s, d).filter(P.kind(F.col("packet")) == "pixel")
    return rows.select("k1", "k2", P.pixel_time(F.col("packet")).alias("raw"), P.pixel_tot(F.col("packet")).alias("tot"))


def extend_timestamp(s, d):
    return decode.pixels(V.packets(s, d), ["k1", "k2"]).select("k1", "k2", "toa_ticks")


def decode_trigger(s, d):
    return decode.triggers(V.packets(s, d), ["k1", "k2"])


def ticks_to_seconds(s, d):
    p, t = decode.decode(V.packets(s, d))
    a = p.agg(F.lit("pixel").alias("stream"), F.round(F.max("toa"), 6).alias("latest"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(t.agg(F.lit("trigger").alias("stream"), F.round(F.max("toa"), 6).alias("latest"), F.count(F.lit(1)).alias("n")))


def time_range(s, d):
    return decode.time_range(V.packets(s, d).withColumn("max_ts", F.col("min_ts") + 1000))


def filter_triggers(s, d):
    return filters.triggers_of(V.triggers(s, d), 0, 0)


def primary_triggers(s, d):
    return _primary(s, d)


def correlate_live(s, d):
    return _events(s, d).select("event_id", "t_trigger", "x", "y", "tof", "tot")


def correlate_live_by_buffer(s, d):
    buffer = F.floor(F.col("toa") / 86_400_000_000).alias("buffer")
    return correlate.live(V.hits(s, d).withColumn("buffer", buffer), _primary(s, d).withColumn("buffer", buffer), *WINDOW, scope=["buffer"]).select("event_id", "buffer", "t_trigger", "tof")


def correlate_offline(s, d):
    return correlate.offline(V.hits(s, d), _primary(s, d), *WINDOW).select("event_id", "event_num", "tof")


def shot_index(s, d):
    return correlate.shot_index(_events(s, d).select("event_id", "t_trigger"), V.triggers(s, d))


def tof_correction(s, d):
    knots = s.createDataFrame([(1000.0, 0.5), (5000.0, 2.5), (12000.0, 4.0), (20000.0, 3.0)], "tof double, correction double")
    return correlate.interpolated(V.hits(s, d), knots, "tot", "c").select("event_id", F.round("c", 6).alias("correction"))


def tof_histogram(s, d):
    return histogram.spectrum(_events(s, d), "tof", *AXIS)


def toa_histogram(s, d):
    return histogram.spectrum(V.hits(s, d), "toa", 0, 40_000_000_000_000, 500)


def pixel_image(s, d):
    return histogram.image(V.hits(s, d))


def roi_images(s, d):
    return histogram.roi_images(_events(s, d), ROIS)


def roi_counts(s, d):
    return histogram.roi_counts(_events(s, d), ROIS).withColumn("yield_pct", F.round("yield_pct", 6))


def accumulator_stats(s, d):
    return histogram.stats(_events(s, d), V.hits(s, d))


def timeseries_per_shot(s, d):
    return histogram.rates(_events(s, d), TICK, ROIS).withColumn("rate", F.round("rate", 6))


def timeseries_compat(s, d):
    return histogram.rates(_events(s, d), TICK, ROIS, per="compat").withColumn("rate", F.round("rate", 9))


def series_last_n(s, d):
    return histogram.last_n(timeseries_per_shot(s, d), 20)


def running_trigger_max(s, d):
    from pyspark.sql import Window

    by = _events(s, d).groupBy(F.floor(F.col("toa") / TICK).alias("tick")).agg(F.max("t_trigger").alias("m"))
    return by.select("tick", F.max("m").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)).alias("running_max"))  # a row a tick


def stride_sample(s, d):
    batch = F.floor(F.col("toa") / 86_400_000_000).alias("batch")
    return filters.every_nth(V.hits(s, d).withColumn("batch", batch), 0.4, ["event_id"], ["batch"]).select("event_id", "batch")


def clipped_hits(s, d):
    return filters.clipped(V.hits(s, d)).select("event_id", "x", "y")


def threshold_filter(s, d):
    return filters.at_most(_events(s, d), 100_000_000).select("event_id", "tof")


def merge_triggers(s, d):
    t = V.triggers(s, d)
    return with_index(aggregate.merged(t.filter("tdc_id = 1"), t.filter("tdc_id = 2")), "toa", ["event_id"], "position").select("event_id", "toa", "position")


def shot_table(s, d):
    return aggregate.indexed_shots(_events(s, d))


def events_for_shot(s, d):
    return aggregate.events_of_shots(_events(s, d), 7, 8).select("event_id", "shot", "t_trigger")


def events_in_range(s, d):
    return aggregate.events_of_shots(_events(s, d), 10, 60).select("event_id", "shot", "t_trigger")


def absolute_times(s, d):
    return aggregate.absolute_times(_events(s, d)).select("event_id", "t_abs")


def run_summary(s, d):
    e = _events(s, d).withColumn("run", F.floor(F.col("toa") / 86_400_000_000))
    t = V.triggers(s, d).withColumn("run", F.floor(F.col("toa") / 86_400_000_000))
    return aggregate.run_summary(e, t, ["run"])


def run_status(s, d):
    o, run = V.table(s, d, "orders"), F.col("o_custkey") % 500
    recorded = (F.col("o_orderstatus") == "F") & (run % 3 == 0)  # only every third run has event files, so that some are EMPTY
    files = o.select(run.alias("run"), F.when(recorded, "events").when(F.col("o_orderstatus") == "O", "centroids").otherwise("raw").alias("kind"), (F.col("o_orderkey") % 7 * 48).alias("size"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime"))
    return aggregate.run_status(files, ["run"]).drop("newest")


def rebased_shots(s, d):
    e = _events(s, d).withColumn("file", F.col("event_id") % 4).select("event_id", "file", F.floor(F.col("t_trigger") / 1_000_000).alias("shot"))
    return aggregate.rebased(e, "shot", ["file"])


def eps_neighbours(s, d):
    p = V.points(s, d).withColumn("z", F.lit(0.0))
    return cluster.neighbours(p, EPS, ["shot"]).groupBy("shot", "pid").agg(F.count(F.lit(1)).alias("n"))


def density_labels(s, d):
    return cluster.density(V.points(s, d), EPS, LEAST_POINTS).select("shot", "pid", "cluster")


def density_in_boxes(s, d):
    """Shots of more than four points go through boxes, the others through one task each. These shots are narrow, a cell or
    a few; ``tests/test_huge_shots.py`` has wide ones."""
    return cluster.density(V.points(s, d), EPS, LEAST_POINTS, huge=4, limit=1).select("shot", "pid", "cluster")


def density_numbered(s, d):
    return filters.without_noise(cluster.numbered(cluster.density(V.points(s, d), EPS, LEAST_POINTS))).select("shot", "pid", "label")


def centroids_weighted(s, d):
    c = aggregate.weighted_centroids(cluster.density(V.points(s, d), EPS, LEAST_POINTS).filter("cluster >= 0"), ["shot", "cluster"])
    return c.select("shot", "cluster", *(F.round(x, 6).alias(x) for x in ("x", "y", "tof")), "tot")


def greedy_centroids(s, d):
    h = V.hits(s, d).withColumn("buffer", F.floor(F.col("toa") / 86_400_000_000))
    return cluster.greedy(h, 40, 900_000_000, 16, ["buffer"])


def sorted_hits(s, d):
    return with_index(V.hits(s, d), "toa", ["event_id"], "position").select("event_id", "toa", "position")


def correlate_offline_by_buffer(s, d):
    """Buffers of fewer than two triggers give nothing."""
    buffer = F.floor(F.col("toa") / TICK).alias("buffer")
    return correlate.offline(V.hits(s, d).withColumn("buffer", buffer), _primary(s, d).withColumn("buffer", buffer), *WINDOW, scope=["buffer"]).select("event_id", "buffer", "event_num", "tof")


def display_mode(s, d):
    """What each mode shows."""
    shown = [filters.shown(_events(s, d), V.hits(s, d), mode).select("event_id", F.lit(mode).alias("mode")) for mode in ("events", "pixels")]
    return shown[0].unionByName(shown[1])


def auto_clear_images(s, d):
    return histogram.cleared_images(V.hits(s, d), DAY)


def image_since_clear(s, d):
    return histogram.image(histogram.since(V.hits(s, d), CLEARED))


def _regions():
    """Regions after some have been defined, changed, renamed and removed."""
    rois = histogram.Rois()
    for r in ROIS:
        rois.add(r.name, r.low, r.high)
    rois.update("middle", 20_000_000, 200_000_000, CLEARED)
    rois.rename("early", "first")
    rois.add("gone", 0, 1)
    rois.remove("gone")
    return rois


def roi_lifecycle(s, d):
    return _regions().counts(_events(s, d))


def roi_lifecycle_images(s, d):
    return _regions().images(_events(s, d))


def single_roi(s, d):
    rois = histogram.Rois()
    rois.set_only(0, 100_000_000)
    return rois.counts(_events(s, d))


def accumulator_stats_by_roi(s, d):
    return histogram.stats(_events(s, d), V.hits(s, d), ROIS)


def coalesced_updates(s, d):
    return histogram.coalesced(V.hits(s, d), TICK, "toa", ["tot"])


def chunk_diagnostics(s, d):
    """Hits and their summed tot over every eight hourly chunks that have any."""
    chunks = V.hits(s, d).groupBy(F.floor(F.col("toa") / TICK).alias("chunk")).agg(F.count(F.lit(1)).alias("n_hits"), F.sum("tot").alias("tot"))
    return histogram.diagnostics(chunks, 8, "chunk", ["n_hits", "tot"])


def parse_frames(s, d):
    """An order's packets are a frame and a file; read back, a row for each frame that holds packets."""
    files = V.frame_files(s, d)
    return frames.frames_of(files).select("path", "frame", "min_ts", "max_ts", F.size("packets").alias("n_packets"))


def parse_packets(s, d):
    """The pixels of those frames, through bytes and back."""
    found = frames.packets_of(frames.frames_of(V.frame_files(s, d)))
    return decode.pixels(found, ["path"]).groupBy("path", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("tot").alias("tot"))


def _raw_folder(s, d):
    """The frames of all orders as raw files, many frames to a file."""
    folder = scratch(s)
    tpx3.register(s)
    V.frame_files(s, d).select("content").write.format("tpx3").option("name", "run").mode("append").save(folder)
    return folder


def _pixel_sums(found):
    return decode.pixels(frames.packets_of(found)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("tot").alias("tot"))


def split_frames(s, d):
    """Raw files whose headers are walked first, then read in ranges of whole frames."""
    return _pixel_sums(tpx3.split_frames(s, _raw_folder(s, d), 1 << 18))


def followed_frames(s, d):
    """The same files followed as a stream by byte offsets, in batches of 2 MB."""
    folder, at = _raw_folder(s, d), scratch(s)
    stream = s.readStream.format("tpx3").option("max_bytes", 2 << 20).option("split", 1 << 18).option("progress", f"{at}/progress").load(folder)
    query = stream.writeStream.format("parquet").option("path", f"{at}/frames").option("checkpointLocation", f"{at}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return _pixel_sums(s.read.schema(frames.SCHEMA).parquet(f"{at}/frames"))


def live_accumulators(s, d):
    """Image, spectrum and regions of a stream of correlated events, cleared by day: what stands after its last batch."""
    at = scratch(s)
    _events(s, d).select("x", "y", "toa", "tof", "t_trigger").withColumn("day", F.floor(F.col("toa") / DAY)).write.parquet(f"{at}/events")
    plan = accumulators.Plan(TICK, AXIS, ROIS, every=DAY, delay="3650 days")  # files come in no order of time
    stream = s.readStream.schema("x int, y int, toa long, tof long, t_trigger long").option("maxFilesPerTrigger", 4).parquet(f"{at}/events")
    query = accumulators.started(accumulators.accumulated(stream, plan), f"{at}/updates", f"{at}/checkpoint", availableNow=True)
    query.awaitTermination()
    rows = accumulators.latest(s, f"{at}/updates").filter("acc in ('image', 'spectrum', 'roi')")
    return rows.select("acc", F.col("period").alias("day"), "shard", "slot", "count")


def correlate_stream(s, d):
    """Hits and primary triggers as two streams, whose files come in no order of time; a late pair ends the run."""
    at, far = scratch(s), 3650 * DAY
    hits, triggers = V.hits(s, d).select("x", "y", "toa", "tot"), _primary(s, d).select("toa")
    last = hits.select("toa").unionByName(triggers).agg((F.coalesce(F.max("toa"), F.lit(0)) + 2 * far).alias("toa"))

    def follow():
        stream = lambda name, schema: s.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/{name}")
        made = correlation.live(stream("hits", "x int, y int, toa long, tot long"), stream("triggers", "toa long"), *WINDOW, "3650 days")
        made.writeStream.format("parquet").option("path", f"{at}/events").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    hits.write.parquet(f"{at}/hits")
    triggers.write.parquet(f"{at}/triggers")
    follow()
    last.select(F.lit(0).alias("x"), F.lit(0).alias("y"), "toa", F.lit(0).cast("long").alias("tot")).write.mode("append").parquet(f"{at}/hits")
    last.write.mode("append").parquet(f"{at}/triggers")
    follow()
    return s.read.parquet(f"{at}/events").select("x", "y", "toa", "tot", "t_trigger", "tof")


def _recorded(s, d, kind, rows, name="run"):
    """The rows through packed files and back."""
    folder = scratch(s)
    packed.register(s)
    rows.write.format("packed").option("kind", kind).option("name", name).mode("append").save(folder)
    return s.read.format("packed").option("kind", kind).option("name", name).load(folder)


def recorded_events(s, d):
    rows = filters.clipped(_events(s, d)).select(F.col("t_trigger").cast("double"), "x", "y", F.col("tof").cast("double"), "tot")
    return _recorded(s, d, "events", rows)


def recorded_pixels(s, d):
    return _recorded(s, d, "pixels", filters.clipped(V.hits(s, d)).select("x", "y", F.col("toa").cast("double"), "tot"))


def recorded_triggers(s, d):
    return _recorded(s, d, "triggers", V.triggers(s, d).select(F.col("toa").cast("double"), "tdc_id", "edge"))


def streamed_pixels(s, d):
    """The pixels as a stream of files into packed files, several writers a batch, and back."""
    at = scratch(s)
    packed.register(s)
    filters.clipped(V.hits(s, d)).select("x", "y", F.col("toa").cast("double"), "tot").repartition(8).write.parquet(f"{at}/hits")
    stream = s.readStream.schema(packed.S.schema("pixels")).option("maxFilesPerTrigger", 4).parquet(f"{at}/hits")
    writer = stream.writeStream.format("packed").option("kind", "pixels").option("name", "run").option("checkpointLocation", f"{at}/checkpoint")
    writer.trigger(availableNow=True).start(f"{at}/run").awaitTermination()
    return s.read.format("packed").option("kind", "pixels").option("name", "run").load(f"{at}/run")


def filtered_scan(s, d):
    """Pixels of a stretch of time: the blocks of sorted files that can hold them."""
    folder, clipped = scratch(s), filters.clipped(V.hits(s, d))
    packed.register(s)
    rows = clipped.select("x", "y", F.col("toa").cast("double"), "tot").repartitionByRange("toa").sortWithinPartitions("toa")
    rows.write.format("packed").option("kind", "pixels").option("name", "run").option("index", "true").mode("append").save(folder)
    return s.read.format("packed").option("kind", "pixels").load(folder).filter((F.col("toa") >= float(CLEARED)) & (F.col("toa") < float(CLEARED + 10 * DAY)))


def tofbin_scan(s, d):
    folder = scratch(s)
    recorded = _events(s, d)
    recorded = filters.clipped(recorded).select(F.col("t_trigger").cast("double"), "x", "y", F.col("tof").cast("double"), "tot")
    packed.register(s)
    recorded.write.format("packed").option("kind", "events").option("name", "a").mode("append").save(folder)
    processing.convert_events(s, folder, folder, "a")
    return s.read.format("packed").option("kind", "tofbin").load(folder)


def corrections_scan(s, d):
    """Lines of part keys and prices, and as many broken ones."""
    folder = scratch(s)
    p = V.table(s, d, "part")
    p.select(F.explode(F.array(F.concat_ws(",", "p_partkey", "p_retailprice"), F.concat(F.lit("bad "), "p_name"))).alias("value")).write.text(f"{folder}/corrections")
    return runs.read_corrections(s, f"{folder}/corrections")


def _run_folder(s, d):
    """A folder with the clustering points as two appended event files and every shot's trigger."""
    at = scratch(s)
    folder = f"{at}/run"
    packed.register(s)
    V.points(s, d).write.parquet(f"{at}/points")  # three files' rows are made of it
    p = s.read.parquet(f"{at}/points").select(F.col("shot").cast("double").alias("t_trigger"), F.col("x").cast("int"), F.col("y").cast("int"), "tof", "tot")
    for part in (p.filter("x < 20"), p.filter("x >= 20")):
        part.write.format("packed").option("kind", "events").option("name", "run").mode("append").save(folder)
    t = p.select(F.col("t_trigger").alias("toa"), F.lit(1).cast("short").alias("tdc_id"), F.lit(0).cast("short").alias("edge")).distinct()
    t.write.format("packed").option("kind", "triggers").option("name", "run").mode("append").save(folder)
    return folder


def run_events(s, d):
    """A run's events in time order, by their position."""
    events = runs.Run(s, _run_folder(s, d)).events
    return with_index(events, "t_trigger", ["x", "y", "tof", "tot"], "position").select("position", "t_trigger", "x", "y", "tot")


def merged_run(s, d):
    """Centroids of a run folder, through its merged file."""
    folder = _run_folder(s, d)
    processing.process_run(s, folder, EPS, LEAST_POINTS, 1.0)
    rows = s.read.format("packed").option("kind", "merged").load(folder)
    return rows.select("shot_index", "t_trigger", *(F.round(c, 6).alias(c) for c in ("x", "y", "tof")), "tot")


def label_files(s, d):
    """Whether each event of a run is in a cluster, through its label file."""
    folder = _run_folder(s, d)
    processing.process_run(s, folder, EPS, LEAST_POINTS, 1.0, labels=True)
    return s.read.format("packed").option("kind", "labels").load(folder).select("shot", "x", "y", "tot", (F.col("label") >= 0).alias("clustered"))


def numbered_label_files(s, d):
    """Clusters of a run by their numbers: how many, the largest, and members."""
    folder = _run_folder(s, d)
    processing.process_run(s, folder, EPS, LEAST_POINTS, 1.0, labels=True)
    kept = filters.without_noise(s.read.format("packed").option("kind", "labels").load(folder))
    return kept.agg(F.countDistinct("label").alias("n_labels"), F.max("label").cast("long").alias("largest"), F.count(F.lit(1)).alias("n_events"))


def run_folder_status(s, d):
    """Status of a processed run folder, from its files alone."""
    folder = _run_folder(s, d)
    processing.process_run(s, folder, EPS, LEAST_POINTS, 1.0)
    return aggregate.run_status(runs.listing(s, folder), ["run"]).select("run", "status", "n_centroids")


FOUND = [
    classify_packets, decode_pixel_address, decode_pixel_time, extend_timestamp, decode_trigger, ticks_to_seconds, time_range, filter_triggers, primary_triggers,
    correlate_live, correlate_live_by_buffer, correlate_offline, shot_index, tof_correction, tof_histogram, toa_histogram, pixel_image, roi_images, roi_counts,
    accumulator_stats, timeseries_per_shot, timeseries_compat, series_last_n, running_trigger_max, stride_sample, clipped_hits, threshold_filter, merge_triggers,
    shot_table, events_for_shot, events_in_range, absolute_times, run_summary, run_status, rebased_shots, eps_neighbours, density_labels, density_in_boxes, density_numbered,
    centroids_weighted, greedy_centroids,
    sorted_hits, correlate_offline_by_buffer, display_mode, auto_clear_images, image_since_clear, roi_lifecycle, roi_lifecycle_images, single_roi, accumulator_stats_by_roi,
    coalesced_updates, chunk_diagnostics, parse_frames, parse_packets, recorded_events, recorded_pixels, recorded_triggers, tofbin_scan, corrections_scan, run_events,
    merged_run, label_files, numbered_label_files, run_folder_status,
    split_frames, followed_frames, live_accumulators, correlate_stream, streamed_pixels, filtered_scan,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in FOUND}

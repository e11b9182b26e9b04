"""Detector tables made from the test tables: packets from lineitem, triggers and hits from events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelflow.functions import packets as P
from pixelflow.sources.frames import frame_bytes

EPOCH_US = 1_700_000_000_000_000  # hits' times count from here, so sums of times stay small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k1, k2 (the source row), packet and min_ts: pixel packets for return flags A and N, trigger packets for R."""
    c = F.col
    order, part, supp, line = (c(x).cast("long") for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    pixel = P.pixel_word(F.when(c("l_returnflag") == "A", 0xB).otherwise(0xA), part % 128, supp % 64, line % 8, order % 16384, (c("l_quantity").cast("long") * 7) % 1024, part % 16, (order * 13) % 65536)
    sub = F.when(line == 1, 0xF).when(line == 2, 0xA).when(line == 3, 0xE).when(line == 4, 0xB).otherwise(0xC)
    trigger = P.trigger_word(sub, (order * 7919 + part) % (1 << 35), supp % 16)
    return table(spark, sf_dir, "lineitem").select(order.alias("k1"), line.alias("k2"), F.when(c("l_returnflag") == "R", trigger).otherwise(pixel).alias("packet"), ((order * 1000003) % (1 << 40)).alias("min_ts"))


def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content: a ``.tpx3`` file of one frame for each order, its packets by line number, then value."""

    @F.arrow_udf("binary")
    def content(packets: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        rows = zip(packets.to_pylist(), low.to_pylist(), high.to_pylist())
        return pa.array([frame_bytes(p, a, b) for p, a, b in rows], pa.binary())

    by = packets(spark, sf_dir).groupBy("k1").agg(F.array_sort(F.collect_list(F.struct("k2", "packet"))).alias("p"), F.min("min_ts").alias("low"), F.max(F.col("min_ts") + 1000).alias("high"))
    return by.select(F.col("k1").cast("string").alias("path"), content(F.col("p.packet"), "low", "high").alias("content"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("toa", F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US)


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = _events(spark, sf_dir).filter(kind.isin("signup", "purchase", "error"))
    return rows.select("event_id", "toa", F.when(kind == "error", 2).otherwise(1).cast("short").alias("tdc_id"), F.when(kind == "purchase", 1).otherwise(0).cast("short").alias("edge"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).filter(F.col("event_type").isin("view", "click"))
    return rows.select("event_id", (F.col("user_id") % 300 - 20).cast("int").alias("x"), (F.col("event_id") % 256).cast("int").alias("y"), "toa", (F.round(F.col("value") * 100).cast("long") % 1024 * 25).alias("tot"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shot, pid, x, y, tof (s), tot for clustering: an order is a shot, a line number a point."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("shot"), F.col("l_linenumber").cast("long").alias("pid"))
    at = lambda c: F.min(F.col(c) % 40).cast("double")
    return rows.agg(at("l_partkey").alias("x"), at("l_suppkey").alias("y"), F.lit(0.0).alias("tof"), F.max("l_quantity").cast("long").alias("tot"))

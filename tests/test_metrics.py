import time

import pytest

from pixelflow.streaming.metrics import Throughput


def progress(batch, rows, ms, left=None, query="q"):
    return {"id": query, "name": "n", "batchId": batch, "numInputRows": rows, "durationMs": {"triggerExecution": ms}, "sources": [{"metrics": None if left is None else {"numFilesOutstanding": str(left)}}]}


def test_figures_of_a_scripted_stream():
    t = Throughput(row_bytes=8, interval=0.5)
    for p in (progress(0, 1000, 500, 7), progress(1, 3000, 1500, 4), progress(1, 3000, 1500, 4), progress(2, 0, 10, 0)):
        t.take(p)
    (of,) = t.report()
    assert (of["batches"], of["rows"], of["bytes"], of["backlog"], of["rows_per_second"], of["lag"]) == (2, 4000, 32000, 0, 0.0, 0.0)
    assert of["mean_rows_per_second"] == pytest.approx(2000) and of["mean_bytes_per_second"] == pytest.approx(16000)
    t.take(progress(3, 100, 1000, 5))
    (of,) = t.report()
    assert (of["rows_per_second"], of["backlog"], of["lag"]) == (100.0, 5, 0.5)
    t.take({"id": "other", "batchId": 0})
    assert [o["id"] for o in t.report()] == ["q", "other"] and t.report()[1]["rows_per_second"] == 0.0


def test_figures_of_a_query(spark, tmp_path):
    listener = Throughput()
    spark.streams.addListener(listener)
    try:
        for k in range(3):
            spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream.writeStream.queryName("figures").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        until = time.time() + 20
        while time.time() < until and not [o for o in listener.report() if o["id"] == str(query.id) and not o["active"]]:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    (of,) = [o for o in listener.report() if o["id"] == str(query.id)]
    assert (of["name"], of["rows"], of["batches"], of["bytes"], of["error"]) == ("figures", 30, 3, 240, None) and of["mean_rows_per_second"] > 0

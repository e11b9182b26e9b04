"""Throughput and backlog of streaming queries, from the progress that Spark reports after each micro-batch."""

from __future__ import annotations

import json
import threading
from collections import OrderedDict, deque

from pyspark.sql.streaming import StreamingQueryListener

KEPT = 100  # batches of a query
QUERIES = 64


class Throughput(StreamingQueryListener):
    """Figures of each query that runs in a session: ``spark.streams.addListener(Throughput())``.

    Rows, and bytes where a source's rows have a known ``row_bytes`` (8 for packets), in total and by second: of the last batch
    (instant), and over the batches kept (mean: rows by the seconds of their triggers). ``backlog``: what the sources say
    is left, as their metrics ``numFilesOutstanding``, ``numBytesOutstanding`` or ``maxOffsetsBehindLatest``, in that unit; zero where none is told.
    ``lag``: seconds that the last batch took beyond its trigger's interval, from ``interval``, zero without one. A batch that comes again after a
    restart, under its number, counts once. Progress without rows moves the instant rate to zero only."""

    def __init__(self, row_bytes: int = 8, interval: float = 0.0):
        self.row_bytes, self.interval = row_bytes, interval
        self._lock, self._queries = threading.Lock(), OrderedDict()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self._lock:
            self._of(str(event.id), event.name)["active"] = True

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.take(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        with self._lock:
            self._of(str(event.id))["instant"] = 0.0

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            of = self._of(str(event.id))
            of["active"], of["error"], of["instant"] = False, event.exception, 0.0

    def _of(self, query: str, name: str | None = None) -> dict:
        new = {"name": None, "active": True, "error": None, "rows": 0, "batches": 0, "last": -1, "instant": 0.0, "backlog": 0, "lag": 0.0, "kept": deque(maxlen=KEPT)}
        of = self._queries.setdefault(query, new)
        of["name"] = name or of["name"]
        while len(self._queries) > QUERIES:
            self._queries.popitem(last=False)
        return of

    def take(self, progress: dict) -> None:
        """A batch's progress, as Spark's JSON has it."""
        seconds = progress.get("durationMs", {}).get("triggerExecution", 0) / 1000
        rows, batch = progress.get("numInputRows", 0), progress["batchId"]
        told = [m.get(k) for s in progress.get("sources", []) for m in [s.get("metrics") or {}] for k in ("numBytesOutstanding", "numFilesOutstanding", "maxOffsetsBehindLatest")]
        with self._lock:
            of = self._of(progress["id"], progress.get("name"))
            of["backlog"] = sum(int(float(v)) for v in told if v is not None)
            of["instant"] = rows / seconds if seconds else 0.0
            of["lag"] = max(0.0, seconds - self.interval) if self.interval else 0.0
            if rows and batch > of["last"]:
                of["rows"], of["batches"], of["last"] = of["rows"] + rows, of["batches"] + 1, batch
                of["kept"].append((rows, seconds))

    def report(self) -> list[dict]:
        """A dictionary for each query, in the order in which they were first seen."""
        with self._lock:
            out = []
            for query, of in self._queries.items():
                seconds = sum(s for _, s in of["kept"])
                mean = sum(r for r, _ in of["kept"]) / seconds if seconds else 0.0
                out.append({"id": query, "name": of["name"], "active": of["active"], "error": of["error"], "batches": of["batches"], "rows": of["rows"], "bytes": of["rows"] * self.row_bytes,
                            "rows_per_second": of["instant"], "mean_rows_per_second": mean, "bytes_per_second": of["instant"] * self.row_bytes, "mean_bytes_per_second": mean * self.row_bytes, "backlog": of["backlog"], "lag": of["lag"]})
            return out

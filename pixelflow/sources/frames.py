"""Raw ``.tpx3`` streams: frames of packets in files, and the way from bytes to packets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelflow import schemas as S

TIME_MASK = (1 << 54) - 1
PATTERN = struct.pack("<I", S.FRAME_SIGNATURE)


def walk(raw: bytes) -> tuple[list[tuple[int, int, int, np.ndarray]], int]:
    """Frames (offset, min_ts, max_ts, packets) of a buffer, and where its unread rest starts.

    Stops at a wrong signature, a body of no or broken words, or a body that is not complete yet. Bodies of five words
    or fewer hold no packets; else the first word and the last three are not data."""
    words = np.frombuffer(raw, "<u8", len(raw) // 8)
    out, at = [], 0
    while at < len(words):
        head = int(words[at])
        size = head >> 48
        n = size // 8
        if head & 0xFFFFFFFF != S.FRAME_SIGNATURE or size == 0 or size % 8 or at + 1 + n > len(words):
            break
        body = words[at + 1 : at + 1 + n]
        if n > 5:
            out.append((at * 8, int(body[n - 2]) & TIME_MASK, int(body[n - 1]) & TIME_MASK, body[1 : n - 3]))
        at += 1 + n
    return out, at * 8


def split_at_last_frame(buffer: bytes) -> tuple[bytes, bytes]:
    """(what is complete, what to carry): cut before the last signature that starts a frame."""
    at = buffer.rfind(PATTERN)
    return (buffer, b"") if at < 0 else (buffer[:at], buffer[at:])


def frame_bytes(packets: list[int], min_ts: int, max_ts: int) -> bytes:
    """A frame that holds the packets; the inverse of ``walk`` for tests and made-up streams."""
    body = [0, *packets, 0, min_ts, max_ts]
    return struct.pack(f"<{len(body) + 1}Q", len(body) * 8 << 48 | S.FRAME_SIGNATURE, *(p & (1 << 64) - 1 for p in body))


def reframed(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks of a byte stream, cut anew so that each starts with a frame and holds whole ones: what follows the last frame's
    start waits for the next chunk, and the rest comes at the end."""
    carried = b""
    for chunk in chunks:
        whole, carried = split_at_last_frame(carried + chunk)
        if whole:
            yield whole
    if carried:
        yield carried


def unread(files: DataFrame) -> DataFrame:
    """path and bytes at each file's end that are no whole frame: a file that was cut short, or one that goes on in another."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rest = [len(raw := c.as_py()) - walk(raw)[1] for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rest, pa.int64())], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long").filter("bytes > 0")


SCHEMA = "path string, frame long, min_ts long, max_ts long, packets array<long>"


def frame_batches(path: str, raw: bytes, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of the frames of a buffer that stands at byte ``first`` of a file, 4096 at a time."""
    found, _ = walk(raw)
    for k in range(0, len(found), 4096):
        part = found[k : k + 4096]
        packets = pa.array([f[3].view(np.int64) for f in part], pa.list_(pa.int64()))
        numbers = [pa.array([first + f[0] for f in part], pa.int64()), *(pa.array([f[i] for f in part], pa.int64()) for i in (1, 2))]
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), *numbers, packets], ["path", "frame", "min_ts", "max_ts", "packets"])


def frames_of(files: DataFrame) -> DataFrame:
    """Frames of ``files`` (path, content), batch or stream. A file held as a value is walked by one task;
    ``tpx3`` splits files."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                yield from frame_batches(path, raw.as_py())

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def packets_of(frames: DataFrame) -> DataFrame:
    return frames.select("path", "frame", "min_ts", "max_ts", F.posexplode("packets").alias("pos", "packet"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all ``.tpx3`` files under a path."""
    return packets_of(frames_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.tpx3").option("recursiveFileLookup", "true").load(path)))

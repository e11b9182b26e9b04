"""Raw ``.tpx3`` files as a Spark data source: split batch reads, a byte-offset stream, and the raw sink.

``spark.read.format("tpx3").load(folder)`` gives the frames of every file. The planner walks the headers by seeking, eight bytes a
frame, files in parallel, and deals ranges of whole frames of at most ``split`` bytes (8 MB) to tasks, so one large file is read
by many of them. A file ends at its first broken header, as in ``frames.walk``. For folders whose headers are too many for one
planner ``split_frames`` walks them in a Spark job, a file a task, and reads the ranges in another.

``spark.readStream.format("tpx3").load(folder)`` follows a folder to which files are added, the last of which may still grow. The
files, by name, are one stream of bytes: a frame that has been written in part waits, and one that goes on in the next file is read
from both. A tail that the next file doesn't go on with (it starts with a signature of its own) is given up, as is what
follows a broken header, up to the next file. The offset is the file and byte of the first frame that isn't read, so a restart
goes on there and no frame comes twice or is lost. ``max_bytes`` (10,000,000) cuts batches, their trigger gives the time. ``progress``,
a folder of the query's own, keeps the position that was planned last: the first batch after a restart then knows where it starts and
is cut too; without it, that batch takes all there is. Later files must sort behind earlier ones.

Writing takes a ``content`` column of whole frames and makes one file for each task, ``<name>.tpx3`` or ``<name>_raw<i>.tpx3``,
under its name when the job commits."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from pixelflow import schemas as S
from pixelflow.sources import files, frames, store

SPLIT, MAX_BYTES = 8 << 20, 10_000_000
SUFFIX = ".tpx3"
THREADS = 16


class Broken(Exception):
    """A header that starts no frame."""


def frame_size(header: bytes) -> int:
    """Bytes of the frame that a header of eight bytes starts, the header included."""
    head = struct.unpack("<Q", header)[0]
    size = head >> 48
    if head & 0xFFFFFFFF != S.FRAME_SIGNATURE or size == 0 or size % 8:
        raise Broken
    return 8 + size


class Feed:
    """Files, in their order, as one stream of frames: a walk over headers from a position on.

    ``joined``: a frame may go on in the next file; else each file stands for itself."""

    def __init__(self, listed: list[tuple[str, int]], joined: bool):
        self.files, self.joined, self.held = listed, joined, {}

    def bytes_at(self, k: int, at: int, n: int) -> bytes:
        if k not in self.held:
            self.close()
            fs, inner = files.at(self.files[k][0])
            self.held = {k: fs.open_input_file(inner)}
        self.held[k].seek(at)
        return self.held[k].read(n)

    def close(self) -> None:
        for f in self.held.values():
            f.close()
        self.held = {}

    def span(self, k: int, at: int, n: int) -> list[tuple[int, int, int]] | None:
        """Pieces (file, start, stop) of the ``n`` bytes from (k, at) on; None if they aren't all there yet. Broken if another file
        comes before they are complete and starts anew."""
        out = []
        while True:
            size = self.files[k][1]
            out.append((k, at, min(size, at + n)))
            n -= out[-1][2] - at
            if n == 0:
                return [p for p in out if p[1] < p[2]]
            if k + 1 == len(self.files):
                return None
            if not self.joined:
                raise Broken
            if self.files[k + 1][1] < 4:
                return None
            if self.bytes_at(k + 1, 0, 4) == frames.PATTERN:
                raise Broken
            k, at = k + 1, 0

    def walk(self, k: int, at: int) -> Iterator[tuple[list[tuple[int, int, int]], int, int]]:
        """Pieces of each complete frame from (k, at) on, and the position after it. A step without pieces is a move to the next file."""
        while k < len(self.files):
            try:
                if at == self.files[k][1]:
                    raise Broken  # nothing is left: on to the next file, if there is one
                header = self.span(k, at, 8)
                whole = header and self.span(k, at, frame_size(b"".join(self.bytes_at(f, a, b - a) for f, a, b in header)))
            except Broken:
                if k + 1 == len(self.files):
                    return
                k, at = k + 1, 0
                yield [], k, at
                continue
            if not whole:
                return
            k, at = whole[-1][0], whole[-1][2]
            yield whole, k, at


@dataclass
class Range(InputPartition):
    """Whole frames: pieces (path, start, stop) of files, more than one only for a frame that lies in several."""

    pieces: list

    def __init__(self, pieces: list):
        super().__init__(pieces)
        self.pieces = pieces


def ranges(feed: Feed, k: int, at: int, end: tuple[int, int] | None, split: int) -> list[list[tuple[str, int, int]]]:
    """Ranges of at most ``split`` bytes (one frame at least) of the complete frames from (k, at) on, up to ``end``."""
    out, named = [], lambda f: feed.files[f][0]
    for pieces, k2, at2 in feed.walk(k, at) if (k, at) != end else ():
        if len(pieces) == 1 and out and len(out[-1]) == 1 and out[-1][0][0] == named(pieces[0][0]) and out[-1][0][2] == pieces[0][1] and pieces[0][2] - out[-1][0][1] <= split:
            out[-1] = [(out[-1][0][0], out[-1][0][1], pieces[0][2])]
        elif pieces:
            out.append([(named(f), a, b) for f, a, b in pieces])
        if end and (k2, at2) >= end:
            break
    feed.close()
    return out


def batches(pieces: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
    """Frames of a range; ``frame`` is the byte at which it starts in ``path``."""
    raw = b"".join(files.read(*p) for p in pieces)
    yield from frames.frame_batches(pieces[0][0], raw, pieces[0][1])


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.recursive = options.get("recursive", "true").lower() == "true"

    def partitions(self):
        each = lambda f: ranges(Feed([f], False), 0, 0, None, self.split)
        with ThreadPoolExecutor(THREADS) as pool:
            found = list(pool.map(each, files.listed(self.path, SUFFIX, self.recursive)))
        return [Range(r) for per_file in found for r in per_file] or [Range([])]

    def read(self, partition):
        if partition.pieces:
            yield from batches(partition.pieces)


class StreamReader(DataSourceStreamReader):
    """Offsets are {"file", "at"}; the empty name stands before all files."""

    def __init__(self, options):
        self.path, self.split, self.most = options["path"], int(options.get("split", SPLIT)), int(options.get("max_bytes", MAX_BYTES))
        self.progress, self.known = options.get("progress"), None
        if self.progress and files.exists(f"{self.progress}/planned"):
            self.known = json.loads(files.read(f"{self.progress}/planned", 0, 1 << 16))

    def initialOffset(self):
        return {"file": "", "at": 0}

    def _feed(self, start: dict) -> tuple[Feed, int, int]:
        """The files from the offset's on, and its place among them."""
        name = lambda path: path.rsplit("/", 1)[-1]
        found = [f for f in files.listed(self.path, SUFFIX) if name(f[0]) >= start["file"]]
        there = bool(found) and name(found[0][0]) == start["file"]
        return Feed(found, True), 0, start["at"] if there else 0

    def _offset(self, feed: Feed, k: int, at: int) -> dict:
        return {"file": feed.files[k][0].rsplit("/", 1)[-1], "at": at}

    def latestOffset(self):
        start = self.known or self.initialOffset()
        feed, k, at = self._feed(start)
        out, taken = start, 0
        for pieces, k, at in feed.walk(k, at):
            taken += sum(b - a for _, a, b in pieces)
            if self.known and taken > self.most and pieces and out != start:
                break
            out = self._offset(feed, k, at)
        feed.close()
        self.known = out
        return out

    def partitions(self, start, end):
        self.known = end
        if self.progress:  # before the batch runs; a batch that is planned again is the first call after a restart
            files.folder(self.progress)
            made = f"{self.progress}/.planned-{uuid.uuid4().hex}"
            with files.opened(made) as f:
                f.write(json.dumps(end).encode())
            files.moved(made, f"{self.progress}/planned")
        if start == end:
            return []
        feed, k, at = self._feed(start)
        names = [p.rsplit("/", 1)[-1] for p, _ in feed.files]
        return [Range(r) for r in ranges(feed, k, at, (names.index(end["file"]), end["at"]), self.split)]

    def read(self, partition):
        yield from batches(partition.pieces)


@dataclass
class Written(WriterCommitMessage):
    parts: list


class RawWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.name, self.overwrite, self.job = options["path"], options.get("name", "run"), overwrite, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        context, n = TaskContext.get(), 0
        part = f"{self.path}/.{self.job}-{uuid.uuid4().hex}"
        files.folder(self.path)
        with files.opened(part) as f:
            for b in iterator:
                for content in b.column("content"):
                    f.write(content.as_py() or b"")
                    n += len(content.as_py() or b"")
        return Written([(context.partitionId() if context else 0, part, n)])

    def commit(self, messages):
        parts = sorted(p for m in messages if m for p in m.parts)
        full = [path for _, path, n in parts if n]
        there = [p for p, _ in files.listed(self.path, SUFFIX) if p.rsplit("/", 1)[-1].startswith(self.name)]
        first = 0 if self.overwrite else len(there)
        targets = [f"{self.path}/{self.name}" + (f"_raw{first + k:06d}" if first or len(full) > 1 else "") + SUFFIX for k in range(len(full))]
        for path, target in zip(full, targets):
            files.moved(path, target)
        for _, path, n in parts:
            if not n:
                files.removed(path)
        if self.overwrite:
            for path in there:
                if path.rsplit("/", 1)[-1] not in {t.rsplit("/", 1)[-1] for t in targets}:
                    files.removed(path)

    def abort(self, messages):
        for m in messages:
            for _, path, _ in m.parts if m else ():
                files.removed(path)


class Tpx3(DataSource):
    @classmethod
    def name(cls):
        return "tpx3"

    def schema(self):
        return frames.SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)

    def writer(self, schema, overwrite):
        return RawWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tpx3)


RANGE = "path string, start long, stop long"


def index(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """path, start and stop of ranges of whole frames; files are dealt one by one to tasks, which read headers only."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", "true").load(folder).select("path", "length")

    def run(rows):
        for b in rows:
            found = [r[0] for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in ranges(Feed([(path, size)], False), 0, 0, None, split)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "start", "stop"])

    return listing.mapInArrow(run, RANGE)


def split_frames(spark: SparkSession, folder: str, split: int = SPLIT, tasks: int | None = None) -> DataFrame:
    """Frames of all files under a folder, any number of tasks to a file. The index is written, so it is made once."""
    at = store.scratch(spark)
    index(spark, folder, split).write.parquet(at)
    found = spark.read.schema(RANGE).parquet(at)
    n = max(1, min(found.count(), tasks or 100_000))

    def run(rows):
        for b in rows:
            for piece in zip(*(c.to_pylist() for c in b.columns)):
                yield from batches([piece])

    return found.repartition(n).mapInArrow(run, frames.SCHEMA)

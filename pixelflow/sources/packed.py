"""Packed fixed-width record files as a Spark data source, to read and to write.

``spark.read.format("packed").option("kind", "events").load(dir)`` reads every file of the kind under a local or shared
folder, split at record bounds; a partial record at the end is ignored. Options: ``name`` reads one run's files only,
``recursive`` (true) goes into subfolders.

Records are filtered by their blocks: with option ``index``, writers leave beside each file the least and greatest value of every
column in each block of BLOCK records (``.<file>.index``). A comparison of a column with a number (``pushFilters``) then reads the blocks that can hold it,
which in files sorted by time are few; files without an index, or with one of another size, are read whole. Spark still applies
the filter.

Writing gives a file for each task, which appears under its name only when its job commits, so a lost or repeated task
leaves nothing behind. Options: ``name`` of the run; ``saver``, the number of a writer whose file is replaced when it
writes again. Append takes the next free numbers and never touches a file; overwrite replaces the files of the very run
(``name`` with or without a number). ``write_single`` makes one file of all rows, in their order, without a byte of it in the driver.

A stream writes exactly once (``writeStream.format("packed")``, or option ``batch`` in foreachBatch): the files of a batch get numbers
of their own, one for each task that has rows, and the batch is done when its entry in ``_commits`` is there. A batch that comes again
after that is discarded; one whose commit was interrupted has its files removed first. A name belongs to one stream."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from pixelflow import schemas as S
from pixelflow.sources import files, store

SPLIT_RECORDS = 1 << 20
BLOCK = 1 << 14  # records of an index's entry
PER_BATCH = 100_000  # numbers of a batch's files
COPY = 1 << 20  # bytes that are copied at a time


def dtype(kind: str) -> np.dtype:
    return np.dtype([(n, "<" + c if c != "u1" else c) for n, c, _ in S.LAYOUTS[kind]])


def suffix(kind: str) -> str:
    return S.SUFFIXES.get(kind, {"centroids": ".datbin", "merged": "_centroids.datbin", "tofbin": ".tofbin", "labels": ".toflabels"}.get(kind, ".dat"))


@dataclass
class Split(InputPartition):
    path: str
    first: int
    n: int

    def __init__(self, path: str, first: int, n: int):
        super().__init__((path, first, n))
        self.path, self.first, self.n = path, first, n


@dataclass
class Written(WriterCommitMessage):
    parts: list


def _local(path: str) -> Path:
    return Path(path.removeprefix("file://").removeprefix("file:"))


def files_of(folder: Path, kind: str, name: str | None = None, recursive: bool = False) -> list[Path]:
    """The kind's files in a folder, of one run or all."""
    found = sorted(f for f in (folder.rglob if recursive else folder.glob)("*" + suffix(kind)) if f.is_file() and not any(p[0] == "." for p in f.relative_to(folder).parts))
    if kind == "centroids":  # whose suffix ends those of merged files too
        found = [f for f in found if not f.name.endswith(suffix("merged"))]
    return found if name is None else [f for f in found if _is_of(f.name, name, kind)]


def _is_of(file_name: str, name: str, kind: str) -> bool:
    return re.fullmatch(re.escape(name) + r"(_saver\d+)?" + re.escape(suffix(kind)), file_name) is not None


def index_of(path: Path) -> Path:
    return path.with_name(f".{path.name}.index")


class Index:
    """Least and greatest values of a file's blocks, and the file's size, as JSON lines: a small file."""

    @staticmethod
    def entry(rows: np.ndarray) -> list:
        """The bounds of a block by column; a column with a NaN has none."""
        return [None if len(v) == 0 or v.dtype.kind == "f" and np.isnan(v).any() else [v.min().item(), v.max().item()] for v in (rows[n] for n in rows.dtype.names)]

    @staticmethod
    def read(path: Path, size: int) -> list | None:
        at = index_of(path)
        if not at.exists():
            return None
        head, *entries = map(json.loads, at.read_text().splitlines())
        return entries if head == size else None


#: Whether a block from low to high can hold a value for which the filter is true.
MAY = {
    EqualTo: lambda low, high, v: low <= v <= high, GreaterThan: lambda low, high, v: high > v, GreaterThanOrEqual: lambda low, high, v: high >= v,
    LessThan: lambda low, high, v: low < v, LessThanOrEqual: lambda low, high, v: low <= v,
}


class Reader(DataSourceReader):
    def __init__(self, options):
        self.kind, self.path, self.name = options["kind"], _local(options["path"]), options.get("name")
        self.recursive, self.filters = options.get("recursive", "true").lower() == "true", []

    def pushFilters(self, filters):
        names = dtype(self.kind).names
        self.filters = [f for f in filters if type(f) in MAY and len(f.attribute) == 1 and f.attribute[0] in names and isinstance(f.value, (int, float))]
        yield from filters  # blocks are chosen by them; rows are not

    def _ranges(self, path: Path, n: int, size: int):
        """First record and number of the file's stretches that can hold rows."""
        entries = Index.read(path, size) if self.filters else None
        if entries is None:
            return [(0, n)] if n else []
        names, out = dtype(self.kind).names, []
        for k, bounds in enumerate(entries):
            first, stop = k * BLOCK, min(n, (k + 1) * BLOCK)
            if all(bounds[at] is None or MAY[type(f)](*bounds[at], f.value) for f in self.filters for at in [names.index(f.attribute[0])]):
                if out and sum(out[-1]) == first:
                    out[-1] = (out[-1][0], stop - out[-1][0])
                else:
                    out.append((first, stop - first))
        return out

    def partitions(self):
        width, out = dtype(self.kind).itemsize, []
        for f in [self.path] if self.path.is_file() else files_of(self.path, self.kind, self.name, self.recursive):
            size = f.stat().st_size
            for first, n in self._ranges(f, size // width, size):
                out += [Split(str(f), at, min(SPLIT_RECORDS, first + n - at)) for at in range(first, first + n, SPLIT_RECORDS)]
        return out or [Split("", 0, 0)]

    def read(self, split):
        kind = dtype(self.kind)
        rows = np.fromfile(split.path, kind, split.n, offset=split.first * kind.itemsize) if split.n else np.zeros(0, kind)
        types = {"f8": pa.float64(), "u2": pa.int32(), "u4": pa.int64(), "u1": pa.int16(), "u8": pa.int64()}
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            cols = [pa.array(part[n].astype(types[c].to_pandas_dtype())) for n, c, _ in S.LAYOUTS[self.kind]]
            yield pa.RecordBatch.from_arrays(cols, [n for n, _, _ in S.LAYOUTS[self.kind]])


class _Parts:
    """What a batch and a stream writer share: a task's rows go to a hidden file, with its blocks' bounds."""

    def __init__(self, options):
        self.kind, self.path, self.name = options["kind"], _local(options["path"]), options.get("name", "run")
        self.job, self.index = uuid.uuid4().hex, options.get("index", "false").lower() == "true"

    def write(self, batches):
        from pyspark import TaskContext

        kind, part, n = dtype(self.kind), self.path / f".{self.job}-{uuid.uuid4().hex}", 0
        self.path.mkdir(parents=True, exist_ok=True)
        held, entries = np.zeros(0, kind), []
        with open(part, "wb") as f:
            for b in batches:
                rows = np.empty(b.num_rows, kind)
                for name in kind.names:
                    column = b.column(name)
                    if column.null_count:
                        raise ValueError(f"a packed record has no place for a null {name}")
                    values = column.to_numpy(zero_copy_only=False)
                    if kind[name].kind == "u" and len(values) and not 0 <= values.min() <= values.max() <= np.iinfo(kind[name]).max:
                        raise ValueError(f"{name} is out of the range of {kind[name]}")
                    rows[name] = values
                f.write(rows.tobytes())
                n += len(rows)
                if self.index:
                    held = np.concatenate([held, rows])
                    whole = len(held) // BLOCK * BLOCK
                    entries += [Index.entry(held[k : k + BLOCK]) for k in range(0, whole, BLOCK)]
                    held = held[whole:]
        if self.index:
            entries += [Index.entry(held)] if len(held) else []
            index_of(part).write_text("\n".join(map(json.dumps, [n * kind.itemsize, *entries])))
        context = TaskContext.get()
        return Written([(context.partitionId() if context else 0, str(part), n > 0)])

    def _file(self, number: int | None) -> Path:
        return self.path / f"{self.name}{'' if number is None else f'_saver{number}'}{suffix(self.kind)}"

    def _full(self, messages) -> list[Path]:
        """The parts that have rows, by partition; the others go."""
        parts = sorted(p for m in messages if m for p in m.parts)
        for _, path, kept in parts:
            if not kept:
                _gone(Path(path))
        return [Path(path) for _, path, kept in parts if kept]

    def commit_batch(self, messages, batch: int) -> None:
        full, log = self._full(messages), self.path / "_commits" / f"{self.name}{suffix(self.kind)}"
        if (log / f"{batch}.json").exists():  # it was written before; this is the same again
            for path in full:
                _gone(path)
            return
        if len(full) > PER_BATCH:
            raise ValueError(f"a batch has {PER_BATCH} files at most")
        first = batch * PER_BATCH
        for path in files_of(self.path, self.kind, self.name):
            number = re.search(r"_saver(\d+)" + re.escape(suffix(self.kind)) + "$", path.name)
            if number and first <= int(number[1]) < first + PER_BATCH:  # of a commit that was interrupted
                _gone(path)
        targets = [self._file(first + k) for k in range(len(full))]
        for path, target in zip(full, targets):
            _placed(path, target)
        log.mkdir(parents=True, exist_ok=True)
        made = log / f".{self.job}"
        made.write_text(json.dumps([t.name for t in targets]))
        os.replace(made, log / f"{batch}.json")

    def _aborted(self) -> None:
        for p in self.path.glob(f".{self.job}-*"):
            _gone(p)
        for p in self.path.glob(f"..{self.job}-*"):
            p.unlink(missing_ok=True)


def _gone(path: Path) -> None:
    path.unlink(missing_ok=True)
    index_of(path).unlink(missing_ok=True)


def _placed(path: Path, target: Path) -> None:
    """A part under its name. The old file's index goes first, so none ever stands for another file of the same size."""
    index_of(target).unlink(missing_ok=True)
    os.replace(path, target)
    _index_placed(path, target)


def _index_placed(path: Path, target: Path) -> None:
    if index_of(path).exists():
        os.replace(index_of(path), index_of(target))


class Writer(_Parts, DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        super().__init__(options)
        self.overwrite, self.saver, self.batch = overwrite, options.get("saver"), options.get("batch")

    def commit(self, messages):
        if self.batch is not None:
            self.commit_batch(messages, int(self.batch))
            return
        full = self._full(messages)
        if self.saver is not None and len(full) > 1:
            raise ValueError("a numbered saver writes one partition")
        if self.overwrite or self.saver is not None:
            old = [self._file(int(self.saver))] if self.saver is not None else files_of(self.path, self.kind, self.name)
            targets = [self._file(int(self.saver) if self.saver is not None else k if len(full) > 1 else None) for k in range(len(full))]
            for path, target in zip(full, targets):
                _placed(path, target)
            for path in old:  # what the new files didn't replace goes after they are in place
                if path not in targets:
                    _gone(path)
            return
        number = None if len(full) == 1 and not files_of(self.path, self.kind, self.name) else 0
        for path in full:
            while True:
                try:
                    os.link(path, self._file(number))  # unlike a rename, a link never replaces a file
                    break
                except FileExistsError:
                    number = 0 if number is None else number + 1
            _index_placed(path, self._file(number))
            os.unlink(path)
            number = 0 if number is None else number + 1

    def abort(self, messages):
        self._aborted()


class StreamWriter(_Parts, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId):
        self.commit_batch(messages, batchId)

    def abort(self, messages, batchId):
        self._aborted()


class Packed(DataSource):
    @classmethod
    def name(cls):
        return "packed"

    def schema(self):
        return S.schema(self.options["kind"])

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Packed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_single(rows: DataFrame, kind: str, folder: str, name: str) -> int:
    """One file ``<name><suffix>`` of all rows, in the order of their partitions; returns its number of records.

    Each task writes its own part; the parts' sizes, summed up, say where each belongs, and a second job's tasks copy them
    to their places in a file of the final length, which then takes its name. A copy that is repeated writes the same bytes.
    Where a store has no writes in the middle of a file, its own concatenation joins the parts."""
    spark, target = rows.sparkSession, f"{folder}/{name}{suffix(kind)}"
    register(spark)
    parts = f"{folder}/.parts-{uuid.uuid4().hex}"
    rows.write.format("packed").option("kind", kind).option("name", name).mode("overwrite").save(parts)
    number = lambda path: int((re.search(r"_saver(\d+)\D*$", path) or ["", "0"])[1])
    found = sorted(files.listed(parts, suffix(kind)), key=lambda f: number(f[0]))
    places, total = [], 0
    for path, size in found:
        places.append((path, total))
        total += size
    whole = f"{folder}/.{uuid.uuid4().hex}-whole"
    if not store.is_local(spark, folder):
        store.concatenated(spark, [p for p, _ in places], whole)
    else:
        local = _local(whole)
        with open(local, "wb") as f:
            f.truncate(total)
        if places:
            spark.createDataFrame(places, "path string, at long").repartition(len(places)).mapInArrow(_copier(str(local)), "bytes long").agg({"bytes": "sum"}).collect()
    if store.is_local(spark, folder):
        index_of(_local(target)).unlink(missing_ok=True)
        os.replace(_local(whole), _local(target))
    else:
        store.renamed(spark, whole, target)
    store.remove(spark, parts)
    return total // dtype(kind).itemsize


def _copier(whole: str):
    def run(batches):
        for b in batches:
            n = 0
            for path, at in zip(*(c.to_pylist() for c in b.columns)):
                with open(path, "rb") as source, open(whole, "r+b") as out:
                    out.seek(at)
                    while piece := source.read(COPY):
                        out.write(piece)
                        n += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["bytes"])

    return run

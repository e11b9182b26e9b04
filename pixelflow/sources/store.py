"""Files in whatever store a path names, through Hadoop's file systems: small driver-side work only."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def is_local(spark: SparkSession, path: str) -> bool:
    """Whether a path lies in a mounted folder, where files can be written at any place."""
    return _at(spark, path)[0].getScheme() == "file"


def renamed(spark: SparkSession, source: str, target: str) -> None:
    """Replaces the target."""
    fs, p = _at(spark, target)
    fs.delete(p, False)
    if not fs.rename(_at(spark, source)[1], p):
        raise OSError(f"{source} can't be renamed to {target}")


def concatenated(spark: SparkSession, parts: list[str], target: str) -> None:
    """One file of the parts, joined by the store itself, which takes them; stores that can't do so say so with an error."""
    fs, p = _at(spark, target)
    if not parts:
        fs.create(p, True).close()
        return
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rest = gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
    for k, part in enumerate(parts[1:]):
        rest[k] = jvm.org.apache.hadoop.fs.Path(part)
    first = jvm.org.apache.hadoop.fs.Path(parts[0])
    if len(parts) > 1:
        fs.concat(first, rest)
    fs.rename(first, p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see, under spark.checkpoint.dir; a temporary one only in local mode. It is removed
    when the driver's Python ends."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pixelflow-")
    path = f"{found.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    atexit.register(_swept, spark, path)
    return path


def _swept(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone by now; the folder is then left to its owner
        pass

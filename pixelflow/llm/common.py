"""Helpers shared by the training-data operators: shared storage, package shipping, column defaults."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, by the contracts of the word-based operators: a run of anything but these six ASCII separators.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_PATTERN = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see, from spark.checkpoint.dir; a temporary one only in local mode."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + _local_folder()
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


_LOCAL: list[str] = []


def _local_folder() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="pixelflow-"))
    return _LOCAL[0]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    The table is removed by ``free``, else when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pixelflow_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove materialized tables before the driver ends: only when everything that reads them has itself been written."""
    for t in tables:
        _remove(t.sparkSession, t._pixelflow_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone by now; the folder is then left to its owner
        pass


#: Rows of an Arrow batch sent to Python, where the session has Spark's own default: texts are long, so a batch of 10,000
#: holds tens of MB, several times over on both sides of the socket.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each application, and keep Arrow batches of texts small."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_pixelflow_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="pixelflow-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(archive))
    sc._pixelflow_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of ``text`` in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR_PATTERN), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row: as a lambda's variable it can't be inlined where it is used,
    which inside another lambda would compute it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

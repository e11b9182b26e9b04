"""Post-processing of recorded runs to files: centroids, labels, and the intermediate tables of single files.

    python -m pixelflow.sources.processing RUN_FOLDER [--epsilon 2] [--tof-threshold 2e-4] [--min-points 1] ..."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelflow import schemas as S
from pixelflow.operators import aggregate, cluster
from pixelflow.sources import packed, runs, store


def tofbin(events: DataFrame) -> DataFrame:
    """Events as the records that clustering takes: all doubles, the trigger time as ``shot``."""
    return events.select(F.col("t_trigger").cast("double").alias("shot"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "tof", "tot")))


def convert_events(spark: SparkSession, source: str, folder: str, name: str) -> int:
    """An events file as one ``.tofbin``; returns its number of rows, and writes nothing for none."""
    packed.register(spark)
    rows = tofbin(spark.read.format("packed").option("kind", "events").load(source))
    return packed.write_single(rows, "tofbin", folder, name) if rows.limit(1).count() else 0


def _write(rows: DataFrame, kind: str, folder: Path, name: str) -> Path:
    """One file in the order of the rows; no rows make an empty one."""
    fields = [F.col(n).cast(t).alias(n) for n, _, t in S.LAYOUTS[kind]]
    packed.write_single(rows.select(*fields), kind, str(folder), name)
    return folder / f"{name}{packed.suffix(kind)}"


def process_run(spark: SparkSession, folder: str, epsilon: float = 2.0, min_points: int = 1, tof_threshold: float = 2e-4, correction: str | None = None, labels: bool = False, force: bool = False, output: str | None = None) -> dict:
    """Centroids of all event files of a run folder as ``<folder>_centroids.datbin``, by shot; with ``labels`` also every
    event's cluster as ``<folder>.toflabels``. What is there already is kept unless ``force``. Triggers come from the run's
    trigger files; without any, the events' own trigger times number the shots. Events whose time is no trigger's are an error, as they have no shot."""
    run = runs.Run(spark, folder)
    out = Path(output) if output else run.folder
    made = out / f"{run.folder.name}{packed.suffix('merged')}"
    if not packed.files_of(run.folder, "events"):
        raise FileNotFoundError(f"no event files in {folder}")
    if made.exists() and not force:
        return {"run": run.folder.name, "path": str(made), "n_centroids": made.stat().st_size // packed.dtype("merged").itemsize, "made": False}
    knots = runs.read_corrections(spark, correction) if correction else None
    events = run.rows("events")
    triggers = run.rows("triggers") if packed.files_of(run.folder, "triggers") else events.select(F.col("t_trigger").alias("toa")).distinct()
    # Clustered once: centroids, numbers and the sorts of both files read it several times.
    at = f"{store.scratch(spark)}/labelled"
    found = runs.labelled_run(events, epsilon, min_points, tof_threshold, knots, huge=cluster.HUGE)
    found.write.parquet(at)
    found = spark.read.schema(found.schema).parquet(at)
    centroids = runs.centroids_of(found, triggers)
    _write(centroids.withColumn("shot_index", F.coalesce("shot_index", F.raise_error(F.lit("events whose trigger is in no trigger file")).cast("long"))), "merged", out, run.folder.name)
    if labels:
        rows = cluster.numbered_in_order(found, "t_trigger", ["x", "y", "tof_c", "tot"])
        _write(rows.select(F.col("t_trigger").alias("shot"), "x", "y", F.col("tof_c").alias("tof"), "tot", "label"), "labels", out, run.folder.name)
    store.remove(spark, at)
    return {"run": run.folder.name, "path": str(made), "n_centroids": made.stat().st_size // packed.dtype("merged").itemsize, "made": True}


def _told(e: Exception) -> str:
    return next((x for x in str(e).splitlines() if x.strip()), type(e).__name__)


def process_files(spark: SparkSession, folder: str, epsilon: float = 2.0, min_points: int = 1, tof_threshold: float = 2e-4, correction: str | None = None, output: str | None = None, progress=None, errors: dict | None = None) -> dict[str, int | None]:
    """Each event file's own centroids as ``<file>.datbin``: number of centroids by file, None for a file that failed, whose error
    goes to ``errors`` by name. ``progress(done, of, name)`` is called after each file."""
    packed.register(spark)
    files, out = packed.files_of(Path(folder), "events"), {}
    knots = runs.read_corrections(spark, correction) if correction else None
    for k, f in enumerate(files):
        name = f.name.removesuffix("_events.dat")
        try:
            events = spark.read.format("packed").option("kind", "events").load(str(f))
            labelled = runs.labelled_run(events, epsilon, min_points, tof_threshold, knots, huge=cluster.HUGE).filter("cluster >= 0")
            means = aggregate.weighted_centroids(labelled, ["t_trigger", "cluster"], "tof_c").orderBy("t_trigger", "cluster")
            out[name] = _write(means, "centroids", Path(output or folder), name).stat().st_size // packed.dtype("centroids").itemsize
        except Exception as e:  # noqa: BLE001  one broken file doesn't stop the others
            out[name] = None
            if errors is not None:
                errors[name] = _told(e)
        if progress:
            progress(k + 1, len(files), name)
    return out


def process_all(spark: SparkSession, root: str, **options) -> DataFrame:
    """Every run folder under ``root``: run, n_centroids, made, error."""
    rows = []
    for folder in sorted({f.parent for f in packed.files_of(Path(root), "events", recursive=True)}):
        try:
            got = process_run(spark, str(folder), **options)
            rows.append((got["run"], got["n_centroids"], got["made"], None))
        except Exception as e:  # noqa: BLE001  the run's error is its row
            rows.append((folder.name, None, False, _told(e)))
    return spark.createDataFrame(rows, "run string, n_centroids long, made boolean, error string")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Centroids of recorded runs")
    p.add_argument("input", help="run folder, or one events file")
    p.add_argument("-o", "--output")
    p.add_argument("--epsilon", type=float, default=2.0)
    p.add_argument("--tof-threshold", type=float, default=2e-4)
    p.add_argument("--min-points", type=int, default=1)
    p.add_argument("--correction")
    p.add_argument("--labels", action="store_true")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    path = Path(a.input)
    got = process_run(spark, str(path if path.is_dir() else path.parent), a.epsilon, a.min_points, a.tof_threshold, a.correction, a.labels, a.force, a.output)
    print(f"{got['run']}: {got['n_centroids']} centroids")


if __name__ == "__main__":
    main()

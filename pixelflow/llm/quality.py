"""Quality rules with thresholds that follow the corpus: mergeable quantile sketches by language and source.

All in DataFrame functions. Each metric's sketch is a histogram over buckets of bounded relative width (exact below 32,
then sixteen to each doubling): counts add up, so partial sketches merge exactly, in any order, and a group's size costs
nothing beyond its buckets. Groups of fewer than LEAST documents take the merged sketch of their language, or of all.
A metric's limits are the far fences of its group, q25 - SPREAD * (q75 - q25) and q75 + SPREAD * (q75 - q25), moved out
by the metric's slack so that groups without spread don't reject small differences.

Null text has no words and fails the base rules; null languages and sources are groups of their own; repeated rows count
as often as they come; an empty table gives an empty result; extra columns are kept by ``filter_documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelflow.llm.common import let, materialize, words_of

SYMBOLS = "#*$%&|<>"
LEAST = 50  # documents from which a group has its own thresholds
SPREAD = 3
#: metric: (checks the lower fence, checks the upper fence, slack)
METRICS = {"symbols_pm": (False, True, 60), "dup_lines_pm": (False, True, 200), "repeats_pm": (False, True, 150), "word_length_x10": (True, True, 20)}
MAX_BROADCAST_GROUPS = 200_000


def _repeated(windows: Column) -> Column:
    """Words covered by three-word windows whose hash occurs twice: ``windows`` is sorted by hash, then place."""
    same = lambda a, b: F.coalesce(F.get(windows, a)["h"] == F.get(windows, b)["h"], F.lit(False))
    twin = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    starts = F.sort_array(F.transform(twin, lambda k: F.get(windows, k)["i"]))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    return F.aggregate(starts, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")), step)["n"]


def base_metrics(text: Column) -> Column:
    """Struct of the base metrics, all whole numbers."""
    body = F.coalesce(text, F.lit(""))
    chars = F.length(F.translate(body, " \t\n\x0b\x0c\r", ""))
    symbols = F.length(body) - F.length(F.translate(body, SYMBOLS, ""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    windows = lambda w: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    repeats = lambda w: F.when(F.size(w) > 3, let(windows(w), _repeated)).otherwise(F.lit(0))
    word_part = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeats(w).alias("r")))
    line_part = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return F.struct(*(c.cast("long").alias(n) for n, c in (("word_chars", chars), ("n_symbols", symbols))), word_part.alias("words"), line_part.alias("lines"))


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base metrics, base_failed and the scaled metrics that the sketches take."""
    m = F.col("_m")
    out = docs.withColumn("_m", base_metrics(F.col(text_col)))
    out = out.withColumns({"n_words": m["words"]["n"].cast("long"), "word_chars": m["word_chars"], "n_symbols": m["n_symbols"], "n_lines": m["lines"]["n"].cast("long"), "n_dup_lines": m["lines"]["d"].cast("long"), "n_repeat_words": m["words"]["r"].cast("long")}).drop("_m")
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    scaled = {"symbols_pm": ("n_symbols", 1000, chars), "dup_lines_pm": ("n_dup_lines", 1000, lines), "repeats_pm": ("n_repeat_words", 1000, words), "word_length_x10": ("word_chars", 10, words)}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({n: F.floor(F.col(c) * k / d).cast("long") for n, (c, k, d) in scaled.items()}).withColumn("base_failed", failed)


def bucket(v: Column) -> Column:
    """Bucket of a count: itself below 32, then sixteen to each doubling."""
    low = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.when(v < 32, v).otherwise(low * 16 + F.floor(v / F.pow(F.lit(2.0), low))).cast("long")


def bucket_low(b: Column) -> Column:
    """Smallest count of a bucket."""
    low = F.floor(b / 16) - 1
    return F.when(b < 32, b).otherwise((b - low * 16) * F.pow(F.lit(2.0), low)).cast("long")


def sketches(metrics: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts by language, source, metric and bucket, of the documents that pass the base rules."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS))
    return (
        metrics.filter(~F.col("base_failed"))
        .select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(pairs).alias("p"))
        .groupBy("lang", "source", "p.metric", "p.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, level (0 their own, 1 the language, 2 all), metric, low, high; from merged sketches."""
    levels = [["lang", "source"], ["lang"], []]
    merged = None
    for k, keys in enumerate(levels):
        part = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        part = part.select(*(F.col(c) if c in keys else F.lit(None).cast("string").alias(c) for c in ("lang", "source")), F.lit(k).alias("level"), "metric", "bucket", "n")
        merged = part if merged is None else merged.unionByName(part)
    w = Window.partitionBy("level", "lang", "source", "metric")
    run = merged.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
    q = lambda part: F.min(F.when(F.col("upto") * 4 >= F.col("total") * part, F.col("bucket")))
    quartiles = run.groupBy("level", "lang", "source", "metric").agg(F.max("total").alias("total"), q(1).alias("b25"), q(3).alias("b75"))
    q25, q75 = bucket_low(F.col("b25")), bucket_low(F.col("b75"))
    slack = F.create_map(*(x for m, (_, _, s) in METRICS.items() for x in (F.lit(m), F.lit(s))))[F.col("metric")]
    reach = SPREAD * (q75 - q25) + slack
    return quartiles.filter((F.col("total") >= LEAST) | (F.col("level") == 2)).select("level", "lang", "source", "metric", (q25 - reach).alias("low"), (q75 + reach).alias("high"))


def _wide(limits: DataFrame, level: int, keys: list[str]) -> DataFrame:
    """One row for each group of a level: its limits as columns."""
    aggs = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"_{side}_{m}_{level}") for m in METRICS for side in ("low", "high")]
    rows = limits.filter(F.col("level") == level)
    return rows.groupBy(*(F.col(k).alias(f"_{k}_{level}") for k in keys)).agg(*aggs)


def judged(metrics: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``metrics`` with ``kept``: joined with the limits of each row's group. Groups up to a checked number are broadcast;
    beyond it the joins shuffle, and adaptive execution splits a hot group."""
    limits = materialize(limits, "limits")
    small = limits.filter("level = 0").select("lang", "source").distinct().count() <= MAX_BROADCAST_GROUPS
    hint = F.broadcast if small else (lambda x: x)
    out = metrics
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        side = _wide(limits, level, keys)
        on = F.lit(True)
        for k, col in zip(keys, (lang_col, source_col)):
            on = on & F.col(col).eqNullSafe(F.col(f"_{k}_{level}"))
        out = out.join(hint(side) if keys else F.broadcast(side), on, "left") if keys else out.join(F.broadcast(side), F.lit(True), "left")
    bad = F.lit(False)
    for m, (lower, upper, _) in METRICS.items():
        low, high = (F.coalesce(*(F.col(f"_{side}_{m}_{k}") for k in range(3))) for side in ("low", "high"))
        if upper:
            bad = bad | F.coalesce(F.col(m) > high, F.lit(False))
        if lower:
            bad = bad | F.coalesce(F.col(m) < low, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).select(*metrics.columns, "kept")


def assess(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Metrics and verdict of every row, with the columns ``keep``. The metrics are computed once and kept in the shared folder."""
    names = list(dict.fromkeys([*keep, lang_col, source_col]))
    metrics = with_metrics(docs.select(*dict.fromkeys([*names, text_col])), text_col)
    metrics = materialize(metrics if text_col in names else metrics.drop(text_col), "metrics")
    return judged(metrics, thresholds(sketches(metrics, lang_col, source_col)), lang_col, source_col)


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that pass, with the columns that they came with; these travel in one column, so no name can clash."""
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    return assess(rows, ["_row"]).filter("kept").select("_row.*")

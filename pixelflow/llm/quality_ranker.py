"""Quality of documents by Bradley-Terry pairwise ranking.

A document is a vector of FEATURES: shares of its bytes, words and lines. A preference pair is a document labelled 1 and one
labelled 0; the model says that the first wins with probability sigmoid(w . (x1 - x0)), and w is what minimises the logistic loss
over the pairs (Newton steps, a ridge). So only differences are learned, and the labels' balance doesn't move the scores. The
threshold is a quantile of the labelled scores: as many fall below it as are labelled 0. Scores are reported
as sigmoid(w . x - threshold + logit(CUT)), so CUT is the threshold on that scale.

Features are computed once, over whole texts, and written; fitting and scoring read them. The fit takes every labelled row: means,
deviations and the threshold are those of all of them, and each row stands in a pair. A row of the rarer label has PAIRS partners,
or more where the other label has more than PAIRS times its rows: both labels are numbered by a hash of the id, and partners are
dealt in turn. The pairs are written once; each Newton step is a pass over them, in which a task gives one sum. Scores see
texts only.

A null text is empty; empty texts get a score like others. Repeated rows get equal scores. Labels other than 0 and 1, and those of ids
without a document, count for nothing. Without labels of both kinds nothing can be ranked: every score is the share of
label 1 among them, or one half. An empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelflow.functions.ordering import with_index
from pixelflow.llm.common import free, materialize

PAIRS = 16
CUT = 0.7
RIDGE, STEPS, FAR = 1e-3, 25, 6.0  # FAR: standard deviations beyond which a feature is cut
SIGNS = b"#*$%&|<>!.,;:?-_/@=+()[]{}\"'~^`\\"
WORD_SIGNS = ["words", "bytes", "bytes_a_word", "distinct_words", "distinct_triples", "repeated_words", "capital_words", "mixed_words", "short_words"]
FEATURES = ["upper", "lower", "digits", "blank", "beyond_ascii", *(f"sign_{c}" for c in SIGNS), "entropy", "distinct_lines", "lines_a_word", *WORD_SIGNS, "few_words", "no_words"]
FEW = 50

_BLANK, _UPPER, _LOWER, _ALPHA = (np.zeros(256, bool) for _ in range(4))
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_UPPER[65:91] = True
_LOWER[97:123] = True
_ALPHA[:] = _UPPER | _LOWER
_ALPHA[128:] = True
_BYTE = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SQUARE = np.uint64(0x9E3779B97F4A7C15**2 % (1 << 64))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the bytes in words, where words start among them, and a hash of each word."""
    inside = np.flatnonzero(~_BLANK[raw])
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    place = np.arange(len(inside)) - np.repeat(first, np.diff(first, append=len(inside)))
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(place.max()), _BASE)]))
    return inside, first, np.add.reduceat(_BYTE[raw[inside]] * powers[place], first)


def features(text: str | None) -> np.ndarray:
    """FEATURES of a whole text."""
    content = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(content, np.uint8)
    share = np.bincount(raw, minlength=256) / max(len(raw), 1)
    seen = share[share > 0]
    lines = [x for x in content.split(b"\n") if x.strip()]
    out = [share[_UPPER].sum(), share[_LOWER].sum(), share[48:58].sum(), share[_BLANK].sum(), share[128:].sum(), *share[list(SIGNS)]]
    if not lines:
        return np.array([*out, 0.0, 1.0, 0.0, 0.0, np.log1p(len(raw)), 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0])
    inside, first, words = _words(raw)
    n, letters = len(words), raw[inside]
    triples = words[:-2] * _BASE + words[1:-1] * _SQUARE + words[2:]
    some = lambda marks: np.add.reduceat(marks.astype(np.int64), first) > 0
    capital, mixed = some(_UPPER[letters]) & ~some(_LOWER[letters]), some(~_ALPHA[letters])
    lengths = np.diff(first, append=len(inside))
    out += [-(seen * np.log(seen)).sum(), len(set(lines)) / len(lines), len(lines) / n, np.log1p(n), np.log1p(len(raw)), len(raw) / n / 10, len(np.unique(words)) / n]
    out += [len(np.unique(triples)) / len(triples) if n > 2 else 1.0, (words[1:] == words[:-1]).sum() / max(n - 1, 1), capital.mean(), mixed.mean(), (lengths == 1).mean(), float(n < FEW), 0.0]
    return np.array(out)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and features of every row."""

    def run(batches):
        for b in batches:
            rows = np.array([features(t) for t in b.column(1).to_pylist()], np.float32).reshape(b.num_rows, len(FEATURES))
            found = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), found], ["doc_id", "features"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, features array<float>")


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x.astype(np.float64) - self.mean) / self.scale, -FAR, FAR)
        return (z * self.weights).sum(axis=1)  # in an order that doesn't depend on the batch

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + np.log(CUT / (1 - CUT)), -500, 500)))


def preferences(labels: np.ndarray, seed: int = 20240607) -> tuple[np.ndarray, np.ndarray]:
    """Places of winners and losers: PAIRS partners for each row of the rarer label."""
    one, zero = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    rng = np.random.Generator(np.random.PCG64(seed))
    few, many = sorted((one, zero), key=len)
    pairs = np.repeat(few, PAIRS), rng.choice(many, len(few) * PAIRS)
    return pairs if few is one else pairs[::-1]


def steps(apart: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope and bend of the loss over pairs ``apart``, without the ridge, and their number; adds up over parts."""
    win = 1 / (1 + np.exp(-np.clip(apart @ w, -500, 500)))
    return np.concatenate([apart.T @ (1 - win), ((apart * (win * (1 - win))[:, None]).T @ apart).ravel(), [len(apart)]])


def fitted(sums, size: int) -> np.ndarray:
    """Weights at which the loss is least; ``sums(w)`` gives ``steps`` over all pairs."""
    w = np.zeros(size)
    for _ in range(STEPS):
        *both, n = sums(w)
        slope, bend = np.array(both[:size]) / n - RIDGE * w, np.array(both[size:]).reshape(size, size) / n + RIDGE * np.eye(size)
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learned(x: np.ndarray, labels: np.ndarray, share: float) -> Ranker:
    """The model of the rows ``x``; ``share``: of label 0 among all labels."""
    x = x.astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -FAR, FAR)
    winners, losers = preferences(labels)
    apart = z[winners] - z[losers]
    w = fitted(lambda w: steps(apart, w), x.shape[1])
    model = Ranker(mean, scale, w, 0.0)
    model.threshold = quantile(model.raw(x), np.where(labels == 0, share / (labels == 0).sum(), (1 - share) / (labels == 1).sum()), share)
    return model


def quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """Midway between the last of the ``share`` smallest values, by weight, and the next."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    k = min(int(np.searchsorted(upto, share - 1e-9)), len(values) - 2)
    return float((values[order[k]] + values[order[k + 1]]) / 2)


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, by the crc32 of their decimals, from which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _rows(column) -> np.ndarray:
    """A batch's lists of features as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _sums(df: DataFrame, of) -> list[np.ndarray]:
    """``of(batches)``, a short vector, of each task that has rows."""

    def run(batches):
        got = of(b for b in batches if b.num_rows)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([got.tolist()], pa.list_(pa.float64()))], ["sums"])

    return [np.array(r["sums"]) for r in df.mapInArrow(run, "sums array<double>").collect()]


def _joined(a: tuple, b: tuple) -> tuple:
    """Number, mean and squared deviations of two parts together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart**2 * (a[0] * b[0] / n)


def _moments(batches) -> np.ndarray | None:
    parts = [(len(x), x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)) for x in (_rows(b.column(0)) for b in batches)]
    return np.concatenate([np.atleast_1d(v) for v in reduce(_joined, parts)]) if parts else None


def pairs(rows: DataFrame, counts: dict[int, int], mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """``apart``, winner less loser, of each pair. ``rows``: label and features, of which ``counts`` tells how many there are."""
    few, many = sorted((1, 0), key=counts.get)
    each = min(max(PAIRS, -(-counts[many] // counts[few])), counts[many])  # partners of a row: every row of the other label is one
    placed = with_index(rows.withColumn("_h", F.xxhash64("doc_id", F.lit(13))), "_h", ["doc_id", "features"], "_at", ["label"])
    turn = F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("_k")
    left = placed.filter(F.col("label") == few).select("_at", "features", turn).select(((F.col("_at") * each + F.col("_k")) % counts[many]).alias("_to"), F.col("features").alias("a"))
    right = placed.filter(F.col("label") == many).select(F.col("_at").alias("_to"), F.col("features").alias("b"))
    sign = 1 if few == 1 else -1

    def run(batches):
        for b in batches:
            z = [np.clip((_rows(b.column(k)) - mean) / scale, -FAR, FAR) for k in (0, 1)] if b.num_rows else [np.zeros((0, len(mean)))] * 2
            flat = (sign * (z[0] - z[1])).astype(np.float32)
            found = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(mean), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([found], ["apart"])

    return left.join(right, "_to").select("a", "b").mapInArrow(run, "apart array<float>")


def fit(described_docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranker | float:
    """The model of all labelled rows, or the share of label 1 where there aren't labels of both kinds. ``labels``: doc_id and label
    to learn from."""
    rows = described_docs.join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)"), "doc_id")
    rows = materialize(rows.select("doc_id", "label", "features"), "labelled")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    parts = _sums(rows.select("features"), _moments)
    size = len(parts[0]) // 2
    n, mean, squares = reduce(_joined, [(p[0], p[1 : size + 1], p[size + 1 :]) for p in parts])
    mean, scale = np.round(mean, 12), np.round(np.sqrt(squares / n), 12)  # sums differ in their last places with the tasks
    scale = np.where(scale > 1e-9, scale, 1.0)
    apart = materialize(pairs(rows, counts, mean, scale), "pairs")

    def sums(w: np.ndarray) -> np.ndarray:
        def of(batches):
            return reduce(np.add, (steps(_rows(b.column(0)), w) for b in batches), np.zeros(size * size + size + 1))

        return reduce(np.add, _sums(apart, of))

    model = Ranker(mean, scale, np.round(fitted(sums, size), 9), 0.0)
    free(apart)

    def scored(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_rows(b.column(0))))], ["raw"])

    # As many of the labelled scores lie below the threshold as are labelled 0.
    placed = with_index(materialize(rows.select("features").mapInArrow(scored, "raw double"), "scores"), "raw", [], "_at")
    around = placed.filter(F.col("_at").isin(counts[0] - 1, counts[0])).agg(F.avg("raw")).first()[0]
    model.threshold = float(around)
    free(rows)
    return model


def ranked(described_docs: DataFrame, model: Ranker | float) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            score = model.score(x) if isinstance(model, Ranker) else np.full(b.num_rows, model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return described_docs.select("doc_id", "features").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learned from the labels that aren't held out."""
    told = materialize(described(docs), "features")
    model = fit(told, labels.filter(~held_out(F.col("doc_id"))))
    return ranked(told, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

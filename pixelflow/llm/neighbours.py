"""Approximate nearest neighbours by a permutation index.

PIVOTS vectors (a sample of fixed size, drawn by a hash of the id) are the pivots. Every vector is represented by its
NEAREST pivots in order of nearness and is posted, with their places, in those pivots' inverted files. A query reads
the files of its own pivots only. The footrule distance of two such orders, with absent pivots at place NEAREST, is a
constant less twice the sum over common pivots of NEAREST - max(place, place), so one pass over the files ranks all
vectors that share a pivot with the query; the best of each block, a share of it, are then ranked by the exact inner product
in double precision.

The share is measured on the very table: PROBES queries, drawn by a hash, are answered exactly, and the places that their true
neighbours have by footrule tell what share finds TARGET of them. That pass meets each block once, with a fixed number of
queries, and at most PROBES * k numbers reach the driver.

Pivots tell directions, not lengths. So a block's vectors are taken in bands of nearly equal length, the longest first:
each band gives that share of it to rerank, and the search ends where a band's longest vector, by the product of the lengths,
can't reach the best found. Equal vectors are one entry of the index, whose smallest ids answer.

Vectors and queries are dealt into blocks of bounded size, and every query block meets every vector block, where the
inverted files of that block are built; only each meeting's best are shuffled on. All vectors are indexed.

Where directions are spread evenly the share stays much the same as a table grows, so a fixed number of candidates would lose ever
more of the true neighbours; the README has figures.

Null vectors, zero vectors, those with null or non-finite components, and those not as long as most take no part, nor do
rows with null ids. A query's own row is no candidate; another row with its id is. A repeated id is asked as often as it
comes, and found as often. Ties go to the smaller id."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelflow.llm.common import materialize

PIVOTS, NEAREST = 512, 48
LEAST_RERANK = 8  # vectors of a band that are ranked exactly, at least, by k
PROBES, TARGET = 64, 0.98  # queries that measure the share of a band to be ranked exactly, and what they must find of their neighbours
BANDS_PER_DOUBLING = 8  # lengths within a band differ by 9 % at most
VECTOR_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 13  # rows at most, in expectation


def places(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Each row's nearest pivots in order; ties to the first pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)


class Files:
    """Inverted files of a block: for each pivot the rows posted there, with the pivot's place in their order."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.nearest = order.shape
        pivot = order.ravel()
        by = np.argsort(pivot, kind="stable")
        self.rows = np.repeat(np.arange(n, dtype=np.int32), self.nearest)[by]
        self.place = np.tile(np.arange(self.nearest, dtype=np.int32), n)[by]
        self.start = np.searchsorted(pivot[by], np.arange(pivots + 1))
        self.n = n

    def common(self, order: np.ndarray) -> np.ndarray:
        """For every row, the sum over pivots shared with ``order`` of NEAREST - max(place, place): the more, the nearer."""
        out = np.zeros(self.n, np.int32)
        for k, p in enumerate(order):
            a, b = self.start[p], self.start[p + 1]
            out[self.rows[a:b]] += self.nearest - np.maximum(self.place[a:b], k)
        return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length 1, and the logarithms (to 2) of their lengths; safe for very large and small components."""
    most = np.abs(x).max(axis=1, keepdims=True)
    part = x / most
    length = np.sqrt((part * part).sum(axis=1, keepdims=True))
    return part / length, (np.log2(most) + np.log2(length)).ravel()


def _products(x: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Inner products summed in an order that doesn't depend on a row's place, so that equal vectors get equal scores."""
    return (x * vec).sum(axis=1)


class Block:
    """Vectors of a block, equal ones once, by length band from the longest on, and their inverted files."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, pivots: np.ndarray, nearest: int):
        by_id = np.lexsort((rows, ids))
        ids, rows, x = ids[by_id], rows[by_id], np.ascontiguousarray(x[by_id]) + 0.0  # no negative zeros
        _, first, member = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        unit, length = _unit(x[first])
        by_length = np.argsort(-length, kind="stable")
        place = np.empty(len(first), np.int64)
        place[by_length] = np.arange(len(first))
        member = place[member.ravel()]
        by_vector = np.argsort(member, kind="stable")
        self.ids, self.rows = ids[by_vector], rows[by_vector]  # by vector, then id
        self.start = np.searchsorted(np.sort(member), np.arange(len(first) + 1))
        self.x, self.length = x[first][by_length], length[by_length]
        band = np.floor(self.length * BANDS_PER_DOUBLING + 0.5)
        self.bands = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), len(first)]
        self.pivots, self.files = pivots, Files(places(unit[by_length], pivots, nearest), len(pivots))

    def shares(self, own: int, vec: np.ndarray, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the block's ``k`` nearest without the row ``own``, by exact search, and the share of its band that each takes
        to be found."""
        common = self.files.common(places(unit[None], self.pivots, self.files.nearest)[0])
        score = np.repeat(_products(self.x, vec), np.diff(self.start))
        entry = np.repeat(np.arange(len(self.x)), np.diff(self.start))
        best = np.lexsort((self.rows, self.ids, -score))
        best = best[self.rows[best] != own][:k]
        need = np.zeros(len(best))
        for i, e in enumerate(entry[best]):
            band = np.searchsorted(self.bands, e, side="right")
            low, high = self.bands[band - 1], self.bands[band]
            need[i] = (common[low:high] >= common[e]).sum() / (high - low)  # ties count against it
        return score[best], need

    def nearest_to(self, own: int, vec: np.ndarray, unit: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, rows and scores of the block's ``k`` nearest found, without the row ``own``."""
        common = self.files.common(places(unit[None], self.pivots, self.files.nearest)[0])
        reach = np.log2(np.abs(vec).max()) + np.log2(np.sqrt(np.square(vec / np.abs(vec).max()).sum()))
        ids, rows, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for low, high in zip(self.bands, self.bands[1:]):
            if len(score) == k and np.exp2(min(self.length[low] + reach, 1023.0)) * (1 + 1e-9) < score[-1]:
                break  # no vector from here on is long enough
            few = min(high - low, max(LEAST_RERANK * k, int(np.ceil(share * (high - low)))))
            near = low + (np.argpartition(-common[low:high], few - 1)[:few] if few < high - low else np.arange(high - low))
            rough = self.x[near] @ vec
            if len(near) > k + 1:  # those that can't be among the best, by more than rounding, needn't be summed again
                cut = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
                near = near[~(rough < cut - 1e-9 * np.exp2(min(self.length[low] + reach, 1023.0)))]
            exact_score = _products(self.x[near], vec)
            size = np.minimum(self.start[near + 1] - self.start[near], k + 1)
            at = np.repeat(self.start[near] - np.cumsum(size) + size, size) + np.arange(size.sum())
            ids, rows = np.concatenate([ids, self.ids[at]]), np.concatenate([rows, self.rows[at]])
            score = np.concatenate([score, np.repeat(exact_score, size)])
            best = np.lexsort((rows, ids, -score))
            best = best[rows[best] != own][:k]
            ids, rows, score = ids[best], rows[best], score[best]
        return ids, rows, score


def _valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(fine)


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def measured_share(valid: DataFrame, asked: DataFrame, pivots, nearest: int, k: int) -> float:
    """Share of a band with which PROBES of the queries find TARGET of their true neighbours. ``valid``: id, row, vec and v, the block."""
    probes = asked.orderBy(F.xxhash64("id", "row", F.lit(9)), "id", "row").limit(PROBES).toPandas()
    if not len(probes):
        return 1.0
    vecs, own = np.stack(probes["vec"].to_numpy()).astype(np.float64), probes["row"].to_numpy()
    units = _unit(vecs)[0]

    def probe(a: pa.Table) -> pa.Table:
        block = Block(a["id"].to_numpy(), a["row"].to_numpy(), _stack(a["vec"]), pivots.value, nearest)
        found = [block.shares(o, vec, unit, k) for o, vec, unit in zip(own, vecs, units)]
        return pa.table({"probe": np.repeat(np.arange(len(found), dtype=np.int64), [len(f[0]) for f in found]), "score": np.concatenate([f[0] for f in found]), "need": np.concatenate([f[1] for f in found])})

    w = Window.partitionBy("probe").orderBy(F.desc("score"), "need")
    got = valid.groupBy("v").applyInArrow(probe, "probe long, score double, need double")
    need = np.sort([r["need"] for r in got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("need").collect()])
    return float(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) if len(need) else 1.0


def search(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found. ``is_query``: condition on column ``id``."""
    spark = rows.sparkSession
    valid = _valid(rows, id_col, vec_col)
    lengths = valid.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    n, dim = lengths[0]["count"], lengths[0]["d"]
    valid = materialize(valid.filter(F.size("vec") == dim).withColumn("row", F.monotonically_increasing_id()), "vectors")
    drawn = valid.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(min(PIVOTS, max(1, n // 2))).toPandas()
    pivots = spark.sparkContext.broadcast(_unit(np.stack(drawn["vec"].to_numpy()).astype(np.float64))[0])
    nearest = min(NEAREST, len(drawn))
    n_queries = valid.filter(is_query).count()
    vector_blocks = -(-n // VECTOR_BLOCK)
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    block = lambda blocks, seed: F.pmod(F.xxhash64("id", "row", F.lit(seed)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    share = measured_share(valid.select("id", "row", "vec", block(vector_blocks, 1).alias("v")), valid.filter(is_query).select("id", "row", "vec"), pivots, nearest, k)
    left = valid.select("id", "row", "vec", block(vector_blocks, 1).alias("v"), every(query_blocks).alias("q"))
    asked = valid.filter(is_query).select("id", "row", "vec", block(query_blocks, 2).alias("q"), every(vector_blocks).alias("v"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"query_id": [], "query_row": [], "vec_id": [], "vec_row": [], "score": []}
        if a.num_rows and b.num_rows:
            block = Block(a["id"].to_numpy(), a["row"].to_numpy(), _stack(a["vec"]), pivots.value, nearest)
            y = _stack(b["vec"])
            for qid, own, vec, unit in zip(b["id"].to_numpy(), b["row"].to_numpy(), y, _unit(y)[0]):
                found = block.nearest_to(own, vec, unit, k, share)
                for c, v in zip(out, (np.full(len(found[0]), qid), np.full(len(found[0]), own), *found)):
                    out[c].append(v)
        kind = lambda c: np.float64 if c == "score" else np.int64
        return pa.table({c: np.concatenate([*v, np.zeros(0, kind(c))]).astype(kind(c)) for c, v in out.items()})

    met = left.groupBy("v", "q").cogroup(asked.groupBy("v", "q")).applyInArrow(meet, "query_id long, query_row long, vec_id long, vec_row long, score double")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(rows: pd.DataFrame, k: int, query) -> list[tuple[int, int, int, float]]:
    """Brute force for tests: every query against every vector."""
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    out = []
    for i in np.flatnonzero(query(ids)):
        score = _products(x, x[i])
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -score[others]))[:k]]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(best)]
    return out

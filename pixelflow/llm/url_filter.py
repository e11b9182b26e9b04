"""URL verdicts: host/path rules first, then exact membership in a block list by a Bloom filter cascade.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1 takes for listed by mistake, level 3 the
listed keys that level 2 takes for mistakes, and so on until a level has no mistakes. Over the complete universe of the
corpus's keys (every host and every parent domain) the answer is exact, and pages are judged by bit tests, without joins.

Only names that can be listed are keys: those of at most as many labels as the longest listed domain has, so a host of
many thousand dots costs no more than another. Lists too long for one broadcast are dealt into shards, and the pages are
judged shard after shard, each pass written to the shared folder before the next one's filters are built.

Null urls and urls without ``://`` have an empty host and path, fit no rule and no key: allowed. Ties between rules are
broken by the longer rule text, then by its order. Empty tables give empty results; extra columns are kept out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelflow.llm.common import free, materialize

BITS_PER_KEY, HASHES = 10, 6
MAX_BITS = 1 << 29  # 64 MB: largest filter that is broadcast at once; longer ones are dealt into shards of this size
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domains_of(host: Column, most: int) -> Column:
    """The host and its parent domains, as far as they have ``most`` labels at most; none for an empty host."""
    tail = F.split(F.substring_index(host, ".", -most), "\\.")
    n = F.size(tail)
    return F.when((host == "") | F.lit(most < 1), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(tail, i, n - i + 1), ".")))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Rows of HASHES bit positions; each level has its own."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    steps = np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(level * HASHES)
    x = a[:, None] + steps * b[:, None]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(bits)).astype(np.int64)


class Cascade:
    """Levels of bit arrays; ``has`` walks them: the first level that says no decides by its parity."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for k, (words, bits) in enumerate(zip(self.levels, self.sizes)):
            if not len(open_):
                return out
            p = _positions(h1[open_], h2[open_], k, bits)
            hit = ((words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            out[open_[~hit]] = k % 2 == 1
            open_ = open_[hit]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _bits(keys: DataFrame, level: int, bits: int) -> np.ndarray:
    """Bit array of the keys: partial words on the executors, at most bits / 64 words to the driver."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                p = np.unique(_positions(b.column(0).to_numpy(), b.column(1).to_numpy(), level, bits))
                word, start = np.unique(p >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (p & 63).astype(np.uint64), start)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    rows = keys.select("h1", "h2").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    out = np.zeros((bits + 63) // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["value"].to_numpy(np.int64).view(np.uint64)
    return out


def _tested(keys: DataFrame, level: int, bits: int, words: np.ndarray) -> DataFrame:
    """Keys that the level says yes to."""
    shared = keys.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for b in batches:
            p = _positions(b.column(0).to_numpy(), b.column(1).to_numpy(), level, bits)
            hit = ((shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            yield b.filter(pa.array(hit))

    return keys.mapInArrow(run, keys.schema)


def build(universe: DataFrame, shards: int = 1) -> list[Cascade]:
    """All of ``cascades`` at once."""
    return list(cascades(universe, shards))


def cascades(universe: DataFrame, shards: int = 1) -> Iterator[Cascade]:
    """Cascades over ``universe`` (h1, h2, listed; distinct keys), one after the other for each shard of the keys."""
    for s in range(shards):
        part = universe.filter(F.pmod("h2", F.lit(shards)) == s) if shards > 1 else universe
        inside, outside = part.filter("listed").drop("listed"), part.filter("not listed").drop("listed")
        levels, sizes, made = [], [], []
        for level in range(MAX_LEVELS):
            n = inside.count()
            if not n:
                break
            bits = max(64, n * BITS_PER_KEY)
            words = _bits(inside, level, bits)
            levels.append(words)
            sizes.append(bits)
            made.append(materialize(_tested(outside, level, bits, words), "cascade"))
            inside, outside = made[-1], inside
        else:
            raise RuntimeError("two keys share both hashes")
        free(*made)
        yield Cascade(levels, sizes)


def _hashed(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(k, F.lit(7)).alias("h2")))


def judge(pages: DataFrame, rules: list[Rule], listed_domains: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule and verdict of every row. ``listed_domains``: column ``domain``; a listed domain blocks its subdomains.

    The filters' size is known before they are built, from the number of listed keys: at most MAX_BITS are broadcast at a
    time, and longer lists are tested shard after shard."""
    parsed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    most = listed_domains.agg(F.coalesce(F.max(F.size(F.split("domain", "\\."))), F.lit(0))).first()[0]
    hosts = parsed.select("host").distinct()
    keys = hosts.select(F.explode(domains_of(F.col("host"), most)).alias("key")).distinct()
    listed = listed_domains.select(F.col("domain").alias("key")).distinct().withColumn("listed", F.lit(True))
    universe = materialize(keys.join(listed, "key", "left").select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(7)).alias("h2"), F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    n = universe.filter("listed").count()
    shards = max(1, -(-2 * n * BITS_PER_KEY // MAX_BITS))
    out = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("keys", _hashed(domains_of(F.col("host"), most))).withColumn("listed", F.lit(False))
    judged = None
    for s, cascade in enumerate(cascades(universe, shards)):
        shared = pages.sparkSession.sparkContext.broadcast(cascade)
        out = out.withColumn("listed", F.col("listed") | _member(shared, s, shards)(F.col("keys.h1"), F.col("keys.h2")))
        if s + 1 < shards:  # written, so that this shard's filters can go
            before, judged = judged, materialize(out, "judged")
            out = judged
            shared.unpersist()
            if before is not None:
                free(before)
    verdicts = F.lit(None).cast("string")
    for r in rules:
        verdicts = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(verdicts)
    return out.select(id_col, "host", "path", "rule", F.coalesce(verdicts, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")


def _member(shared, shard: int, shards: int):
    @F.pandas_udf("boolean")
    def member(a, b):
        import pandas as pd

        sizes = np.array([len(x) for x in a], np.int64)
        h1 = np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64)
        h2 = np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64)
        yes = shared.value.has(h1, h2) & (np.mod(h2, shards) == shard)
        row = np.repeat(np.arange(len(sizes)), sizes)
        return pd.Series(np.bincount(row[yes], minlength=len(sizes)) > 0)

    return member

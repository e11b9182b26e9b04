"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Every document's distinct five-word shingles are hashed to 64 bits; KEPT minima give BANDS band keys, and the low
   BITS bits of each minimum are packed into the signature.
2. Documents with equal sets form a class (its key is a 128-bit digest of the set); one member stands for it from here.
3. Classes that share a band key are candidates. Within a bucket everyone is a candidate with the smallest member only, and
   each class keeps the candidate that it shares most bands with. The signatures' equal bit groups, corrected for chance
   collisions, estimate the similarity; survivors are confirmed on full sets and joined to components.
4. The rest is done exactly: members of buckets that still hold several components are compared across components by
   the prefix filter. With all shingles in one order, rare ones first, two sets that reach the threshold share one of the
   first n - ceil(threshold * n) + 1 shingles of each. Of the pairs that do, the join keeps those whose estimate and whose
   bitmaps (an exact bound) allow the threshold; they are confirmed as before.
   So no link between components that share a bucket is lost, and a group of copies costs its size, not its square.

A pair at the threshold shares a band with probability 1 - (1 - 0.85^5)^28 > 0.9999999 (> 0.99998 at 0.8), and its estimate falls under
the margin of five standard deviations about once in three million; links also follow from other pairs of a group.

Null or wordless texts have no shingles and stand alone. Rows with the same doc_id are one document to the components.
A null doc_id stands alone: component null, kept true. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelflow.llm.common import free, materialize

WORDS, THRESHOLD = 5, 85  # words in a shingle; percent
BANDS, ROWS, BITS = 28, 5, 4
KEPT = 144  # minima: BANDS * ROWS of them make bands, all are in the signature of KEPT * BITS bits
MARGIN = 5.0  # standard deviations by which an estimate may fall short
STEP = 64
SLOTS = 1 << 18  # for the shingles' order
WIDTH = 2048  # bits of a text's bitmap
PAIRS = 32  # pairs of texts compared at a time

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_PERMUTE = _rng.integers(0, 1 << 63, KEPT, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(4095, _BASE)]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.flatnonzero(~_IS_BLANK[raw])
    if not len(inside):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    place = np.arange(len(inside)) - np.repeat(first, np.diff(first, append=len(inside)))
    powers = _POWERS if place.max() < len(_POWERS) else np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(place.max()), _BASE)]))
    w = _mix(np.add.reduceat(_BYTE[_FOLD[raw[inside]]] * powers[place], first))
    n = len(w)
    if n < WORDS:
        return _mix((w * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _PLACE[WORDS:] * np.uint64(n))
    s = w[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        s = s + w[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(_mix(s))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(KEPT, ~np.uint64(0))
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048]
        np.minimum(out, np.array([(part * a).min() for a in _PERMUTE]), out=out)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 // BITS to a word."""
    low = (m & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        out = _mix(out * _BASE ^ rows[:, k])
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key, sig and bands; the last three null without shingles."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                ids, rows = b.column(0).slice(at, STEP), []
                for text in b.column(1).slice(at, STEP).to_pylist():
                    s = shingles(text)
                    if len(s):
                        m = minima(s)
                        rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), packed(m).view(np.int64), band_keys(m).view(np.int64)))
                    else:
                        rows.append((0, None, None, None))
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_shingles", "set_key", "sig", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from equal bit groups of two signatures, corrected for those that are equal by chance."""
    every = int("1" * (64 // BITS), 16) if BITS == 4 else sum(1 << (k * BITS) for k in range(64 // BITS))
    equal = F.lit(KEPT)
    for k in range(KEPT * BITS // 64):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        shift = 1
        while shift < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        equal = equal - F.bit_count(x.bitwiseAND(F.lit(every)))
    chance = 1 / (1 << BITS)
    return (equal / float(KEPT) - chance) / (1 - chance)


def least_estimate(threshold: int) -> float:
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * threshold / 100
    return threshold / 100 - MARGIN * math.sqrt(p * (1 - p) / KEPT) / (1 - chance)


def _alike(sa: str, na: str, sb: str, nb: str, threshold: int) -> Column:
    """Sizes and signatures allow the threshold."""
    low, high = F.least(F.col(na), F.col(nb)), F.greatest(F.col(na), F.col(nb))
    return (low * 100 >= high * threshold) & (estimate(F.col(sa), F.col(sb)) >= least_estimate(threshold))


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. ``texts``: doc_id, text of every member of a pair."""
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        held: tuple = (None, None)
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                for a, ta, tb in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if held[0] != (a, ta):
                        held = ((a, ta), shingles(ta))
                    sa, sb = held[1], shingles(tb)
                    common = len(np.intersect1d(sa, sb, assume_unique=True))
                    keep.append(100 * common >= threshold * (len(sa) + len(sb) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and its component's smallest node, for every node of ``edges`` (a, b): smallest labels spread along edges and
    jump along labels, until nothing changes."""
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        new = materialize(jump.select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        free(labels)
        if not new.filter("old != label").limit(1).count():
            free(both)
            return new.select("node", "label")
        labels = new


def _slot_counts(texts: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each of SLOTS slots; partial counts on the executors, at most SLOTS rows to the driver."""

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                for text in b.column(1).slice(at, STEP).to_pylist():
                    counts += np.bincount((shingles(text) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], ["slot", "n"])

    got = texts.select("doc_id", "text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """WIDTH bits, those set that a shingle of the set falls on."""
    out = np.zeros(WIDTH, np.uint8)
    out[((s >> np.uint64(20)) % np.uint64(WIDTH)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def _within(ba: str, na: str, bb: str, nb: str, threshold: int) -> Column:
    """The bitmaps allow the threshold: every bit in which they differ takes a shingle that only one of the sets has, and
    sets at the threshold have (100 - threshold) / (100 + threshold) of their sizes' sum of those at most."""
    apart = F.lit(0)
    for k in range(WIDTH // 64):
        apart = apart + F.bit_count(F.get(F.col(ba), F.lit(k)).bitwiseXOR(F.get(F.col(bb), F.lit(k))))
    return apart * (100 + threshold) <= (F.col(na) + F.col(nb)) * (100 - threshold)


def _prefixes(texts: DataFrame, threshold: int) -> DataFrame:
    """rep, label, prefix (shingles in the order of their slot's count, then hash) and bits of each text."""
    counts = texts.sparkSession.sparkContext.broadcast(_slot_counts(texts))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part, prefix, bits = b.slice(at, STEP), [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text)
                    n = len(s) - -(-threshold * len(s) // 100) + 1
                    prefix.append((s[np.lexsort((s, counts.value[(s % np.uint64(SLOTS)).astype(np.int64)]))[:n]] if len(s) else s).view(np.int64))
                    bits.append(bitmap(s))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(prefix, longs), pa.array(bits, longs)], ["rep", "label", "prefix", "bits"])

    return texts.select("doc_id", "text", "label").mapInArrow(run, "rep long, label long, prefix array<long>, bits array<long>")


def group(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    known = signed.filter("set_key is not null and doc_id is not null")
    classes = materialize(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    buckets = materialize(banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    member = materialize(banded.join(buckets, "key").select("key", "pivot", "rep"), "members")
    signs = classes.select("rep", "n", "sig")
    # both sides grow with the corpus, so neither is broadcast, however small this corpus is
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = materialize(rows.join(member.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")

    def alike(pairs: DataFrame) -> DataFrame:
        for x in ("b", "a"):
            pairs = pairs.join(signs.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")), x)
        return pairs.filter(_alike("sig_a", "n_a", "sig_b", "n_b", threshold)).select("a", "b")

    star = member.filter("rep != pivot").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    best = star.groupBy("b").agg(F.max(F.struct(F.col("shared"), (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    best_pairs = materialize(alike(best), "pairs")
    sure = materialize(confirmed(best_pairs, texts, threshold), "links")
    linked = components(sure)
    free(best_pairs, sure)

    placed = materialize(member.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label")), "placed")
    free(buckets, member)
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    rest = placed.join(mixed, "key").select(F.col("rep").alias("doc_id"), "label").distinct()
    unsure = materialize(texts.join(rest, "doc_id"), "mixed")
    drafts = materialize(_prefixes(unsure, threshold), "prefixes")
    free(unsure, placed)
    prefix = drafts.select("rep", "label", F.explode("prefix").alias("h"))
    several = prefix.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("h")
    side = prefix.select("h", "rep").join(several, "h").join(drafts.select("rep", "label", "bits"), "rep").join(signs, "rep")
    a, b = (side.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "label", "bits", "n", "sig"))) for x in "ab")
    met = a.join(b, "h").filter((F.col("rep_a") < F.col("rep_b")) & (F.col("label_a") != F.col("label_b")) & _within("bits_a", "n_a", "bits_b", "n_b", threshold) & _alike("sig_a", "n_a", "sig_b", "n_b", threshold))
    left = materialize(met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct(), "pairs")
    late = confirmed(left, texts, threshold)
    for x in ("a", "b"):
        late = late.join(linked.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")), x, "left")
    late = materialize(late.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")), "links")
    free(left, drafts, texts)
    joined = components(late)
    free(late)

    home = classes.select("set_key", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("first"))
    home = materialize(home.join(joined.withColumnRenamed("node", "first"), "first", "left").select("set_key", F.coalesce("label", "first").alias("component_id")), "homes")
    free(classes)
    # rows without a set stay out of the join, where they would all meet in one task
    rows = signed.select("doc_id", "n_shingles", "set_key")
    out = rows.filter("set_key is not null").join(home, "set_key", "left").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.filter("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row for each document that stands for its group, with the columns that it came with.

    Of rows with one doc_id the greatest stays, by text and then the other columns; rows without doc_id all stay."""
    gone = group(docs, threshold).filter("not kept").select(F.col("doc_id").alias("_gone"))
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    ids = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).agg(F.count(F.lit(1)).alias("_rows"))
    again = materialize(ids.filter("_rows > 1").select("_again"), "repeated")
    if not again.limit(1).count():
        return left
    left = materialize(left, "left")
    once = left.join(again, F.col("doc_id") == F.col("_again"), "left_anti")
    rows = left.join(again, F.col("doc_id") == F.col("_again"), "left_semi").groupBy(F.col("doc_id").alias("_again"))
    best = rows.agg(F.max(F.struct("text", F.struct(*(F.col(c) for c in docs.columns)).alias("row"))).alias("_best"))
    return once.unionByName(best.select("_best.row.*"))

"""Prefix trie of conversations: shared first turns as nodes, rolled up by pointer jumping.

Conversations are rebuilt first: conversation c starts with the first h turns of conversation c - c % BLOCK (all of them if it
has fewer, none if it is absent) and goes on with its own turns after its first h; h is crc32(decimal c) % SHARED.

1. Turns are ordered within conversations by ``turn`` (null first), turns of one number by the digest of role and text, with
   a position and the digest of the turns up to each (``ordered.numbered``; a long conversation lies in many partitions).
   That digest is a sum, so the rebuilt path's digest follows from those of its two parts.
2. A node is a distinct path digest; its edge leads to the digest of the path without the last turn. The root is (0, 0).
3. Pointer jumping: each node holds the sums over its descendants nearer than 2^k edges, and a pointer to its ancestor 2^k
   edges up. A round adds the sums of the nodes that point to a node to its own, and doubles the pointers. So leaf counts and
   savings reach all ancestors after log2(depth) rounds. Nodes that nothing points to any more and that have no pointer left
   are finished and leave the rounds. Sums to a popular ancestor are partial in the map stage; looking up its pointer is
   an inner join whose hot side Spark splits; nobody looks up the root.
4. The ids of the conversations that end in a node are digested in order: range partitions of (node, id) make pieces of
   at most PIECE ids, and a node's pieces pass one after the other through one SHA-256, which can't be split.

Rows with a null conv_id are no conversation and are left out. Null role or text is empty. Repeated rows are further turns. An
empty table has no conversation, no node and no root. c % BLOCK has the sign of c."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelflow.llm import ordered
from pixelflow.llm.common import materialize

BLOCK, SHARED = 100, 6
PIECE = 8192
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, own (16 bytes of the turn's SHA-256) and points of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.substring(F.unhex(F.sha2(told, 256)), 1, 16).alias("own"), F.char_length(text).cast("long").alias("points"))


def _moved(a: Column, b: Column, less: tuple[Column, Column], to: tuple[Column, Column], back: Column) -> tuple[Column, Column]:
    """The digest that starts with ``to`` and goes on with what (a, b) has after ``less``, moved ``back`` positions."""
    lanes = []
    for k, (x, o, t) in enumerate(zip(ordered.unpack(a, b), ordered.unpack(*less), ordered.unpack(*to))):
        inverse = F.element_at(F.array(*(F.lit(pow(ordered.BASES[k], -n, ordered.P)).cast("long") for n in range(SHARED))), back.cast("int") + 1)
        lanes.append(((x - o + ordered.P) % ordered.P * inverse + t) % ordered.P)
    return ordered.pack_columns(lanes)


def _paths(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rebuilt conversations: all their prefixes (conv, depth, a, b, parent_a, parent_b, points), the empty one too, and
    where each ends (conv, a, b)."""
    head = F.when(F.col("at") < SHARED - 1, F.struct("at", "a", "b", "before_a", "before_b", "points"))
    own = placed.groupBy("conv").agg(F.array_sort(F.collect_list(head)).alias("own"), F.max(F.struct("at", "a", "b")).alias("last"))  # SHARED - 1 at most
    own = materialize(own.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED), "heads")
    base = own.filter(F.col("conv") % BLOCK == 0).select(F.col("conv").alias("_base"), F.col("own").alias("first"))
    whole = own.join(base, F.col("conv") - F.col("conv") % BLOCK == F.col("_base"), "left").drop("_base")
    whole = whole.withColumn("first", F.coalesce("first", F.array().cast(dict(own.dtypes)["own"]))).withColumn("m", F.least("h", F.size("first").cast("long")))
    zero = F.lit(0).cast("long")
    of = lambda rows, n, c: F.coalesce(F.get(F.col(rows), (n - 1).cast("int"))[c], zero)
    told = {"_t_a": of("first", F.col("m"), "a"), "_t_b": of("first", F.col("m"), "b"), "_l_a": of("own", F.col("h"), "a"), "_l_b": of("own", F.col("h"), "b")}
    whole = materialize(whole.withColumns(told), "whole")
    to, less, back = (F.col("_t_a"), F.col("_t_b")), (F.col("_l_a"), F.col("_l_b")), F.col("h") - F.col("m")
    empty = whole.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("parent_a"), zero.alias("parent_b"), zero.alias("points"))
    begin = whole.select("conv", F.explode(F.slice("first", F.lit(1), F.col("m").cast("int"))).alias("t"))
    begin = begin.select("conv", (F.col("t.at") + 1).alias("depth"), "t.a", "t.b", F.col("t.before_a").alias("parent_a"), F.col("t.before_b").alias("parent_b"), "t.points")
    rest = placed.join(whole.select(F.col("conv").alias("_conv"), "h", "m", *told), (F.col("conv") == F.col("_conv")) & (F.col("at") >= F.col("h")))
    here, there = _moved(F.col("a"), F.col("b"), less, to, back), _moved(F.col("before_a"), F.col("before_b"), less, to, back)
    rest = rest.select("conv", (F.col("m") + F.col("at") - F.col("h") + 1).alias("depth"), here[0].alias("a"), here[1].alias("b"), there[0].alias("parent_a"), there[1].alias("parent_b"), "points")
    goes_on = F.col("last.at") >= F.col("h")
    end = _moved(F.col("last.a"), F.col("last.b"), less, to, back)
    ends = whole.select("conv", *(F.when(goes_on, e).otherwise(t).alias(c) for e, t, c in zip(end, to, "ab")))
    return empty.unionByName(begin).unionByName(rest), ends


def _end_digests(ends: DataFrame) -> DataFrame:
    """a, b and ends_sha256 of every node in which conversations end."""

    def pieces(batches):
        node, first, ids = None, None, []
        rows: list = []
        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != node or len(ids) == PIECE:
                    if ids:
                        rows.append((*node, first, ",".join(ids)))
                    node, first, ids = (a, b), conv, []
                ids.append(str(conv))
            yield _table(rows)
            rows = []
        if ids:
            yield _table([(*node, first, ",".join(ids))])

    def _table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["a", "b", "first", "ids"])

    def digests(batches):
        node, sha, rows = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) == node:
                    sha.update(b"," + ids.encode())
                else:
                    if node:
                        rows.append((*node, sha.hexdigest()))
                    node, sha = (a, b), hashlib.sha256(ids.encode())
            yield _digested(rows)
            rows = []
        if node:
            yield _digested([(*node, sha.hexdigest())])

    def _digested(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])

    dealt = ends.select("a", "b", "conv").repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    parts = dealt.mapInArrow(pieces, "a long, b long, first long, ids string")
    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids").mapInArrow(digests, "a long, b long, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """a, b, n_leaves and saved_tokens over each node's subtree. ``nodes``: a, b, parent_a, parent_b, depth, leaf (0 or 1) and
    saved of the node itself."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    live = nodes.select("a", "b", F.col("parent_a").alias("up_a"), F.col("parent_b").alias("up_b"), "depth", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lit(False).alias("done"))
    finished, reach = [], 1
    while reach <= deepest:
        added = live.filter(F.col("depth") >= reach).groupBy(F.col("up_a").alias("_a"), F.col("up_b").alias("_b")).agg(F.sum("n_leaves").alias("_n"), F.sum("saved_tokens").alias("_s"))
        grown = live.join(added, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
        grown = grown.withColumn("done", (F.col("depth") < 2 * reach) & F.col("_n").isNull())
        grown = grown.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("_n", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("_s", F.lit(0))}).drop("_a", "_b", "_n", "_s")
        # ancestors 2 * reach up: those of nodes at that depth are the root, deeper ones ask their ancestor
        far = F.col("depth") > 2 * reach
        ups = live.filter(F.col("depth") > reach).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("up_a").alias("_ua"), F.col("up_b").alias("_ub"))
        asked = grown.filter(far).join(ups, (F.col("up_a") == F.col("_a")) & (F.col("up_b") == F.col("_b"))).withColumns({"up_a": F.col("_ua"), "up_b": F.col("_ub")}).drop("_a", "_b", "_ua", "_ub")
        rest = grown.filter(~far).withColumns({c: F.when(F.col("depth") == 2 * reach, F.lit(0).cast("long")) for c in ("up_a", "up_b")})
        grown = materialize(asked.unionByName(rest), "jumped")
        finished.append(grown.filter("done"))
        live, reach = grown.filter("not done"), 2 * reach
    out = live
    for f in finished:
        out = out.unionByName(f)
    return out.select("a", "b", "n_leaves", "saved_tokens")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256."""
    placed = ordered.numbered(materialize(turns(conversations), "turns"), "conv", [F.col("turn").asc_nulls_first(), F.col("own")], "own")
    paths, ends = _paths(placed)
    most = [F.max(c).alias(c) for c in ("depth", "parent_a", "parent_b", "points")]  # the same in all of a node's rows
    nodes = materialize(paths.groupBy("a", "b").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *most), "nodes")
    below = nodes.filter("depth > 0").groupBy(F.col("parent_a").alias("_a"), F.col("parent_b").alias("_b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(below, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").drop("_a", "_b").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialize(nodes, "nodes")
    top = nodes.filter("depth = 0").select("conv_id").first()
    inner = nodes.filter("depth > 1").join(nodes.filter("depth > 0 and n_children > 0").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("conv_id").alias("parent_conv_id")), (F.col("parent_a") == F.col("_a")) & (F.col("parent_b") == F.col("_b"))).drop("_a", "_b")
    outer = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top[0] if top else None).cast("long")))
    own = nodes.select("a", "b", "parent_a", "parent_b", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    out = inner.unionByName(outer).join(rolled_up(own), ["a", "b"]).join(_end_digests(ends), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

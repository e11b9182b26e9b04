"""Merkle manifest of a table: one digest for all rows, one for each group of them, and a proof for every row.

A row's leaf is H of its fields, each `-` if null, else its length in UTF-8 bytes, a colon and its value. H is SHA-256 in
lowercase hex over the concatenated inputs. Within a language leaves stand by doc_id; every FAN consecutive nodes become their H
until one is left, the language's subroot. The subroots, by language, become the root in the same way.

1. Leaves (and those of the rows as a checker sees them) are made where the texts are read; only digests go on. Their
   positions come from ``ordered.numbered``, so a language with a third of all rows lies in many partitions.
2. Aligned blocks of FAN ** LEVELS nodes are traversed recursively, in post-order: a subtree's visit returns its
   digest. The blocks' roots are the nodes of the next traversal, which is distributed in the same way, until a language has one node.
   A block that isn't its language's first one climbs all LEVELS levels, even with one node: so its root stands on the same
   level as the others'.
3. On the way back, block roots carry the siblings from their place up to the root, and their block is traversed again: while
   the visits unwind, each appends the siblings to the leaves contained in its children. A leaf's whole proof exists
   only inside its task unless ``proofs`` is asked for; the table that moves has a digest of it.

Rows of one doc_id stand by their leaves' digests; null ids come first. Null languages are one group, the first. Repeated rows are
leaves of their own. An empty table gives an empty manifest."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelflow.llm import ordered
from pixelflow.llm.common import materialize

FAN, LEVELS = 8, 4  # nodes of a run, levels of a block: 4,096 leaves
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict[str, Column]) -> Column:
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in row.values()]
    return F.sha2(F.concat(*told), 256)


def visit(nodes: list[str], low: int, level: int, proofs: list[list[str]] | None = None) -> str:
    """Digest of the subtree of ``level`` levels over ``nodes`` from ``low`` on. Unwinding, appends to the ``proofs`` of every
    contained node the siblings of the child that holds it, as one string: the digests on its level, its own left out."""
    if level == 0:
        return nodes[low]
    step = FAN ** (level - 1)
    starts = range(low, min(low + FAN * step, len(nodes)), step)
    parts = [visit(nodes, at, level - 1, proofs) for at in starts]
    if proofs is not None:
        for k, at in enumerate(starts):
            siblings = "".join(parts[:k] + parts[k + 1 :])
            for i in range(at, min(at + step, len(nodes))):
                proofs[i].append(siblings)
    return H(*parts)


def height(block: int, n: int, levels: int) -> int:
    """Levels over a block of ``n`` nodes: the first one stops when one node is left, as it does on the top level too."""
    if block:
        return levels
    level = 0
    while FAN**level < n:
        level += 1
    return level


def folded(digest: str, at: int, siblings: list[str]) -> str:
    """What a node at position ``at`` makes of the root with its siblings, level by level."""
    for level in siblings:
        cut = at % FAN * 64
        digest, at = H(level[:cut], digest, level[cut:]), at // FAN
    return digest


NODE = "grp string, at long, node string"
PROVEN = "grp string, block long, above array<struct<at: long, siblings: array<string>>>"


def _dealt(nodes: DataFrame, levels: int, group: str = "grp"):
    return nodes.withColumn("block", F.floor(F.col("at") / FAN**levels)).groupBy(group, "block")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """The next traversal's nodes: grp, at and node of each block's root. ``nodes``: grp, at, node."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        digests, block = rows["node"].to_pylist(), key[1].as_py()
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "at": pa.array([block], pa.int64()), "node": [visit(digests, 0, height(block, len(digests), levels))]})

    return _dealt(nodes, levels).applyInArrow(run, NODE)


def climbed(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The traversals' inputs from ``nodes`` on; the last has one node a group, its root."""
    found = [nodes]
    while True:
        found.append(materialize(_blocks(found[-1], levels), "blocks"))
        if not found[-1].filter("at > 0").limit(1).count():
            return found


def _steps(proofs: list[list[str]], upper: list[dict]) -> pa.Array:
    """For each node of a block its position and siblings there, then those above the block."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("siblings", pa.list_(pa.string()))]))
    return pa.array([[{"at": k, "siblings": p}, *upper] for k, p in enumerate(proofs)], kind)


def descended(found: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """grp, block and what stands above the root of each block of the lowest level: (position, siblings) once for each traversal.
    ``above``: the same for the groups' own roots, their block being 0."""
    for nodes in reversed(found[1:-1]):

        def run(key: tuple[pa.Scalar, ...], table: pa.Table, up: pa.Table) -> pa.Table:
            rows = table.sort_by("at")
            digests, block = rows["node"].to_pylist(), key[1].as_py()
            proofs: list[list[str]] = [[] for _ in digests]
            visit(digests, 0, height(block, len(digests), levels), proofs)
            return pa.table({"grp": pa.array([key[0].as_py()] * len(digests), pa.string()), "block": rows["at"].cast(pa.int64()), "above": _steps(proofs, up["above"].to_pylist()[0])})

        above = materialize(_dealt(nodes, levels).cogroup(above.groupBy("grp", "block")).applyInArrow(run, PROVEN), "above")
    return above


def manifest(docs: DataFrame, seen: dict[str, Column] | None = None, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """For every row doc_id, leaf, subroot, root, proof_sha256 (H of its proof), and folded_root and verified: what the row as a
    checker sees it, with the fields ``seen`` in place of its own, makes of the root with the proof, and whether it is the
    root. ``proofs``: also ``proof``, the siblings as a list with a string for each level. ``levels``: of a block."""
    own = {c: F.col(c) for c in FIELDS}
    there = leaf(own | seen) if seen else F.lit(None).cast("string")
    rows = docs.select(F.col("lang").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("node"), there.alias("other"))
    rows = materialize(rows.withColumn("other", F.when(F.col("other") != F.col("node"), F.col("other"))), "leaves")
    leaves = ordered.numbered(rows, "grp", [F.col("doc_id").asc_nulls_first(), F.col("node")])
    tree = climbed(leaves.select("grp", "at", "node"), levels)
    # all subroots are one group of the upper tree, numbered by language
    subroots = materialize(ordered.numbered(tree[-1].select(F.lit("").alias("one"), "grp", "node"), "one", [F.col("grp").asc_nulls_first()]), "subroots")
    upper = climbed(subroots.select(F.col("one").alias("grp"), "at", "node"), levels)
    top = upper[-1].first()
    begin = docs.sparkSession.createDataFrame([("", 0, [])], PROVEN)
    above = descended(tree, _of_groups(subroots, descended(upper, begin, levels), levels), levels)
    return _judged(leaves, above, tree[-1].select("grp", F.col("node").alias("subroot")), top["node"] if top else None, proofs, levels)


def _of_groups(subroots: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """grp (a language), block 0 and what stands above each language's subroot."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, up: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        digests, block = rows["node"].to_pylist(), key[1].as_py()
        proofs: list[list[str]] = [[] for _ in digests]
        visit(digests, 0, height(block, len(digests), levels), proofs)
        return pa.table({"grp": rows["grp"].cast(pa.string()), "block": pa.array([0] * len(digests), pa.int64()), "above": _steps(proofs, up["above"].to_pylist()[0])})

    return _dealt(subroots, levels, "one").cogroup(above.withColumnRenamed("grp", "one").groupBy("one", "block")).applyInArrow(run, PROVEN)


def _judged(leaves: DataFrame, above: DataFrame, subroots: DataFrame, root: str | None, proofs: bool, levels: int) -> DataFrame:
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if proofs else "")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, up: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        digests, others, block = rows["node"].to_pylist(), rows["other"].to_pylist(), key[1].as_py()
        upper, subroot = up["above"].to_pylist()[0], up["subroot"].to_pylist()[0]
        found: list[list[str]] = [[] for _ in digests]
        visit(digests, 0, height(block, len(digests), levels), found)
        rest = "".join(s for x in upper for s in x["siblings"])
        made = []
        for k, (mine, other, siblings) in enumerate(zip(digests, others, found)):
            got = folded(other or mine, k, siblings)
            for x in upper:
                got = folded(got, x["at"], x["siblings"])
            made.append((subroot, root, H(*siblings, rest), got, got == root))
        out = {"doc_id": rows["doc_id"], "leaf": rows["node"]}
        out |= {c: [m[i] for m in made] for i, c in enumerate(("subroot", "root", "proof_sha256", "folded_root", "verified"))}
        if proofs:
            out["proof"] = pa.array([[*s, *(t for x in upper for t in x["siblings"])] for s in found], pa.list_(pa.string()))
        return pa.table(out)

    up = above.join(subroots.withColumnRenamed("grp", "_g"), F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")
    return _dealt(leaves, levels).cogroup(up.groupBy("grp", "block")).applyInArrow(run, schema)


def lowered(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Tampering of the query: texts of ids whose decimal crc32 is divisible by 3 lose their capitals A-Z."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0
    return {"text": F.when(hit, F.translate(F.col(text), upper, upper.lower())).otherwise(F.col(text))}

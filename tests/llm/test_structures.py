"""Prefix trie, Merkle manifest and pairwise ranking against brute force."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelflow.llm import merkle, neighbours, ordered, prefix_trie, quality_ranker, queries

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# positions and digests


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_and_digests_of_keys_in_many_partitions(spark, partitions):
    rng, rows = random.Random(1), []
    for k in range(900):
        key = rng.choice([None, 5, 5, 5, 9, *range(20, 40)])
        rows.append((key, rng.randint(0, 50), hashlib.sha256(str(k).encode()).digest()[:16], k))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(rows, "key long, place int, own binary, id int").repartition(3)
        got = ordered.numbered(df, "key", [F.col("place"), F.col("own")], "own").collect()
        plain = {(r.id): r.at for r in ordered.numbered(df.drop("own"), "key", [F.col("place"), F.col("id")]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and len(plain) == len(rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    found = {r.id: r for r in got}
    for part in by.values():
        sums = [0] * ordered.LANES
        for at, (_, _, own, k) in enumerate(part):
            before = ordered.pack(sums)
            words = [int.from_bytes(own[4 * i : 4 * i + 4], "big") for i in range(ordered.LANES)]
            sums = [(s + w * pow(b, at, ordered.P)) % ordered.P for s, w, b in zip(sums, words, ordered.BASES)]
            assert (found[k].at, (found[k].a, found[k].b), (found[k].before_a, found[k].before_b)) == (at, ordered.pack(sums), before)
        assert [plain[r[3]] for r in sorted(part, key=lambda r: (r[1], r[3]))] == list(range(len(part)))


# prefix trie


def brute_trie(rows):
    own, by = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append(((t is not None, t or 0), own(r or "", x or ""), (r or "", x or "")))
    turns = {c: [z[2] for z in sorted(v, key=lambda z: z[:2])] for c, v in by.items()}
    built, members, children = {}, {}, {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:])
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = sum(saved[q] for q in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], H(ends)))
    return sorted(out)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made(df):
    return sorted(tuple(r) for r in prefix_trie.trie(df).select(NODE).collect())


def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = made(df)
    assert got == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(NODE)} FROM ({queries.oracle_sql()['op11_prefix_trie']})").fetchall())


def test_trie_of_odd_conversations(spark):
    rng, rows = random.Random(3), []
    for c in (0, 1, 2, 5, 17, 99, 100, 101, 250, 263, 299, -3, -100, 10**12 + 7):  # conversation 200 is absent
        for t in range(rng.choice([1, 2, 3, 7, 9])):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["a", "é🙂", None, "", "b"])))
    rows += [(300 + k % 5, k // 5, "user", "same") for k in range(60)]  # equal conversations
    rows += [(400, t, "user", f"long {t // 3}") for t in range(150)] + [(k, t, "user", f"long {t // 3}") for k in (401, 402) for t in range(rng.choice([100, 150]))]
    rows += [(7, None, "user", "first"), (7, None, None, "second"), (7, 1, "user", "x"), (7, 1, "user", "x"), (None, 1, "user", "nobody")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, a int, conv string").repartition(5)
    assert made(df) == brute_trie(rows)
    assert made(df.limit(0)) == [] and made(df.filter("conv_id is null")) == []
    assert made(df.filter("conv_id = 101")) == brute_trie([r for r in rows if r[0] == 101])


def test_many_ends_in_one_node(spark):
    ends = spark.range(20_001).select((F.col("id") % 2).alias("a"), F.lit(4).cast("long").alias("b"), (F.col("id") - 300).alias("conv")).repartition(6)
    got = {r.a: r.ends_sha256 for r in prefix_trie._end_digests(ends).collect()}
    assert got == {a: H(",".join(str(k - 300) for k in range(20_001) if k % 2 == a)) for a in (0, 1)}


# Merkle manifest


def brute_manifest(rows):
    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    groups, out = {}, []
    for k, text, lang, source, n in rows:
        told = lambda t: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (k, source, lang, n, t)))
        hit = k is not None and text is not None and zlib.crc32(str(k).encode()) % 3 == 0
        other = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if hit else text
        groups.setdefault(lang, []).append(((k is not None, k or 0), told(text), told(other), k))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([x[1] for x in sorted(groups[g])]) for g in langs}
    top = climb([trees[g][-1][0] for g in langs])
    for place, g in enumerate(langs):
        for i, (_, mine, digest, k) in enumerate(sorted(groups[g])):
            proof = []
            for levels, at in ((trees[g], i), (top, place)):
                for nodes in levels[:-1]:
                    run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
                    proof += run[: at % 8] + run[at % 8 + 1 :]
                    digest, at = H(*run[: at % 8], digest, *run[at % 8 + 1 :]), at // 8
            out.append((k, mine, trees[g][-1][0], top[-1][0], H(*proof), digest, digest == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    rows = [(k, rng.choice(["Ab", "é ß", "", None, "x" * 5000]), rng.choice(["en"] * 8 + ["de", "", None, "é"]), rng.choice(["s", None]), rng.choice([1, None])) for k in range(700)]
    rows += [(9, "Ab", "en", "s", 1), (9, "Ab", "en", "s", 1), (None, "A", "en", None, None), (None, None, None, None, None), (5000, "One", "one", "s", 3)]
    rows += [(6000 + k, "T", f"lang {k}", "s", 1) for k in range(20)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, at int, node string").repartition(5)
    got = merkle.manifest(df, merkle.lowered(), proofs=True, levels=levels).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == brute_manifest(rows)
    assert all(H(*r.proof) == r.proof_sha256 for r in got) and any(r.verified for r in got) and not all(r.verified for r in got)
    assert merkle.manifest(df.limit(0), merkle.lowered()).collect() == []
    alone = merkle.manifest(df.filter("doc_id = 5000")).collect()
    assert [(r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in alone] == [(alone[0].leaf,) * 3 + (H(), True)]


def test_manifest_of_the_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.queries()["op12_merkle_manifest"](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()['op12_merkle_manifest']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


# Pairwise ranking


def plain_features(text):
    content = (text or "").encode()
    n, words, lines = len(content), [w for w in content.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w], [x for x in content.split(b"\n") if x.strip()]
    share = lambda cs: sum(c in cs for c in content) / max(n, 1)
    triples = list(zip(words, words[1:], words[2:]))
    return {
        "upper": share(range(65, 91)), "digits": share(range(48, 58)), "sign_35": share(b"#"), "words": np.log1p(len(words)),
        "distinct_words": len(set(words)) / len(words) if words else 1.0, "distinct_triples": len(set(triples)) / len(triples) if triples else 1.0,
        "repeated_words": sum(a == b for a, b in zip(words, words[1:])) / max(len(words) - 1, 1), "distinct_lines": len(set(lines)) / len(lines) if lines else 1.0,
        "capital_words": sum(any(65 <= c < 91 for c in w) and not any(97 <= c < 123 for c in w) for w in words) / max(len(words), 1),
        "mixed_words": sum(any(c < 128 and not chr(c).isalpha() for c in w) for w in words) / max(len(words), 1), "short_words": sum(len(w) == 1 for w in words) / max(len(words), 1),
        "few_words": float(len(words) < 50), "no_words": float(not words),
    }


def test_features(spark, docs):
    texts = [r.text for r in docs.collect()] + ["A a A", "\n\n", "x\ty\x0bz", "AB ab A1 é ÉÉ"]
    for text in texts:
        got = dict(zip(quality_ranker.FEATURES, quality_ranker.features(text)))
        assert len(got) == len(quality_ranker.FEATURES) and all(np.isfinite(v) for v in got.values())
        for name, value in plain_features(text).items():
            assert got[name] == pytest.approx(value), (name, text)


def test_preferences_are_learned_by_differences():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6))
    worth = x @ np.array([2.0, -1.0, 0.5, 0, 0, 0]) + rng.logistic(size=600) * 0.3
    labels = (worth > np.quantile(worth, 0.2)).astype(int)
    model = quality_ranker.learned(x, labels, 0.2)
    winners, losers = quality_ranker.preferences(labels)
    assert len(winners) == 120 * quality_ranker.PAIRS and (labels[winners] == 1).all() and (labels[losers] == 0).all()
    z = (x - model.mean) / model.scale
    apart = np.clip(z, -6, 6)[winners] - np.clip(z, -6, 6)[losers]
    slope = apart.T @ (1 / (1 + np.exp(apart @ model.weights))) / len(apart) - quality_ranker.RIDGE * model.weights
    assert np.abs(slope).max() < 1e-6  # the loss is at its smallest
    score = model.score(x)
    assert (score < quality_ranker.CUT).sum() == 120 and ((score >= quality_ranker.CUT) == labels).mean() > 0.93


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.queries()["op13_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "_id")
    got = rows.join(labels, F.col("doc_id") == F.col("_id")).collect()
    assert rows.count() == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    good, bad = (np.array([r.score for r in held if r.quality == k]) for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.995
    assert np.mean([r.predicted == r.quality for r in held]) > 0.98 and np.mean([r.predicted for r in held if r.quality]) > 0.995
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_nothing_is_learned_from_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    wrong = labels.withColumn("quality", F.when(quality_ranker.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_ranker.classify(docs, x).collect())) for x in (labels, wrong))
    assert a == b


def test_classifier_of_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (6, 1, 0), (11, 0, 0), (5, 3, 0), (777, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, label int")
    out = quality_ranker.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 6}) == 1
    assert quality_ranker.classify(none, labels).collect() == []
    assert {(r.score, r.predicted) for r in quality_ranker.classify(docs, labels.limit(0)).collect()} == {(0.5, 0)}
    assert {r.score for r in quality_ranker.classify(docs, labels.filter("quality = 1")).collect()} == {1.0}


# Nearest neighbours


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, sf):
    path = f"/root/testdata/{sf}"
    got = queries.queries()["op9_nearest_neighbours"](spark, path).collect()
    want = neighbours.exact(spark.read.parquet(f"{path}/embeddings.parquet").toPandas(), 20, lambda i: i % 20 == 0)
    found, true = {}, {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, _, v, _ in want:
        true.setdefault(q, set()).add(v)
    assert set(found) == set(true)
    recall = [len(found[q] & true[q]) / len(true[q]) for q in true]
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.7


def test_every_labelled_row_is_fitted(spark):
    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"))
    noise = F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000
    told = rows.select("doc_id", F.array(noise, F.col("quality") + noise * 2, F.when(F.col("doc_id") == 11_999, 1.0).otherwise(0.0)).cast("array<float>").alias("features"))
    model = quality_ranker.fit(told, rows)
    x = np.array([r.features for r in told.orderBy("doc_id").collect()])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    assert (model.raw(x) < model.threshold).sum() == 4000
    counts = {0: 4000, 1: 8000}
    found = quality_ranker.pairs(rows.join(told, "doc_id").withColumnRenamed("quality", "label"), counts, model.mean, model.scale)
    apart = np.array([r.apart for r in found.collect()])
    assert len(apart) == 4000 * quality_ranker.PAIRS and (apart[:, 2] > 0).any()  # the marked row is in a pair
    slope = apart.T @ (1 / (1 + np.exp(apart @ model.weights))) / len(apart) - quality_ranker.RIDGE * model.weights
    assert np.abs(slope).max() < 1e-6

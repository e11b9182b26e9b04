import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelflow.llm import bpe, language, licences, near_duplicates, neighbours, packing, queries, training_order, url_filter
from tests.llm.conftest import ROWS
from tests.llm.test_documents import grouped, words

tokenizers = pytest.importorskip("tokenizers")
WORD = queries.tokenizer("word_bpe_49k.json")
word = tokenizers.Tokenizer.from_file(WORD)


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def fused(rows, model):
    """Brute force of the fusion. ``rows``: text, declared, host, suffix, fitted."""
    n = len(model.languages)
    scores = [model.score(r[0]) for r in rows]
    logs = [s * language.TEMPER for s, _ in scores]
    soft = [softmax(x) if g else None for x, (_, g) in zip(logs, scores)]
    count = lambda pick: sum((p for p, r in zip(soft, rows) if p is not None and pick(r)), np.zeros(n))
    shrunk = lambda own, to: (own + language.STRENGTH * to) / (own.sum() + language.STRENGTH)
    base = count(lambda r: True) + 1
    base, apart = base / base.sum(), count(lambda r: not r[4])
    out = []
    for (text, tag, host, suffix, _), x, (s, grams) in zip(rows, logs, scores):
        prior = shrunk(count(lambda r: suffix is not None and r[3] == suffix), base) if host is not None or suffix is not None else base
        prior = shrunk(count(lambda r: host is not None and r[2] == host), prior) if host is not None or suffix is not None else prior
        # a pair without host or suffix still shrinks, towards what is known
        told = tag is not None and any(p is not None and r[1] == tag and not r[4] for p, r in zip(soft, rows))
        evidence = np.log((count(lambda r: r[1] == tag and not r[4]) + 0.1) / (apart + 1.0)) if told else np.zeros(n)
        post = softmax(x + np.log(prior) + evidence)
        kept = post.max() >= language.MIN_POSTERIOR and (grams < language.MIN_BYTES or s.max() / max(grams, 1) >= model.floor) and (grams > 0 or told)
        out.append((model.languages[int(post.argmax())], round(float(post.max()), 6), bool(kept)))
    return out


def test_fusion_equals_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000")
    model = language.fit(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"))
    texts = [(r.text, r.lang) for r in d.orderBy("doc_id").limit(60).collect()]
    rng = random.Random(4)
    rows = [(t, rng.choice([tag, tag, None, "de"]), rng.choice(["h1", "h2", "h3", None]), rng.choice(["fr", "com", None]), rng.random() < 0.3) for t, tag in texts]
    rows += [("", "fr", "h1", "fr", False), (None, None, "new", "com", False), (None, "zz", None, None, False), ("a b", None, None, None, False), rows[0]]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, tag string, host string, suffix string, used boolean").repartition(3)
    got = language.identify(df, model, "text", F.col("tag"), F.col("host"), F.col("suffix"), F.col("used")).select("row.k", "language", F.round("posterior", 6).alias("p"), "kept").orderBy("k").collect()
    want = fused(rows, model)
    assert len(got) == len(rows)
    for r, (lang, p, kept) in zip(got, want):
        assert (r.language, r.kept) == (lang, kept) and abs(r.p - p) < 1e-5, rows[r.k]


def test_language_without_columns_of_evidence(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"))
    assert language.identify_documents(d.drop("source")).count() == d.count()
    bare = language.identify_documents(d.select("doc_id", "text"), model=model)
    assert bare.count() == d.count() and bare.filter("kept").count() > 0.9 * d.count()


def test_licences_with_insertions_and_deletions(spark):
    rng, texts = random.Random(9), {}
    templates = licences.TEMPLATES
    clean = lambda t: words("".join(c for c in t.lower() if c not in licences.IGNORED))
    for k in range(160):
        w = list(templates.values())[k % len(templates)].split()
        for _ in range(rng.randint(0, 3) if len(w) > 20 else 0):
            at = rng.randrange(len(w))
            if rng.random() < 0.5:
                del w[at]
            else:
                w.insert(at, f"ins{rng.randint(0, 99)}")
        texts[k] = " ".join([f"f{rng.randint(0, 999)}" for _ in range(rng.randint(0, 90))] + w + [f"g{rng.randint(0, 999)}" for _ in range(rng.randint(0, 60))])
    want = set()
    for k, text in texts.items():
        grams = [tuple(w) for t in [clean(text)] for w in (t[i : i + 5] for i in range(len(t) - 4))]
        for name, t in templates.items():
            tw = clean(t)
            tg = [tuple(tw[i : i + 5]) for i in range(len(tw) - 4)]
            s = max(1, len(tg) // 4)
            if any(len(set(tg) & set(grams[b : b + len(tg) + s])) >= licences.CONTAINED * len(set(tg)) for b in range(0, len(grams), s)):
                want.add((k, name))
    got = {(r.doc_id, r.licence) for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and len(want) > 120


def test_cuts_lie_at_boundaries(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3000)
    size = 128
    p = packing.Packer(WORD, size, 0)
    assert p.block == 4096
    sample = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(k, t) for k, t, _, _ in ROWS] + [(-1, "word " * 20_000)]
    pieces = [x for k, t in sample for x in p.add(k, t)] + list(p.flush())
    ids = [np.array([*word.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for _, t in sample]
    stream, at, whole = np.concatenate(ids), 0, [k for (k, _), i in zip(sample, ids) for k in [k] * len(i)]
    ends = set(np.cumsum([len(i) for i in ids]).tolist())
    bounds = sorted(ends | set((np.flatnonzero(p.stops[stream]) + 1).tolist()) | {0})
    far = [(a, b) for a, b in zip(bounds, bounds[1:]) if b - a > size]
    lengths = Counter()
    for doc_id, _, length, crc, doc_tokens, sequence, offset in pieces:
        assert set(whole[at : at + length]) == {doc_id} and crc == zlib.crc32(stream[at : at + length].tobytes())
        assert offset == lengths[sequence]
        lengths[sequence] += length
        at += length
        if offset == 0 and at - length not in bounds:  # a cut off all boundaries: only where there is none for a window
            assert any(a < at - length < b for a, b in far)
    assert at == len(stream) and max(lengths.values()) <= size


def test_repeated_rows_are_packed_as_often(docs):
    n = Counter(r.doc_id for r in packing.pack(docs, WORD).collect() if r.start == 0)
    assert n == Counter(k for k, _, _, _ in ROWS)


def test_neighbours_by_row(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[40] *= 5  # so that a copy of it comes first
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(40, x[7].tolist()), (40, x[40].tolist()), (9, x[9].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("id") % 20 == 0, 5).collect()
    ids, all_ = np.array([k for k, _ in rows]), np.array([v for _, v in rows])
    want = Counter()
    for q in np.flatnonzero(ids % 20 == 0):
        score = (all_ * all_[q]).sum(axis=1)
        others = np.flatnonzero(np.arange(len(ids)) != q)
        best = others[np.lexsort((ids[others], -score[others]))[:5]]
        want.update((int(ids[q]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(best))
    assert Counter(map(tuple, got)) == want and want[40, 1, 40, float((x[40] * x[40]).sum())] == 2


def test_urls_with_many_dots_and_repeated_pages(spark):
    long = "http://" + "a." * 200_000 + "spam-farm.example.org/x"
    rows = [(1, long), (1, long), (2, "http://" + "b" * 500_000), (3, "://..//"), (4, "http://x.spam-farm.example.org.")]
    listed = spark.createDataFrame([("spam-farm.example.org",)], "domain string")
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), [], listed).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "allow")]


def test_long_lists_go_shard_after_shard(spark, monkeypatch):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 700).cast("string"), F.lit(".example.com/")).alias("url"))
    listed = spark.range(0, 700, 3).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.com")).alias("domain"))
    monkeypatch.setattr(url_filter, "MAX_BITS", 2000)
    got = url_filter.judge(pages, [], listed)
    assert got.filter((F.col("verdict") == "block") != (F.col("page_id") % 700 % 3 == 0)).count() == 0 and got.count() == 2000


def test_sets_of_rows_without_id(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (3, "seven"), (None, None), (4, None)]
    got = near_duplicates.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and all(r.kept and r.component_id == r.doc_id for r in got)


def test_shard_files(spark, docs, none, tmp_path):
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    rows = training_order.shards(docs, path, 5, length=64, per_shard=16)
    made = training_order.write_files(rows, str(tmp_path)).orderBy("shard").collect()
    total = sum(r.n_slots for r in made)
    assert [r.shard for r in made] == list(range(len(made))) and all(zlib.crc32(open(r.path, "rb").read()) == r.crc32 for r in made)
    want = {s: x.tobytes() for s, x in training_order.read(rows, 0, total)}
    for first in (0, 5, 16, 30, total - 1):
        got = list(training_order.read_files(str(tmp_path), first, 40, 64, 16))
        assert [s for s, _ in got] == list(range(first, min(first + 40, total))) and all(x.tobytes() == want[s] for s, x in got)
    assert training_order.write_files(training_order.shards(none, path, 5), str(tmp_path / "n")).collect() == []


def test_caches_go_with_their_task():
    p = bpe.Pieces(len)
    with pytest.raises(KeyError), bpe.pieces_of_a_task():
        assert p["abc"] == 3 and len(p) == 1
        raise KeyError
    assert len(p) == 0


def test_caches_keep_what_came_first():
    p = bpe.Pieces(len)
    with bpe.pieces_of_a_task(2):
        assert [p[x] for x in ("a", "bb", "ccc")] == [1, 2, 3]
    assert dict(p) == {"a": 1, "bb": 2}


def test_byte_pieces_are_the_patterns():
    parts = ["a", "The", "don't", " ", "\n", "\t", ",", ".", "?!", "7", "'s", "é", "ß", "Σ", "１", "ʰ", "x\u0301", "\u3000", "\x1c", "日本"]
    for n in range(4):
        for chunk in map("".join, itertools.product(parts, repeat=n)):
            assert bpe.byte_pieces(chunk) == bpe.BYTE_PATTERN.findall(chunk)


def test_pipeline_rows(spark):
    sf = "/root/testdata/sf0.001"
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, sf).cache()
    texts = {r.doc_id: r.text for r in kept.collect()}
    want = {k for k, top in grouped(list(texts.items()), 80).items() if k == top}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == want
    by = {}
    for r in pieces:
        by.setdefault(r.doc_id, []).append(r)
    for k, found in by.items():
        ids, at = np.array([*word.encode(texts[k], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)

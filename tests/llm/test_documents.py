import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelflow.llm import language, licences, near_duplicates, neighbours, quality, queries, url_filter
from tests.llm.conftest import ROWS

SEP = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SEP.split(text or "") if w]


def shingle_set(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def grouped(rows, percent=85):
    """Brute force: doc_id to the smallest doc_id that it reaches."""
    sets, parent = [(k, shingle_set(t)) for k, t in rows], {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in parent}


def test_near_duplicates_equal_brute_force(spark, docs, none):
    rng = random.Random(3)
    rows = [(k, t) for k, t, _, _ in ROWS if k != 4 and k != 5]
    bases = [[f"v{rng.randint(0, 400)}" for _ in range(rng.randint(30, 120))] for _ in range(6)]
    for k in range(150):  # families whose members differ in a few words, at similarities around the threshold
        w = list(bases[k % 6])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 99)}"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates.group(df).collect()
    want = grouped(rows)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingle_set(dict(rows)[r.doc_id])) for r in got)
    left = near_duplicates.keep_one(docs)
    assert left.columns == docs.columns and {5, 7}.isdisjoint(r.doc_id for r in left.collect())
    assert near_duplicates.group(none).collect() == []


def test_one_row_of_a_repeated_document_stays(spark, docs):
    left = [r.doc_id for r in near_duplicates.keep_one(docs).collect()]
    assert len(left) == len(set(left)) and 6 in left
    rows = [(1, "a b c", 0), (1, None, 9), (1, "a b c", 2), (2, "A b c", 3), (2, "A b c", 3), (3, "d", 4), (None, "e", 5), (None, "e", 5)]
    got = near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string, extra int")).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([rows[2], rows[5], rows[6], rows[7]], "doc_id long, text string, extra int").collect()))


def test_estimate_is_close(spark):
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(101, 1101, dtype=np.uint64)
    a, b = (near_duplicates._mix(x) for x in (a, b))
    sig = [near_duplicates.packed(near_duplicates.minima(x)).view(np.int64).tolist() for x in (a, b)]
    df = spark.createDataFrame([(sig[0], sig[1])], "a array<long>, b array<long>")
    assert abs(df.select(near_duplicates.estimate(F.col("a"), F.col("b"))).first()[0] - 900 / 1100) < 0.15


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(50, 40), (40, 60)]
    got = dict(near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(21)}, 40: 40, 50: 40, 60: 40}


def test_quality_base_columns(docs, none):
    got = Counter(tuple(r) for r in quality.assess(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for k, text, _, _ in ROWS:
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want[k, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and quality.filter_documents(none).collect() == []


def test_sketch_merges_exactly(spark):
    df = spark.range(100_000).select(F.col("id").alias("v"))
    b = df.select("v", quality.bucket(F.col("v")).alias("b")).select("v", "b", quality.bucket_low(F.col("b")).alias("low"))
    assert b.filter("low > v or v - low > v / 16").count() == 0 and b.filter("v < 32 and low != v").count() == 0


def test_thresholds_follow_their_group(spark):
    usual, marked = " ".join(f"word{k}" for k in range(60)), " ".join(f"word{k}|" for k in range(60))
    rows = [(k, usual + f" {k}", "en", "plain") for k in range(80)] + [(100 + k, marked + f" {k}", "en", "tables") for k in range(80)] + [(999, marked, "en", "plain")]
    got = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert not got[999] and all(v for k, v in got.items() if k != 999)


def test_language(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identify_documents(d)
    truth = got.filter("row.lang = language").count() / d.count()
    assert truth > 0.97 and got.filter("kept").count() >= 0.97 * d.count()
    model = language.fit(d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"))
    held = language.identify(d.filter("doc_id % 2 = 1"), model, F.col("text"))  # held out, by the text alone
    assert held.filter("row.lang = language").count() / held.count() > 0.95
    odd = language.identify_documents(docs)
    assert odd.count() == len(ROWS) and odd.select("row.*").columns == docs.columns
    assert language.identify_documents(none).collect() == []
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    p = language.identify_pages(pages, model)
    assert p.filter(F.col("language") == language.markup_language(F.col("row.html"))).count() / pages.count() > 0.9


def test_all_pages_are_judged_by_all_evidence(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in queries.page_queries()["op4_language_id_pages"](spark, sf).collect()}
    assert len(got) == pages.count() and list(got) != []
    told = pages.select("page_id", language.markup_language(F.col("html")).alias("tag")).filter("tag is not null").collect()
    assert np.mean([got[r.page_id].language == r.tag for r in told]) > 0.9
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"))
    words = {r.lang: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 300").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    page = lambda k, host, lang, text: (k, f"http://{host}/", f"<html{lang}><body>{text}</body></html>")
    rows = [page(k, f"h{k}.de" if k % 2 else f"h{k}.fr", "", words["de" if k % 2 else "fr"]) for k in range(200)]
    rows += [page(1000, "new.de", "", ""), page(1001, "new.fr", "", ""), page(1002, "h1.de", "", "")]  # suffix, suffix, host
    silent = language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).filter("row.page_id >= 1000")
    assert {r.row.page_id: r.language for r in silent.collect()} == {1000: "de", 1001: "fr", 1002: "de"}


def test_evidence_decides_where_text_is_silent(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"))
    rows = d.select("text", "lang", F.concat(F.lit("host-"), "lang").alias("host")).unionByName(spark.createDataFrame([("", None, "host-fr"), (None, "de", None)], "text string, lang string, host string"))
    got = language.identify(rows, model, F.col("text"), F.col("lang"), F.col("host")).filter("coalesce(row.text, '') = ''").collect()
    assert {(r.row.host, r.row.lang): r.language for r in got} == {("host-fr", None): "fr", (None, "de"): "de"}


def contains(text, template):
    clean = lambda t: words("".join(c for c in re.sub("[A-Z]", lambda m: m[0].lower(), t) if c not in licences.IGNORED))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = set(grams(clean(template)))
    return len(want & set(grams(clean(text)))) / len(want)


def test_licences(spark, docs, none):
    rng = random.Random(1)
    filler = lambda n: " ".join(f"f{rng.randint(0, 999)}" for _ in range(n))
    texts = {k: f"{filler(rng.randint(0, 300))} {t.upper() if k % 2 else t} {filler(50)}" for k, t in enumerate(licences.TEMPLATES.values())}
    texts[100] = filler(500)
    broken = licences.TEMPLATES["MIT grant"].split()
    broken[40] = "changed"
    texts[101] = filler(17) + " " + " ".join(broken)
    got = licences.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found = {(r.doc_id, r.licence) for r in got}
    want = {(k, name) for k, x in texts.items() for name, t in licences.TEMPLATES.items() if contains(x, t) >= licences.CONTAINED}
    assert found == want
    assert next(r.start_word for r in got if r.doc_id == 101) == 17
    assert [(r.doc_id, r.licence) for r in licences.scan(docs).collect()] == [(13, "MIT notice")] and licences.scan(none).collect() == []


def test_short_templates_are_refused(docs):
    with pytest.raises(ValueError, match="rights"):
        licences.scan(docs, {"rights": "All rights reserved.", "MIT notice": licences.TEMPLATES["MIT notice"]})


def test_url_verdicts(spark):
    urls = [None, "nothing", "http://", "HTTP://WWW.Free-Bets.example.com/x?y", "http://a.example.net/en/1", "http://a.example.net/enx", "http://example.net", "https://free-bets.example.com:80/", "https://x.example.com/de/#f", "http://y.org/fr/2", "ftp://spam-farm.example.org#a/b", "http://a b.example.com/é?", "http://y.org/fr/2"]
    pages = spark.createDataFrame([(k, u, "x", True) for k, u in enumerate(urls)], "page_id long, url string, host string, listed boolean")
    listed = spark.createDataFrame([("free-bets.example.com",), ("spam-farm.example.org",)], "domain string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, queries.RULES, listed).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.free-bets.example.com", "/x", None, "block"), 4: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        5: ("a.example.net", "/enx", "net/", "block"), 6: ("example.net", "", None, "allow"), 7: ("free-bets.example.com:80", "/", None, "allow"), 8: ("x.example.com", "/de/", "example.com/de/", "block"),
        9: ("y.org", "/fr/2", "org/fr/", "allow"), 10: ("spam-farm.example.org", "", None, "block"), 11: ("a b.example.com", "/é", None, "allow"), 12: ("y.org", "/fr/2", "org/fr/", "allow"),
    }
    assert url_filter.judge(pages.limit(0), queries.RULES, listed).collect() == [] and url_filter.judge(pages, [], listed.limit(0)).filter("verdict = 'block'").count() == 0


@pytest.mark.parametrize("shards", [1, 3])
def test_cascade_is_exact(spark, shards):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(7)).alias("h2"), (F.col("id") % 9 == 0).alias("listed"))
    cascades, rows = url_filter.build(keys, shards), keys.toPandas()
    assert len(cascades) == shards and len(cascades[0].levels) >= 2
    for s, c in enumerate(cascades):
        mine = rows[np.mod(rows.h2, shards) == s]
        assert (c.has(mine.h1.to_numpy(), mine.h2.to_numpy()) == mine.listed.to_numpy()).all()


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(20_000, None), (20_020, [0.0] * 16), (20_040, [float("nan")] * 16), (20_060, [None] * 16), (20_080, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = neighbours.search(df, F.col("id") % 20 == 0).collect()
    want = neighbours.exact(pd.DataFrame(rows, columns=["vec_id", "embedding"]).assign(embedding=list(x)), 20, lambda i: i % 20 == 0)
    found = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(got) == 150 * 20 and np.mean([(q, v) in found for q, _, v, _ in want]) >= 0.9
    assert all(abs(found[q, v] - s) < 1e-9 for q, _, v, s in want if (q, v) in found)
    few = neighbours.search(df.filter("vec_id < 5"), F.col("id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(q, r, v) for q, r, v, _ in neighbours.exact(pd.DataFrame(rows[:5], columns=["vec_id", "embedding"]).assign(embedding=list(x[:5])), 20, lambda i: i % 20 == 0)]
    assert neighbours.search(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_neighbours_of_all_lengths_and_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 16)) * np.exp(rng.normal(size=(4000, 1)))
    x[1000:2400] = x[17]  # a third and more of all rows are one vector
    x[3999] *= 1e200
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    want = neighbours.exact(pd.DataFrame({"vec_id": range(4000), "embedding": list(x)}), 20, lambda i: i % 20 == 0)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == 200 * 20 and np.mean([(q, v) in found for q, _, v, _ in want]) >= 0.95
    copies = sorted((r.rank, r.vec_id) for r in got if r.query_id == 1000 and r.vec_id in {17, *range(1000, 2400)})
    assert [v for _, v in copies] == sorted(v for _, v in copies)
    score = {}
    for r in got:
        if r.vec_id in {17, *range(1000, 2400)}:
            score.setdefault(r.query_id, set()).add(r.score)
    assert all(len(s) == 1 for s in score.values())


def test_bitmaps_never_reject_a_link(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in (1, 7, 100, 3000, 40_000):
        for lost in (0, n // 13, n // 6):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 1 << 63, lost // 2, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            rows.append((len(a), len(b), near_duplicates.bitmap(a).tolist(), near_duplicates.bitmap(b).tolist(), 100 * common >= 85 * (len(a) + len(b) - common)))
    df = spark.createDataFrame(rows, "na long, nb long, ba array<long>, bb array<long>, link boolean")
    judged = df.select("link", near_duplicates._within("ba", "na", "bb", "nb", 85).alias("within")).collect()
    assert any(r.link for r in judged) and any(not r.within for r in judged)
    assert all(r.within for r in judged if r.link)

import random

import corpus_pipeline
from pixelflow.llm import language, queries
from tests.llm.test_documents import grouped, words


def test_pipeline_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, sf)
        assert kept.columns == columns and kept.exceptAll(before).count() == 0, name
        kept = kept.cache()
    ids = {r.doc_id for r in kept.collect()}
    passed = {r.doc_id for r in corpus_pipeline.apply_quality_rules(spark, language.identify_documents(docs).filter("kept").select("row.*"), sf).collect()}
    assert all(len(words(t)) >= 50 for k, t in rows if k in passed)
    group = grouped([(k, t) for k, t in rows if k in passed], 80)
    assert ids == {k for k, top in group.items() if k == top}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == ids


def test_queries_are_all_there():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]


def test_stage_drops_copies_from_four_fifths_on(spark):
    rng = random.Random(7)
    rows = []
    for k in range(8):  # pairs whose similarity is 0.79 to 0.86: 100 shingles each, some of which only one of the two has
        base = [f"p{k}w{rng.randint(0, 10**6)}" for _ in range(104)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 92 + k - 3] + [f"q{k}w{i}" for i in range(15 - k)]))]
    want = {p: {k for k, top in grouped(rows, p).items() if k == top} for p in (80, 85)}
    assert want[80] < want[85] < {k for k, _ in rows}
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in got} == want[80]

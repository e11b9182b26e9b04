"""Queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelflow.llm import bpe_codec, language, licences, merkle, near_duplicates, neighbours, packing, prefix_trie, quality, quality_ranker, token_counts, training_order, url_filter
from pixelflow.llm.common import ship, table

ORDER_KEY = 20_240_607
RULES = [url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
#: Block list: these names under each of the three domains (fixed values).
LISTED_NAMES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_ENDS = ["example.com", "example.net", "example.org"]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.shards(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), ORDER_KEY)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify_documents(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "kept")


def op4_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by its text, markup, host and address suffix; the text model is fitted on the documents."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"))
    out = language.identify_pages(table(spark, sf_dir, "pages"), model)
    return out.select("row.page_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "kept")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group(table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(f"{n}.{e}",) for n in LISTED_NAMES for e in LISTED_ENDS], "domain string")
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.lowered())


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranker.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _shipped(found: list[Callable]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in found}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _shipped([op1_training_order, op2_token_counts, op3_quality_rules, op4_language_id, op5_minhash_near_dedup, op6_bpe_codec, op7_url_filter, op8_licence_scan, op9_nearest_neighbours, op10_packing, op11_prefix_trie, op12_merkle_manifest, op13_quality_classifier])


def page_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Operators that have a second query, over pages."""
    return _shipped([op4_language_id_pages])


def oracle_sql() -> dict[str, str]:
    names = " OR ".join(f"host = '{n}.{e}' OR ends_with(host, '.{n}.{e}')" for n in LISTED_NAMES for e in LISTED_ENDS)
    return {"op7_url_filter": OP7.replace("$LISTED", names), "op3_quality_rules": OP3, "op11_prefix_trie": OP11, "op12_merkle_manifest": OP12}


OP7 = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN $LISTED THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

#: crc32 of a decimal number: the table of its 256 steps, and the number's digits through it.
CRC_TABLE = """SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) r(i)"""
CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST($ID AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295)"""

OP11 = """
WITH crc AS (%s),
t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, %s %% 6 AS h FROM (SELECT DISTINCT c FROM t), crc),
b AS (SELECT k.c, t.i AS o, t.r, t.x FROM k JOIN t ON t.c = k.c - k.c %% 100 AND t.i <= k.h
      UNION ALL SELECT k.c, t.i + 10, t.r, t.x FROM k JOIN t ON t.c = k.c AND t.i > k.h),
n AS (SELECT c, row_number() OVER w AS d, length(x) AS p, sha256(strlen(r) || ':' || r || x) AS s FROM b WINDOW w AS (PARTITION BY c ORDER BY o)),
q AS (SELECT c, d, p, sha256(string_agg(s, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM n
      UNION ALL SELECT c, 0, 0, '' FROM k),
u AS (SELECT *, lag(k) OVER w AS up, lead(k) OVER w IS NULL AS ends FROM q WINDOW w AS (PARTITION BY c ORDER BY d)),
v AS (SELECT k, min(c) AS c, max(d) AS d, max(p) AS p, max(up) AS up, count(*) AS n,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS e FROM u GROUP BY k),
m AS (SELECT v.*, coalesce(z.m, 0) AS m FROM v LEFT JOIN (SELECT up, count(*) AS m FROM v WHERE d > 0 GROUP BY up) z ON z.up = v.k),
s AS (SELECT q.k, count(*) FILTER (m.m = 0) AS leaves, sum((m.n - 1) * m.p) AS saved FROM m JOIN q ON q.c = m.c AND q.d <= m.d GROUP BY q.k)
SELECT m.c AS conv_id, CAST(m.d AS BIGINT) AS depth, w.c AS parent_conv_id, m.n AS n_convs, CAST(m.m AS BIGINT) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.e AS ends_sha256
FROM m JOIN s USING (k) LEFT JOIN m w ON w.k = m.up AND m.d > 0
""" % (CRC_TABLE, CRC.replace("$ID", "c"))

_LEAF = "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "$TEXT")) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A recursion climbs level by level: a language's nodes (g 0) and then the subroots (g 1); another folds each leaf with its siblings.
OP12 = """
WITH RECURSIVE crc AS (%s),
a AS (SELECT row_number() OVER () AS id, doc_id, lang, %s AS leaf, CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND %s %% 3 = 0 THEN %s ELSE %s END AS seen FROM documents, crc),
l AS (SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM a),
n AS (SELECT g, 0 AS v, i, leaf AS k, count(*) OVER (PARTITION BY g) AS c FROM l
      UNION ALL
      SELECT g, v + 1, i, k, count(*) OVER (PARTITION BY g) FROM (SELECT g, v, i // 8 AS i, sha256(string_agg(k, '' ORDER BY i)) AS k FROM n WHERE c > 1 GROUP BY g, v, i // 8)),
r AS (SELECT g, v, k FROM n WHERE c = 1),
w AS (SELECT 0 AS v, g AS i, k, count(*) OVER () AS c FROM r
      UNION ALL
      SELECT v + 1, i, k, count(*) OVER () FROM (SELECT v, i // 8 AS i, sha256(string_agg(k, '' ORDER BY i)) AS k FROM w WHERE c > 1 GROUP BY v, i // 8)),
x AS (SELECT n.g, n.v, n.i, n.k, r.v AS top FROM n JOIN r USING (g) UNION ALL SELECT -1, v, i, k, 99 FROM w WHERE c > 1),
b AS (SELECT p.g, p.v, p.i, coalesce(string_agg(o.k, '' ORDER BY o.i) FILTER (o.i < p.i), '') AS lo, coalesce(string_agg(o.k, '' ORDER BY o.i) FILTER (o.i > p.i), '') AS hi
      FROM x p JOIN x o ON o.g = p.g AND o.v = p.v AND o.i // 8 = p.i // 8 WHERE p.v < p.top GROUP BY ALL),
f AS (SELECT id, g, g AS lang_place, 0 AS v, i, seen AS k, '' AS proof FROM l
      UNION ALL
      SELECT f.id, b.g, f.lang_place, f.v + 1, f.i // 8, sha256(b.lo || f.k || b.hi), f.proof || b.lo || b.hi
      FROM (SELECT f.id, f.lang_place, f.k, f.proof, CASE WHEN f.g >= 0 AND f.v = r.v THEN -1 ELSE f.g END AS g, CASE WHEN f.g >= 0 AND f.v = r.v THEN 0 ELSE f.v END AS v, CASE WHEN f.g >= 0 AND f.v = r.v THEN f.lang_place ELSE f.i END AS i
            FROM f JOIN r ON r.g = f.lang_place) f JOIN b ON b.g = f.g AND b.v = f.v AND b.i = f.i),
e AS (SELECT id, arg_max(k, length(proof) * 100 + CASE WHEN g < 0 THEN 50 ELSE 0 END + v) AS k, arg_max(proof, length(proof) * 100 + CASE WHEN g < 0 THEN 50 ELSE 0 END + v) AS proof FROM f GROUP BY id)
SELECT l.doc_id, l.leaf, r.k AS subroot, w.k AS root, sha256(e.proof) AS proof_sha256, e.k AS folded_root, e.k = w.k AS verified
FROM l JOIN e USING (id) JOIN r ON r.g = l.g JOIN w ON w.c = 1
""" % (CRC_TABLE, _LEAF.replace("$TEXT", "text"), CRC.replace("$ID", "doc_id"), _LEAF.replace("$TEXT", _LOWER), _LEAF.replace("$TEXT", "text"))

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body, lang, source FROM documents),
w AS (SELECT k, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(body, chr(10)), lambda x: translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') AS l FROM d),
t AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
s AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM t) WHERE n > 1),
c AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM s) GROUP BY k),
m AS (SELECT d.doc_id, d.lang, d.source, CAST(len(w.w) AS BIGINT) AS n_words,
        CAST(length(translate(body, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
        CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(w.l) AS BIGINT) AS n_lines, CAST(len(w.l) - len(list_distinct(w.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (k) LEFT JOIN c USING (k)),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_symbols * 1000 // greatest(word_chars, 1) AS symbols_pm, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines_pm,
        n_repeat_words * 1000 // greatest(n_words, 1) AS repeats_pm, word_chars * 10 // greatest(n_words, 1) AS word_length_x10 FROM m),
v AS (SELECT lang, source, unnest([{'m': 'symbols_pm', 'v': symbols_pm}, {'m': 'dup_lines_pm', 'v': dup_lines_pm}, {'m': 'repeats_pm', 'v': repeats_pm}, {'m': 'word_length_x10', 'v': word_length_x10}]) AS p FROM x WHERE NOT base_failed),
b AS (SELECT lang, source, p.m AS m, CASE WHEN p.v < 32 THEN p.v ELSE (length(bin(p.v)) - 5) * 16 + (p.v >> (length(bin(p.v)) - 5)) END AS b FROM v),
h AS (SELECT 0 AS z, lang, source, m, b, count(*) AS n FROM b GROUP BY ALL
      UNION ALL SELECT 1, lang, NULL, m, b, count(*) FROM b GROUP BY ALL
      UNION ALL SELECT 2, NULL, NULL, m, b, count(*) FROM b GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY z, lang, source, m) AS total, sum(n) OVER (PARTITION BY z, lang, source, m ORDER BY b) AS upto FROM h),
q AS (SELECT z, lang, source, m, max(total) AS total, min(b) FILTER (upto * 4 >= total) AS b25, min(b) FILTER (upto * 4 >= total * 3) AS b75 FROM u GROUP BY ALL),
e AS (SELECT *, CASE WHEN b25 < 32 THEN b25 ELSE (b25 - (b25 // 16 - 1) * 16) << (b25 // 16 - 1) END AS q25, CASE WHEN b75 < 32 THEN b75 ELSE (b75 - (b75 // 16 - 1) * 16) << (b75 // 16 - 1) END AS q75,
        CASE m WHEN 'symbols_pm' THEN 60 WHEN 'dup_lines_pm' THEN 200 WHEN 'repeats_pm' THEN 150 ELSE 20 END AS slack FROM q WHERE total >= 50 OR z = 2),
f AS (SELECT z, lang, source, m, q25 - 3 * (q75 - q25) - slack AS low, q75 + 3 * (q75 - q25) + slack AS high FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (
   $OVER(symbols_pm) OR $OVER(dup_lines_pm) OR $OVER(repeats_pm) OR $OVER(word_length_x10) OR $UNDER(word_length_x10)) AS kept
FROM x
"""
for _side, _sign, _name in (("high", ">", "OVER"), ("low", "<", "UNDER")):
    for _m in quality.METRICS:
        _look = [f"(SELECT max({_side}) FROM f WHERE z = {z} AND m = '{_m}'{on})" for z, on in ((0, " AND f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source"), (1, " AND f.lang IS NOT DISTINCT FROM x.lang"), (2, ""))]
        OP3 = OP3.replace(f"${_name}({_m})", f"coalesce({_m} {_sign} coalesce({', '.join(_look)}), false)")

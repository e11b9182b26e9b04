"""Language identification by Bayesian fusion of evidence.

log posterior(language) = tempered text likelihood + log P(declared | language) + log prior(language | host), where
* the text likelihood is a hashed byte-trigram model, fitted on a bounded sample of labelled rows (SAMPLE rows for each
  language, at most half of them, drawn by a hash of the id; this bound is the model's only sample, and every row is
  judged on its whole text);
* the declared language's reliability is its soft confusion with the text's own verdict, over all rows but those of the
  sample: a label that taught the model tells nothing about labels;
* the host prior shrinks the host's soft counts towards its address suffix's, and those towards the whole corpus's,
  each with STRENGTH pseudo-rows. All counts are grouped sums over all rows with map-side partials, so a hot host is
  a few partial sums.

Priors are worked out once for each pair of host and suffix, in tables without rows of the corpus. Rows then meet two
tables, priors and tags: broadcast where adaptive execution finds them small, else joined by key, where a hot host is
split by adaptive execution and rows without host and suffix are dealt by a hash of their likelihoods.

Missing evidence (null or no such column) says nothing. A row is rejected if its best posterior stays under
MIN_POSTERIOR, or if its text is far from every language's (mean log likelihood under the model's floor; texts of fewer
than MIN_BYTES bytes are exempt). Null and empty texts are judged by the other evidence. Ties go to the first language.
Repeated rows count as often as they come; an empty table gives an empty result; rows travel under numbered names, so no
column's name can clash."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelflow.llm.common import materialize

LANGUAGES = ("en", "de", "fr", "es")
SLOTS = 1 << 16
SAMPLE = 4000  # labelled rows for each language, in expectation
TEMPER, STRENGTH, MIN_POSTERIOR, MIN_BYTES = 0.3, 20.0, 0.5, 40
SPAN = 1 << 15  # bytes looked up at once
STEP = 128
SALTS = 1024


def _slots(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def _drawn(id_col: Column, label: Column, shares: dict[str, float]) -> Column:
    """Whether the sample of the text model has the row."""
    share = F.lit(0.0)
    for x, part in shares.items():
        share = F.when(label == x, F.lit(part)).otherwise(share)
    return F.coalesce(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)) < share * float(1 << 30), F.lit(False))


@dataclass
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # SLOTS x languages, log probabilities
    floor: float  # mean log likelihood under which a text is in none of the languages
    shares: dict[str, float]  # of each label's rows in the sample

    def fitted(self, id_col: Column, label: Column) -> Column:
        """Whether the model was fitted on the row."""
        return _drawn(id_col, label, self.shares)

    def score(self, text: str | None) -> tuple[np.ndarray, int]:
        """Log likelihood in each language, and the number of trigrams."""
        raw = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
        out, n = np.zeros(len(self.languages)), max(0, len(raw) - 2)
        if not (text or "").strip():
            return out, 0
        for at in range(0, n, SPAN):
            out += self.weights[_slots(raw[at : at + SPAN + 2])].sum(axis=0, dtype=np.float64)
        return out, n


def fit(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> Model:
    """``labelled``: columns id, label, text. Counts are summed on the executors; SLOTS numbers a language reach the driver."""
    order = {x: k for k, x in enumerate(languages)}
    rows = labelled.filter(F.col("label").isin(*languages) & F.col("text").isNotNull())
    shares = {r["label"]: min(0.5, sample / r["count"]) for r in rows.groupBy("label").count().collect()}
    drawn = rows.filter(_drawn(F.col("id"), F.col("label"), shares)).select("label", "text")

    def count(batches):
        sums = np.zeros((len(order), SLOTS), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                for label, text in zip(b.column(0).slice(at, STEP).to_pylist(), b.column(1).slice(at, STEP).to_pylist()):
                    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
                    for k in range(0, len(raw) - 2, SPAN):
                        sums[order[label]] += np.bincount(_slots(raw[k : k + SPAN + 2]), minlength=SLOTS)
        lang, slot = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(slot), pa.array(sums[lang, slot])], ["lang", "slot", "n"])

    got = drawn.mapInArrow(count, "lang long, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((SLOTS, len(languages)))
    counts[got["slot"].to_numpy(np.int64), got["lang"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    smooth = counts + 0.5
    weights = np.log(smooth / smooth.sum(axis=0))
    seen = counts.sum(axis=0)
    mean = ((counts * weights).sum(axis=0)[seen > 0] / seen[seen > 0]).mean() if seen.any() else -np.log(SLOTS)
    return Model(languages, weights.astype(np.float32), float((mean - np.log(SLOTS) - 2) / 2), shares)


def _scored(model: Model, spark):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<loglik:array<double>,grams:bigint>")
    def score(texts: pa.Array) -> pa.Array:
        loglik, grams = [], []
        for at in range(0, len(texts), STEP):  # few texts at a time as Python strings
            for x in texts.slice(at, STEP).to_pylist():
                got, n = shared.value.score(x)
                loglik.append(got)
                grams.append(n)
        return pa.StructArray.from_arrays([pa.array(loglik, pa.list_(pa.float64())), pa.array(grams, pa.int64())], ["loglik", "grams"])

    return score.asNondeterministic()  # it isn't, but else a filter on its result would score every text once more


def _softmax(logs: Column) -> Column:
    """Log weights to probabilities."""
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _counts(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Soft counts of each language by key."""
    return rows.groupBy(*keys).agg(F.array(*(F.coalesce(F.sum(F.col("p")[k]), F.lit(0.0)) for k in range(n))).alias("n"))


def _total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _shrunk(own, to) -> Column:
    """Soft counts ``own`` to probabilities, with STRENGTH pseudo-rows dealt as ``to``."""
    return F.zip_with(own, to, lambda x, p: (x + STRENGTH * p) / (_total(own) + STRENGTH))


def identify(rows: DataFrame, model: Model, text: str | Column, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, fitted: Column | None = None) -> DataFrame:
    """``rows`` in one column ``row``, with language, posterior, text_language and kept. ``text``: a column's name, or an
    expression; ``fitted``: whether the model was fitted on the row."""
    spark, langs = rows.sparkSession, model.languages
    n, none = len(langs), F.lit(None).cast("string")
    place = {c: f"_c{k}" for k, c in enumerate(rows.columns)}
    clues = [(none if c is None else c.cast("string")).alias(f"_{k}") for k, c in (("declared", declared), ("host", host), ("suffix", suffix))]
    body = [] if isinstance(text, str) else [text.alias("_text")]
    score = _scored(model, spark)(F.col(place[text] if isinstance(text, str) else "_text"))
    loglik = F.transform("_s.loglik", lambda x: x * TEMPER)

    # a first pass for the evidence, of a few numbers a row; texts are scored once more for the verdict rather than written
    clue_only = rows.select(*clues, (F.lit(False) if fitted is None else fitted).alias("_fitted"), (F.col(text).alias(place[text]) if isinstance(text, str) else body[0]))
    seen = clue_only.select("_declared", "_host", "_suffix", "_fitted", score.alias("_s"))
    seen = materialize(seen.select("_declared", "_host", "_suffix", "_fitted", F.when(F.col("_s.grams") > 0, _softmax(loglik)).alias("p")), "evidence")
    told = seen.filter("p is not null")
    whole = _counts(told, [], n).select(F.transform("n", lambda x: x + 1.0).alias("n"))
    whole = whole.select(F.transform("n", lambda x: x / _total("n")).alias("base"))  # one row
    keys, zero = F.col("_host").isNotNull() | F.col("_suffix").isNotNull(), F.array(*(F.lit(0.0) for _ in langs))
    by_suffix = _counts(told.filter("_suffix is not null"), ["_suffix"], n).select(F.col("_suffix").alias("_x"), F.col("n").alias("n_suffix"))
    by_host = _counts(told.filter("_host is not null"), ["_host"], n).select(F.col("_host").alias("_y"), F.col("n").alias("n_host"))
    pairs = seen.filter(keys).select("_host", "_suffix").distinct()
    pairs = pairs.join(by_suffix, F.col("_suffix") == F.col("_x"), "left").join(by_host, F.col("_host") == F.col("_y"), "left").join(F.broadcast(whole), F.lit(True), "left")
    prior = _shrunk(F.coalesce("n_host", zero), _shrunk(F.coalesce("n_suffix", zero), F.col("base")))
    priors = materialize(pairs.select(F.col("_host").alias("_x"), F.col("_suffix").alias("_y"), prior.alias("prior")), "priors")
    apart = told.filter("not _fitted")
    # P(declared | language), up to a factor that is the same for all languages
    tags = _counts(apart.filter("_declared is not null"), ["_declared"], n).join(F.broadcast(_counts(apart, [], n).select(F.col("n").alias("in_all"))), F.lit(True), "left")
    tags = materialize(tags.select(F.col("_declared").alias("_tag"), F.zip_with("n", "in_all", lambda x, a: F.log((x + 0.1) / (a + 1.0))).alias("tag")), "tags")

    out = rows.select(*(F.col(c).alias(k) for c, k in place.items()), *clues, *body)
    out = out.select(*place.values(), "_declared", "_host", "_suffix", score.alias("_s"))
    out = out.withColumns({"_loglik": loglik, "_salt": F.when(keys, F.lit(0)).otherwise(F.pmod(F.hash("_s"), F.lit(SALTS)) + 1)})
    met = F.col("_host").eqNullSafe(F.col("_x")) & F.col("_suffix").eqNullSafe(F.col("_y")) & (F.col("_salt") == F.col("_zero"))
    out = out.join(priors.withColumn("_zero", F.lit(0)), met, "left").join(F.broadcast(whole), F.lit(True), "left")
    mark = F.coalesce("_declared", F.concat(F.lit("\0"), F.pmod(F.hash("_s"), F.lit(SALTS))))  # in no table, so nothing is told
    out = out.join(tags, mark == F.col("_tag"), "left")
    logs = F.zip_with(F.zip_with("_loglik", F.coalesce("prior", "base"), lambda a, p: a + F.log(p)), F.coalesce("tag", zero), lambda a, t: a + t)
    names = F.array(*(F.lit(x) for x in langs))
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    out = out.withColumn("_logs", logs).withColumn("_posteriors", _softmax(F.col("_logs")))
    grams = F.col("_s.grams")
    mean = F.array_max("_s.loglik") / F.greatest(grams, F.lit(1))
    known = (F.array_max("_posteriors") >= MIN_POSTERIOR) & ((grams < MIN_BYTES) | (mean >= model.floor)) & ((grams > 0) | F.col("tag").isNotNull())
    row = F.struct(*(F.col(k).alias(c) for c, k in place.items()))
    return out.select(row.alias("row"), best(F.col("_logs")).alias("language"), F.array_max("_posteriors").alias("posterior"), F.when(grams > 0, best(F.col("_loglik"))).alias("text_language"), known.alias("kept"))


def identify_documents(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, model: Model | None = None) -> DataFrame:
    """Documents: their ``lang`` is what they declare, their ``source`` stands for the host, if they have such columns.
    Without ``model`` one is fitted on them, for which ``lang`` is needed."""
    has = lambda c: F.col(c) if c in docs.columns else None
    own = model is None
    if own:
        model = fit(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"), languages)
    return identify(docs, model, "text", has("lang"), has("source"), fitted=model.fitted(F.col("doc_id"), F.col("lang")) if own else None)


def markup_language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)), F.lit(""))


def markup_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    host = F.nullif(F.lower(F.regexp_extract("url", "(?s)^.*?://([^/?#:]*)", 1)), F.lit(""))
    return identify(pages, model, markup_text(F.col("html")), markup_language(F.col("html")), host, F.substring_index(host, ".", -1))

"""Language ID by fusing evidence in Bayes' way.

Evidence on a text's language, each as a likelihood or prior that is learned by grouped sums:

* *text*: a naive Bayes model over hashed byte trigrams, fitted on a bounded sample of labelled
  rows (``SAMPLE`` of each language, by hash; every label is fitted). The mean log-likelihood of the whole text counts
  as ``WEIGHT`` trigrams at most, as neighbouring trigrams are not independent. A text whose
  mean log-likelihood lies more than ``FAR`` standard deviations below that of the sampled rows
  of each language (their spread, and that of a mean of so many trigrams) is of none of them.
* *declared markup language* and *address suffix*: the likelihood of what is declared given the
  language, from counts over all rows and all their pages of what goes with which text language.
* *host prior*: the share of each language on the host, smoothed towards that of its domain,
  which is smoothed towards that of all rows (a host with few rows follows its domain).

The posterior is their normalised product. Missing evidence is left out of the product.

Results by case: a null or empty text, or one of fewer than ``LEAST`` letters' bytes, is
undetermined (``und``), as is a text of no fitted language (it gives no votes to the evidence
either) and a posterior below ``SURE``; null declared language, suffix, domain or host are
no evidence (the next level up is the prior); repeated rows are judged row by row and counted
as often; without labels all is undetermined; an empty table gives no rows; columns named like
the result columns are replaced."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import few, small_batches, staged, table, tidy
from tollbook.llm.quality import fold
from tollbook.llm.url_filters import host_and_path

BUCKETS = 1 << 15
SAMPLE = 2_000
WEIGHT, LEAST, SURE = 60, 3, 0.5
SMOOTH = 5.0
FAR, OVERLAP, PRIOR_ROWS = 8.0, 3, 20  # standard deviations; trigrams that share a byte; rows of spread 1 that are added to those of a language
LETTERS = re.compile(r"[^\W\d_]+")


def trigrams(raw: bytes) -> np.ndarray:
    """Bucket of each byte trigram of a lower-cased text."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(17)


def prepared(text: str | None) -> bytes:
    """The runs of letters of a text, lower-cased, with one space between them."""
    return f" {' '.join(LETTERS.findall((text or '').lower()))} ".encode("utf-8", "replace")


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # trigram bucket x language
    usual: np.ndarray | None = None  # mean, variance over rows and variance over trigrams of the log-likelihood of own rows, x language

    def known(self, mean: np.ndarray, n: int) -> bool:
        """Whether a mean over ``n`` trigrams is usual in any language."""
        if self.usual is None:
            return True
        own, rows, single = self.usual
        return bool((mean >= own - FAR * np.sqrt(rows + OVERLAP * single / n)).any())

    def scores(self, text: str | None) -> list[float]:
        """Log-likelihood of a whole text in each language; empty if there is too little of it."""
        raw = prepared(text)
        if len(raw) - 2 < LEAST or not self.languages:
            return []
        found = trigrams(raw)
        mean = self.logs[found].mean(0)
        return (mean * min(len(found), WEIGHT)).tolist() if self.known(mean, len(found)) else []


def fit_text(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> TextModel:
    """Trigram counts per language over a bounded sample of labelled rows outside the held-out fold."""
    from pyspark.sql import Window as W

    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~fold(F.col(key)))
    names_in_order = sorted(r[0] for r in labelled.select(label).distinct().collect())
    if not names_in_order:
        return TextModel([], np.zeros((BUCKETS, 0)))
    first = W.partitionBy(label).orderBy(F.xxhash64(key), key)
    chosen = labelled.select(label, key).distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= sample).select(key)
    rows = docs.select(key, text, label).filter(F.col(label).isNotNull()).join(few(chosen), key).select(label, text)  # at most sample ids of each language

    def counted(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang in names:
                    total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total[lang] += np.bincount(trigrams(prepared(x.as_py())), minlength=BUCKETS)
        for lang, n in total.items():
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held)), pa.array(held), pa.array(n[held])], ["lang", "bucket", "n"])

    names = set(names_in_order)
    sums = small_batches(rows).mapInArrow(tidy(counted), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    logs = np.full((BUCKETS, len(names_in_order)), -np.log(BUCKETS))
    column = {x: k for k, x in enumerate(names_in_order)}
    for lang, held in sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("held")).toLocalIterator():  # at most BUCKETS pairs each
        counts, at = np.full(BUCKETS, 0.5), np.array(held)
        counts[at[:, 0]] += at[:, 1]
        logs[:, column[lang]] = np.log(counts / counts.sum())
    return TextModel(names_in_order, logs, usual(rows, names_in_order, logs))


def usual(rows: DataFrame, languages: list[str], logs: np.ndarray) -> np.ndarray:
    """Mean, variance over rows and variance over trigrams of the log-likelihood of each language's own rows."""
    column = {x: k for k, x in enumerate(languages)}

    def run(batches):
        for batch in batches:
            out = []
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = prepared(x.as_py())
                if len(raw) - 2 >= LEAST:
                    own = logs[trigrams(raw), column[lang]]
                    out.append((lang, float(own.mean()), float(own.var()), len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.float64(), pa.float64(), pa.int64()))], ["lang", "own", "single", "n"])

    found = small_batches(rows).mapInArrow(tidy(run), "lang string, own double, single double, n long").groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), (F.sum(F.col("own") * F.col("n")) / F.sum("n")).alias("own"), F.var_pop("own").alias("var"), (F.sum(F.col("single") * F.col("n")) / F.sum("n")).alias("single")).collect()
    out = np.array([[0.0], [1.0], [1.0]]).repeat(len(languages), 1)
    for r in found:
        out[:, column[r["lang"]]] = r["own"], (r["rows"] * r["var"] + PRIOR_ROWS) / (r["rows"] + PRIOR_ROWS), r["single"]
    return out


def with_text_scores(rows: DataFrame, model: TextModel, keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns and ``text_scores``, one log-likelihood per language."""
    keep = [c for c in keep if c.lower() != "text_scores"]

    def run(batches):
        for batch in batches:
            scores = [model.scores(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.list_(pa.float64()))], [*keep, "text_scores"])

    source = rows.select(*[rows[c] for c in keep], rows[text].alias("_text"))
    from pyspark.sql import types as T

    return small_batches(source).mapInArrow(tidy(run), T.StructType([*source.schema.fields[:-1], T.StructField("text_scores", T.ArrayType(T.DoubleType()))]))


def softmax(scores: Column) -> Column:
    top = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(top, lambda x: x / F.aggregate(top, F.lit(0.0), lambda s, y: s + y))


def fused(rows: DataFrame, languages: list[str], seen: DataFrame | None = None) -> DataFrame:
    """Rows with text_lang, lang and confidence. ``rows`` holds text_scores, declared, suffix, domain and host;
    ``seen`` the same and n, the pages that say so, if what is counted is more than the rows.

    Every count is of soft votes (the text's own posterior), summed per group before any join;
    the joined sides have one row per declared language, suffix, domain or host."""
    if not languages:
        return rows.withColumns({"text_lang": F.lit("und"), "lang": F.lit("und"), "confidence": F.lit(0.0)})
    n = len(languages)
    every = F.array(*[F.lit(x) for x in languages])
    vote = lambda frame: frame.withColumn("_vote", F.when(F.size("text_scores") > 0, softmax(F.col("text_scores"))))
    voted = vote(rows)
    pages = vote(rows.withColumn("n", F.lit(1)) if seen is None else seen)
    pages = pages.withColumn("_vote", F.transform("_vote", lambda x: x * F.col("n")))
    sums = lambda frame, *by: frame.filter("_vote is not null").groupBy(*by).agg(F.array(*[F.sum(F.col("_vote")[k]) for k in range(n)]).alias("_sum"))
    total = (sums(voted).first() or [None])[0]
    total = [x or 0.0 for x in total or [0.0] * n]
    whole = [(x + 1) / (sum(total) + n) for x in total]
    overall = F.array(*[F.lit(x) for x in whole])

    def likelihood(name):
        """log P(value | language), smoothed over the number of values."""
        counts = sums(pages.filter(F.col(name).isNotNull()), name)
        m = counts.agg(F.count(F.lit(1)), *[F.sum(F.col("_sum")[k]) for k in range(n)]).first()
        of_all = F.array(*[F.lit(float(x or 0)) for x in m[1:]])
        return few(counts.select(name, F.zip_with("_sum", of_all, lambda x, t: F.log((x + 0.5) / (t + 0.5 * max(1, m[0])))).alias(f"_{name}")))

    smoothed = lambda own, above: F.zip_with(own, above, lambda x, p: (x + SMOOTH * p) / (F.aggregate(own, F.lit(0.0), lambda s, y: s + y) + SMOOTH))
    domains = sums(pages.filter("domain is not null"), "domain").select("domain", smoothed(F.col("_sum"), overall).alias("_domain"))
    hosts = sums(pages.filter("host is not null"), "domain", "host").withColumnRenamed("_sum", "_own").join(domains, "domain", "left")
    hosts = hosts.select("host", F.col("domain").alias("_of"), smoothed(F.col("_own"), F.coalesce("_domain", overall)).alias("_host"))
    out = (voted.join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left")
           .join(few(domains), "domain", "left").join(few(hosts.withColumnRenamed("host", "_h")), (F.col("host") == F.col("_h")) & F.col("domain").eqNullSafe(F.col("_of")), "left"))
    none = F.array(*[F.lit(0.0)] * n)
    prior = F.transform(F.coalesce("_host", "_domain", overall), lambda p: F.log(p))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    posterior = softmax(add(add(F.col("text_scores"), prior), add(F.coalesce("_declared", none), F.coalesce("_suffix", none))))
    out = out.withColumn("_post", F.when(F.size("text_scores") > 0, posterior))
    pick = lambda p: F.element_at(every, F.array_position(p, F.array_max(p)).cast("int"))
    confidence = F.coalesce(F.array_max("_post"), F.lit(0.0))
    return out.select(*rows.columns, F.coalesce(pick(F.col("_vote")), F.lit("und")).alias("text_lang"), F.when(confidence >= SURE, pick(F.col("_post"))).otherwise("und").alias("lang"), confidence.alias("confidence"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """What every page says of the document whose id ends its path: declared markup language, suffix, domain and host."""
    host, path = host_and_path(F.col("url"))
    doc = F.expr(r"try_cast(nullif(regexp_extract(path, '/([0-9]+)(?:[.]html|/)?$', 1), '') as long)")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1)), F.lit(""))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), declared.alias("declared")).withColumn("_doc", doc).filter("_doc is not null")
    rows = rows.select("_doc", "page_id", "declared", F.nullif(F.regexp_extract("host", r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"),
                       F.nullif(F.regexp_extract("host", r"([^.]+\.[a-z]+)$", 1), F.lit("")).alias("domain"), F.nullif("host", F.lit("")).alias("host"))
    return rows


def first_evidence(evidence: DataFrame) -> DataFrame:
    """The first declared language, suffix and host (with its domain) of each document that are not null, by page id."""
    first = lambda c, *more: F.min(F.when(F.col(c).isNotNull(), F.struct("page_id", c, *more))).alias(f"_{c}")
    found = evidence.groupBy("_doc").agg(first("declared"), first("suffix"), first("host", "domain"))
    return found.select("_doc", *[F.col(c).alias(c.split(".")[1]) for c in ("_declared.declared", "_suffix.suffix", "_host.domain", "_host.host")])


def document_languages(docs: DataFrame, pages: DataFrame, model: TextModel) -> DataFrame:
    """Language of every document (row): doc_id, _source, text_key (a hash of the text), evidence, text_lang, lang and confidence.
    A document without a page has its source as host and no domain."""
    rows = with_text_scores(docs.select("doc_id", F.col("source").alias("_source"), "text", F.xxhash64("text").alias("text_key")), model, ["doc_id", "_source", "text_key"])
    rows, evidence = staged(rows, "language-scores"), page_evidence(pages)
    with_source = lambda said: rows.join(said, F.col("doc_id") == F.col("_doc"), "left").withColumn("host", F.coalesce("host", F.concat(F.lit("source:"), "_source"))).drop("_doc")
    said = evidence.groupBy("_doc", "declared", "suffix", "domain", "host").agg(F.count(F.lit(1)).alias("n"))
    seen = with_source(said).withColumn("n", F.coalesce("n", F.lit(1)))
    return fused(staged(with_source(first_evidence(evidence)), "language-evidence"), model.languages, staged(seen, "language-pages"))


def op1_language_id(spark, sf_dir):
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = document_languages(docs, table(spark, sf_dir, "pages"), fit_text(docs))
    return found.select("doc_id", "lang", "confidence", "text_lang", "declared", "suffix", "host")

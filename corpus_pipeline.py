"""The corpus pipeline: from raw documents to token ids of clean ones.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. Rows with null ids stay as long
as their texts are good, as nothing can name them. A stage's own columns get names that no
column of documents has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollbook.llm import decontaminate, jaccard, language, pieces, quality
from tollbook.llm.common import few, free_name, staged, table
from tollbook.operators.numbering import numbered

SHINGLE, PERCENT = 5, 80  # words and similarity of near-duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. A null text counts as empty."""
    model, name = quality.train(docs, table(spark, sf_dir, "labels")), free_name(docs, "_score")
    return quality.score(docs, model, docs.columns, name=name).filter(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (null and empty texts and those of no labelled language go). Rows of one id, source and text are judged alike."""
    found = language.document_languages(docs, table(spark, sf_dir, "pages"), language.fit_text(docs))
    rejected = found.filter("lang = 'und'").select(F.col("doc_id").alias("_id"), F.col("_source").alias("_of"), F.col("text_key").alias("_key")).distinct()
    rejected = rejected.select(*[F.col(c).alias(free_name(docs, c)) for c in rejected.columns])
    by_id, of, key = (F.col(c) for c in rejected.columns)
    return docs.join(few(rejected), docs["doc_id"].eqNullSafe(by_id) & docs["source"].eqNullSafe(of) & (F.xxhash64(docs["text"]) == key), "left_anti")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, of several rows of that id the
    first by text and further columns. Rows are judged one by one: of an id with several rows those stay whose texts
    are neither equal nor linked to a kept one. Null ids, null and empty texts stay, as they are linked with nothing; a very long text is
    one set of n-grams, whole; an empty table stays empty."""
    row, rank, of = (free_name(docs, name) for name in ("_row", "_rank", "_of"))
    repeated = staged(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(of)), "repeated-ids")
    at = docs["doc_id"] == F.col(of)
    single = docs.join(repeated, at, "left_anti").withColumn(row, F.col("doc_id"))
    several = numbered(docs.join(repeated, at, "left_semi"), ["doc_id", "text", *ordered_columns(docs)], rank)
    # rows of repeated ids get numbers that no id has
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    several = several.withColumn(row, F.lit(high or 0) + F.col(rank) if (high or 0) < 1 << 62 else F.lit(low) - F.col(rank))
    every = single.select(row, "doc_id", "text").unionByName(several.select(row, "doc_id", "text"))
    found = jaccard.jaccard_components(every.select(row, "text"), SHINGLE, PERCENT, key=row).filter(F.col(row).isNotNull())
    named = found.join(several.select(F.col(row).alias("_number"), F.col("doc_id").alias("_id")), F.col(row) == F.col("_number"), "left")
    order = F.struct(F.coalesce("_id", row).alias("id"), F.col(row).alias("row"))
    first = named.groupBy("component_id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    double = found.join(first, "component_id").filter(F.col(row) != F.col("first.row")).select(F.col(row).alias("_double"))
    double = staged(double, "double-rows")
    left = lambda part: part.join(double, part[row] == F.col("_double"), "left_anti").select(*docs.columns)
    return left(single).unionByName(left(several))


def ordered_columns(docs: DataFrame) -> list[str]:
    """Columns other than id and text whose values have an order."""
    return [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text") and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; a very long text is looked through whole."""
    name = free_name(docs, "_leaks")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), docs.columns, name=name).filter(F.size(name) == 0).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether decoding gives the text again. A null text has null ids and no
    count, an empty one no ids; a very long text is encoded whole."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    name = free_name(docs, "_decoded")
    out = pieces.encode(docs, path, decoded=name, slice_bytes=1024 * 1024)  # earlier stages leave executors little memory
    return out.withColumns({"n_tokens": F.size("token_ids").cast("long"), "exact": F.col(name).eqNullSafe(F.col("text"))}).drop(name)


STAGES = [
    ("quality_classifier", quality_classifier), ("language_id", language_id), ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination), ("sentencepiece", sentencepiece),
]

# No SQL: the classifier is fitted, components are iterative, pieces are merged.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs

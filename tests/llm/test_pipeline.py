import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import TESTDATA
from tests.llm.test_jaccard import brute
from tollbook.llm import decontaminate, language, quality
from tollbook.llm.common import staged, table


@pytest.fixture(scope="module")
def kept(spark):
    """The documents before each stage, and the result."""
    docs = [table(spark, TESTDATA, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], TESTDATA), name))
    return docs


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_rows_and_columns(kept):
    for a, b in zip(kept, kept[1:-1]):
        assert a.columns == b.columns and b.exceptAll(a).count() == 0
    assert set(kept[0].columns) <= set(kept[-1].columns) and ids(kept[-1]) == ids(kept[-2])


def test_quality_and_language(spark, kept):
    labels = {r.doc_id: r.quality for r in table(spark, TESTDATA, "labels").collect()}
    after = set(ids(kept[1]))
    known = [(i in after) == bool(labels[i]) for i in ids(kept[0]) if i in labels]
    assert sum(known) > 0.97 * len(known)
    assert ids(kept[2]) == ids(kept[1])  # every text's language can be told


def test_near_duplicates(kept):
    rows = [(r.doc_id, r.text) for r in kept[2].collect()]
    assert ids(kept[3]) == sorted(k for k, _, c in brute(rows, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT) if k == c)


def test_decontamination(spark, kept):
    items = [r.text for r in table(spark, TESTDATA, "benchmark").collect()]
    holds = {r.doc_id for r in kept[3].collect() if any(t in r.text for t in items)}
    gone = set(ids(kept[3])) - set(ids(kept[4]))
    assert holds <= gone and len(gone - holds) <= 2


def test_pieces(kept):
    assert kept[5].filter("NOT exact OR n_tokens <> size(token_ids)").count() == 0


def test_odd_rows(spark, tmp_path):
    good = " ".join(f"word{i} and the other thing" for i in range(30))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, good, None, None, None), (None, good + " x", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "hi", "en", "s", 2)]
    docs = spark.createDataFrame([(*r, 0.0, "a", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _score double, _leaks string, text_key int, token_ids int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, schema in (("labels", "doc_id long, quality int"), ("pages", "page_id long, url string, html string"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in out), key=str) in ([1, 5, None], [1, None])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    say = lambda word: " ".join(f"{word}{i} and" for i in range(40))
    rows = [(1, say("a"), "en"), (1, say("a"), "de"), (1, say("b"), "en"), (2, say("b") + " more", "en"), (3, say("c"), "en"), (4, say("c"), "en"), (4, say("d"), "en"), (4, None, "en"), (4, None, "en"), (5, "", "en"), (None, say("a"), "en"), (None, say("a"), "en")]
    docs = spark.createDataFrame([(*r, {"k": 1}, 7) for r in rows], "doc_id long, text string, lang string, more map<string,int>, _row int")
    kept = sorted(((r.doc_id, r.text, r.lang) for r in corpus_pipeline.jaccard_join(spark, docs, "").collect()), key=str)
    assert kept == sorted([(1, say("a"), "de"), (1, say("b"), "en"), (3, say("c"), "en"), (4, say("d"), "en"), (4, None, "en"), (4, None, "en"), (5, "", "en"), (None, say("a"), "en"), (None, say("a"), "en")], key=str)
    far = docs.select(F.when(F.col("doc_id") == 5, F.lit((1 << 63) - 1)).otherwise(F.col("doc_id")).alias("doc_id"), "text", "lang")
    assert corpus_pipeline.jaccard_join(spark, far, "").count() == len(kept)

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tollbook.llm import language as lang
from tollbook.llm import quality as q
from tollbook.llm.common import table

MIDDLE = TESTDATA.replace("sf0.001", "sf0.01")


def test_held_out_quality(spark):
    out = q.op4_quality_classifier(spark, MIDDLE).join(table(spark, MIDDLE, "labels"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 50 and ((out["predicted"] == out["quality"]).mean()) > 0.97
    assert out["score"].between(0, 1).all()


def test_lookup_tables_and_pairs_fit_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, len(q.MEASURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = q.fit(x[:3000], y[:3000])
    assert (5, 2) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    b = model.bins(x[:5])
    by_hand = [model.base + sum(t[b[k, f]] for f, t in enumerate(model.tables)) + sum(t[b[k, i], b[k, j]] for i, j, t in model.pairs) for k in range(5)]
    assert model.score(x[:5]) == pytest.approx(1 / (1 + np.exp(-np.array(by_hand))))


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "some words here", 0.5), (1, None, 0.5), (3, "x" * 100_000, 0.5)], "doc_id long, text string, Score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = q.score(docs, q.train(docs, none), docs.columns).collect()
    assert len(out) == 5 and all(r.score == 0.5 for r in out)
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, quality int")
    assert len(q.score(docs, q.train(docs, odd), ["doc_id"]).collect()) == 5
    assert q.score(docs.limit(0), q.train(docs.limit(0), none), ["doc_id"]).count() == 0


def test_held_out_language(spark):
    docs = table(spark, MIDDLE, "documents")
    out = lang.op1_language_id(spark, MIDDLE).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").filter(q.fold(F.col("doc_id"))).toPandas()
    assert len(out) > 100 and (out["lang"] == out["truth"]).mean() > 0.98


def test_evidence_is_fused_like_by_hand(spark):
    rows = [(1, [0.0, -9.0], "en", "com", "a.com", "x.a.com")] * 3 + [(2, [-9.0, 0.0], "fr", "fr", "b.fr", "x.b.fr")] * 2 + [(3, [0.0, 0.0], "fr", "fr", "b.fr", "x.b.fr"), (4, [0.0, 0.0], None, None, None, None), (5, [], "fr", "fr", None, None)]
    out = {r.doc_id: r for r in lang.fused(spark.createDataFrame(rows, "doc_id long, text_scores array<double>, declared string, suffix string, domain string, host string"), ["en", "fr"]).collect()}
    assert (out[1].lang, out[2].lang, out[3].lang, out[5].lang) == ("en", "fr", "fr", "und")  # 3: the text alone cannot tell
    votes = [np.exp(np.array(s)) / np.exp(np.array(s)).sum() for s in ([0, -9.0], [0, -9.0], [0, -9.0], [-9.0, 0], [-9.0, 0], [0, 0], [0, 0])]
    total = sum(votes)
    prior = (total + 1) / (total.sum() + 2)
    assert out[4].confidence == pytest.approx(max(prior))
    b = votes[3] + votes[4] + votes[5]
    domain = (b + lang.SMOOTH * prior) / (b.sum() + lang.SMOOTH)
    host = (b + lang.SMOOTH * domain) / (b.sum() + lang.SMOOTH)
    declared_total = total - votes[6]
    like = (b + 0.5) / (declared_total + 0.5 * 2)
    post = host * like * like
    assert out[3].confidence == pytest.approx(max(post / post.sum()))


def test_language_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", "s"), (2, "", "en", None), (None, "the cat and the dog", "en", "s"), (4, "le chat et le chien", "fr", "s"), (4, "le chat et le chien", "fr", "s"), (5, "12 !!", None, "s"), (6, "le " * 50_000, None, "s")] +
                                 [(10 + i, "the dog and the cat", "en", "s") for i in range(9)] + [(30 + i, "le chien et le chat", "fr", "s") for i in range(9)], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, "http://x.fr/5", "<html lang='fr'>"), (2, None, None), (3, "http://y.com/10.html", "<p>"), (4, "http://y.com/99999999999999999999", "<html lang=en>")], "page_id long, url string, html string")
    out = lang.document_languages(docs, pages, lang.fit_text(docs)).collect()
    assert len(out) == docs.count()
    got = {r.doc_id: r.lang for r in out}
    assert (got[1], got[2], got[5], got[4], got[None], got[6]) == ("und", "und", "und", "fr", "en", "fr")
    bare = lang.document_languages(docs, pages.limit(0), lang.fit_text(docs.limit(0)))
    assert {r.lang for r in bare.collect()} == {"und"}
    assert lang.document_languages(docs.limit(0), pages, lang.fit_text(docs)).count() == 0


FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, ja heille on annettu järki ja omatunto. "
POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem. "


def foreign_rows():
    r = np.random.default_rng(3)
    letters = [" ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(2, 9))) for _ in range(n)) for n in (30, 300, 3000)]
    return [FINNISH, FINNISH * 20, POLISH, POLISH * 20, "<div class='a'><span id=b></span></div>" * 30, *letters]


def test_texts_of_no_labelled_language_are_undetermined(spark):
    docs, pages = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "pages")
    planted = spark.createDataFrame([(10**9 + i, x, "planted") for i, x in enumerate(foreign_rows())], "doc_id long, text string, source string")
    out = lang.document_languages(docs.unionByName(planted, allowMissingColumns=True), pages, lang.fit_text(docs)).collect()
    assert {r.lang for r in out if r.doc_id >= 10**9} == {"und"}
    assert all(r.lang != "und" for r in out if r.doc_id < 10**9)


def test_the_stage_rejects_by_row(spark):
    import corpus_pipeline

    docs = table(spark, MIDDLE, "documents")
    odd = [(i, x, "planted") for x in foreign_rows() for i in (None, 10**9)] + [(None, None, None), (None, "", "planted")]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string"), allowMissingColumns=True)
    both = both.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    out = corpus_pipeline.language_id(spark, both, MIDDLE).select("doc_id", "source").collect()
    assert len(out) == docs.count() + 1 and all(r.source != "planted" for r in out)


def test_every_label_is_fitted(spark):
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" * 3 for i in range(70)]
    docs = spark.createDataFrame([(100 * i + k, f"{w} {w} {w}", f"l{i:02}", "s") for i, w in enumerate(words) for k in range(8)], "doc_id long, text string, lang string, source string")
    model = lang.fit_text(docs)
    assert model.languages == [f"l{i:02}" for i in range(70)]
    assert {model.languages[int(np.argmax(model.scores(f"{w} {w} {w}")))] for w in words} == set(model.languages)


def test_all_pages_of_a_document_are_evidence(spark):
    docs = spark.createDataFrame([(i, "the dog and the cat", "en", "s") for i in range(9)] + [(20 + i, "le chien et le chat", "fr", "s") for i in range(9)] + [(None, "le chat", None, "s")], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, "http://nosuffix/3", "<p>"), (2, "http://x.com/3", "<html lang=en>"), (3, "http://y.fr/3", "<html lang=fr>")], "page_id long, url string, html string")
    first = lang.first_evidence(lang.page_evidence(pages)).collect()
    assert [tuple(r) for r in first] == [(3, "en", "com", None, "nosuffix")]
    model = lang.fit_text(docs)
    out = {r.doc_id: r for r in lang.document_languages(docs, pages, model).collect()}
    assert len(out) == 19 and (out[3].declared, out[3].suffix, out[3].host) == ("en", "com", "nosuffix")
    schema = "doc_id long, text_scores array<double>, declared string, suffix string, domain string, host string"
    rows = spark.createDataFrame([(1, [0.0, -1.0], None, None, None, "a"), (2, [0.0, 0.0], None, None, None, "b")], schema)
    seen = rows.withColumn("n", F.lit(1)).union(spark.createDataFrame([(1, [0.0, -1.0], None, None, None, "b", 5)], schema + ", n int"))  # five more pages on b
    few, more = ({r.doc_id: r.confidence for r in lang.fused(rows, ["en", "fr"], s).collect()} for s in (None, seen))
    assert few[1] == pytest.approx(more[1]) and few[2] < more[2]

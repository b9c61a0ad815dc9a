import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tollbook.llm import pieces as p
from tollbook.llm import token_counts as t

BPE, MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a  b ", "a\n\nb\tc ", "ﬁ①Ａ ß İ Σς", "x\u00a0y\u2003z\x1cw\x85v", "e\u0301 \u0301x", "<|endoftext|>a<|startoftext|> <|endoftext|>", "it's we'll I'd 'S '",
    "日本語 𝕏 👍🏽", "a\x00b", "don't!!! ###$$$", "<s>a</s> <unk> <0x41>", "▁x ▁ ▁▁y", " " * 40 + "x", "1234567890.5", "A" * 3000, "é" * 500 + "," * 400,
]


def texts(n=300):
    r = random.Random(5)
    return ODD + ["".join(r.choice("aeinrst thANDé.,!\n'日0 ") for _ in range(r.randint(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("block_bytes", [1, 500, 10**7])
def test_counts_are_the_librarys(spark, block_bytes):
    every = texts()
    rows = [(i // 2, x, "m", 3) for i, x in enumerate(every * 2)] + [(None, "null id", "m", 1), (9, None, "m", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n_tokens int").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in t.count_tokens(docs, BPE, block_bytes=block_bytes).collect()), key=str)
    own = Tokenizer.from_file(BPE)
    want = sorted(((i, len((x or "").encode()), len(own.encode(x or "", add_special_tokens=False).ids)) for i, x, _, _ in rows), key=str)
    assert got == want


def test_ids_are_the_librarys_and_decode_to_the_text(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    every = texts(1500)
    rows = [(i, x) for i, x in enumerate(every)] + [(-1, None)]
    out = p.decode(p.encode(spark.createDataFrame(rows, "doc_id long, text string").withColumn("Token_IDs", F.lit(1)), MODEL), MODEL).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.text is None:
            assert r.token_ids is None and r.decoded is None
        else:
            assert list(r.token_ids) == own.encode(r.text) and r.decoded == own.decode(own.encode(r.text))
            assert r.decoded == r.text or "▁" in r.text


def test_bytes_that_are_no_text():
    own = p.Pieces(MODEL)
    bad = own.byte_ids[0xFF]
    assert own.decode([bad, own.ids["▁a"]]) == "\ufffd a" and own.decode([]) == ""


def test_scores_rule_like_trying_all_segmentations():
    r = random.Random(3)
    for _ in range(200):
        known = {c: r.uniform(-9, -1) for c in "ab"} | {"".join(r.choice("ab") for _ in range(r.randint(2, 4))): r.uniform(-9, -1) for _ in range(5)}
        own = p.Pieces.of([(x, i + 1, s) for i, (x, s) in enumerate(known.items())], "scores")
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))

        def best(w):
            if not w:
                return 0.0
            return max(best(w[n:]) + known.get(w[:n], own.worst if n == 1 else -1e9) for n in range(1, len(w) + 1))

        split = own.split(word)
        assert "".join(split) == word
        assert sum(known.get(x, own.worst) for x in split) == pytest.approx(best(word))


def test_small_caches_change_nothing(monkeypatch):
    plain = p.Pieces(MODEL)
    want = [plain.encode(x) for x in texts(200)]
    monkeypatch.setattr(p, "CACHED_WORDS", 3)
    monkeypatch.setattr(p, "CACHED_PAIRS", 3)
    small = p.Pieces(MODEL)
    assert [small.encode(x) for x in texts(200)] == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert t.count_tokens(none, BPE).count() == 0 and p.decode(p.encode(none, MODEL), MODEL).count() == 0


def test_decoding_of_any_ids(spark):
    own = p.Pieces(MODEL)
    a = own.ids["▁a"]
    rows = [[1, 2, a, a], [a], [1], [], None, [0, a], [99_999_999, a], [-1], [1, own.ids["a"], a], [own.byte_ids[0x20], a], [None, a], [own.byte_ids[0xE2], own.byte_ids[0x82], own.byte_ids[0xAC]]]
    got = [r.decoded for r in p.decode(spark.createDataFrame([(x,) for x in rows], "token_ids array<int>"), MODEL).collect()]
    assert got == ["a a", "a", "", "", None, "⁇  a", "⁇  a", "⁇ ", "a a", " a", "⁇  a", "€"]


def test_fused_decoding_is_the_same(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*texts(200), None])], "doc_id long, text string")
    fused = {r.doc_id: r.decoded for r in p.encode(docs, MODEL, decoded="decoded").collect()}
    assert fused == {r.doc_id: r.decoded for r in p.decode(p.encode(docs, MODEL), MODEL).collect()}


def test_counts_refuse_files_that_cut_otherwise(spark):
    with pytest.raises(ValueError):
        t.count_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))


def test_words_of_one_stretch_share_its_ids():
    """A word that is one stretch holds no copy of the ids."""
    from tollbook.llm.pieces import Pieces

    pieces = Pieces.of([("a", 1, -1.0), ("b", 2, -2.0), ("ab", 3, -0.5), ("▁", 4, -3.0), ("▁ab", 5, -0.4)])
    assert pieces.encode("ab") == [5] and pieces.encode("ab?") == [5, 0]
    assert pieces.words[" ab"] is pieces.stems["▁ab"]

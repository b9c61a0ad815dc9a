import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tollbook.llm import bpe as b

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a  b ", "a\n\nb\tc ", "ﬁ①Ａ ß İ Σς ΣΑΣ", "x y z\x1cw\x85v​u", "é ́x", "<|endoftext|>a<|startoftext|> <|endoftext|>", "<|ENDOFTEXT|><|endoftext",
    "it's we'll I'd 'S ' IT'S", "日本語 𝕏 👍🏽 ٣٤ ⅷ", "a\x00b", "don't!!! ###$$$", "</w> a</w>", " " * 40 + "x", "1234567890.5", "A" * 3000, "ab" * 2000 + " tail", "é" * 500 + "," * 400,
]


def texts(n=400):
    r = random.Random(8)
    return ODD + ["".join(r.choice("aeinrst thANDé.,!\n'日0 ") for _ in range(r.randint(1, 90))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_and_texts_are_the_librarys(spark, path):
    own = Tokenizer.from_file(path)
    rows = [(i // 2, x, "m", 3) for i, x in enumerate(texts() * 2)] + [(None, "null id", "m", 1), (-1, None, "m", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Token_IDs string, decoded int").repartition(3)
    out = b.encode(docs, path, decoded="decoded")
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    again = b.decode(out.drop("decoded"), path, name="again").join(out.select("doc_id", "text", F.col("decoded").alias("fused")), ["doc_id", "text"], "left").collect()
    assert out.count() == len(rows)
    for r in again:
        if r.text is None:
            assert r.token_ids is None and r.again is None
        else:
            want = own.encode(r.text, add_special_tokens=False).ids
            assert list(r.token_ids) == want, r.text
            assert r.again == own.decode(want, skip_special_tokens=False)
            assert r.doc_id is None or r.fused == r.again
    if path == BYTE:
        assert all(r.again == r.text for r in again)


def test_ids_that_are_no_text(spark):
    own = Tokenizer.from_file(BYTE)
    half = own.encode("日", add_special_tokens=False).ids[:-1]
    rows = [(1, [*half, 70000, -3, 64]), (2, []), (3, None), (4, [64, 70000])]
    got = {r.k: r.decoded for r in b.decode(spark.createDataFrame(rows, "k int, token_ids array<int>"), BYTE).collect()}
    assert got == {1: own.decode([*half, 64], skip_special_tokens=False), 2: "", 3: None, 4: own.decode([64])}
    words = {r.k: r.decoded for r in b.decode(spark.createDataFrame(rows, "k int, token_ids array<int>"), WORD).collect()}
    assert words[2] == "" and words[3] is None and words[4] == Tokenizer.from_file(WORD).decode([64], skip_special_tokens=False)


def test_trees_like_looking_for_the_lowest_pair_each_time(monkeypatch):
    r = random.Random(4)
    for cells in (1 << 20, 40):
        monkeypatch.setattr(b, "TREE_CELLS", cells)
        for _ in range(40):
            pairs = r.sample([(x, y) for x in range(9) for y in range(9)], 30)
            merges = {p: (rank // 2, r.randint(0, 8)) for rank, p in enumerate(pairs)}  # ranks tie
            words = [[r.randint(0, 8) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 9, 17, 40]))] for _ in range(30)]
            flat, left = b.merged(np.array([x for w in words for x in w], np.int64), np.array([len(w) for w in words], np.int64), b.Merges([(*p, *rule) for p, rule in merges.items()]))
            flat = flat.tolist()
            for want, size in zip(words, left):
                while found := [(merges[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in merges]:
                    _, i = min(found)
                    want[i: i + 2] = [merges[want[i], want[i + 1]][1]]
                assert flat[:size] == want
                del flat[:size]
            assert not flat


def test_small_caches_change_nothing():
    codec = b.Codec(WORD)
    want = codec.encode_texts(texts(200))
    small = b.Codec(WORD)
    small.words.most = small.pieces.most = 3
    assert [small.encode_texts([x])[0] for x in texts(200)] == want == codec.encode_texts(texts(200))
    assert all(len(w) <= b.CACHED_LENGTH for w in [*codec.words, *codec.pieces])


def test_long_words_stay_quick():
    codec, own = b.Codec(WORD), Tokenizer.from_file(WORD)
    text = "".join(random.Random(1).choices("abcdefgh", k=100_000))
    assert list(memoryview(codec.encode_texts([text])[0]).cast("i")) == own.encode(text, add_special_tokens=False).ids


def test_other_kinds_of_files_are_refused(tmp_path):
    own = Tokenizer.from_file(WORD)
    text = own.to_str().replace('"dropout":null', '"dropout":0.5')
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError):
        b.Codec(str(tmp_path / "x.json"))


def test_registered_query_like_the_library(spark):
    own, sf = Tokenizer.from_file(WORD), "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in b.op12_bpe(spark, sf).collect()} == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert b.decode(b.encode(none, WORD), WORD).count() == 0

"""Token counts: pieces are counted once per distinct pre-token and summed over frequencies.

1. Tasks cut their documents into blocks of a bounded size of text. A block holds a word
   list of its distinct pre-tokens and, for every document, which of them it has and how often.
2. The word lists are dealt out and sorted by pre-token, so that each distinct pre-token of
   all blocks is counted once by the tokenizer's model.
3. The counts of a block's words are joined to the block, one array per block, and every
   document sums frequency times count. No token ids are made.

A word list names a pre-token once per block, so a very common word is no hot key.
The tokenizer's own normalizer and pre-tokenizer cut the words. Text is first cut at ASCII
white space, which no pre-token of such a tokenizer spans; only distinct words are then
looked at; files that cut otherwise are refused. Special strings inside texts count as one token each, the library's default.

Results by case: a null text counts as empty, with no tokens; a null id is kept; repeated
rows are counted row by row; a text larger than a block makes a block of its own; an empty
table gives no rows; further columns are not read."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm.bpe import spaceless
from tollbook.llm.common import staged, table

BLOCK_BYTES = 32 * 1024 * 1024
LIMIT = 2048
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
BLOCK_SCHEMA = "block long, ids array<long>, n_bytes array<long>, special array<long>, n_words array<long>, packed binary, words array<string>"


def load(path: str):
    """The tokenizer and the pattern of its special strings (none: never matches)."""
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    if not spaceless(said):
        raise ValueError("only tokenizer files whose pre-tokens are lower-cased words without white space are handled")
    special = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
    return Tokenizer.from_file(path), re.compile("|".join(map(re.escape, special)) or r"(?!)")


class Block:
    """Documents gathered by one task until the block is full."""

    def __init__(self, tokenizer, special):
        self.tokenizer, self.special = tokenizer, special
        self.clear()

    def clear(self):
        self.words = defaultdict()
        self.words.default_factory = self.words.__len__  # the next free number
        self.ids, self.sizes, self.found, self.bytes = [], [], [], 0

    def add(self, key, text):
        size = len(text.encode("utf-8", "surrogatepass"))
        self.ids.append(key)
        self.sizes.append(size)
        self.found.append(np.fromiter(map(self.words.__getitem__, WORD.findall(text)), np.int32))
        self.bytes += size

    def pre_tokens(self, word):
        """Pre-tokens of a word and the number of special strings in it."""
        if word.isascii() and word.isalpha():
            return [word.lower()], 0
        out = [piece for part in self.special.split(word) if part
               for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
        return out, len(self.special.findall(word))

    def closed(self, name):
        """The block as one row."""
        names = defaultdict()
        names.default_factory = names.__len__
        starts, flat, fixed = [0], [], []
        for word in self.words:
            pieces, n_special = self.pre_tokens(word)
            flat.extend(map(names.__getitem__, pieces))
            starts.append(len(flat))
            fixed.append(n_special)
        starts, flat, fixed = np.array(starts), np.array(flat, np.int64), np.array(fixed, np.int64)
        steps, counts, n_words, special = [], [], [], []
        for found in self.found:
            lengths = starts[found + 1] - starts[found]
            places = np.repeat(starts[found] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            own, n = np.unique(flat[places], return_counts=True)
            steps.append(np.diff(own, prepend=0).astype(np.uint32))
            counts.append(n.astype(np.uint32))
            n_words.append(len(own))
            special.append(int(fixed[found].sum()))
        packed = zstandard.compress(b"".join(x.tobytes() for x in (*steps, *counts)), 1)
        row = {"block": name, "ids": self.ids, "n_bytes": self.sizes, "special": special, "n_words": n_words, "packed": packed, "words": list(names)}
        self.clear()
        return row


ARROW_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("special", pa.list_(pa.int64())),
                         ("n_words", pa.list_(pa.int64())), ("packed", pa.binary()), ("words", pa.list_(pa.string()))])


def blocks(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents; ``docs`` holds id and text."""

    def cut(batches):
        block, task, n = Block(*load(path)), TaskContext.get(), 0
        row = lambda: pa.RecordBatch.from_pylist([block.closed((task.partitionId() << 32) + n)], ARROW_BLOCK)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(key, text.as_py() or "")
                if block.bytes >= block_bytes:
                    yield row()
                    n += 1
        if block.ids:
            yield row()

    return docs.mapInArrow(cut, BLOCK_SCHEMA)


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """Block and place of every word (place) with its number of pieces, packed as place * 2^32 + pieces.
    ``words`` is dealt out and sorted by word, so equal ones follow each other and are counted once."""

    def count(batches):
        model, last, pieces = load(path)[0].model, None, 0
        for batch in batches:
            words, packed = batch.column("word").to_pylist(), batch.column("pos").to_numpy().astype(np.int64) << 32
            counts = np.empty(len(words), np.int64)
            for i, word in enumerate(words):
                if word != last:
                    last, pieces = word, len(model.tokenize(word))
                counts[i] = pieces
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed + counts)], ["block", "packed_count"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(count, "block long, packed_count long")


def summed(batches):
    """Documents of each block with the sum of frequency times count."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            ids, n_bytes, special, n_words = (one.column(c).flatten() for c in ("ids", "n_bytes", "special", "n_words"))
            n_words = n_words.to_numpy()
            raw = np.frombuffer(zstandard.decompress(one.column("packed")[0].as_py()), np.uint32).astype(np.int64)
            steps, counts = raw[: len(raw) // 2], raw[len(raw) // 2:]
            pairs = one.column("counts").flatten().to_numpy()
            pieces = np.zeros(len(pairs), np.int64)
            pieces[pairs >> 32] = pairs & 0xFFFFFFFF
            ends = np.cumsum(n_words)
            starts, sums = ends - n_words, np.concatenate([[0], np.cumsum(steps)])
            own = sums[1:] - np.repeat(sums[starts], n_words)  # steps begin anew in each document
            total = np.concatenate([[0], np.cumsum(pieces[own] * counts)])
            tokens = total[ends] - total[starts] + special.to_numpy()
            yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(tokens)], ["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Id, n_bytes and n_tokens of every document by the tokenizer file at ``path`` (present on all machines)."""
    load(path)  # refuses other files before any task does
    cut = staged(blocks(docs.select(F.col(key).cast("long"), F.col(text)), path, block_bytes), "token-blocks")
    words = cut.select("block", F.posexplode("words").alias("pos", "word"))
    lists = piece_counts(words, path).groupBy("block").agg(F.collect_list("packed_count").alias("counts"))
    full = cut.drop("words").join(lists, "block", "left").withColumn("counts", F.coalesce("counts", F.expr("cast(array() as array<long>)")))
    return full.mapInArrow(summed, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", key)


def op7_token_counts(spark, sf_dir):
    """Tokens of every document."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)

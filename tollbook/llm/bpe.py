"""BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the pairs of neighbouring symbols of a pre-token, each with the rank of
its merge and its place; a node keeps the smaller of its two children. The root is then the
leftmost of the merges of lowest rank. Carrying it out changes three leaves (the pair itself,
the one before and the one after), each mended on its way to the root, until the root holds
no merge. A pre-token of n symbols takes O(n log n) steps, however long it is. The trees of all
new pre-tokens of a batch lie side by side in arrays and are worked on together.

The tokenizer file (kind BPE) names the merges, the mark of a word's end and the special
strings; its own normalizer and pre-tokenizer cut texts into pre-tokens. Ids of words and of
pre-tokens are kept in caches of a bounded size. Where the file's pre-tokens never hold white
space (``SPACELESS``), texts are cut there first, so that each word is looked up whole. Special strings
inside a text are one token each, the library's default; dropout, unknown tokens and byte
fallback are not handled, and a file that asks for them is refused.

Decoding takes the pieces of the ids and joins them as the file's decoder says: by bytes (the
byte-level decoder; bytes that are no UTF-8 become the replacement character) or, without
a decoder, by one space. It is done on whole batches of ids, without a step per id.

Results by case: a null text has null ids and decodes to null; an empty text has no ids and
decodes to an empty text; ids that the file does not know decode to nothing; equal ranks are
merged from the left; repeated rows are encoded row by row; a very long text is encoded
whole, in a batch of its own; an empty table gives no rows; input columns named like a result column (in any case of letters) are
replaced, the rest are kept."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollbook.llm.common import CACHED_LENGTH, CACHED_WORDS, Kept, added, table

# The cutting rule of files whose pre-tokens hold no white space.
SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACELESS_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDS_AT_ONCE, TREE_CELLS = 1_000, 1 << 20
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
NONE = 1 << 62


class Merges:
    """The merges of a file: for a pair of symbols its rank and what it becomes."""

    def __init__(self, rules: list[tuple[int, int, int, int]]):
        """``rules``: left, right, rank, result."""
        left, right, rank, into = np.array(sorted(rules), np.int64).reshape(-1, 4).T
        self.keys, self.ranks, self.into = left << 32 | right, np.append(rank, -1), np.append(into, -1)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and results of pairs; rank -1 where nothing merges."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[self.keys[at] != keys] = len(self.keys) - 1
        return self.ranks[at], self.into[at]


def merged(flat: np.ndarray, sizes: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The symbols left of many pre-tokens and how many each has. All trees of one depth are worked on at once."""
    starts = np.cumsum(sizes) - sizes
    kept = np.ones(len(flat), bool)
    flat = flat.astype(np.int64)
    depth = np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(int)
    for d in np.unique(depth[sizes > 1]):
        every, d = np.flatnonzero((sizes > 1) & (depth == d)), int(d)
        each = max(1, TREE_CELLS >> (d + 1))
        for some in (every[k: k + each] for k in range(0, len(every), each)):
            _merge(flat, kept, starts[some], sizes[some], 1 << d, merges)
    ends = np.concatenate([[0], np.cumsum(kept)])
    left = ends[starts + sizes] - ends[starts]
    return flat[kept].astype(np.int32), left


def _merge(flat, kept, starts, sizes, leaves, merges):
    """Merge pre-tokens whose trees have so many leaves; leaf i is the pair that begins at symbol i.
    ``flat`` and ``kept`` are changed in place."""
    n, wide = len(starts), 2 * leaves + 1  # the last cell is a leaf that no pair has
    tree = np.full(n * wide, NONE)
    row = np.repeat(np.arange(n), sizes - 1)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1)
    at = starts[row] + place
    rank, into = merges.find(flat[at], flat[at + 1])
    tree[row * wide + leaves + place] = np.where(rank < 0, NONE, rank * wide + place)
    becomes = np.full(n * wide, -1)
    becomes[row * wide + place] = into
    for level in range(leaves.bit_length() - 2, -1, -1):
        nodes = (np.arange(n) * wide)[:, None] + np.arange(1 << level, 2 << level)
        inside = nodes - (np.arange(n) * wide)[:, None]
        tree[nodes] = np.minimum(tree[nodes + inside], tree[nodes + inside + 1])
    after = np.tile(np.arange(1, wide + 1), n)
    before = np.tile(np.arange(-1, wide - 1), n)
    live = np.arange(n)
    while True:
        best = tree[live * wide + 1]
        live, best = live[best != NONE], best[best != NONE]
        if not len(live):
            return
        base, first, size = live * wide, starts[live], sizes[live]
        at = best % wide
        gone, left = after[base + at], before[base + at]
        right = after[base + gone]
        flat[first + at] = becomes[base + at]
        kept[first + gone] = False
        after[base + at] = right
        there, begun = right < size, left >= 0
        before[base[there] + right[there]] = at[there]
        tree[base + np.minimum(leaves + gone, 2 * leaves)] = NONE
        tree[base + leaves + at] = NONE
        for own, a, b in ((there, at, right), (begun, left, at)):
            rank, into = merges.find(flat[first[own] + a[own]], flat[first[own] + b[own]])
            tree[base[own] + leaves + a[own]] = np.where(rank < 0, NONE, rank * wide + a[own])
            becomes[base[own] + a[own]] = into
        nodes = np.stack([at, np.minimum(gone, leaves - 1), np.where(begun, left, at)]) + leaves
        for _ in range(leaves.bit_length() - 1):
            nodes >>= 1
            tree[base + nodes] = np.minimum(tree[base + 2 * nodes], tree[base + 2 * nodes + 1])


def spaceless(said: dict) -> bool:
    """Whether a tokenizer file lower-cases and cuts texts in the one way of which it is known that no pre-token holds white space."""
    steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return ([n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])] == SPACELESS_NORMALIZERS
            and steps[0].get("pattern", {}).get("Regex") == SPACELESS and steps[0]["behavior"] == "Removed" and steps[0]["invert"])


class Codec:
    """Encoding and decoding by a tokenizer file. Ids are kept as packed 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE files are handled")
        if any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special strings must be plain ones")
        decoder = said.get("decoder")
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError("the decoder must be byte level or none")
        own, self.vocab, self.end = Tokenizer.from_file(path), model["vocab"], model.get("end_of_word_suffix") or ""
        self.normalize = own.normalizer.normalize_str if own.normalizer else str
        self.cut = own.pre_tokenizer.pre_tokenize_str
        pairs = (pair if isinstance(pair, list) else pair.split(" ", 1) for pair in model["merges"])
        self.merges = Merges([(self.vocab[a], self.vocab[b], rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)])
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.spaceless = spaceless(said)
        self.words, self.pieces = Kept(), Kept()
        self.load_signs()
        self.load_pieces(self.vocab | self.special, bool(decoder))

    def load_pieces(self, ids: dict[str, int], by_bytes: bool):
        """What each id decodes to."""
        self.by_bytes = by_bytes
        named: list[str | None] = [None] * (max(ids.values()) + 1)
        for piece, i in ids.items():
            named[i] = piece
        if by_bytes:
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
            rest = [b for b in range(256) if b not in plain]
            of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
            raw = [None if p is None else bytes(of[c] for c in p) if all(c in of for c in p) else p.encode() for p in named]
            self.texts = pa.array(raw, pa.binary())
        else:
            self.texts = pa.array(named, pa.string())

    def load_signs(self):
        """The symbol of every sign, inside a pre-token and at its end; -1 where there is none."""
        inner = {ord(p): i for p, i in self.vocab.items() if len(p) == 1}
        last = {ord(p[0]): i for p, i in self.vocab.items() if len(p) == 1 + len(self.end) and p.endswith(self.end)}
        top = max([*inner, *last], default=0) + 2
        self.inner, self.last = np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        for table_of, found in ((self.inner, inner), (self.last, last)):
            table_of[list(found)] = list(found.values())

    def encode_pre_tokens(self, pre_tokens: set[str]) -> list[str]:
        """Put the ids of pre-tokens into the cache; the new ones."""
        new = list(self.pieces.missing(pre_tokens))
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        signs = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = np.minimum(signs, len(self.inner) - 1)
        first, ends = self.inner[signs], np.cumsum(lengths)
        first[ends[lengths > 0] - 1] = self.last[signs[ends[lengths > 0] - 1]]
        known = np.concatenate([[0], np.cumsum(first >= 0)])
        sizes = known[ends] - known[ends - lengths]
        flat, left = merged(first[first >= 0], sizes, self.merges)
        raw, cuts = flat.tobytes(), (np.concatenate([[0], np.cumsum(left)]) * 4).tolist()
        for word, a, b in zip(new, cuts, cuts[1:]):
            self.pieces[word] = raw[a:b]
        return new

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        return [p for p, _ in self.cut(self.normalize(text))]

    def parts(self, text: str) -> list[str | int]:
        """Pre-tokens of a text, and ids of special strings in it."""
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += self.plain(text[at: found.start()]) if found.start() > at else []
            out.append(self.special[found[0]])
            at = found.end()
        return out + self.plain(text[at:]) if at < len(text) else out

    def many(self, words: list[str]) -> list[list[str]]:
        """Pre-tokens of words without special strings and white space, cut in one go, joined by spaces."""
        normal = self.normalize(" ".join(words)).split(" ")
        if len(normal) != len(words):
            return [self.plain(w) for w in words]
        out, at, end = [[] for _ in words], -1, -1
        for piece, (start, _) in self.cut(" ".join(normal)):
            while start >= end:
                at += 1
                end += len(normal[at]) + 1
            out[at].append(piece)
        return out

    def encode_words(self, words: set[str]) -> list[str]:
        """Put the ids of words into the cache; the new ones."""
        parts: dict[str, list[str | int]] = {}
        joined = []
        for word in self.words.missing(words):
            if word.isascii() and word.isalpha():
                parts[word] = [word.lower()]
            elif len(word.split()) == 1 and not self.specials.search(word):
                joined.append(word)
            else:
                parts[word] = self.parts(word)
        for at in range(0, len(joined), WORDS_AT_ONCE):
            some = joined[at: at + WORDS_AT_ONCE]
            parts.update(zip(some, self.many(some)))
        new = self.encode_pre_tokens({p for part in parts.values() for p in part if isinstance(p, str)})
        for word, part in parts.items():
            self.words[word] = self.packed(part)
        self.pieces.without_long(new)
        return list(parts)

    def packed(self, parts: list[str | int]) -> bytes:
        return b"".join([self.pieces[p] if isinstance(p, str) else np.int32(p).tobytes() for p in parts])

    def encode_texts(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed ids of texts."""
        if self.spaceless:
            found = [None if t is None else WORD.findall(t) for t in texts]
            new = self.encode_words(set().union(*(f for f in found if f)))
            out = [None if f is None else b"".join(map(self.words.__getitem__, f)) for f in found]
            self.words.without_long(new)
            return out
        parts = [None if t is None else self.parts(t) for t in texts]
        new = self.encode_pre_tokens({p for part in parts if part for p in part if isinstance(p, str)})
        out = [None if p is None else self.packed(p) for p in parts]
        self.pieces.without_long(new)
        return out

    def encode_column(self, texts) -> pa.ListArray:
        """Ids of a column of texts."""
        packed = self.encode_texts(texts.to_pylist())
        ends = np.cumsum([0] + [len(p) // 4 if p else 0 for p in packed])
        starts = pa.array(ends.astype(np.int32), mask=np.array([p is None for p in packed] + [False]))
        return pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(p for p in packed if p), np.int32)))

    def decode_column(self, lists) -> pa.StringArray:
        """Texts of a column of ids."""
        ids = lists.flatten()
        known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(self.texts)))
        pieces = self.texts.take(pc.if_else(known, ids, pa.scalar(None, ids.type)))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        if pieces.null_count:
            there = pieces.is_valid().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(there)])[starts]
            pieces = pieces.drop_null()
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pieces), b"" if self.by_bytes else " ")
        if self.by_bytes:
            try:
                whole = whole.cast(pa.string())
            except pa.ArrowInvalid:
                whole = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())
        return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.string()))


@lru_cache(2)
def loaded(path: str) -> Codec:
    """The codec of a file, kept for the later tasks of a Python worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Documents with their ids by the tokenizer file at ``path`` (present on all machines), and, where
    ``decoded`` names a column, what the ids decode to."""
    fields = [T.StructField(name, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def make(texts):
        codec = loaded(path)
        ids = codec.encode_column(texts)
        return [ids, codec.decode_column(ids)] if decoded else [ids]

    return added(docs, fields, text, make)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """Rows with the text of their ids."""
    return added(tokens, [T.StructField(name, T.StringType())], ids, lambda lists: [loaded(path).decode_column(lists)])


def op12_bpe(spark, sf_dir):
    """Every document encoded and decoded again: number of ids, digest of the ids, digest of the decoded text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded")
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

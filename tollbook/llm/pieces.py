"""SentencePiece encoding and decoding by one pass of an automaton over each text.

An Aho-Corasick automaton holds the pieces. At every position its output links name all
pieces that end there; each is tried on top of the best segmentation that ends where the
piece begins, and the best is kept, as in a Viterbi pass. What "best" means is the model's:

* ``merges`` (the installed model is of this kind): the segmentation that merging by score
  would give. Exactly one piece can be its last one at each position: the piece that is
  compatible with the last piece before it, that is, merging the two pieces' characters
  gives the two again. Adding up scores instead would not give the library's ids.
* ``scores``: the highest sum of scores.

No piece holds the space mark after another character, so the distinct words of a batch are encoded
once and kept in a bounded cache; a word is first cut wherever no piece holds both neighbours, so that
a stem is known whatever punctuation follows it. Characters that no piece holds become byte pieces.
Decoding takes the pieces of all ids of a batch and joins them, without a step per id.

Results by case: a null text has null ids and decodes to null; an empty text has no ids;
byte pieces that are no UTF-8 decode to the replacement character; repeated rows are
encoded row by row; an empty table gives no rows; input columns named like the result
column are replaced, the rest are kept."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollbook.llm.common import SLICE_BYTES, Kept, added, released, table

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
RUN = re.compile(" +[^ ]*")
UNKNOWN = " ⁇ ".encode()
CACHED_WORDS, CACHED_PAIRS = 40_000, 150_000  # of words and of stems; of what is known of pairs of pieces


class Pieces:
    """The pieces of a model file, encoding and decoding."""

    def __init__(self, path: str, rule: str = "merges"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in every if model.is_byte(i)}
        self.silent = {i for i in every if model.is_control(i)}
        self.load([(model.id_to_piece(i), i, model.get_score(i)) for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))], model.unk_id(), rule)

    @classmethod
    def of(cls, pieces, rule="merges", unknown=0):
        """Pieces given as (text, id, score)."""
        own = cls.__new__(cls)
        own.byte_ids, own.silent = {}, set()
        own.load(pieces, unknown, rule)
        return own

    def load(self, pieces, unknown, rule):
        if any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
            raise ValueError("a piece holds the space mark after another character")
        self.rule, self.unknown = rule, unknown
        self.ids = {p: i for p, i, _ in pieces}
        self.scores = {p: s for p, _, s in pieces}
        self.worst = min(self.scores.values(), default=0.0) - 10
        self.text = {i: p for p, i, _ in pieces}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        self.neighbours = np.array(sorted({ord(a) << 21 | ord(b) for p in self.ids for a, b in zip(p, p[1:])}) or [-1], np.int64)
        self.pairs, self.known, self.words, self.stems = {}, 0, Kept(CACHED_WORDS), Kept(CACHED_WORDS)
        spoken = {i: p.replace(MARK, " ").encode() for i, p in self.text.items()} | {i: bytes([b]) for i, b in self.bytes.items()} | dict.fromkeys(self.silent, b"")
        top = max(spoken, default=-1) + 1
        texts = [spoken.get(i, UNKNOWN) for i in range(top + 1)]  # the last one is that of all other ids
        self.texts, self.spoken = pa.array(texts + [t.removeprefix(b" ") for t in texts], pa.binary()), np.array([t != b"" for t in texts])

    def merged(self, text: str) -> list[str]:
        """Merging by score, leftmost first: for short texts."""
        parts, scores = list(text), self.scores
        found = [scores.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = at = None
            for i, score in enumerate(found):
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at is None:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = scores.get(parts[at - 1] + parts[at])
            if at < len(found):
                found[at] = scores.get(parts[at] + parts[at + 1])

    def row(self, before: str | None) -> dict[str, bool]:
        """What is known of the pieces that may follow a piece (or begin a stretch)."""
        if (row := self.pairs.get(before)) is None:
            if self.known > CACHED_PAIRS:
                self.pairs, self.known = {}, 0
            row = self.pairs[before] = {}
        return row

    def fits(self, before: str | None, piece: str) -> bool:
        """Whether merging leaves the two pieces (or the one, at a start) as they are."""
        if before is None or before not in self.ids:
            return self.merged(piece) == [piece]
        return self.merged(before + piece) == [before, piece]

    def split(self, word: str) -> list[str]:
        """Best pieces of a word; characters that no piece holds stand alone."""
        size = len(word)
        last: list[str | None] = [None] * (size + 1)
        if self.rule == "merges":
            rows: list[dict | None] = [self.row(None), *last[1:]]
            known = self.pairs.get
            for at, (n, piece) in self.automaton.iter(word):  # of pieces with one end, longer ones come first
                at += 1
                if rows[at] is None:
                    start = at - n
                    if (row := rows[start]) is None:
                        before = last[start] = word[start - 1]  # no piece ends there
                        row = rows[start] = self.row(before)
                    if (good := row.get(piece)) is None:
                        good = row[piece] = self.fits(last[start], piece)
                        self.known += 1
                    if good:
                        last[at] = piece
                        if (row := known(piece)) is None:
                            row = self.row(piece)
                        rows[at] = row
        else:
            best: list[float | None] = [0.0] + [None] * size
            ends: list[list[str]] = [[] for _ in range(size)]
            for at, (_, piece) in self.automaton.iter(word):
                ends[at].append(piece)
            for end in range(1, size + 1):
                alone = [] if word[end - 1] in self.ids else [word[end - 1]]
                for piece in ends[end - 1] + alone:
                    score = best[end - len(piece)] + self.scores.get(piece, self.worst)
                    if best[end] is None or score > best[end]:
                        best[end], last[end] = score, piece
        out = []
        while size:
            piece = last[size] or word[size - 1]
            out.append(piece)
            size -= len(piece)
        return out[::-1]

    def stem_ids(self, stem: str) -> list[int]:
        """Ids of a stretch that pieces may span."""
        pieces, ids = self.split(stem), self.ids
        try:
            return [ids[piece] for piece in pieces]
        except KeyError:  # some characters are in no piece
            pass
        out: list[int] = []
        for piece in pieces:
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return out

    def stretches(self, words: list[str]) -> list[list[str]]:
        """Each word cut wherever no piece holds both neighbours."""
        whole, lengths = "".join(words), np.fromiter(map(len, words), np.int64, len(words))
        if not whole:
            return [[] for _ in words]
        signs = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = signs[:-1] << 21 | signs[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pairs), len(self.neighbours) - 1)
        begins = np.append(True, self.neighbours[at] != pairs)
        starts = np.cumsum(lengths) - lengths
        begins[starts[lengths > 0]] = True
        cuts = np.append(np.flatnonzero(begins), len(whole)).tolist()
        stems = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        ends = np.searchsorted(cuts, np.append(starts, len(whole))).tolist()
        return [stems[a:b] for a, b in zip(ends, ends[1:])]

    def encode_words(self, words: set[str]) -> list[str]:
        """Put the packed ids of words into the cache; the new ones."""
        new = list(self.words.missing(words))
        stretches = self.stretches([w.replace(" ", MARK) for w in new])
        stems = self.stems.missing(set().union(*stretches))
        for stem in stems:
            self.stems[stem] = array("i", self.stem_ids(stem)).tobytes()
        for word, own in zip(new, stretches):
            self.words[word] = self.stems[own[0]] if len(own) == 1 else b"".join([self.stems[s] for s in own])
        self.stems.without_long(stems)
        return new

    def encode_texts(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed ids of texts: a space is put before each, spaces are marks."""
        found = [t and (RUN.findall(" " + t) if MARK not in t else WORD.findall(MARK + t.replace(" ", MARK))) for t in texts]
        new = self.encode_words(set().union(*(f for f in found if f)))
        out = [None if t is None else b"".join(map(self.words.__getitem__, f or ())) for t, f in zip(texts, found)]
        self.words.without_long(new)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return np.frombuffer(self.encode_texts([text])[0], np.int32).tolist()

    def decode_column(self, lists) -> pa.StringArray:
        """Texts of a column of ids, without the space put before them."""
        ids, last = lists.flatten(), len(self.texts) // 2 - 1
        known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, last))
        ids = pc.fill_null(pc.if_else(known, ids, last), last).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.append(0, np.cumsum(sizes))
        spoken = np.append(0, np.cumsum(self.spoken[ids]))
        first = np.searchsorted(spoken, spoken[ends[:-1]], "right") - 1  # the first of a list's ids that says something
        ids[first[first < ends[1:]]] += last + 1
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), self.texts.take(pa.array(ids))), b"")
        try:
            whole = whole.cast(pa.string())
        except pa.ArrowInvalid:
            whole = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())
        return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.string()))

    def decode(self, ids) -> str:
        """The text of ids."""
        return self.decode_column(pa.array([list(ids)], pa.list_(pa.int32())))[0].as_py()


@lru_cache(2)
def loaded(path: str, rule: str) -> Pieces:
    """The pieces of a file, kept for the later tasks of a Python worker."""
    pieces = Pieces(path, rule)
    released()  # what the model's own library took
    return pieces


def _encoded(column, pieces: Pieces) -> pa.ListArray:
    """Ids of a column of texts."""
    packed = pieces.encode_texts(column.to_pylist())
    ends = np.cumsum([0] + [len(p) // 4 if p else 0 for p in packed]).astype(np.int32)
    starts = pa.array(ends, mask=np.array([p is None for p in packed] + [False]))
    return pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(p for p in packed if p), np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "token_ids", rule: str = "merges", decoded: str | None = None,
           slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Documents with their ids by the model file at ``path`` (present on all machines), and, where ``decoded``
    names a column, the text that the ids decode to, in the same pass. A worker holds the words of ``slice_bytes`` of
    texts, or of one text."""
    fields = [T.StructField(name, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def make(texts):
        pieces = loaded(path, rule)
        ids = _encoded(texts, pieces)
        return [ids, pieces.decode_column(ids)] if decoded else [ids]

    return added(docs, fields, text, make, slice_bytes)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", name: str = "decoded", rule: str = "merges") -> DataFrame:
    """Rows with the text of their ids."""
    return added(tokens, [T.StructField(name, T.StringType())], ids, lambda lists: [loaded(path, rule).decode_column(lists)])


def op6_sentencepiece(spark, sf_dir):
    """Every document encoded and decoded again: id count and hash, length and checksum of the decoded text, and whether it is the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, path, decoded="decoded")
    return out.select("doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("token_ids").alias("ids_hash"),
                      F.length("decoded").cast("long").alias("decoded_chars"), F.crc32("decoded").alias("decoded_crc32"), F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))
